"""Binary files in the shared folder, whatever store it is in; the folder's name comes with its scheme (``session.shared_dir``)."""

from __future__ import annotations

from pyarrow import fs

#: Spark's names of stores that are called otherwise here.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    for spark_name, name in _SCHEMES.items():
        uri = uri.replace(f"{spark_name}://", f"{name}://", 1) if uri.startswith(f"{spark_name}://") else uri
    return fs.FileSystem.from_uri(uri)


def writer(uri: str):
    """An output stream; its folder is made where it is missing."""
    store, path = _at(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path)


def reader(uri: str):
    """A file opened for reading at any place."""
    store, path = _at(uri)
    return store.open_input_file(path)
