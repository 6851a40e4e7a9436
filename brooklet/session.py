"""Session helpers shared by the whole library."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read lazily by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent (local tests) a folder of our own is made.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if where:  # without a scheme it is a folder of the default file system, for all that use it
        path = sc._jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="brooklet-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not have it on their path."""
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_brooklet_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="brooklet-")) / "brooklet.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((ROOT / "brooklet").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(archive))
    sc._brooklet_shipped = True
