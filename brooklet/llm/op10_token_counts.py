"""Operator 10: token counts of the sections of a text, from one encoding of the whole text.

Every document is encoded once. The vocabulary is byte-level, so the running total of the byte lengths of its tokens gives
each token's span in the text; spans are turned into characters (a token that holds part of a character covers it). The
token spans are then interval-joined to the section spans by bisection over both sorted lists. Sections are lines, each
with its line feed, and cover the text without gaps.

Rule for a token that crosses a boundary: ``first`` gives it to the section of its first character; ``most`` gives it to
the section that holds most of its characters, the earlier one of equals. Either way the counts of a document's sections
add up to the number of its tokens.

Nulls and odd rows: a null or empty text has one section, 0 to 0, without tokens; a repeated row gives its sections again;
a null doc_id stays null; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.llm._bpe import encoder
from brooklet.llm._text import batches
from brooklet.session import table

SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])


def attribute(first: np.ndarray, last: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token [first, last) and whether the token crosses a boundary; ``sections`` are sorted starts."""
    here = np.searchsorted(sections, first, "right") - 1
    there = np.searchsorted(sections, np.maximum(last - 1, first), "right") - 1
    crossing = there > here
    if rule == "most" and crossing.any():
        for i in np.flatnonzero(crossing):
            edges = np.concatenate([[first[i]], sections[here[i] + 1 : there[i] + 1], [last[i]]])
            here[i] += int(np.argmax(np.diff(edges)))
    elif rule not in ("first", "most"):
        raise ValueError(f"no such rule: {rule}")
    return here, crossing


def token_counts(docs: DataFrame, tokenizer: str, rule: str = "first") -> DataFrame:
    """One row for each section of each document: span in characters, tokens, and those that cross its end."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        size = np.array([len(bpe.tokenizer.id_to_token(i) or "") for i in range(bpe.tokenizer.get_vocab_size())], dtype=np.int64)
        for batch in rows:
            keys = batch.column(0)
            for a, _, data, off in batches(batch.column(1)):
                ids, counts = bpe.encode(data, off)
                n, texts = len(data), len(off) - 1
                chars = np.zeros(n + 1, dtype=np.int64)  # characters that begin before each byte
                np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
                stops = np.cumsum(size[ids])
                first, last = chars[np.minimum(stops - size[ids] + 1, n)] - 1, chars[stops]
                opens = np.zeros(n + 1, dtype=bool)
                opens[1:] = data == 10
                opens[off[1:]] = False
                opens[off[:-1][off[:-1] < off[1:]]] = True
                starts = np.flatnonzero(opens)
                section, crossing = attribute(first, last, chars[starts], rule)
                n_tokens = np.bincount(section, minlength=len(starts))
                n_crossing = np.bincount(section[crossing], minlength=len(starts))
                owner = np.searchsorted(off, starts, "right") - 1
                ends = np.append(starts[1:], n)
                empty = np.setdiff1d(np.arange(texts), owner)
                doc = np.concatenate([owner, empty])
                base = chars[off[:-1]]
                number = np.arange(len(starts)) - np.searchsorted(owner, owner, "left")
                pad = np.zeros(len(empty), dtype=np.int64)
                columns = [number, chars[starts] - base[owner], chars[ends] - base[owner], n_tokens, n_crossing]
                yield pa.record_batch([keys.take(pa.array(doc + a)), *(pa.array(np.concatenate([c, pad]), t) for c, t in zip(columns, _SCHEMA.types[1:], strict=True))], schema=_SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
