"""Corpus pipeline: toxic and poor texts go, one text of each near-duplicate group stays, benchmark leaks go, the rest is encoded.

Stages, each on all that the one before kept:

1. toxicity: texts with a noisy-or score of at least 0.3 go;
2. quality: texts with a score below 0.7 go;
3. near duplicates: of texts linked by a word 5-gram Jaccard index of at least 0.8, directly or through others, the one with
   the smallest doc_id stays;
4. decontamination: texts of which at least a twentieth of the words lies in benchmark windows go;
5. encoding: SentencePiece ids of each text, and whether decoding gives the text back.

Null ids and texts, empty tables and extra columns are dealt with as the operators say; columns pass through unchanged up
to stage 4. Rows of equal text meet one fate in stages 1, 2 and 4; of rows with equal text or linked texts stage 3 keeps the one with
the smallest id (an id comes before none), a repeated row once; texts without words link with nothing and all pass stage 3. Texts of any
length are read whole in every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brooklet.llm import op1_sentencepiece, op2_quality, op5_jaccard, op7_decontaminate, op8_toxicity
from brooklet.llm.registry import prepare
from brooklet.session import shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: No SQL: trained models and a tokenizer decide.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return op8_toxicity.keep_clean(docs, op8_toxicity.train(docs, table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return op2_quality.keep_good(docs, op2_quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return op5_jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return op7_decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    prepare(spark)
    return op1_sentencepiece.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded rest of ``documents``; what each stage keeps is written to the shared folder and read again."""
    folder, docs = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
