"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brooklet.llm import op1_sentencepiece, op2_quality, op3_urls, op4_sstable, op5_jaccard, op6_embeddings, op7_decontaminate, op8_toxicity, op9_html, op10_token_counts, op11_clusters, op12_codes, op13_bpe
from brooklet.session import ship


#: Rows and bytes that Spark hands to a Python worker at once: texts may be long, so batches are small.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def prepare(spark: SparkSession) -> None:
    """Makes the package known to the workers and bounds what they are handed at once."""
    ship(spark)
    for k, v in ARROW.items():
        spark.conf.set(k, v)


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_sentencepiece": op1_sentencepiece.query,
        "op2_quality_classifier": op2_quality.query,
        "op3_url_filter": op3_urls.query,
        "op4_token_id_shards": op4_sstable.query,
        "op5_ngram_jaccard_join": op5_jaccard.query,
        "op6_embedding_near_dedup": op6_embeddings.query,
        "op7_decontaminate": op7_decontaminate.query,
        "op8_toxicity": op8_toxicity.query,
        "op9_html_extraction": op9_html.query,
        "op10_token_counts": op10_token_counts.query,
        "op11_centroid_clustering": op11_clusters.query,
        "op12_vector_codes": op12_codes.query,
        "op13_bpe": op13_bpe.query,
    }
    return {k: _shipped(f) for k, f in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_ngram_jaccard_join": op5_jaccard.SQL,
        "op6_embedding_near_dedup": op6_embeddings.SQL,
        "op7_decontaminate": op7_decontaminate.SQL,
        "op11_centroid_clustering": op11_clusters.sql(),
        "op12_vector_codes": op12_codes.sql(),
    }
