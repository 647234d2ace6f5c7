"""Reading the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events embeddings corpus_law corpus_version provisions "
    "ref_row label_row trace_target doc_rank ocr_result documents fetched_page body_file corpus_run"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of `sf_dir`: a parquet file or a directory of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
