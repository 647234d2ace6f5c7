"""Queries on documents as tokens: p8 and p9."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.llm.bpe import encode_corpus
from lexloom.llm.packing import pack
from lexloom.session import materialize


def _docs(spark, d, *cols):
    return spark.read.parquet(f"{d}/documents.parquet").select(*cols)


def p8_ids(spark, d):
    """Token ids of every document."""
    return encode_corpus(_docs(spark, d, "doc_id", "text"), "doc_id", "text")


def p9_containers(spark, d):
    """Which part of which document lies in which container of 2,048 tokens."""
    sizes = materialize(encode_corpus(_docs(spark, d, "doc_id", "text"), "doc_id", "text", only_sizes=True), "p9-sizes")
    return pack(sizes, "doc_id", "n_tokens", 2048).withColumnRenamed("size", "n_tokens")


def p9_fill(spark, d):
    """How full the containers are, by each way of packing."""
    sizes = materialize(encode_corpus(_docs(spark, d, "doc_id", "text"), "doc_id", "text", only_sizes=True), "p9-sizes")
    out = None
    for m in ("harmonic", "pattern"):
        a = pack(sizes, "doc_id", "n_tokens", 2048, m).agg(F.countDistinct("container").alias("containers"), F.sum("size").alias("tokens"))
        a = a.select(F.lit(m).alias("method"), "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * 2048), 4).alias("fill"))
        out = a if out is None else out.unionByName(a)
    return out


QUERIES = {"p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fill": p9_fill}
ORACLE: dict[str, str] = {}
