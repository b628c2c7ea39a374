"""From raw documents to packed training sequences: five stages, each calling one operator.

Each stage reads what its predecessor wrote. Language ID drops documents whose language can't be told, exact
and SimHash dedup keep one document of each group, mixing repeats and orders documents, packing returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayscribe.llm import exact_dedup, langid, mixing, packing, simhash
from dayscribe.llm.common import staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null and empty texts and those without a letter. Repeated rows share their fate."""
    return langid.identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, the one with the largest id; null text counts as empty, a null id is smaller than any."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, one with the smallest id; rows are decided each on its own, whatever ids they share."""
    return simhash.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's target needs them, in order of training position; a null source is a source of its own."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 1024 tokens: columns as op10's. Repeated rows are documents of their own; no rows give none."""
    # Executors still hold what earlier stages used: fewer words are remembered, for less memory and some more CPU.
    rows = packing.pack(docs, remembered=600_000)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mix), ("packing", pack)]
#: No SQL: suffix automata, SimHash components and best-fit packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents. An empty table gives no piece; extra columns are carried up to packing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
