"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries name the digests that may hold many rows; these are counted exactly and their winners
broadcast, so their copies go on the map side. All other digests meet in an ordinary shuffle, in groups that
the summary's guarantee bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import clean_text, fresh, staged

#: Counters of a summary; also the most digests that are ever broadcast.
COUNTERS = 1024


def digest(text: str | Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes, as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(clean_text(text).cast("binary"), 256))


def _summary(counters: int):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held, total = {}, 0
        for batch in batches:
            total += batch.num_rows
            found = pc.value_counts(batch.column(0))
            for key, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                held[key] = held.get(key, 0) + n
            if len(held) > counters:
                least = sorted(held.values(), reverse=True)[counters]
                held = {k: n - least for k, n in held.items() if n > least}
        keys, sums = [None, *held], [total, *held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sums, pa.int64())], ["digest", "least"])

    return run


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest) of column digest that may hold over 1/counters of all rows: every digest with over 2/counters of
    them is among these, and there are fewer than counters, whatever the input. A summary a partition; their
    counts add up."""
    sums = digests.select("digest").mapInArrow(_summary(counters), "digest binary, least long")
    sums = staged(sums.groupBy("digest").agg(F.sum("least").alias("least")), "misra-gries")
    total = sums.filter("digest is null").agg(F.sum("least")).first()[0] or 0
    return sums.filter(F.col("digest").isNotNull() & (F.col("least") > max(1.0, total / counters))).select("digest")


def resolve(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """rows: (doc_id, digest), read several times. One row for each: doc_id, digest, keep_id, group_size, kept.

    Of equal digests the row with the largest doc_id stays (a null doc_id is smaller than any); of repeated
    rows with that doc_id exactly one is kept. An empty table gives an empty result.
    """
    rows = staged(rows.select("doc_id", "digest", F.monotonically_increasing_id().alias("row")), "digests")
    hot = F.broadcast(frequent(rows, counters))
    last, none = F.max(F.struct("doc_id", "row")), F.count(F.lit(1))
    winners = rows.join(hot, "digest").groupBy("digest").agg(last.alias("last"), none.alias("group_size"))
    winners = F.broadcast(staged(winners, "winners"))
    same = Window.partitionBy("digest")
    rest = rows.join(winners, "digest", "left_anti").select("*", last.over(same).alias("last"), none.over(same).alias("group_size"))
    rest = rest.select("digest", "doc_id", "row", "last", "group_size")
    out = rows.join(winners, "digest").select("digest", "doc_id", "row", "last", "group_size").unionByName(rest)
    return out.select("doc_id", "digest", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"))


def dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """docs without all but one row of each text; its columns unchanged, whatever their names.

    The row with the largest id stays (any one of rows that also share it). Null text counts as empty.
    Copies of frequent texts are dropped before the shuffle; the rest shuffle once, each partition
    sending at most one row of a text.
    """
    key, last, place = fresh(docs, "digest", "keep_id", "place")
    digests = staged(docs.select(F.col(id_col).alias("doc_id"), digest(text).alias("digest")), "digests")
    hot = F.broadcast(frequent(digests, counters))
    winners = digests.join(hot, "digest").groupBy("digest").agg(F.max("doc_id").alias(last)).withColumnRenamed("digest", key)
    rows = docs.withColumn(key, digest(text)).join(F.broadcast(staged(winners.withColumn(place, F.lit(1)), "winners")), key, "left")
    rows = rows.filter(F.col(place).isNull() | F.col(id_col).eqNullSafe(F.col(last)))
    order = Window.partitionBy(key).orderBy(F.col(id_col).desc_nulls_last())
    return rows.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
