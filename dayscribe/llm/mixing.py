"""Mixing of sources to target weights by a time-varying curriculum, with DataFrame functions only.

A source's weight over training time t in [0, 1] runs linearly from start to end times its own weight; its
cumulative token demand is its target times the integral. A document's place in its source's token stream
(cumulative tokens, in hash order) is turned into a training position by inverting that demand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.corpus import cumulated
from .common import clean_text, fresh, staged

#: Hash order is cut into buckets of about this many rows, a power of two of them; cumulated sizes are exact within and across them.
BUCKET = 1 << 10
#: The plan, a row a source and bucket, is broadcast up to this many rows (about 20 MB), and joined by shuffle beyond.
BROADCAST_ROWS = 200_000
#: Sources that are ranked in one task.
RANKED = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.size(F.regexp_extract_all(clean_text(text), F.lit(WORD), F.lit(0))).cast("long")


def _key(source: Column) -> list[Column]:
    """A source as two columns without nulls, in code-point order with null last."""
    return [source.isNull().alias("none"), F.coalesce(source.cast("string"), F.lit("")).alias("source")]


def targets(sizes: DataFrame, weights=(5, 2, 1), repeats: float = 3.0) -> DataFrame:
    """sizes: (none, source, source_size), a row a source. Adds rank, weight and target.

    Targets are min(repeats * size, level * weight). The excess of sources that a level would take beyond repeats times their
    size is reshared by weight among the others, which gives a higher level, until none is above: each round is
    three sums over all sources. Ranks are counted in one task up to RANKED sources, and by ranges of them beyond.
    """
    sizes = staged(sizes, "sources")
    if sizes.count() <= RANKED:
        ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("none", "source")) - 1)
    else:
        ranked = cumulated(sizes.withColumn("at", F.struct("none", "source")), "at").withColumnRenamed("_before", "rank").drop("at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = staged(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(repeats)), "ranks")
    level, before = 0.0, -1
    while True:
        full = F.col("most") < F.lit(level) * F.col("weight") if before >= 0 else F.lit(False)
        taken = ranked.agg(F.sum("source_size"), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if taken[3] == before or not taken[2]:
            break
        level, before = ((taken[0] or 0) - float(repeats) * (taken[1] or 0)) / taken[2], taken[3]
    target = F.least(F.col("most"), F.lit(level) * F.col("weight"))
    return ranked.select("none", "source", "source_size", "rank", "weight", target.alias("target"))


def _bucket(bits: int) -> Column:
    return (F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")).alias("bucket")


def plan(narrow: DataFrame, weights=(5, 2, 1), repeats: float = 3.0, schedule=((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))) -> tuple[DataFrame, int]:
    """narrow: (none, source, h, size), staged. A row a source and bucket: source_size, target, whole passes, what is
    left for the last pass, tokens before the bucket, and the schedule's start and end; and the bits of a bucket."""
    bits = max(0, (narrow.count() // BUCKET).bit_length())
    cells = staged(narrow.groupBy("none", "source", _bucket(bits)).agg(F.sum("size").alias("tokens")), "buckets")
    sized = cells.groupBy("none", "source").agg(F.sum("tokens").alias("source_size"))
    aimed = targets(sized, weights, repeats)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    passes = F.least(F.floor(ratio + 1e-9), F.lit(int(repeats))).cast("int")
    aimed = aimed.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    # Sums before a bucket: of the runs of buckets before its own, and of the buckets before it in its run.
    high = F.shiftright("bucket", (bits + 1) // 2).alias("high")
    runs = cells.groupBy("none", "source", high).agg(F.sum("tokens").alias("all"))
    runs = runs.withColumn("below", F.sum("all").over(Window.partitionBy("none", "source").orderBy("high")) - F.col("all")).drop("all")
    own = Window.partitionBy("none", "source", "high").orderBy("bucket")
    placed = cells.withColumn("high", high).withColumn("within", F.sum("tokens").over(own) - F.col("tokens")).join(runs, ["none", "source", "high"])
    placed = placed.withColumn("before", F.col("below") + F.col("within")).drop("tokens", "high", "below", "within").join(aimed, ["none", "source"])
    start = F.element_at(F.array(*[F.lit(float(a)) for a, _ in schedule]), (F.col("rank") % len(schedule) + 1).cast("int"))
    end = F.element_at(F.array(*[F.lit(float(b)) for _, b in schedule]), (F.col("rank") % len(schedule) + 1).cast("int"))
    planned = staged(placed.withColumn("start", start).withColumn("end", end).drop("rank", "weight"), "mix")
    return F.broadcast(planned) if planned.count() <= BROADCAST_ROWS else planned, bits


def _narrow(docs: DataFrame, text: str, source: str, id_col: str) -> list[Column]:
    body = clean_text(text)
    return [*_key(F.col(source)), F.xxhash64(F.lit(11), F.col(id_col), body).alias("h"), word_count(text).alias("size")]


def _takes(rows: DataFrame, planned: DataFrame, bits: int) -> DataFrame:
    """rows with none, source, h, size: adds source_size, target, copies, place (tokens before, in a pass) and the schedule.

    A place is the sum of the sizes of all the source's rows with a smaller hash: summed by bucket in the plan, and
    within the bucket by a window over it, whose rows are few whatever the source's size."""
    rows = rows.withColumn("bucket", _bucket(bits))
    within = Window.partitionBy("none", "source", "bucket").orderBy("h").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = rows.join(planned, ["none", "source", "bucket"], "left").withColumn("place", F.col("before") + F.col("within"))
    # In the last pass a document goes in if most of it does.
    more = (F.col("rest") > 0) & (F.col("place") + F.col("size") / 2 <= F.col("rest"))
    return out.withColumn("copies", F.col("passes") + more.cast("int"))


def _position(turn: Column) -> Column:
    """Training time at which the source's cumulative demand reaches the document's place in the given pass."""
    u = F.least(F.lit(1.0), (turn * F.col("source_size") + F.col("place")) / F.col("target"))
    a, b = F.col("start"), F.col("end")
    return F.when(F.abs(b - a) < 1e-12, u).otherwise((F.sqrt(a * a + u * (b * b - a * a)) - a) / (b - a))


def assign(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", **how) -> DataFrame:
    """One row for each row of docs, in order of training position: doc_id, source, size, source_size, target,
    copies, taken (size times copies), position of the first copy (null if none).

    Null text has size 0; null source is a source of its own, ranked last. Equal rows are taken alike. A source
    misses its target by at most half the document at which its last pass ends. An empty table gives none.
    """
    (own,) = fresh(docs, "id")
    rows = staged(docs.select(F.col(id_col).alias(own), *_narrow(docs, text, source, id_col)), "sizes").withColumnRenamed(own, "doc_id")
    out = _takes(rows, *plan(rows.select("none", "source", "h", "size"), **how))
    position = F.when(F.col("copies") > 0, _position(F.lit(0)))
    out = out.select(
        "doc_id", F.when(~F.col("none"), F.col("source")).alias("source"), "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"), position.alias("position"), "h",
    )
    return out.repartitionByRange("position", "h").sortWithinPartitions("position", "h").drop("h")


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", **how) -> DataFrame:
    """docs as the mix trains on them: rows taken repeatedly repeat, rows not taken are left out, and all are
    range-sorted by training position. Columns unchanged, whatever their names. Null text, null sources and equal
    rows are as in assign; a row without words is taken where its place is. An empty table gives none."""
    rows = staged(docs.select(*_narrow(docs, text, source, id_col)), "sizes")
    planned, bits = plan(rows, **how)
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_narrow(docs, text, source, id_col))
    out = _takes(kept, planned, bits).filter("copies > 0")
    out = out.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    out = out.select("row", _position(F.col("turn")).alias("position"), "h")
    return out.repartitionByRange("position", "h").sortWithinPartitions("position", "h").select("row.*")
