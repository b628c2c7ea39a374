"""Helpers shared by the operators: column names, components, and the library's staging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stage import shared_dir, spread_join, staged  # noqa: F401


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def clean_text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): (node, component), component being the smallest node.

    Alternating large-star and small-star steps over a staged edge table; each step is two aggregations with map-side
    combine and two joins in which the neighbours of a hub aren't one task's. Each of the four is staged: plans that read one
    another's would be planned and shuffled anew for each use, and the driver holds and prints them all. Steps end when no node
    has both a smaller neighbour and another one: all edges are those of stars by then. Nodes without an edge aren't
    returned; self-loops, repeated edges and nulls are ignored. No edges give no row."""
    a, b = F.col("a"), F.col("b")
    e = staged(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    lowest = F.min("v").alias("m"), F.count(F.lit(1)).alias("n")
    while True:
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        around = staged(both.groupBy("u").agg(*lowest), "neighbours")
        ends, open_ = around.agg(F.sum("n"), F.count_if((F.col("n") > 1) & (F.col("m") < F.col("u")))).first()
        if not open_:
            break
        around = around.select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both, around, "u", "n", ends).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.distinct(), "large-star")
        below = staged(large.groupBy("u").agg(*lowest), "neighbours")
        small = spread_join(large, below, "u", "n", ends // 2)
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        e = staged(small.filter("x.v <> x.m").select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).distinct(), "edges")
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
