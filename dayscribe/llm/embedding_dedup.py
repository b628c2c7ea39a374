"""Embedding near-dedup by PCA-ordered tiled comparison.

Unit vectors are turned into the basis of their principal components, so the leading dimensions carry most of a
product. Vectors of a label are dealt into tiles by their first components; a pair of tiles whose first
components are further apart than the threshold allows is never compared. Within a pair of tiles the leading
dimensions are multiplied first, and a pair stops when what is left, bounded by the product of the suffix norms,
cannot lift its cosine to the threshold. Pairs that get through are decided by the whole vectors. Labels that fit
one tile are one group each, with principal components of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, spread_join, staged

#: Numbers that a tile holds (8 MB); cells with more are dealt into several tiles by hash.
TILE = 1 << 20
LEAD = 16
#: Dimensions that are turned; those of longer vectors beyond stay as they are, so a basis has so many numbers squared at most.
TURNED = 1024
SLACK = 1e-9


def _unit(x):
    """Rows scaled to length 1, by their largest component first: squares of large or tiny ones leave double precision."""
    import numpy as np

    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _matrix(column):
    """Lists of equal length as rows of a matrix of their own."""
    import pyarrow as pa

    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(float, copy=True)


def _components(moments):
    """Principal components, largest first, as columns."""
    import numpy as np

    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1].copy()


def _turned(x, basis):
    """Rows of x in another orthonormal basis: of their first dimensions, as many as basis has."""
    import numpy as np

    k = len(basis)
    return x @ basis if k == x.shape[1] else np.hstack([x[:, :k] @ basis, x[:, k:]])


def _moments(batches):
    import pyarrow as pa

    total = None
    for batch in batches:
        if batch.num_rows:
            x = _unit(_matrix(batch.column(0)))[:, :TURNED]
            total = x.T @ x + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([row.tobytes() for row in total], pa.binary())], ["i", "row"])


def _summed(table):
    import numpy as np
    import pyarrow as pa

    total = np.zeros(1)
    for row in table.column("row"):
        total = total + np.frombuffer(row.as_buffer())
    return pa.table({"i": table.column("i")[:1].combine_chunks(), "row": pa.array([total.tobytes()], pa.binary())})


def principal(vectors: DataFrame, size: int):
    """The principal components of the first TURNED dimensions of unit vectors of the given size, from all vectors. The driver gets
    as many numbers squared, 8 MB at most."""
    import numpy as np

    size = min(size, TURNED)
    sums = vectors.select("embedding").mapInArrow(_moments, "i int, row binary")
    # Sums of partitions meet by row of the matrix, a few dozen at a time.
    some = sums.withColumn("slot", F.spark_partition_id() % 64).groupBy("i", "slot").applyInArrow(_summed, "i int, row binary")
    moments = np.zeros((size, size))
    for r in some.groupBy("i").applyInArrow(_summed, "i int, row binary").collect():
        moments[r.i] = np.frombuffer(r.row)
    return _components(moments)


def _tiles(basis, reach: float, grid: int):
    """Adds the cell of a vector: its first components in steps as long as the threshold lets two of them differ."""
    lead = basis[:, :grid]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column("embedding")))
            cells = np.floor((x[:, : len(lead)] @ lead) / reach).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.tolist(), pa.list_(pa.int32()))], [*batch.schema.names, "cell"])

    return run


def _compare(basis, threshold: float, lead: int):
    """A group is two tiles (left and right, or one tile with itself): partial link counts and links that join parts.
    Without a basis it is a whole label of its own, which gives the basis."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        side = table.column("side").to_numpy()
        ids, weight = table.column("rep").to_numpy(), table.column("weight").to_numpy()
        x = _unit(_matrix(table.column("embedding")))
        turned = _turned(x, _components(x[:, :TURNED].T @ x[:, :TURNED]) if basis is None else basis)
        k = min(lead, x.shape[1])
        rest = np.sqrt(np.maximum(0.0, (turned[:, k:] ** 2).sum(1)))
        a = np.flatnonzero(side < 2)
        b = np.flatnonzero(side > 0)
        counts, part, edges = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
        alone = len(a) == len(b) and (side == 1).all()
        step = max(16, (1 << 21) // max(len(b), 1))
        for start in range(0, len(a), step):
            own = a[start : start + step]
            bound = turned[own, :k] @ turned[b, :k].T
            bound += rest[own][:, None] * rest[b][None, :]
            i, j = np.nonzero(bound >= threshold - SLACK)
            p, q = own[i], b[j]
            if alone:
                p, q = p[p < q], q[p < q]
            for s in range(0, len(p), 1 << 16):
                u, v = p[s : s + (1 << 16)], q[s : s + (1 << 16)]
                hit = np.einsum("ij,ij->i", x[u], x[v]) >= threshold
                u, v = u[hit], v[hit]
                np.add.at(counts, u, weight[v])
                np.add.at(counts, v, weight[u])
                while len(u := u[(keep := part[u] != part[v])]):
                    v = v[keep]
                    m, n = int(u[0]), int(v[0])
                    edges.append((int(ids[m]), int(ids[n])))
                    low, high = sorted((part[m], part[n]))
                    part[part == high] = low
        found = counts > 0
        n, e = int(found.sum()), np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({
            "rep": pa.array(np.r_[ids[found], e[:, 0]], pa.int64()),
            "links": pa.array(np.r_[counts[found], np.zeros(len(e), np.int64)], pa.int64()),
            "other": pa.array([None] * n + e[:, 1].tolist(), pa.int64()),
        })

    return run


def near_duplicates(vectors: DataFrame, vec: str = "embedding", label: str = "label", id_col: str = "vec_id", threshold: float = 0.98, tile: int = TILE, grid: int | None = None) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links (others of the same label with cosine >= threshold),
    component_id (smallest vec_id reachable, itself included), kept (vec_id = component_id).

    A null label, and a vector that is null, empty, zero or holds a null or non-finite component, links with
    nothing. Vectors of another length than the label's others link with nothing of that length. Equal vectors
    (by two 64-bit hashes) are compared once and counted as many. grid is the number of components by which large labels
    are cut into cells: more, the more tiles a label has, if it isn't given. Work within a label grows with the square of its
    size, less what tiles and bounds skip. An empty table gives none.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    fit = F.coalesce(F.col("label").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("embedding"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = staged(rows.select("*", *[F.when(fit, F.xxhash64(F.lit(k), "label", "embedding")).alias(f"k{k}") for k in (1, 2)]), "vectors")
    same = ["label", "k1", "k2"]
    equal = rows.filter("k1 is not null").groupBy(*same).agg(F.first("embedding").alias("embedding"), F.min("row").alias("rep"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    distinct = staged(equal.withColumn("size", F.size("embedding")), "distinct")
    sized = staged(distinct.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    whole = sized.filter(F.col("n") * F.col("size") <= 2 * tile)
    out = "rep long, links long, other long"
    # A label of up to two tiles' numbers is one group; a single vector of its length is none.
    groups = spread_join(distinct.select("label", "size", "embedding", "rep", "weight"), whole, ["label", "size"], "n", distinct.count()).withColumn("side", F.lit(1))
    found = [staged(groups.groupBy("label", "size").applyInArrow(_compare(None, threshold, LEAD), out), "links")]
    wide = sized.filter(F.col("n") * F.col("size") > 2 * tile)
    reach = (2 - 2 * threshold) ** 0.5 + SLACK
    for size, most in sorted(wide.groupBy("size").agg(F.max("n")).collect()):
        tiles = most * size // tile
        steps = grid or (2 if tiles < 64 else 3 if tiles < 4096 else 4)
        own = distinct.filter(F.col("size") == size).join(wide.select("label", "size"), ["label", "size"], "left_semi")
        found.append(_tiled(own, dict(vectors.dtypes)[label], size, threshold, reach, max(2, tile // size), min(steps, size)))
    per_rep = found[0]
    for more in found[1:]:
        per_rep = per_rep.unionByName(more)
    counts = per_rep.groupBy("rep").agg(F.sum("links").alias("links"))
    grouped = components(per_rep.filter("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    grouped = staged(distinct.select("rep", "least").join(grouped.withColumnRenamed("node", "rep"), "rep"), "linked")
    lowest = grouped.groupBy("component").agg(F.min("least").alias("lowest"), F.count(F.lit(1)).alias("n"))
    moved = spread_join(grouped, lowest, "component", "n", grouped.count()).select("rep", "lowest")
    of = distinct.select(*same, "rep", "least", "weight").join(counts, "rep", "left").join(moved, "rep", "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long")
    of = staged(of.select(*same, "weight", n_links.alias("n_links"), F.coalesce("lowest", "least").alias("component_id")), "classes")
    base = rows.select("vec_id", *same)
    linked = spread_join(base.filter("k1 is not null"), of, same, "weight", rows.count()).select("vec_id", "n_links", "component_id")
    alone = base.filter("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    # A component without ids has none to be named by.
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _tiled(own: DataFrame, label_type: str, size: int, threshold: float, reach: float, tile: int, steps: int) -> DataFrame:
    """(rep, links, other) of distinct vectors of one size whose labels hold more than one group can: by pairs of tiles."""
    basis = principal(own, size)
    shape = f"label {label_type}, embedding array<double>, rep long, weight long, cell array<int>"
    placed = own.select("label", "embedding", "rep", "weight").mapInArrow(_tiles(basis, reach, steps), shape)
    placed = staged(placed, "tiles")
    held = placed.groupBy("label", "cell").count().withColumn("tiles", F.ceil(F.col("count") / tile).cast("int")).drop("count")
    held = staged(held, "cells")
    near = held
    for k in range(steps):
        near = near.withColumn(f"d{k}", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    to = F.array(*[F.col("cell")[k] + F.col(f"d{k}") for k in range(steps)])
    near = near.select("label", "cell", to.alias("to"), "tiles")
    other = held.select("label", F.col("cell").alias("to"), F.col("tiles").alias("to_tiles"))
    # Each pair of cells once, from its smaller cell, and each pair of their tiles once.
    pairs = near.filter(F.col("to") >= F.col("cell")).join(other, ["label", "to"])
    pairs = pairs.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("to_tiles") - 1)))
    pairs = pairs.filter((F.col("to") > F.col("cell")) | (F.col("a") <= F.col("b"))).withColumn("pair", F.xxhash64("label", "cell", "to", "a", "b"))
    both = (F.col("to") == F.col("cell")) & (F.col("a") == F.col("b"))
    left = pairs.select("pair", "label", "cell", F.col("a").alias("block"), F.when(both, 1).otherwise(0).alias("side"))
    right = pairs.filter(~both).select("pair", "label", F.col("to").alias("cell"), F.col("b").alias("block"), F.lit(2).alias("side"))
    dealt = placed.join(held, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    dealt = dealt.join(left.unionByName(right), ["label", "cell", "block"]).select("pair", "rep", "weight", "embedding", "side")
    return staged(dealt.groupBy("pair").applyInArrow(_compare(basis, threshold, LEAD), "rep long, links long, other long"), "links")
