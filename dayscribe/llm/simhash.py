"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint's 32 two-bit segments have 32 counts of 0 to 2; the Manhattan distance of two count vectors is
at most the Hamming distance of the fingerprints. The counts are dealt into G groups. Of two vectors within
distance d at least G - d groups are equal, so both lie in the same cell of one of the grids over G - d groups.
Within a cell, rows are sorted by their total count, which also differs by d at most: a range join that looks
at following rows only as far as the total reaches, drops pairs by the Manhattan bound and checks the rest.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_text, components, fresh, spread_join, staged

#: Rows of a cell that one task compares; larger cells are dealt into pairs of blocks of about this many.
BLOCK = 4096
EVEN = 0x5555555555555555


def fingerprint(text: str | None, words: int = 4, block: int = 1 << 22) -> int:
    """64-bit SimHash of a text's word shingles; A-Z lower-cased, words split at ASCII white space, repeats count.
    Fewer words: the whole sequence is the one shingle. No word: 0. Works through long texts in blocks."""
    import numpy as np
    from xxhash import xxh64_intdigest

    data = (text or "").encode("utf-8", "surrogatepass").lower()
    ones, total, carry, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(data):
        end = min(len(data), at + block)
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        found, at = carry + data[at:end].split(), end
        if len(found) < words:
            carry = found
            continue
        lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
        ends = np.cumsum(lengths)
        line = b" ".join(found)
        starts, stops = (ends - lengths).tolist(), (ends - 1)[words - 1 :].tolist()
        h = np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops)], dtype="<u8")
        for i in range(0, len(h), 65536):
            ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(h)
        carry = found[len(found) - words + 1 :] if words > 1 else []
    if not total:
        return xxh64_intdigest(b" ".join(carry), 42) if carry else 0
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 4, row: str | None = None) -> DataFrame:
    """(doc_id, fp): fp as a signed long with the fingerprint's bits. Null text counts as empty. With row, the name
    of a column that numbers the rows, also row and h, a hash of the text."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = [fingerprint(x.as_py(), words) for x in batch.column(1)]
            signed = pa.array([x - (x >> 63 << 64) for x in fps], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), signed, *batch.columns[2:]], ["doc_id", "fp", "row", "h"][: batch.num_columns])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), clean_text(text).alias("text"), *([F.col(row).alias("row"), F.xxhash64(clean_text(text)).alias("h")] if row else []))
    return rows.mapInArrow(run, "doc_id long, fp long" + (", row long, h long" if row else ""))


def n_groups(rows: int, distance: int, per_cell: int = 64) -> int:
    """Groups such that a cell of spread-out fingerprints holds about per_cell rows at most; exact for any number."""
    import math

    for groups in range(distance + 2, 12):
        bits = 1.415 * 32 * (groups - distance) / groups
        if math.log2(max(rows, 1) / per_cell + 1) <= bits:
            return groups
    return 12


def _cells(groups: int, distance: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        masks = [sum(3 << (2 * s) for s in range(32) if s % groups == g) for g in range(groups)]
        grids = [np.uint64(sum(masks[g] for g in own)) for own in combinations(range(groups), groups - distance)]
        mix = lambda x: (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            counts = fp - ((fp >> np.uint64(1)) & np.uint64(EVEN))
            total = np.bitwise_count(fp).astype(np.int8)
            for k, grid in enumerate(grids):
                cell = mix(mix(mix(counts & grid)) + np.uint64(k + 1))
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(total), batch.column(0)], ["cell", "total", "fp"])

    return run


def _links(distance: int):
    """Rows in order of (cell, total): the links found in each cell that join two of its parts not yet joined."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def near(a, b):
            def counts(x):
                return x - ((x >> np.uint64(1)) & np.uint64(EVEN))

            x = counts(a) ^ counts(b)
            high, low = (x >> np.uint64(1)) & np.uint64(EVEN), x & np.uint64(EVEN)
            bound = np.bitwise_count(high | low) + np.bitwise_count(high & ~low)
            ok = bound <= distance
            ok[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= distance
            return ok

        def joined(cell, total, fp):
            part, out = np.arange(len(fp)), []
            own, lag = np.arange(len(fp)), 1
            while len(own := own[own + lag < len(fp)]):
                own = own[(cell[own] == cell[own + lag]) & (total[own + lag] - total[own] <= distance)]
                if not len(own):
                    break
                i = own[part[own] != part[own + lag]]
                for start in range(0, len(i), 1 << 18):
                    j = i[start : start + (1 << 18)]
                    hit = j[near(fp[j], fp[j + lag])]
                    if len(hit):
                        up = {}

                        def root(x):
                            while x in up:
                                x = up[x]
                            return x

                        for p in hit.tolist():
                            a, b = root(int(part[p])), root(int(part[p + lag]))
                            if a != b:
                                up[max(a, b)] = min(a, b)
                                out.append((p, p + lag))
                        if up:
                            old = np.fromiter(up, np.int64, len(up))
                            to = np.arange(len(fp))
                            to[old] = [root(x) for x in old.tolist()]
                            part = to[part]
                lag += 1
            i = np.array(out, np.int64).reshape(-1, 2)
            return fp[i[:, 0]], fp[i[:, 1]]

        def spans(cell):
            """Whole cells, long ones on their own."""
            edges = np.flatnonzero(np.diff(cell)) + 1
            starts, ends = np.r_[0, edges], np.r_[edges, len(cell)]
            at = 0
            for a, b in zip(starts[ends - starts >= 128].tolist(), ends[ends - starts >= 128].tolist()):
                if at < a:
                    yield at, a
                yield a, b
                at = b
            if at < len(cell):
                yield at, len(cell)

        def found(cell, total, fp):
            for a, b in spans(cell):
                if b - a > 1:
                    x, y = joined(cell[a:b], total[a:b], fp[a:b])
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

        rest, held = None, []
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(x[0]) for x in held) < 65536:
                continue
            now = [np.concatenate(x) for x in zip(*([rest] if rest is not None else []), *held)]
            held = []
            last = int(np.searchsorted(now[0], now[0][-1]))
            if last:
                yield from found(now[0][:last], now[1][:last].astype(np.int64), now[2][:last].view(np.uint64))
            rest = [x[last:].copy() for x in now]
        if held:
            rest = [np.concatenate(x) for x in zip(*([rest] if rest is not None else []), *held)]
        if rest is not None:
            yield from found(rest[0], rest[1].astype(np.int64), rest[2].view(np.uint64))

    return run


def links(distinct: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): links between the distinct fingerprints in column fp that connect all that are within distance,
    directly or by other such links. A link is always exact; in a dense cell only those that join parts are given.

    A cell with over block rows is dealt into blocks by hash and each pair of blocks compared by a task of its
    own, so no task holds more than about two blocks of one cell, and none is capped."""
    groups = n_groups(distinct.count(), distance)
    cells = distinct.select("fp").mapInArrow(_cells(groups, distance), "cell long, total byte, fp long")
    big = staged(cells.groupBy("cell").count().filter(F.col("count") > block), "cells")
    n = big.count()
    if n:
        split = F.ceil(F.col("count") / block).cast("int")
        held = F.broadcast(big) if n <= 100_000 else big
        cells = cells.join(held, "cell", "left").withColumn("blocks", F.coalesce(split, F.lit(1))).drop("count")
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        cells = cells.withColumn("own", own).withColumn("other", other)
        pair = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
        cells = cells.select(F.when(F.col("blocks") > 1, pair).otherwise(F.col("cell")).alias("cell"), "total", "fp")
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "total")
    return dealt.mapInArrow(_links(distance), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 4, distance: int = 4) -> DataFrame:
    """One row for each row of docs: doc_id, fp, component_id (smallest id reachable over links of at most
    distance differing bits). Texts without words have fingerprint zero and link like any other. A null id is
    returned as it is and never is a component_id while the component has another. An empty table gives none."""
    fps = staged(fingerprints(docs, text, id_col, words), "fingerprints")
    return _resolved(fps, F.min("doc_id"), "component_id", distance).select("doc_id", "fp", "component_id")


def _resolved(fps: DataFrame, least: Column, name: str, distance: int) -> DataFrame:
    """fps, read several times, with the aggregate least of all rows reachable over links in column name."""
    distinct = staged(fps.groupBy("fp").agg(least.alias("least"), F.count(F.lit(1)).alias("c")), "distinct")
    found = components(links(distinct, distance))
    roots = staged(distinct.join(found.withColumnRenamed("node", "fp"), "fp"), "linked")
    lowest = roots.groupBy("component").agg(F.min("least").alias("lowest"), F.count(F.lit(1)).alias("n"))
    moved = staged(spread_join(roots, lowest, "component", "n", roots.count()).select("fp", "lowest"), "roots")
    of = distinct.join(moved, "fp", "left").select("fp", F.coalesce("lowest", "least").alias(name), "c")
    return spread_join(fps, of, "fp", "c", fps.count())


def dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 4, distance: int = 4) -> DataFrame:
    """docs with one row of each component, one with the smallest id (a null one only if there is no other); columns
    unchanged. Each row is decided on its own, whatever rows share its id: of repeated rows, and of different texts
    with the smallest id, one stays. An empty table gives none."""
    (key,) = fresh(docs, "row")
    rows = staged(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    fps = staged(fingerprints(rows, text, id_col, words, key), "fingerprints")
    found = _resolved(fps, F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "h", "row")), "first", distance)
    gone = staged(found.filter(F.col("row") != F.col("first.row")).select(F.col("row").alias(key)), "near-duplicates")
    return rows.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
