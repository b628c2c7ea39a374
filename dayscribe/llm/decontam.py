"""Benchmark decontamination by a prefix-filtered set join of word shingles. DataFrame functions only.

A window of an item (its runs of WINDOW words; a shorter item is one) occurs in a document only if all its shingles do,
so of the window's shingles, ordered by how rare they are in the documents, a prefix of one is enough to find each place
where it may lie. The prefix's place in the window and the window's length say where it would start and end; places
outside the document are dropped. Of the others the first and the last shingle, which together cover the window, must be
found at its two ends: words are compared as texts, so what remains is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, staged

#: Words of a window; shingles have half as many, so that two of them cover it.
WINDOW = 10
# Fixed value: what counts as a word after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows up to which a table made of the benchmark is broadcast (some 100 bytes a row); beyond, its rows are dealt in
#: SALT copies over tasks, so that a frequent shingle of the documents isn't one task's.
BROADCAST, SALT = 200_000, 64


def words(text: Column) -> Column:
    """The words of a text, with A-Z lower-cased; none for null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _shingles(w: Column, n: Column, size: int) -> Column:
    """(place, size, shingle) of each run of size words, places from 0."""
    at = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
    one = lambda i: F.struct((i - 1).alias("place"), F.lit(size).alias("size"), F.array_join(F.slice(w, i, F.lit(size)), " ").alias("shingle"))
    return F.when(n >= size, F.transform(at, one)).otherwise(F.array().cast("array<struct<place:int,size:int,shingle:string>>"))


def _shares(window: int) -> Column:
    """Words of the shingles of a window of size words: half of it, rounded up, so that the first and last cover it."""
    return F.ceil(F.least("size", F.lit(window)) / 2).cast("int")


def windows(items: DataFrame, text: str = "text", id_col: str = "item_id", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Windows (window, size, words), each text once, and their items (window, item_id); null ids and repeats of an item's
    window are left out of the second, items without words of both."""
    rows = items.select(F.col(id_col).alias("item_id"), words(F.col(text)).alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    size = F.least("n", F.lit(window))
    starts = F.sequence(F.lit(1), F.col("n") - size + 1)
    cut = rows.select("item_id", size.alias("size"), F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    cut = staged(cut.withColumn("text", F.array_join("words", " ")), "windows")
    own = cut.groupBy("text").agg(F.first("size").alias("size"), F.first("words").alias("words")).withColumn("window", F.monotonically_increasing_id())
    own = staged(own, "distinct-windows")
    return own, staged(cut.select("item_id", "text").distinct().join(own.select("text", "window"), "text").select("window", "item_id").filter("item_id is not null"), "window-items")


def _kept(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST else df


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit (words inside an occurrence of a window of an item), n_items
    (items with windows that occur), items_sha256 (of their ids, sorted as strings, joined by commas), contaminated.

    Null texts have no words. Items without words match nothing; an item whose id is null hits words, but isn't counted or
    listed; items that share an id are one. Repeated rows come each, an empty table gives none, without items nothing is hit."""
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text)).alias("w"))
    plain = staged(plain.select("row", "doc_id", F.coalesce(F.size("w"), F.lit(0)).alias("n"), F.array_join("w", " ").alias("text")), "document-words")
    own, of = windows(items, item_text, item_id, window)
    found = staged(occurrences(plain, own, window), "occurrences")

    # Words inside an occurrence: each adds what lies beyond all that start before it.
    hit = found.select("row", "start", (F.col("start") + F.col("size")).alias("end")).groupBy("row", "start").agg(F.max("end").alias("end"))
    ends = hit.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
    step = lambda a, r: F.struct((a["hit"] + F.greatest(F.lit(0), r["end"] - F.greatest(a["end"], r["start"]))).alias("hit"), F.greatest(a["end"], r["end"]).alias("end"))
    hits = ends.select("row", F.aggregate("runs", F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")), step)["hit"].alias("n_hit"))
    pairs = staged(found.select("row", "window").distinct(), "document-windows")
    # A window of many items is one row of many ids, and equal lists count once a document.
    ids = of.groupBy("window").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    sizes = pairs.groupBy("window").agg(F.count(F.lit(1)).alias("c"))
    listed = spread_join(pairs, ids.join(sizes, "window"), "window", "c", pairs.count())
    listed = listed.groupBy("row").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))), ",").alias("ids"), F.size(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("n_items"))
    out = plain.select("row", "doc_id", "n").join(hits, "row", "left").join(listed, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def occurrences(plain: DataFrame, own: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, start, size, window): each place where a window's words stand in a document, each once.

    plain has (row, n, text), text being n words joined by spaces; own has (window, size, words)."""
    parts = own.withColumn("part", _shares(window))
    sizes = sorted(r[0] for r in parts.select("part").distinct().collect())  # at most half a window
    if not sizes:
        return own.select(F.lit(0).cast("long").alias("row"), F.lit(0).alias("start"), "size", "window").limit(0)
    split = lambda k: F.when(F.col("part") == k, _shingles(F.col("words"), F.col("size"), k))
    every = F.coalesce(*[split(k) for k in sizes])
    flat = staged(parts.select("window", F.col("size").alias("length"), F.inline(every)), "window-shingles")
    named = staged(flat.select("shingle", F.col("size")).distinct().withColumn("id", F.monotonically_increasing_id()), "shingles")
    count = named.count()
    text = F.split("text", " ")
    cut = plain.filter("n > 0").select("row", "n", text.alias("w"))
    cut = cut.select("row", F.inline(F.array(F.struct("w", "n"))))  # words are made once
    at = cut.select("row", F.inline(F.concat(*[_shingles(F.col("w"), F.col("n"), k) for k in sizes])))
    if count <= BROADCAST:
        places = at.join(F.broadcast(named), ["shingle", "size"])
    else:
        dealt = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        places = at.withColumn("salt", F.pmod(F.xxhash64("row", "place"), F.lit(SALT)).cast("int")).join(dealt, ["shingle", "size", "salt"])
    places = staged(places.select("row", "place", "id"), "places")

    # Rarest first: the one shingle of each window that is looked for.
    counts = staged(places.groupBy("id").agg(F.count(F.lit(1)).alias("c")), "shingle-counts")
    flat = flat.join(_kept(named, count), ["shingle", "size"]).select("window", "length", F.col("size").alias("part"), "place", "id")
    ranked = flat.join(_kept(counts, count), "id", "left")
    can = ranked.groupBy("window", "length", "part").agg(
        F.min(F.struct("c", "id", "place")).alias("rarest"), F.min_by("id", "place").alias("first"), F.max_by("id", "place").alias("last"), F.count_if(F.isnull("c")).alias("unseen")
    ).filter("unseen = 0")
    can = staged(can, "prefixes")
    # A shingle has few places within windows, however many windows share it.
    near = can.select(F.col("rarest.id").alias("id"), F.struct(F.col("rarest.place").alias("back"), "length", "part").alias("x"), F.col("rarest.c").alias("c"))
    near = near.groupBy("id").agg(F.collect_set("x").alias("x"), F.max("c").alias("c"))
    total = places.count()
    maybe = spread_join(places, near, "id", "c", total).select("row", F.col("place").alias("_at"), F.explode("x").alias("x"))
    maybe = maybe.select("row", (F.col("_at") - F.col("x.back")).alias("start"), F.col("x.length").alias("length"), F.col("x.part").alias("part")).filter("start >= 0").distinct()
    ends = places.join(_kept(named.select("id", F.col("size").alias("part")), count), "id").select("row", "place", "part", "id")
    first = maybe.join(ends.select("row", F.col("place").alias("start"), "part", F.col("id").alias("first")), ["row", "start", "part"])
    first = first.withColumn("place", F.col("start") + F.col("length") - F.col("part"))
    both = staged(first.join(ends.withColumnRenamed("id", "last"), ["row", "place", "part"]).select("row", "start", "length", "first", "last"), "covered")
    keys = ["first", "last", "length"]
    same = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    seen = can.select("window", *keys).join(same, keys)
    out = spread_join(both, seen, keys, "c", both.count())
    return out.select("row", "start", F.col("length").alias("size"), "window")
