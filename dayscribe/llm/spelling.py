"""Spelling variants: words that one inserted, deleted or replaced code point makes of each other.

Words are found by a prefix filter on their positional bigrams. One edit changes two bigrams of a word at most, so with the
bigrams ordered by how many words have them, rarest first, two near words share one of the three rarest of each, at
the same place, or one place on in the longer word. What an edit does to the length says which: words of equal length hold it at
the same place. Candidates are compared as texts in the join itself, so pairs that aren't near are never written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, staged

# Fixed value: what a word is.
RUN = "[A-Za-zÀ-ÿ]+"
#: One edit changes two bigrams, so one of this many is left as it was.
PREFIX = 3
#: A word's form is at least so many times as frequent.
TIMES = 5
#: Words that share a bigram, place and length are compared in blocks of this many, each pair of blocks by itself.
BLOCK = 1024


def counted(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: int = 6, occurrences: int = 5, typo: int | None = None) -> DataFrame:
    """(word, n) of each distinct word of least code points or more and so many occurrences: runs of letters with A-Z lower-cased.

    With typo, a run whose hash with its document's id typo divides loses the code point that the hash says. A null id
    is an empty one, null text has no words."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = lambda c: F.when(c.rlike("[A-Z]"), F.translate(c, upper, upper.lower())).otherwise(c)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    rows = rows.filter(F.length("run") >= least).select("id", low(F.col("run")).alias("word"))
    if typo:
        rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), F.col("word"))))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        rows = rows.select(F.when(F.col("h") % typo == 0, cut).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= least)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= occurrences)


def _bigrams(word: Column) -> Column:
    """(bigram, place) of each pair of neighbouring code points, places from 0."""
    return F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.struct(F.substring(word, i, F.lit(2)).alias("g"), (i - 1).cast("int").alias("at")))


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, other, other_n): pairs of near words both ways, from (word, n), each word once and of four code points or more.

    A word's prefix is its three rarest bigrams by (count, bigram), and further places of the same bigrams. Words are dealt by
    (bigram, place, length): those of equal length meet at equal places, a shorter word also meets those one longer at its own
    place and the next. Where over block words meet they are dealt into blocks, none left out."""
    grams = words.select("word", "n", F.length("word").alias("size"), F.inline(_bigrams(F.col("word"))))
    counts = staged(words.select(F.explode(F.array_distinct(F.transform(_bigrams(F.col("word")), lambda x: x["g"]))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c")), "bigrams")
    total = counts.agg(F.sum("c")).first()[0] or 0
    ranked = spread_join(grams, counts.withColumn("of", F.col("c")), "g", "of", total)
    ranked = ranked.groupBy("word", "n", "size").agg(F.array_sort(F.collect_list(F.struct("c", "g", "at"))).alias("x"))
    third = F.element_at("x", PREFIX)
    kept = F.filter("x", lambda y: (y["c"] < third["c"]) | ((y["c"] == third["c"]) & (y["g"] <= third["g"])))
    first = staged(ranked.select("word", "n", "size", F.explode(kept).alias("y")).select("word", "n", "size", F.col("y.g").alias("g"), F.col("y.at").alias("at")), "prefixes")

    # Cells: a word stands in that of its own place and length, and looks for longer words in two more.
    own = first.select("word", "n", "g", "at", "size", F.lit(0).alias("more"))
    up = F.explode(F.array(F.lit(0), F.lit(1)))
    longer = first.withColumn("on", up).select("word", "n", "g", (F.col("at") + F.col("on")).alias("at"), (F.col("size") + 1).alias("size"), F.lit(1).alias("more"))
    cell = ["g", "at", "size"]
    asked = longer.join(own.select(*cell).distinct(), cell, "left_semi").unionByName(own)
    big = own.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).filter("blocks > 1")
    big = staged(big, "big-cells")
    there, ask = own.drop("more").withColumn("block", F.lit(0)), asked.withColumn("block", F.lit(0))
    if big.count():
        size = big.withColumn("c", F.col("blocks") * block)
        deal = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        at_rest = lambda rows: rows.drop("block").join(big.select(*cell), cell, "left_anti").withColumn("block", F.lit(0))
        there = spread_join(there.drop("block"), size, cell, "c", first.count()).withColumn("block", deal).drop("blocks").unionByName(at_rest(there))
        ask = spread_join(ask.drop("block"), size, cell, "c", first.count()).withColumn("block", every).drop("blocks").unionByName(at_rest(ask))
    x, y = ask.alias("x"), there.alias("y")
    c = F.col
    pair = reduce(lambda a, b: a & b, [c(f"x.{k}") == c(f"y.{k}") for k in (*cell, "block")])
    pair &= ((c("x.more") == 1) | (c("x.word") < c("y.word"))) & (F.levenshtein("x.word", "y.word", 1) == 1)
    found = x.join(y, pair).select(c("x.word").alias("a"), c("x.n").alias("a_n"), c("y.word").alias("b"), c("y.n").alias("b_n")).distinct()
    ways = F.explode(F.array(F.struct(c("a").alias("word"), c("a_n").alias("n"), c("b").alias("other"), c("b_n").alias("other_n")), F.struct(c("b").alias("word"), c("b_n").alias("n"), c("a").alias("other"), c("a_n").alias("other_n"))))
    return found.select(ways.alias("p")).select("p.*")


def variants(words: DataFrame, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """One row for each word of (word, n), each once: word, n, form (its near word with the largest n, ties: the smallest word, if
    at least times as frequent; else null), form_n, n_near (near words), root (from the word on, forms to the last). No word, no row."""
    words = staged(words, "words")
    near = near_words(words, block)
    best = F.min(F.struct((-F.col("other_n")).alias("o"), F.col("other").alias("w")))
    found = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.w").alias("near"), (-F.col("best.o")).alias("near_n"))
    good = F.col("near_n") >= times * F.col("n")
    rows = staged(rows.select("word", "n", "n_near", F.when(good, F.col("near")).alias("form"), F.when(good, F.col("near_n")).alias("form_n")), "forms")
    # Each step doubles how far a word has followed its forms; each form is times as frequent, so few steps are needed.
    ends = staged(rows.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        most = ends.groupBy("root").agg(F.count(F.lit(1)).alias("c"))
        on = staged(ends.select(F.col("word").alias("root"), F.col("root").alias("next")).join(most, "root"), "steps")
        if not on.count():
            break
        moved = spread_join(ends, on, "root", "c", ends.count()).select("word", F.col("next").alias("root"))
        ends = staged(moved.unionByName(ends.join(on.select("root"), "root", "left_anti").select("word", "root")), "roots")
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
