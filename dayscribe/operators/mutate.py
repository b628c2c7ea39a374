"""Systematic mutations of a digest, to see that a score falls when its digest gets worse. Columns of strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.files import ACTIVITY, COMMIT, FILES
from .corpus import lowest_drawn
from .scoring import COMPONENTS, grounded, score

# Fixed values.
FILLER = "banana mango kayak umbrella giraffe volcano ticket window quartz nomadic lantern".split()
SOUP = "refactor polish cleanup tweak adjust shuffle nudge wander browse scroll ponder humdrum routine ordinary steady gentle quiet modest".split()
FAKE_FILE = "The new src/app/Widget.svelte component landed cleanly."
GHOST = "Unverified claims about src/app/Ghost.svelte appeared from nowhere."
UNGROUNDED = (
    "The mango giraffe session kept everything moving overall, with steady window throughout and a general sense of forward motion across the wider landscape."
)
EPS, NEUTRAL_BAND = 0.02, 0.05
# End of the fixed values.


SECTION = "array<array<string>>"


def parsed(df: DataFrame, digest: str, seed: int) -> DataFrame:
    """(row, d, and what mutations read of d): all columns of df in row; salt, lines, summary and per_repo (places of the first
    lines that start so, from 1; null without), said (place of the first line with text after the summary's header), pre
    (lines before the first section), sections (each an array of its lines, header first). Each is made once a digest."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    d = F.col(f"`{digest}`")
    df = T.barrier(df.select(row.alias("row"), d.alias("d"), F.md5(F.concat_ws(":", F.lit(seed), d).cast("binary")).alias("salt"), T.lines(d).alias("lines")))
    places = lambda test: F.filter(F.transform("lines", lambda x, i: F.when(test(x), i + 1)), lambda i: i.isNotNull())
    first = lambda test: F.try_element_at(places(test), F.lit(1))
    df = df.select("*", places(lambda x: x.startswith("### ")).alias("heads"), first(lambda x: x.startswith("## Summary")).alias("summary"), first(lambda x: x.startswith("## Per-Repo")).alias("per_repo"))
    df = T.barrier(df)
    n = F.size("lines")
    ends = F.concat(_rest(F.col("heads")), F.array(n + 1))
    sections = F.when(F.size("heads") > 0, F.zip_with("heads", ends, lambda a, b: F.slice("lines", a, b - a))).otherwise(F.array().cast(SECTION))
    pre = F.slice("lines", F.lit(1), F.coalesce(F.try_element_at("heads", F.lit(1)), n + 1) - 1)
    said = F.filter(F.transform("lines", lambda x, i: F.when((i + 1 > F.col("summary")) & (T.strip(x) != ""), i + 1)), lambda i: i.isNotNull())
    return T.barrier(df.select("row", "d", "salt", "lines", "summary", "per_repo", F.try_element_at(said, F.lit(1)).alias("said"), pre.alias("pre"), sections.alias("sections")))


def _join(*arrays: Column) -> Column:
    return F.array_join(F.concat(*arrays), "\n")


def _from(ls: Column, i: Column) -> Column:
    """Elements from the i-th on."""
    return F.slice(ls, i, F.greatest(F.size(ls) - i + 1, F.lit(0)))


def _rest(ls: Column) -> Column:
    return _from(ls, F.lit(2))


def _before(i: Column) -> Column:
    return F.slice("lines", F.lit(1), i - 1)


def _insert(at: Column, line: str) -> Column:
    """The line before the at-th one; the digest itself where at is null."""
    return F.coalesce(_join(_before(at), F.array(F.lit(line)), _from(F.col("lines"), at)), "d")


def truncate(share: float) -> Column:
    return F.array_join(F.slice("lines", F.lit(1), F.floor(F.size("lines") * share).cast("int")), "\n")


def drop_section() -> Column:
    victim = T.drawn(F.col("salt"), F.lit("drop")) % F.greatest(F.size("sections"), F.lit(1))
    return F.when(F.size("sections") == 0, F.col("d")).otherwise(_join(F.col("pre"), F.flatten(F.filter("sections", lambda b, i: i != victim))))


def swap_bodies() -> Column:
    """Each header with the next section's body, directly behind it; null under two sections."""
    rotated = F.concat(_rest(F.col("sections")), F.slice("sections", 1, 1))
    mixed = F.zip_with("sections", rotated, lambda a, b: F.concat(F.element_at(a, 1), F.array_join(_rest(b), "\n")))
    return F.when(F.size("sections") >= 2, _join(F.col("pre"), mixed))


def duplicate_section() -> Column:
    last = F.array_join(F.try_element_at("sections", F.lit(-1)), "\n")
    return F.when(F.size("sections") == 0, F.col("d")).otherwise(F.concat(F.regexp_replace("d", r"\n+\z", ""), F.lit("\n"), last))


def fabricate_in_body() -> Column:
    head = F.try_element_at("sections", F.lit(1))
    said = F.filter(F.transform(head, lambda x, i: F.when((i > 0) & (T.strip(x) != ""), i + 1)), lambda i: i.isNotNull())
    at = F.coalesce(F.try_element_at(said, F.lit(1)), F.size(head))
    changed = F.concat(F.slice(head, F.lit(1), at), F.array(F.lit(FAKE_FILE)), _from(head, at + 1))
    return F.when(F.size("sections") == 0, F.col("d")).otherwise(_join(F.col("pre"), changed, F.flatten(_rest(F.col("sections")))))


def fabricate_in_summary() -> Column:
    return _insert(F.col("said"), FAKE_FILE)


def ungrounded_summary() -> Column:
    fake = F.array(F.lit("## Summary"), F.lit(""), F.lit(UNGROUNDED))
    return F.coalesce(_join(_before(F.col("summary")), fake, _from(F.col("lines"), F.col("per_repo"))), "d")


def fake_repos() -> Column:
    base = F.coalesce(F.try_element_at("sections", F.lit(-1)), F.array(F.lit("### nobody/nowhere"), F.lit(""), F.lit("Stuff happened.")))
    spam = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.concat(F.array(F.concat(F.element_at(base, 1), F.lit("-clone"), k.cast("string"))), _rest(base)))
    return _join(F.col("pre"), F.flatten("sections"), F.flatten(spam))


def strip_per_repo_header() -> Column:
    return F.array_join(F.filter("lines", lambda x: ~x.startswith("## Per-Repo")), "\n")


def word_soup(n: int = 14) -> Column:
    words = F.array(*[F.lit(w) for w in SOUP])
    pick = lambda i, k: F.element_at(words, (T.drawn(F.col("salt"), i, k) % len(SOUP) + 1).cast("int"))
    soup = lambda i: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: pick(i, k)), " ")
    return _join(F.col("pre"), F.flatten(F.transform("sections", lambda b, i: F.array(F.element_at(b, 1), F.lit(""), soup(i), F.lit("")))))


def orphan_prose() -> Column:
    return _insert(F.col("per_repo") + 1, GHOST)


def shuffle_sections() -> Column:
    keyed = F.transform("sections", lambda b, i: F.struct(T.drawn(F.col("salt"), i).alias("k"), i.alias("i"), b.alias("b")))
    return _join(F.col("pre"), F.flatten(F.transform(F.array_sort(keyed), lambda x: x["b"])))


#: name -> (tier, mutation of a parsed digest)
MUTATIONS: dict[str, tuple[str, Callable[[], Column]]] = {
    "truncate_50": ("must_cost", lambda: truncate(0.50)),
    "truncate_75": ("must_cost", lambda: truncate(0.75)),
    "duplicate_section": ("must_cost", duplicate_section),
    "fabricate_file_body": ("must_cost", fabricate_in_body),
    "fabricate_file_summary": ("must_cost", fabricate_in_summary),
    "ungrounded_summary": ("must_cost", ungrounded_summary),
    "fake_repo_spam": ("must_cost", fake_repos),
    "strip_per_repo_header": ("must_cost", strip_per_repo_header),
    "word_soup_bodies": ("must_cost", word_soup),
    "orphan_prose": ("must_cost", orphan_prose),
    "drop_section": ("must_not_pay", drop_section),
    "swap_bodies": ("must_not_pay", swap_bodies),
    "shuffle_sections": ("neutral", shuffle_sections),
}


def mutated(df: DataFrame, digest: str = "digest", seed: int = 0, names=tuple(MUTATIONS)) -> DataFrame:
    """df once for each mutation and once as it is (mutation `base`): mutation, tier and the mutated digest added or
    put in place. Choices are by hash of seed and digest, so a rerun makes the same. Undefined mutations give no row."""
    made = [F.struct(F.lit("base").alias("m"), F.lit("base").alias("t"), F.col("d"))]
    made += [F.struct(F.lit(n).alias("m"), F.lit(MUTATIONS[n][0]).alias("t"), MUTATIONS[n][1]().alias("d")) for n in names]
    rows = parsed(df, digest, seed).select("row", F.explode(F.array(*made)).alias("_x")).filter("_x.d is not null")
    keep = [F.col(f"row.`{c}`") for c in df.columns if c != digest]
    return rows.select(*keep, F.col("_x.m").alias("mutation"), F.col("_x.t").alias("tier"), F.col("_x.d").alias(digest))


def deltas(df: DataFrame, key: str, digest: str = "digest", activity: str = "activity", seed: int = 0) -> DataFrame:
    """(mutation, tier, key, delta, violates) of each row and mutation against the row's own base score. A record is
    grounded once, however many mutations its digest has."""
    rows = df.select(key, digest, activity)
    # Scoring is all work and few bytes: as many tasks as shuffles have, however small the table.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    rows = mutated(grounded(rows, activity).drop(activity), digest, seed)
    scored = score(rows, digest, None).select(key, "mutation", "tier", "total")
    base = F.max(F.when(F.col("mutation") == "base", F.col("total"))).over(Window.partitionBy(key))
    out = scored.withColumn("delta", F.col("total") - base).filter("mutation <> 'base'")
    bad = F.when(F.col("tier") == "must_cost", F.col("delta") > -EPS).when(F.col("tier") == "must_not_pay", F.col("delta") > EPS)
    return out.select("mutation", "tier", key, "delta", bad.otherwise(F.abs("delta") > NEUTRAL_BAND).alias("violates"))


def _prose(seed: int, most: int, *k: Column) -> Column:
    """None to most words that ground in nothing, by a hash of seed and k."""
    pool = F.array(*[F.lit(w) for w in SOUP + FILLER])
    n = (T.drawn(F.lit(seed + 1), *k) % (most + 1)).cast("int")
    pick = lambda i: F.element_at(pool, (T.drawn(F.lit(seed), i, *k) % len(SOUP + FILLER) + 1).cast("int"))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), pick), " ")).otherwise("")


def _skeleton(seed: int, key: Column, activity: Column) -> Column:
    """The record's sections one to three times over, each of words that ground in nothing."""
    copies = (T.drawn(F.lit(seed + 2), key) % 3 + 1).cast("int")
    one = lambda r, i, c: F.concat(F.lit("### "), T.text(r["repo"]), F.lit("\n\n"), _prose(seed, 25, key, i, c))
    every = F.flatten(F.transform(F.sequence(F.lit(1), copies), lambda c: F.transform(activity, lambda r, i: one(r, i, c))))
    return F.array_join(every, "\n\n")


def _cut(seed: int, key: Column, digest: str) -> Column:
    """Three in ten digests end after some share of their lines."""
    ls = T.lines(digest)
    share = T.drawn(F.lit(seed + 4), key) / float(2**32)
    short = F.array_join(F.slice(ls, F.lit(1), F.floor(F.size(ls) * share).cast("int")), "\n")
    return F.when(T.drawn(F.lit(seed + 3), key) % 10 < 3, short).otherwise(F.col(digest))


def soup_digests(spark, activities: DataFrame, n: int = 300, seed: int = 0, activity: str = "activity", key: str | None = None) -> DataFrame:
    """(sample, digest, activity): exactly n well-formed digests of words that ground in nothing, over n rows of activities drawn by
    a hash of seed and key (of the record, if none is named), over all in turn if there are fewer; none if there is no row.
    Sections are there one to three times, and three in ten digests are cut off."""
    mark = F.to_json(activity) if key is None else F.col(key).cast("string")
    rows = activities.select(F.col(activity).alias("activity"), mark.alias("_key"))
    total = rows.count()
    drawn = lowest_drawn(rows, n, F.lit(seed), F.col("_key"))
    samples = spark.range(n if total else 0).select(F.col("id").cast("int").alias("sample"), (F.col("id") % max(min(total, n), 1)).cast("int").alias("_place"))
    drawn = drawn.join(samples, "_place")
    head = F.concat(F.lit("# Developer Journal\n\n## Summary\n\n"), _prose(seed, 30, F.col("sample")), F.lit("\n\n## Per-Repo Activity\n\n"))
    made = T.barrier(drawn.select("sample", F.concat(head, _skeleton(seed, F.col("sample"), F.col("activity"))).alias("digest"), "activity"))
    return made.select("sample", _cut(seed, F.col("sample"), "digest").alias("digest"), "activity")


#: How often lines of odd digests end in each way, by turns.
ENDS = ("\n", "\r\n", "\r", "\x0b", "\n")


def odd_digests(records: DataFrame, key: str, seed: int = 0, activity: str = "activity") -> DataFrame:
    """(key, digest, activity): an odd digest for each record, by a grammar whose choices are hashes of seed and key, and the record
    made odd as well.

    Titles, summaries and the per-repo header may lack, come twice or out of order, prose may stray, sections come one to three
    times, three in ten digests are cut anywhere, and lines end in different ways. Records may have no repositories, none with a
    name, no commits, or commits without a message or files."""
    k = F.col(key)
    turn = lambda what, n: T.drawn(F.lit(seed + 5), k, F.lit(what)) % n
    acts = F.coalesce(F.col(activity), F.array().cast(ACTIVITY))
    bare = lambda c: F.struct(c["sha"].alias("sha"), F.lit(None).cast("string").alias("message"), c["url"].alias("url"), F.lit(None).cast(FILES).alias("files"))
    repo = lambda r, name, commits: F.struct(name.alias("repo"), commits.alias("commits"))
    kind = turn("record", 6)
    odd = (
        F.when(kind == 1, F.transform(acts, lambda r: repo(r, r["repo"], F.lit(None).cast(f"array<{COMMIT}>"))).cast(ACTIVITY))
        .when(kind == 2, F.transform(acts, lambda r: repo(r, F.lit(""), r["commits"])).cast(ACTIVITY))
        .when(kind == 3, F.transform(acts, lambda r: repo(r, r["repo"], F.transform(r["commits"], bare))).cast(ACTIVITY))
        .when(kind == 4, F.array().cast(ACTIVITY))
        .otherwise(acts)
    )
    title = F.when(turn("title", 5) == 0, "").otherwise("# Developer Journal\n\n")
    said = F.concat(F.lit("## Summary\n\n"), _prose(seed, 30, k, F.lit("s")), F.lit("\n\n"))
    per = F.when(turn("per", 6) == 0, "").otherwise("## Per-Repo Activity\n\n")
    stray = F.when(turn("stray", 4) == 0, F.concat(_prose(seed, 12, k, F.lit("p")), F.lit("\n\n"))).otherwise("")
    summary = F.when(turn("summary", 7) == 0, "").when(turn("summary", 7) == 1, F.concat(said, said)).otherwise(said)
    late = turn("summary", 7) == 2
    parts = [title, F.when(late, "").otherwise(summary), per, stray, _skeleton(seed, k, acts), F.when(late, F.concat(F.lit("\n\n"), summary)).otherwise("")]
    made = T.barrier(records.select(key, F.concat(*parts).alias("digest"), odd.alias("activity")))
    made = T.barrier(made.select(key, _cut(seed, k, "digest").alias("digest"), "activity"))
    end = F.element_at(F.array(*[F.lit(e) for e in ENDS]), (turn("ends", len(ENDS)) + 1).cast("int"))
    return made.select(key, F.replace("digest", F.lit("\n"), end).alias("digest"), "activity")


def _within(c: str) -> Column:
    return F.coalesce(F.col(c).between(0.0, 1.0) & ~F.isnan(c), F.lit(False))


#: name -> (rows that it is about, what holds for them), over scores with detail.
INVARIANTS: dict[str, tuple[Callable[[], Column], Callable[[], Column]]] = {
    "total_within_bounds": (lambda: F.lit(True), lambda: _within("total")),
    "parts_within_bounds": (lambda: F.lit(True), lambda: _within("format") & _within("coverage") & _within("grounding") & _within("penalties")),
    "nothing_to_cover": (lambda: F.size("activity") == 0, lambda: (F.col("coverage") == 1.0) & (F.col("grounding") == 0.0)),
    "words_of_nothing_stay_low": (lambda: F.size("activity") > 0, lambda: F.col("total") <= 0.55),
    "penalties_only_cost": (lambda: F.lit(True), lambda: F.col("total") <= 0.30 * F.col("format") + 0.45 * F.col("coverage") + 0.25 * F.col("grounding")),
    "penalties_cover_each": (lambda: F.lit(True), lambda: F.col("penalties") >= F.greatest(*[F.col(f"p_{c}") for c in COMPONENTS]) - 1e-12),
}


def invariants(scored: DataFrame, key: str) -> DataFrame:
    """(invariant, checked, broken, first): over scores with detail and their records, how many rows each invariant is about, how many
    break it, and the smallest key that does, null if none."""
    each = [F.struct(F.lit(n).alias("invariant"), about().alias("about"), F.coalesce(holds(), F.lit(False)).alias("holds")) for n, (about, holds) in INVARIANTS.items()]
    rows = scored.select(F.col(key).alias("k"), F.inline(F.array(*each))).filter("about")
    return rows.groupBy("invariant").agg(F.count(F.lit(1)).alias("checked"), F.count_if(~F.col("holds")).alias("broken"), F.min(F.when(~F.col("holds"), F.col("k"))).alias("first"))
