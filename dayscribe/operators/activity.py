"""Activity records: repositories in order, their commits and files, and the words they ground a digest in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.files import ACTIVITY, COMMIT, FILES, SPARSE_COMMITS, is_low_signal, shown_files
from ..sources import versions
from ..stage import staged

JSON = f"map<string,struct<commits:array<{COMMIT}>>>"


def from_json(c: str | Column) -> Column:
    """Ordered activity of a JSON object repo -> {commits}; of a repeated repo the first place and the last value
    count. Null where the text is no such object."""
    parsed = F.map_entries(F.from_json(T.col(c), JSON, {"mode": "PERMISSIVE"}))
    names = F.array_distinct(F.transform(parsed, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(parsed, lambda e: e["key"] == k), -1)["value"]["commits"]
    return F.transform(names, lambda k: F.struct(k.alias("repo"), last(k).alias("commits"))).cast(ACTIVITY)


def commits_of(repo: Column) -> Column:
    return F.coalesce(repo["commits"], F.array().cast(f"array<{COMMIT}>"))


def total_commits(activity: str | Column) -> Column:
    return F.aggregate(T.col(activity), F.lit(0), lambda n, r: n + F.size(commits_of(r)))


def shows_patches(activity: str | Column) -> Column:
    """Whether a record is sparse enough for its patches to be shown: a property of the whole record."""
    return total_commits(activity) <= SPARSE_COMMITS


def _files(commit: Column) -> Column:
    named = F.coalesce(commit["files"], F.array().cast(FILES))
    return F.filter(named, lambda f: (T.text(f["filename"]) != "") & ~is_low_signal(f["filename"]))


def commit_text(commit: Column, patches: Column) -> Column:
    """What a commit shows: its message, its files' names and, if shown, their patches. Words never span two of them."""
    file = lambda f: F.concat_ws("\n", T.text(f["filename"]), F.when(patches, T.text(f["patch"])))
    return F.concat_ws("\n", T.text(commit["message"]), F.array_join(F.transform(_files(commit), file), "\n"))


GROUNDED = "norm, name_tokens, name_words, commits (array of token arrays), source (tokens), surface (words)"


def with_grounding(df: DataFrame, activity: str = "activity") -> DataFrame:
    """Adds repos, for each repository of the record in order: repo and the columns named in GROUNDED; and
    real_files, base names of all its files and of files that messages mention."""
    other = [c for c in df.columns if c not in ("repos", "real_files")]
    no_files = F.array().cast(FILES)
    known = lambda c: F.concat(
        F.transform(F.filter(F.coalesce(c["files"], no_files), lambda f: T.text(f["filename"]) != ""), lambda f: F.element_at(F.split(F.lower(T.strip(f["filename"])), "/"), -1)),
        T.file_mentions(c["message"]),
    )
    acts = F.coalesce(F.col(activity), F.array().cast(ACTIVITY))
    df = T.barrier(df.select(*other, acts.alias("_acts"), shows_patches(acts).alias("_patches")))
    every = F.array_distinct(F.flatten(F.flatten(F.transform("_acts", lambda r: F.transform(commits_of(r), known)))))
    one = lambda r: F.struct(
        r["repo"].alias("repo"), T.norm_repo(r["repo"]).alias("norm"), T.content_tokens(r["repo"]).alias("name_tokens"), T.words(r["repo"]).alias("name_words"),
        F.transform(commits_of(r), lambda c: T.words(commit_text(c, F.col("_patches")))).alias("words"),
    )
    df = T.barrier(df.select(*other, F.transform("_acts", one).alias("_repos"), F.coalesce(every, T.no_words()).alias("real_files")))
    tokens = lambda w: F.array_distinct(F.transform(F.filter(w, T.is_content), T.stem))
    two = lambda r: F.struct(
        r["repo"].alias("repo"), r["norm"].alias("norm"), r["name_tokens"].alias("name_tokens"), r["name_words"].alias("name_words"),
        F.transform(r["words"], tokens).alias("commits"), F.array_distinct(F.flatten(r["words"])).alias("surface"),
    )
    df = T.barrier(df.select(*other, F.transform("_repos", two).alias("_repos"), "real_files"))
    three = lambda r: F.struct(
        r["repo"].alias("repo"), r["norm"].alias("norm"), r["name_tokens"].alias("name_tokens"), r["name_words"].alias("name_words"), r["surface"].alias("surface"),
        F.when(F.size(r["commits"]) > 0, r["commits"]).otherwise(F.array(r["name_tokens"])).alias("commits"),
        F.array_union(r["name_tokens"], F.flatten(r["commits"])).alias("source"),
    )
    return T.barrier(df.select(*other, F.transform("_repos", three).alias("repos"), "real_files"))


def merge(days: DataFrame, by: str, order: str, activity: str = "activity") -> DataFrame:
    """One record for each value of by: repositories of all its rows in first-seen order, their commits one after
    the other in row order, repeats kept. The parts of a group are put in order within its one output row."""
    rows = days.select(by, F.col(order).alias("_o"), F.posexplode(activity).alias("_k", "_r"))
    rows = rows.select(by, "_o", "_k", F.col("_r.repo").alias("repo"), commits_of(F.col("_r")).alias("commits"))
    each = F.transform(F.sort_array(F.collect_list(F.struct("_o", "_k", "commits"))), lambda x: x["commits"])
    repos = rows.groupBy(by, "repo").agg(F.min(F.struct("_o", "_k")).alias("_first"), F.flatten(each).alias("commits"))
    listed = F.sort_array(F.collect_list(F.struct("_first", "repo", "commits")))
    return repos.groupBy(by).agg(F.transform(listed, lambda x: F.struct(x["repo"].alias("repo"), x["commits"].alias("commits"))).cast(ACTIVITY).alias(activity))


def backfill(rows: DataFrame, commit_files: DataFrame, key: str, activity: str = "activity") -> DataFrame:
    """rows with each commit's files taken from commit_files (repo, sha, files), as they are shown; commits it doesn't
    have get none. The dimension is deduplicated and joined on the key's hash; Spark broadcasts it if it is small."""
    dim = commit_files.groupBy("repo", "sha").agg(F.first("files", True).alias("_files"))
    flat = rows.select(key, F.posexplode(activity).alias("_i", "_r"))
    flat = flat.select(key, "_i", F.col("_r.repo").alias("repo"), F.posexplode_outer(F.col("_r.commits")).alias("_j", "_c"))
    flat = flat.withColumn("sha", F.col("_c.sha")).join(dim, ["repo", "sha"], "left")
    files = shown_files(F.col("_files"))
    commit = F.struct(F.col("_c.sha").alias("sha"), F.col("_c.message").alias("message"), F.col("_c.url").alias("url"), files.alias("files"))
    ordered = F.sort_array(F.collect_list(F.when(F.col("_c").isNotNull(), F.struct("_j", commit.alias("c")))))
    flat = flat.groupBy(key, "_i", "repo").agg(F.transform(ordered, lambda x: x["c"]).alias("commits"))
    listed = F.sort_array(F.collect_list(F.struct("_i", "repo", "commits")))
    done = flat.groupBy(key).agg(F.transform(listed, lambda x: F.struct(x["repo"].alias("repo"), x["commits"].alias("commits"))).cast(ACTIVITY).alias("_new"))
    out = rows.join(done, key, "left")
    empty = F.coalesce(F.col("_new"), F.array().cast(ACTIVITY))
    return out.select(*[empty.alias(activity) if c == activity else F.col(f"`{c}`") for c in rows.columns])


KEPT = f"repo string, sha string, files {FILES}"


def enrich(rows: DataFrame, folder: str, fetch: Callable[[DataFrame], DataFrame], key: str, activity: str = "activity") -> DataFrame:
    """rows with each commit's files, from a table of versions in folder that is kept between runs; what it lacks is fetched first.

    The commits that rows name, each once, are held against those that the table has, keys alone, and fetch is given only
    the others: (repo, sha) to (repo, sha, files), without a row for one that isn't there. Each of them is kept, without files too,
    so the next run asks for new ones only."""
    spark = rows.sparkSession
    repos = rows.select(F.explode(activity).alias("r")).select(F.col("r.repo").alias("repo"), F.explode("r.commits").alias("c"))
    named = repos.select("repo", F.col("c.sha").alias("sha")).filter("repo is not null and sha is not null").distinct()
    have = versions.read(spark, folder, schema=KEPT)
    lacking = staged(named.join(have.select("repo", "sha"), ["repo", "sha"], "left_anti"), "lacking")
    if not lacking.isEmpty():
        found = lacking.join(fetch(lacking).groupBy("repo", "sha").agg(F.first("files", True).cast(FILES).alias("files")), ["repo", "sha"], "left")
        versions.append(found.select("repo", "sha", "files"), folder)
    return backfill(rows, versions.read(spark, folder, schema=have.schema), key, activity)


def bundles(rows: DataFrame, key: str, n: int, least: int, most: int, seed: int = 42) -> DataFrame:
    """(bundle, key): n samples of least to most rows each (all rows, if there are fewer), without replacement.

    Rows are ranked once by a hash of seed and key. A bundle cuts the ranks into as many ranges as it has members and
    takes a hashed rank of each, so only the rows that are drawn are ever joined to a bundle."""
    from .corpus import cumulated

    mark = F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary"))
    ranked = cumulated(rows.select(key, mark.alias("_h")), "_h")
    count = rows.count()
    size = F.least(T.drawn(F.lit(seed), F.col("bundle"), F.lit("size")) % (most - least + 1) + least, F.lit(count))
    numbered = rows.sparkSession.range(n).select(F.col("id").alias("bundle")).withColumn("_size", size).filter("_size > 0")
    each = numbered.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_size") - 1)))
    low, high = F.floor(F.col("_j") * count / F.col("_size")), F.floor((F.col("_j") + 1) * count / F.col("_size"))
    drawn = each.select("bundle", (low + T.drawn(F.lit(seed), F.col("bundle"), F.col("_j")) % (high - low)).alias("_before"))
    return ranked.join(drawn, "_before").select("bundle", key)
