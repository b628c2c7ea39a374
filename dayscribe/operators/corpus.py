"""Corpus construction: digest bodies, prompts, splits and chat projections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.files import FILES
from ..stage import spread_join, staged
from .activity import commits_of, shows_patches

# Fixed value: prompts must equal those that digests were written for.
INSTRUCTION = (
    "Write a developer journal entry in markdown with:\n"
    "1. `## Summary` — what shipped, what you were deep in, anything notable across repos\n"
    "2. `## Per-Repo Activity` — one `### repo` subsection per repo, 1-2 sentences each. "
    "Use just the repo name, not the owner/repo path (e.g. `### {example}`, not `### {user}/{example}`).\n"
    "Tone: retrospective and observational, like a code blog post. "
    "No 'next steps', no 'you should'. Just what happened and why it matters.\n"
    "Ground every claim in the commit messages and diffs above. "
    "Do not invent features, filenames, or behaviors not evidenced in the data."
)


def extract_target(markdown: str | Column, user: str) -> Column:
    """The digest's body: from the first `# Developer Journal`, else the first line that starts with `## Summary`;
    owner taken off section headers, a fence left at the end taken off. Null if there is neither."""
    c = T.col(markdown)
    title = F.locate("# Developer Journal", c)
    summary = F.regexp_extract(c, r"(?s)\A(.*?)(?m:^)## Summary", 1)
    start = F.when(title > 0, title).when(c.rlike(r"(?m)^## Summary"), F.length(summary) + 1)
    body = T.strip(F.substring(c, start, F.length(c)))
    body = F.regexp_replace(body, rf"(?m)^### {re.escape(user)}/", "### ")
    return F.when(start.isNotNull(), F.regexp_replace(body, r"\n```\s*\z", ""))


def build_prompt(date: Column, days: Column, user: str, activity: str | Column, instruction: str = INSTRUCTION, example: str = "project") -> Column:
    """Heading, each repository with commits, each commit's short id and first line, its files' counts, and patches if
    the record is sparse; then the instruction. A missing id, message, name or count reads as empty or 0."""
    acts, patches, zero = T.col(activity), shows_patches(activity), F.lit(0)

    def file_patch(f: Column) -> Column:
        rows = F.transform(F.split(f["patch"], "\n"), lambda x: F.concat(F.lit("    "), x, F.lit("\n")))
        return F.when(T.text(f["patch"]) == "", "").otherwise(F.concat(F.lit("  diff "), T.text(f["filename"]), F.lit(":\n"), F.array_join(rows, "")))

    def commit(c: Column) -> Column:
        head = F.concat(F.lit("- "), F.substring(T.text(c["sha"]), 1, 7), F.lit(": "), F.element_at(F.split(T.text(c["message"]), "\n"), 1), F.lit("\n"))
        files = F.coalesce(c["files"], F.array().cast(FILES))
        stat = lambda f: F.concat(T.text(f["filename"]), F.lit(" +"), F.coalesce(f["additions"], zero), F.lit(" -"), F.coalesce(f["deletions"], zero))
        stats = F.concat(F.lit("  "), F.array_join(F.transform(files, stat), ", "), F.lit("\n"))
        diffs = F.when(patches, F.array_join(F.transform(files, file_patch), "")).otherwise("")
        return F.concat(head, F.when(F.size(files) > 0, F.concat(stats, diffs)).otherwise(""))

    repo = lambda r: F.concat(F.lit("**"), r["repo"], F.lit("**\n"), F.array_join(F.transform(commits_of(r), commit), ""), F.lit("\n"))
    busy = F.filter(acts, lambda r: F.size(commits_of(r)) > 0)
    head = F.concat(F.lit(f"GitHub commits for {user}, "), date, F.lit(" (last "), days.cast("string"), F.lit(" day(s)):\n"))
    return F.concat(head, F.array_join(F.transform(busy, repo), ""), F.lit(instruction.replace("{user}", user).replace("{example}", example)))


def has_commits(prompt: str | Column) -> Column:
    """Whether the prompt lists a commit before its first empty line."""
    return F.element_at(F.split(T.col(prompt), "\n\n"), 1).contains("- ")


#: Equal rows that are numbered by one task, and ranges whose sums are broadcast (16 bytes each).
EQUAL, RANGES = 1 << 16, 100_000


def cumulated(df: DataFrame, order: str, weight: Column | None = None, rows_a_bucket: int = 1 << 20) -> DataFrame:
    """Adds _before: the sum of weight (1 a row if not given) of all rows earlier in order; nulls come first.

    Keys (the order, and a hash of the row for ties) are range-partitioned into buckets, more the more there are, and
    staged, so a key's bucket stays what it is however often the plan runs. Only the buckets' sums go into one task, one a
    million keys; the rows themselves are shuffled once, to their keys, those of very many equal rows not at all. Rows of equal
    order are ranked by the hash, equal rows, whose weights are equal, in any order; very many of them by parts."""
    kinds = dict(df.dtypes)
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if "map<" not in kinds[c] and "variant" not in kinds[c]])
    at = F.struct(F.col(order).alias("at"))  # equal to itself where the order is null, too
    rows = df.withColumn("_u", F.monotonically_increasing_id()).withColumn("_o", at).withColumn("_t", tie).withColumn("_w", F.lit(1) if weight is None else weight)
    key = ["_o", "_t"]
    keys = staged(rows.groupBy(*key).agg(F.sum("_w").alias("_n"), F.count(F.lit(1)).alias("_c")), "keys")
    parts = keys.count() // rows_a_bucket + 1
    dealt = staged(keys.repartitionByRange(parts, *key).withColumn("_b", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_b").agg(F.sum("_n").alias("_all"))
    base = F.coalesce(F.sum("_all").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_b", base.alias("_base"))
    within = Window.partitionBy("_b").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_l", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    placed = local.join(F.broadcast(sums) if parts <= RANGES else sums, "_b").select(*key, (F.col("_base") + F.col("_l")).alias("_s"), "_c")
    total, most = keys.agg(F.sum("_c"), F.max("_c")).first()
    parts_of = F.ceil(F.col("_c") / EQUAL)
    out = spread_join(rows, placed.withColumn("_m", parts_of).withColumnRenamed("_c", "_k"), key, "_k", total or 0)
    if (most or 0) > EQUAL:
        # Parts by a number that each row has from where it is read.
        out = staged(out.withColumn("_p", F.pmod(F.xxhash64("_u"), F.col("_m"))), "numbered")
        sizes = out.filter("_m > 1").groupBy(*key, "_p").agg(F.sum("_w").alias("_all"))
        below = F.coalesce(F.sum("_all").over(Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sizes = sizes.select(*key, "_p", below.alias("_below"))
        many = out.filter("_m > 1").join(F.broadcast(sizes) if total <= RANGES * EQUAL else sizes, [*key, "_p"])
        out = many.unionByName(out.filter("_m <= 1").withColumn("_below", F.lit(0)))
    else:
        out = out.withColumn("_p", F.lit(0).cast("long")).withColumn("_below", F.lit(0))
    equal = F.coalesce(F.sum("_w").over(Window.partitionBy(*key, "_p").orderBy("_u").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_s") + F.col("_below") + equal).alias("_before"))


def lowest_drawn(df: DataFrame, n: int, *parts: Column) -> DataFrame:
    """The n rows of df (all, if there are fewer) with the smallest hash of parts, with _place from 0 in that order; of equal hashes in
    the order of a hash of the row. Only rows under a bound that n and the number of rows give are put in order."""
    total, kinds = df.count(), dict(df.dtypes)
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if "map<" not in kinds[c] and "variant" not in kinds[c]])
    rows, share = df.withColumn("_m", F.md5(F.concat_ws(":", *parts).cast("binary"))), (n + 6 * n**0.5 + 32) / max(total, 1)
    while True:
        few = rows.filter(F.conv(F.substring("_m", 1, 8), 16, 10).cast("long") < int(min(1.0, share) * 2**32))
        if share >= 1 or few.count() >= n:
            break
        share *= 2
    # As many rows as are asked for and some more, whatever the table's size.
    place = F.row_number().over(Window.orderBy("_m", tie)) - 1
    return few.withColumn("_place", place).filter(F.col("_place") < n).drop("_m")


def split_every(df: DataFrame, order: str, every: int = 9, **how) -> DataFrame:
    """Adds split: eval for every k-th row in order, from the first, else train. Ranks count all rows of df, so call it
    before unusable rows go."""
    ranked = cumulated(df, order, **how)
    return ranked.withColumn("split", F.when(F.col("_before") % every == 0, "eval").otherwise("train")).drop("_before")


def with_previous(df: DataFrame, order: str, key: str, value: str, rows_a_bucket: int = 1 << 20, name: str = "previous") -> DataFrame:
    """df with name added: the value of the row before in (order, key) over all rows, null for the first; nulls come first.

    Rows are dealt into ranges, more the more there are, and staged; within a range the row before is the one above, and each
    range hands its last row on to the next that has rows. Only these last rows, one a range, are put in order together."""
    parts = df.count() // rows_a_bucket + 1
    dealt = staged(df.repartitionByRange(parts, order, key).withColumn("_b", F.spark_partition_id()), "ranges")
    place = F.struct(*[F.struct(F.col(c).isNotNull().alias("known"), F.col(c).alias("at")) for c in (order, key)])
    last = dealt.groupBy("_b").agg(F.max_by(F.struct(F.col(value).alias("v")), place).alias("_last"))
    handed = last.select("_b", F.lag("_last").over(Window.orderBy("_b")).alias("_last"))
    within = Window.partitionBy("_b").orderBy(order, key)
    above = F.lag(F.struct(F.col(value).alias("v"))).over(within)
    out = dealt.withColumn("_above", above).join(handed, "_b")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("_above", "_last")["v"].alias(name))


def lookback(prompt: str | Column) -> Column:
    """Days that an old prompt says it looks back on; 1 if it doesn't say."""
    found = F.regexp_extract(T.text(prompt), r"\(last (\d+) day", 1)
    return F.when(found == "", 1).otherwise(found.try_cast("int"))


def regenerate(df: DataFrame, user: str, prompt: str = "prompt", activity: str = "activity", date: str = "date") -> DataFrame:
    """df with prompts built anew from its records, for the days that the old ones name."""
    new = build_prompt(F.col(date), lookback(prompt), user, activity)
    return df.select(*[new.alias(prompt) if c == prompt else F.col(f"`{c}`") for c in df.columns])


def chat(prompt: str | Column, completion: str | Column) -> tuple[Column, Column]:
    """prompt and completion as lists of one message each, so that training can leave out the prompt by column."""
    said = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), T.col(c).alias("content")))
    return said("user", prompt).alias("prompt"), said("assistant", completion).alias("completion")
