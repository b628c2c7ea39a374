"""Orders as activity records, and the operators of corpora, sources and reports over them and other tables; the same in SQL.

A customer's record has their orders as commits, dealt into repositories by priority; an order's items are its files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import files as ff
from ..functions import text as T
from ..operators import activity as A
from ..operators import corpus, guard, preflight, report
from ..sources import files as src
from ..stage import dealt, shared_dir
from .scored import rounded

EXTENSIONS = ("py", "txt", "svelte", "LOCK", "Rs")


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def order_files(spark, d: str) -> DataFrame:
    """(l_orderkey, files): the items of each order as files, some of low signal, some without a count or a patch."""
    item = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"))
    item = item.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    end = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("l_partkey") % len(EXTENSIONS) + 1).cast("int"))
    name = F.when(F.col("l_partkey") % 7 == 0, "web/yarn.lock").otherwise(F.concat(F.lit("src/part_"), "l_partkey", F.lit("."), end))
    n = F.col("l_linenumber").cast("long")
    patch = F.when(n != 3, F.expr("repeat(concat('+', p_name, '\n'), cast(l_linenumber as int))"))
    file = F.struct(name.alias("filename"), F.col("q").alias("additions"), F.when(n != 2, n).alias("deletions"), patch.alias("patch"))
    listed = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "q", file.alias("f"))))
    return item.groupBy("l_orderkey").agg(F.transform(listed, lambda x: x["f"]).cast(ff.FILES).alias("files"))


def commits(spark, d: str, files: bool = True) -> DataFrame:
    """(o_custkey, o_orderkey, o_orderdate, repo, c): each order as a commit; its items are read where its files are wanted."""
    o = table(spark, d, "orders")
    if files:
        o = o.join(order_files(spark, d).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    else:
        o = o.withColumn("files", F.lit(None).cast(ff.FILES))
    key = F.col("o_orderkey").cast("string")
    message = F.concat(F.lit("order "), key, F.lit(" of "), "o_orderstatus", F.lit("\nsecond line"))
    c = F.struct(F.md5(key.cast("binary")).alias("sha"), message.alias("message"), F.lit(None).cast("string").alias("url"), "files").cast(ff.COMMIT)
    return o.select("o_custkey", "o_orderkey", "o_orderdate", F.concat(F.lit("shop/"), "o_orderpriority").alias("repo"), c.alias("c"))


def gathered(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, activity): commits of each repository by order, repositories by their first one."""
    listed = F.sort_array(F.collect_list(F.struct("o_orderkey", "c")))
    repos = rows.groupBy(*keys, "repo").agg(F.min("o_orderkey").alias("first"), F.transform(listed, lambda x: x["c"]).alias("commits"))
    every = F.sort_array(F.collect_list(F.struct("first", "repo", "commits")))
    return repos.groupBy(*keys).agg(F.transform(every, lambda x: F.struct(x["repo"].alias("repo"), x["commits"].alias("commits"))).cast(ff.ACTIVITY).alias("activity"))


def records(spark, d: str, files: bool = True) -> DataFrame:
    return gathered(commits(spark, d, files), "o_custkey")


def _flat(rows: DataFrame, *keys: str) -> DataFrame:
    """A row a repository of a record: its place, and the number and names of its commits."""
    rows = rows.select(*keys, F.posexplode("activity").alias("place", "r"))
    shas = F.md5(F.array_join(F.transform(A.commits_of(F.col("r")), lambda c: c["sha"]), ",").cast("binary"))
    return rows.select(*keys, "place", F.col("r.repo").alias("repo"), F.size("r.commits").alias("n_commits"), shas.alias("shas"))


def q_commits(spark, d):
    """Commits of each record, and whether they are few enough for patches to be shown."""
    return records(spark, d, files=False).select("o_custkey", A.total_commits("activity").alias("n_commits"), A.shows_patches("activity").alias("shows_patches"))


def q_top_files(spark, d):
    """The files that are shown of each order, their counts, and their cut patches."""
    rows = T.barrier(order_files(spark, d).select("l_orderkey", F.size("files").alias("n_files"), ff.shown_files(F.col("files")).alias("x")))
    stat = lambda f: F.concat(f["filename"], F.lit(" +"), f["additions"], F.lit(" -"), f["deletions"])
    patches = F.md5(F.array_join(F.transform("x", lambda f: f["patch"]), "|").cast("binary"))
    return rows.select("l_orderkey", "n_files", F.array_join(F.transform("x", stat), ", ").alias("stats"), patches.alias("patches"))


def q_regenerate(spark, d):
    """Prompts of all records, built anew for the days that old prompts name."""
    old = F.when(F.col("o_custkey") % 5 == 0, "no days").otherwise(F.concat(F.lit("GitHub (last "), F.col("o_custkey") % 5, F.lit(" day(s))")))
    rows = records(spark, d).select("o_custkey", F.col("o_custkey").cast("string").alias("date"), old.alias("prompt"), "activity")
    rows = T.barrier(corpus.regenerate(rows, "user")).filter(corpus.has_commits("prompt"))
    return rows.select("o_custkey", F.md5(F.col("prompt").cast("binary")).alias("prompt"), F.length("prompt").alias("n_chars"))


def q_backfill(spark, d):
    """Records without files, given those of a table that lacks some commits."""
    have = commits(spark, d).filter("o_orderkey % 4 <> 0").select("repo", F.col("c.sha").alias("sha"), F.col("c.files").alias("files"))
    rows = A.backfill(records(spark, d, files=False), have, "o_custkey")
    rows = rows.select("o_custkey", F.posexplode("activity").alias("i", "r")).select("o_custkey", "i", F.posexplode("r.commits").alias("j", "c"))
    name = lambda f: F.concat(f["filename"], F.lit(" +"), f["additions"], F.lit(" -"), f["deletions"])
    return rows.select("o_custkey", "i", "j", F.col("c.sha").alias("sha"), F.size("c.files").alias("n_files"), F.array_join(F.transform("c.files", name), ",").alias("files"))


def q_merge(spark, d):
    """A day's record a customer segment each, merged into bundles of seven days: commits and first-seen order."""
    named = commits(spark, d, files=False).join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    days = gathered(named.select(day.alias("day"), F.col("segment").alias("repo"), "o_orderkey", "c"), "day")
    return _flat(A.merge(days.withColumn("bundle", F.floor(F.col("day") / 7)), "bundle", "day"), "bundle")


def q_bundles(spark, d):
    """40 samples of two to five parts."""
    return A.bundles(table(spark, d, "part").select("p_partkey"), "p_partkey", 40, 2, 5)


def q_split(spark, d):
    """Every ninth order by key goes to eval."""
    return corpus.split_every(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


def q_chat(spark, d):
    """Each answer with what was asked before it as chat, written and read back."""
    turns = table(spark, d, "conversations")
    asked = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = turns.select("role", asked.alias("prompt"), F.col("text").alias("completion")).filter("role = 'assistant'")
    folder = _folder(spark, "chat")
    src.write_chat(rows, folder)
    back = spark.read.parquet(folder).select("prompt", "completion")
    one = lambda c: (F.size(c).alias(f"{c}_messages"), F.col(c)[0]["role"].alias(f"{c}_role"), F.col(c)[0]["content"].alias(f"{c}_content"))
    return back.select(*one("prompt"), *one("completion"))


def q_jsonl(spark, d):
    """Records written as JSON lines by split, read, written anew and read again; lines added that don't parse are set aside."""
    key = F.col("o_custkey")
    rows = records(spark, d).select(
        key.cast("string").alias("date"), F.lit("p").alias("prompt"), F.concat(F.lit('said "so", é\n'), key).alias("completion"), "activity", F.when(key % 9 == 0, "eval").otherwise("train").alias("split")
    )
    first, second = _folder(spark, "jsonl"), _folder(spark, "jsonl")
    src.write_jsonl(rows, first)
    src.write_jsonl(src.read_jsonl(spark, first).drop("_corrupt"), second)
    src.append(table(spark, d, "region").select(F.col("r_name").alias("date"), F.lit("q").alias("prompt")), second)
    back = src.read_jsonl(spark, second)
    shas = F.flatten(F.transform("activity", lambda r: F.transform(r["commits"], lambda c: c["sha"])))
    return back.select("date", "prompt", "completion", F.size("activity").alias("n_repos"), F.md5(F.array_join(shas, ",").cast("binary")).alias("shas"), F.col("_corrupt").isNotNull().alias("aside"))


def _ratios(spark, d) -> DataFrame:
    docs = T.barrier(dealt(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.words("text").alias("w")))
    return T.barrier(table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "quality", T.repetition_ratio(F.col("w")).alias("total")))


def q_calibrate(spark, d):
    """Repetition of the documents of each label, and those below the floor."""
    c = report.calibration(_ratios(spark, d), "quality")
    return c.select("quality", "n", rounded("mean"), rounded("least"), "below_floor")


def q_worst(spark, d):
    """A1: labelled documents below the floor."""
    return report.worst(_ratios(spark, d)).select("doc_id", rounded("total"))


def q_first(spark, d):
    """Mean of the first hundred events."""
    return report.first_n_mean(table(spark, d, "events"), "event_id", 100, "value").select(rounded("mean"))


def q_ticks(spark, d):
    """Events as rollouts, a tick a kind and day."""
    day = F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).cast("long")
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("run"), day.alias("step"), F.lit(0.5).alias("train_reward"), F.col("value").alias("total"), (F.col("event_id") % 100).alias("n_tokens"),
        (F.col("event_id") % 7).alias("ref_tokens"), F.when(F.col("event_id") % 11 > 0, F.col("value") > 50).alias("truncated"),
    )
    means = [rounded(c) for c in ("train_reward", "spotcheck_total", "tokens", "truncated_rate")]
    return guard.ticks(rows).select("run", "step", *means, "ref_tokens", "rollouts")


def history(spark, d: str) -> DataFrame:
    """Ticks of 48 runs, kinds of events by some of their users: in one sixth rewards part, in others texts are short or cut off."""
    day = F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).cast("long")
    part = F.col("user_id") % 12
    e = table(spark, d, "events").withColumn("value", F.col("value").cast("decimal(18,6)")).withColumn("part", part)
    per = e.groupBy(F.concat("event_type", F.lit("/"), F.col("part").cast("string")).alias("run"), F.floor(day / 5).alias("step"), "part").agg(
        F.avg("value").cast("double").alias("a"), F.min("value").cast("double").alias("m"), F.count_if(F.col("value") > 60).alias("high"), F.count(F.lit(1)).alias("n")
    )
    kind = F.col("part") % 6
    ref = F.when(kind == 0, 0).when(kind == 1, 100).when(kind == 2, None).otherwise(40).cast("long")
    cut = F.when(kind == 2, F.col("high") * 3 / F.col("n")).otherwise(F.col("high") / F.col("n"))
    return per.select("run", "step", (F.col("a") / 100).alias("train_reward"), F.when(kind == 0, -F.col("a") / 50).otherwise(F.col("m") / 100).alias("spotcheck_total"), F.col("a").alias("tokens"), ref.alias("ref_tokens"), cut.alias("truncated_rate"))


def q_guard(spark, d):
    """First five days at which a run fires the guard over three months, and by which rule."""
    return guard.first_abort(history(spark, d))


def q_plan(spark, d):
    """M4: documents that fit a budget, by a word count that stands in for tokens; the plan beside each."""
    words = T.barrier(dealt(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.size(T.words("text")).alias("n")))
    p = preflight.plan(words, "n", 8, 9, 1264, 3 * 2**29, most_dropped=1.0)
    told = {"max_prompt": p.max_prompt, "max_seq": p.max_seq, "spike": p.spike, "dropped": p.dropped, "total": p.total}
    return p.rows.select("doc_id", "n", "keep", *[F.lit(v).cast("long").alias(k) for k, v in told.items()])


def q_ladder_table(spark, d):
    """The ladder of events as a markdown table."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("model"), F.least(F.lit(1.0), F.col("value") / 200).alias("total"), (F.col("value") > 50).alias("truncated"))
    return report.ladder_markdown(report.ladder(rows))


QUERIES = (
    q_commits, q_top_files, q_regenerate, q_backfill, q_merge, q_bundles, q_split, q_chat, q_jsonl, q_calibrate, q_worst, q_first, q_ticks, q_guard, q_plan, q_ladder_table,
)

_NL = "chr(10)"
_W = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')"
#: fi: items as files (l_orderkey, k, name, a, b, patch, low); cm: commits (cust, okey, odate, repo, sha, line).
_RECORDS = f"""
    fi as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity::bigint) as k,
                  case when l_partkey % 7 = 0 then 'web/yarn.lock' else 'src/part_' || l_partkey || '.' || ['py', 'txt', 'svelte', 'LOCK', 'Rs'][(l_partkey % 5 + 1)::int] end as name,
                  l_quantity::bigint as a, case when l_linenumber <> 2 then l_linenumber else 0 end as b, l_partkey % 7 = 0 or l_partkey % 5 = 3 as low,
                  case when l_linenumber <> 3 then repeat('+' || p_name || {_NL}, l_linenumber::int) else '' end as patch from lineitem join part on p_partkey = l_partkey),
    cm as (select o_custkey as cust, o_orderkey as okey, o_orderdate::date as odate, 'shop/' || o_orderpriority as repo, md5(o_orderkey::varchar) as sha, 'order ' || o_orderkey || ' of ' || o_orderstatus as line,
                  count(*) over (partition by o_custkey) <= 5 as shown from orders)"""
#: The patch of a file as it is shown, from lines l of it.
_SHOWN = f"case when low or patch = '' then '' else array_to_string(list_concat(list_transform(string_split(patch, {_NL})[1:5], lambda x: x[1:300]), case when len(string_split(patch, {_NL})) > 5 then ['…'] else [] end), {_NL}) end"
_PLACES = """rp as (select cust, repo, min(okey) as f from cm group by cust, repo), pl as (select cust, repo, row_number() over (partition by cust order by f) - 1 as i from rp)"""
_GRAMS3 = "list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))"
_RATIOS = f"ra as (select doc_id, quality, case when len(w) < 12 then 1.0::double else len(list_distinct({_GRAMS3})) / len({_GRAMS3}) end as total from labels join (select doc_id, {_W} as w from documents) using (doc_id))"
_DRAWN = lambda *x: f"('0x' || substr(md5({' || chr(58) || '.join(x)}), 1, 8))::bigint"

ORACLE_SQL = {
    "q_commits": "select o_custkey, count(*)::int as n_commits, count(*) <= 5 as shows_patches from orders group by o_custkey",
    "q_top_files": f"""
        with {_RECORDS} select l_orderkey, count(*)::int as n_files, string_agg(name || ' +' || a || ' -' || b, ', ' order by k) filter (k <= 5) as stats,
               md5(string_agg({_SHOWN}, '|' order by k) filter (k <= 5)) as patches from fi group by l_orderkey""",
    "q_regenerate": f"""
        with {_RECORDS}, {_PLACES},
        ft as (select l_orderkey, '  ' || string_agg(name || ' +' || a || ' -' || b, ', ' order by k) || {_NL} as stats,
                      string_agg(case when patch = '' then '' else '  diff ' || name || ':' || {_NL} || array_to_string(list_transform(string_split(patch, {_NL}), lambda x: '    ' || x || {_NL}), '') end, '' order by k) as diffs
               from fi group by l_orderkey),
        ct as (select cust, repo, string_agg('- ' || sha[1:7] || ': ' || line || {_NL} || coalesce(stats || case when shown then diffs else '' end, ''), '' order by okey) as t
               from cm left join ft on l_orderkey = okey group by cust, repo),
        pr as (select cust, 'GitHub commits for user, ' || cust || ' (last ' || case when cust % 5 = 0 then 1 else cust % 5 end || ' day(s)):' || {_NL}
                      || string_agg('**' || repo || '**' || {_NL} || t || {_NL}, '' order by i)
                      || '{corpus.INSTRUCTION.replace("{user}", "user").replace("{example}", "project").replace("'", "''")}' as prompt from ct join pl using (cust, repo) group by cust)
        select cust as o_custkey, md5(prompt) as prompt, length(prompt)::int as n_chars from pr""",
    "q_backfill": f"""
        with {_RECORDS}, {_PLACES}, ff as (select l_orderkey, count(*) as n, string_agg(name || ' +' || a || ' -' || b, ',' order by k) as files from fi where k <= 5 group by l_orderkey)
        select cust as o_custkey, i::int as i, (row_number() over (partition by cust, repo order by okey) - 1)::int as j, sha, coalesce(n, 0)::int as n_files, coalesce(files, '') as files
        from cm join pl using (cust, repo) left join ff on l_orderkey = okey and okey % 4 <> 0""",
    "q_merge": f"""
        with {_RECORDS}, o as (select datediff('day', date '1970-01-01', odate) as day, okey, c_mktsegment as repo, sha from cm join customer on c_custkey = cust),
             s as (select day // 7 as bundle, repo, count(*)::int as n_commits, min(day * 1000000000000 + okey) as f, md5(string_agg(sha, ',' order by day, okey)) as shas from o group by all)
        select bundle, (row_number() over (partition by bundle order by f) - 1)::int as place, repo, n_commits, shas from s""",
    "q_bundles": f"""
        with p as (select p_partkey, row_number() over (order by md5('42:' || p_partkey)) - 1 as place, count(*) over () as n from part),
             b as (select x as bundle, least({_DRAWN("'42'", "x", "'size'")} % 4 + 2, (select count(*) from part)) as size from (select unnest(range(0, 40)) as x)),
             e as (select bundle, size, unnest(range(0, size)) as j, (select count(*) from part) as n from b),
             w as (select bundle, j * n // size as low, (j + 1) * n // size as high, j from e),
             t as (select bundle, low + {_DRAWN("'42'", "bundle", "j")} % (high - low) as place from w)
        select bundle, p_partkey from t join p using (place)""",
    "q_split": "select o_orderkey, case when (row_number() over (order by o_orderkey) - 1) % 9 = 0 then 'eval' else 'train' end as split from orders",
    "q_chat": """
        select 1 as prompt_messages, 'user' as prompt_role, asked as prompt_content, 1 as completion_messages, 'assistant' as completion_role, text as completion_content
        from (select role, text, lag(text) over (partition by conv_id order by turn) as asked from conversations) where role = 'assistant'""",
    "q_jsonl": f"""
        with {_RECORDS}, {_PLACES}, x as (select cust, count(distinct repo)::int as n, md5(string_agg(sha, ',' order by i, okey)) as shas from cm join pl using (cust, repo) group by cust)
        select cust::varchar as date, 'p' as prompt, 'said "so", é' || {_NL} || cust as completion, n as n_repos, shas, false as aside from x
        union all select r_name, 'q', null, null, null, true from region""",
    "q_calibrate": f"with {_RATIOS} select quality, count(*) as n, round(avg(total) + 1e-10::double, 6) as mean, round(min(total) + 1e-10::double, 6) as least, count(*) filter (total < 0.85::double) as below_floor from ra group by quality",
    "q_worst": f"with {_RATIOS} select doc_id, round(total + 1e-10::double, 6) as total from ra where total < 0.85::double",
    "q_first": "select round(avg(value) + 1e-10::double, 6) as mean from (select value from events order by event_id limit 100)",
    "q_ticks": """
        select event_type as run, datediff('day', date '2020-01-01', ts::date) as step, 0.5::double as train_reward, round(avg(value) + 1e-10::double, 6) as spotcheck_total, round(avg(event_id % 100) + 1e-10::double, 6) as tokens,
               round(avg(case when event_id % 11 > 0 then (value > 50)::int::double end) + 1e-10::double, 6) as truncated_rate, max(event_id % 7) as ref_tokens, count(*) as rollouts from events group by 1, 2""",
    "q_guard": """
        with e as (select event_type || '/' || (user_id % 12) as run, datediff('day', date '2020-01-01', ts::date) // 5 as step, user_id % 6 as kind, value::decimal(18, 6) as value from events),
             t as (select run, step, kind, avg(value)::double as a, min(value)::double as m, count(*) filter (value > 60) as high, count(*) as n from e group by run, step, kind),
             x as (select run, step, a / 100 as reward, case when kind = 0 then -a / 50 else m / 100 end as heldout, case when kind in (0, 2) then null when kind = 1 then a / 100 else a / 40 end as ratio,
                          case when kind = 2 then high * 3 / n else high / n end as cut from t),
             w as (select run, step, count(*) over l as n, last(reward) over l - first(reward) over l as gain, last(heldout) over l - first(heldout) over l as drop,
                          avg(ratio) over l as ratio, avg(cut) over l as cut from x window l as (partition by run order by step rows between 2 preceding and current row)),
             r as (select run, step, case when gain >= 0.05::double and drop <= -0.10::double then 'diverged' when ratio < 0.5::double then 'collapsed' when cut > 0.5::double then 'truncated' end as reason from w where n >= 3)
        select run, min(step) as step, arg_min(reason, step) as reason from r where reason is not null group by run""",
    "q_plan": f"""
        with w as (select doc_id, len({_W}) as n from documents), c as (select floor(sqrt(1610612736 / (8 * 9 * 4)))::bigint as most)
        select doc_id, n::int as n, n <= most - 1264 as keep, most - 1264 as max_prompt, most as max_seq, 8 * 9 * most * most * 4 as spike,
               (select count(*) from w, c where n > most - 1264) as dropped, (select count(*) from w) as total from w, c""",
    "q_ladder_table": f"""
        with l as (select event_type as model, avg(least(1.0::double, value / 200)) as mean, count(*) as n, count(*) filter (value > 50) as cut from events group by 1),
             b as (select *, round_even(mean * 24, 0)::int as blocks from l)
        select '| model | | mean | n | truncated |' || {_NL} || '|---|---|---|---|---|' || {_NL}
               || string_agg('| ' || model || ' | `' || repeat('█', blocks) || repeat('░', 24 - blocks) || '` | ' || printf('%.4f', mean) || ' | ' || n || ' | ' || cut || ' |', {_NL} order by mean desc, model) as markdown from b""",
}
