"""Conversations as digests and records: the scorer, its mutations and its parsing over them, and the same in SQL.

An assistant turn is a section, the user turn before it a repository with one commit. Digests are bent by
conversation so that each rule has some that break it. The SQL parses the digests' text by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.files import ACTIVITY
from ..operators import corpus, mutate, report, scoring
from ..operators import activity as A
from ..operators.sections import with_sections

#: What is added to the sections of conversations, by their number modulo BENT.
BENT = 13
ADDED = {
    1: " Next steps: you should rest.", 2: " See src/Ghost.py, node.js and src/t0.py.", 3: " GPT-4 and claude helped, as gpt-4 does.", 4: " Three active repos and 2 git projects, 1 repository.",
    5: " " + "again and again we go " * 40,
}
SAME = "Beacon lamps dim at dawn once lux thresholds are crossed while harbor pilots sleep"
SUMMARY = "Nothing much went on in the whole of that long and quiet week"


def digests(spark, d: str) -> DataFrame:
    """(conv_id, digest, activity, previous, cut) of each conversation."""
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    before = F.lag(T.text("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    bent, n = F.col("conv_id") % BENT, (F.col("turn") - 1).cast("string")
    added = T.text("text")
    for k, words in ADDED.items():
        added = F.when(bent == k, F.concat(T.text("text"), F.lit(words))).otherwise(added)
    body = F.when(bent == 9, F.coalesce(before, F.lit(""))).when(bent == 10, F.lit(SAME)).otherwise(added)
    name = F.when(bent == 7, F.lit("me/t0")).when(bent == 8, F.concat(F.lit("x"), n)).otherwise(F.concat(F.lit("me/t"), n))
    rows = turns.select("conv_id", "turn", "role", T.text("text").alias("text"), body.alias("body"), name.alias("name"), before.alias("b"))
    listed = lambda role, *c: F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", *c))))
    # Scoring is all work and few bytes: as many tasks as shuffles have, however small the table.
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    convs = rows.groupBy("conv_id").agg(listed("user", "text").alias("u"), listed("assistant", "name", "body", "b").alias("a"))
    turn = lambda x: x["turn"].cast("string")
    file = lambda name, patch: F.struct(name.alias("filename"), F.lit(1).cast("bigint").alias("additions"), F.lit(0).cast("bigint").alias("deletions"), patch.alias("patch"))
    files = lambda x: F.when(
        F.col("conv_id") % 2 == 0,
        F.array(file(F.concat(F.lit("src/T"), turn(x), F.lit(".py")), F.concat(F.lit("+def helper"), turn(x), F.lit("(rows)"))), file(F.lit("yarn.lock"), F.lit("+sealed"))),
    )
    commit = lambda x: F.struct(F.lit("").alias("sha"), x["text"].alias("message"), F.lit(None).cast("string").alias("url"), files(x).alias("files"))
    # Where names meet, the first repository of a name counts.
    owner = lambda x: F.when((bent == 12) & (x["turn"] > 1), F.concat(F.lit("more"), turn(x), F.lit("/t0"))).otherwise(F.concat(F.lit("conv/t"), turn(x)))
    bent = F.col("conv_id") % BENT
    acts = F.transform("u", lambda x: F.struct(owner(x).alias("repo"), F.array(commit(x)).alias("commits"))).cast(ACTIVITY)
    one = lambda x: F.concat(F.lit("### "), x["name"], F.lit("\n\n"), x["body"], F.lit("\n"))
    asked = F.coalesce(F.try_element_at("u", F.lit(1))["text"], F.lit(""))
    told = F.coalesce(F.try_element_at("a", F.lit(1))["body"], F.lit(""))
    summary = F.when(F.col("conv_id") % 3 == 0, told).when(F.col("conv_id") % 3 == 1, asked).otherwise(F.lit(SUMMARY))
    stray = F.when(bent == 11, "Stray prose about src/lost.rs.\n\n").otherwise("")
    head = F.concat(F.lit("# Developer Journal\n\n## Summary\n\n"), summary, F.lit("\n\n## Per-Repo Activity\n\n"), stray)
    convs = convs.select("conv_id", F.concat(head, F.array_join(F.transform("a", one), "\n")).alias("digest"), acts.alias("activity"))
    previous = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("Earlier that week. "), F.col("digest"))).when(F.col("conv_id") % 4 == 1, F.lit(SUMMARY))
    return T.barrier(convs).select("*", previous.alias("previous"), (F.col("conv_id") % 5 == 0).alias("cut"))


def rounded(c: str):
    """To 6 digits; a value on the edge goes up, however its sum was taken."""
    return F.round(F.col(c) + 1e-10, 6).alias(c)


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[rounded(c) for c in ("format", "coverage", "grounding", *[f"p_{k}" for k in scoring.COMPONENTS], "penalties", "total")])


def q_score(spark, d):
    """F, C, G, N1-N11, T, L8-L15, G1-G4: score and every penalty of those digests."""
    return _rounded(scoring.score(digests(spark, d), previous="previous", truncated="cut", detail=True), "conv_id")


def q_sections(spark, d):
    """Summary and sections of those digests, an orphan one under the per-repo header among them."""
    rows = with_sections(digests(spark, d).select("conv_id", "digest")).select("conv_id", "summary", F.posexplode("sections").alias("place", "s"))
    return rows.select("conv_id", "place", "summary", F.col("s.name").alias("name"), F.col("s.body").alias("body"))


def q_mutated(spark, d):
    """Each mutation of those digests, as the md5 of its text."""
    rows = mutate.mutated(digests(spark, d).select("conv_id", "digest"))
    return rows.select("conv_id", "mutation", "tier", F.md5(F.col("digest").cast("binary")).alias("text"), F.length("digest").alias("n_chars"))


def q_mutations(spark, d):
    """How the score of those digests moves under each mutation."""
    t = report.mutation_report(mutate.deltas(digests(spark, d), "conv_id"))
    return t.select("mutation", "tier", *[rounded(c) for c in ("mean_delta", "min_delta", "max_delta")], "violations")


def q_soup(spark, d):
    """300 digests of words that ground in nothing, over records drawn by hash: the score of each, and whether it is over the ceiling."""
    scores = scoring.score(mutate.soup_digests(spark, digests(spark, d), 300, key="conv_id"))
    return scores.select("sample", F.size("activity").alias("n_repos"), rounded("total"), (F.col("total") > 0.55).alias("over"))


def odd_scores(spark, d) -> DataFrame:
    return scoring.score(mutate.odd_digests(digests(spark, d), "conv_id"), detail=True)


def q_odd(spark, d):
    """The score of an odd digest against an odd record, of each conversation."""
    return _rounded(odd_scores(spark, d), "conv_id")


def q_properties(spark, d):
    """Each invariant over those scores: rows that it is about, rows that break it, and the first of them."""
    return mutate.invariants(odd_scores(spark, d), "conv_id")


def q_step_means(spark, d):
    """Means of the scores of those digests, a step eight conversations."""
    rows = scoring.score(digests(spark, d), previous="previous", truncated="cut").withColumn("step", F.floor(F.col("conv_id") / 8)).withColumn("truncated", F.col("cut"))
    return report.step_means(rows).select("step", *[rounded(c) for c in ("format", "coverage", "grounding", "penalties", "total", "truncated_rate")])


def q_grounding(spark, d):
    """What each repository of those records grounds a digest in, by numbers and by the words themselves."""
    rows = A.with_grounding(digests(spark, d).select("conv_id", "activity")).select("conv_id", F.array_join("real_files", ",").alias("files"), F.posexplode("repos").alias("place", "r"))
    joined = lambda c: F.md5(F.array_join(F.array_sort(c), " ").cast("binary"))
    return rows.select("conv_id", "place", "files", F.col("r.norm").alias("norm"), F.size("r.commits").alias("n_commits"), joined(F.col("r.source")).alias("source"), joined(F.col("r.surface")).alias("surface"))


def q_prompt(spark, d):
    """The prompts of those records."""
    rows = digests(spark, d).select("conv_id", corpus.build_prompt(F.col("conv_id").cast("string"), F.lit(1), "user", "activity").alias("prompt"))
    return rows.filter(corpus.has_commits("prompt")).select("conv_id", F.md5(F.col("prompt").cast("binary")).alias("prompt"), F.length("prompt").alias("n_chars"))


def q_target(spark, d):
    """The bodies of those digests in files with an introduction, the owner in headers and a fence left at the end;
    some without the title, some with neither title nor summary."""
    k = F.col("conv_id") % 3
    untitled = F.regexp_replace(F.col("digest"), "^# Developer Journal\n\n", "")
    text = F.when(k == 0, F.col("digest")).when(k == 1, untitled).otherwise(F.lit("no digest at all\n### me/x"))
    rows = digests(spark, d).select("conv_id", corpus.extract_target(F.concat(F.lit("What I did:\n"), text, F.lit("\n```\n")), "me").alias("t"))
    return rows.select("conv_id", F.md5(F.col("t").cast("binary")).alias("target"), F.length("t").alias("n_chars"))


QUERIES = (q_score, q_sections, q_mutated, q_mutations, q_soup, q_odd, q_properties, q_step_means, q_grounding, q_prompt, q_target)

# The same in SQL. Values are written out; nothing is taken from the engine but the words that are added to digests.
# Fixed values.
STOP = """a an and are as at be been but by can did do does for from had has have how i in into is it its just like more new not of on or our out over should so some
such than that the their them then there these they this to up use used using was we were what when which while who will with would you your also added fix fixed
fixes update updated updates change changes changed name version private public main module modules scripts type types author engines description dependencies
devdependencies peerdependencies license""".split()
CODE = """js jsx ts tsx py go rs c h cpp hpp java kt kts svelte vue json yaml yml md css html xml sh toml sql rb php dart gradle cfg ini env proto""".split()
SOUP = "refactor polish cleanup tweak adjust shuffle nudge wander browse scroll ponder humdrum routine ordinary steady gentle quiet modest".split()
FAKE, GHOST = "The new src/app/Widget.svelte component landed cleanly.", "Unverified claims about src/app/Ghost.svelte appeared from nowhere."
UNGROUNDED = "The mango giraffe session kept everything moving overall, with steady window throughout and a general sense of forward motion across the wider landscape."
# End of the fixed values.


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9_]+')"


_CONTENT = f"(length(w) >= 3 and not list_contains({_list(STOP)}, w))"
_STEM = (
    "case when length(w) <= 4 then w when w like '%ing' then w[:-4] when w like '%ies' then w[:-4] when w like '%ed' then w[:-3] "
    "when w like '%es' then w[:-3] when w like '%s' then w[:-2] else w end"
)


def tokens(w: str) -> str:
    """Distinct stemmed content words of a list of words."""
    return f"list_distinct(list_transform(list_filter({w}, lambda w: {_CONTENT}), lambda w: {_STEM}))"


def grams(w: str, n: int) -> str:
    return f"case when len({w}) >= {n} then list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' ')) else [] end"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _case(table: dict, bent: str, text: str) -> str:
    return "case " + " ".join(f"when {bent} = {k} then {text} || '{w}'" for k, w in table.items()) + f" else {text} end"


_NL = "chr(10)"
#: Conversations: records r (conv_id, ord, repo, msg, files) and digests dg (conv_id, digest, previous, cut).
BASE = f"""
    c as (select conv_id, turn, role, coalesce(text, '') as text, lag(coalesce(text, '')) over (partition by conv_id order by turn) as b, conv_id % {BENT} as bent from conversations),
    a as (select conv_id, turn, case when bent = 9 then coalesce(b, '') when bent = 10 then '{SAME}' else {_case(ADDED, "bent", "text")} end as body,
                 case when bent = 7 then 'me/t0' when bent = 8 then 'x' || (turn - 1) else 'me/t' || (turn - 1) end as name from c where role = 'assistant'),
    r as (select conv_id, turn as ord, case when bent = 12 and turn > 1 then 'more' || turn || '/t0' else 'conv/t' || turn end as repo, text as msg, case when conv_id % 2 = 0 then ['src/T' || turn || '.py', 'yarn.lock'] else [] end as files,
                 case when conv_id % 2 = 0 then '+def helper' || turn || '(rows)' else '' end as patch, count(*) over (partition by conv_id) <= 5 as shown from c where role = 'user'),
    ids as (select distinct conv_id from conversations),
    s0 as (select conv_id, arg_min(body, turn) as told, string_agg('### ' || name || {_NL} || {_NL} || body || {_NL}, {_NL} order by turn) as secs from a group by conv_id),
    u0 as (select conv_id, arg_min(msg, ord) as asked from r group by conv_id),
    dg as (select conv_id, '# Developer Journal' || {_NL} || {_NL} || '## Summary' || {_NL} || {_NL}
                  || case conv_id % 3 when 0 then coalesce(told, '') when 1 then coalesce(asked, '') else '{SUMMARY}' end || {_NL} || {_NL} || '## Per-Repo Activity' || {_NL} || {_NL}
                  || case when conv_id % {BENT} = 11 then 'Stray prose about src/lost.rs.' || {_NL} || {_NL} else '' end || coalesce(secs, '') as digest, conv_id % 5 = 0 as cut
           from ids left join s0 using (conv_id) left join u0 using (conv_id)),
    prev as (select conv_id, case conv_id % 4 when 0 then 'Earlier that week. ' || digest when 1 then '{SUMMARY}' end as previous from dg)"""


def parsed(of: str) -> str:
    """Sections sec (k, pos, name, norm, body) and summaries summ (k, summary) of the digests of relation of (k, digest)."""
    return f"""
    ls as (select k, string_split(digest, {_NL}) as l from {of}),
    ln as (select k, l[i] as line, i from (select k, l, unnest(range(1, len(l) + 1)) as i from ls)),
    hd as (select *, starts_with(line, '### ') or starts_with(line, '## ') as h from ln),
    sg as (select *, sum(h::int) over (partition by k order by i) as s from hd),
    he as (select k, s, line as head, lead(line) over (partition by k order by s) as next from sg where h),
    bo as (select k, s, string_agg(line, {_NL} order by i) as body, string_agg(case when {strip('line')} <> '' then line end, {_NL} order by i) as prose from sg where not h group by k, s),
    pa as (select he.k, he.s, head, next, body, prose, starts_with(head, '### ') as opens, lower({strip("substr(head, 4)")}) as title from he left join bo on he.k = bo.k and he.s = bo.s),
    se as (select k, s, case when opens then {strip("substr(head, 5)")} else '' end as name, case when opens then {strip("coalesce(body, '')")} else {strip("prose")} end as body
           from pa where (opens and {strip("substr(head, 5)")} <> '') or (not opens and title = 'per-repo activity' and prose is not null and (next is null or starts_with(next, '### ')))),
    sec as (select k, (row_number() over (partition by k order by s) - 1)::int as pos, name, string_split(lower(name), '/')[-1] as norm, body from se),
    summ as (select d.k, coalesce({strip("x.t")}, '') as summary
             from (select k from {of}) d left join (select k, string_agg(body, {_NL} order by s) as t from pa where not opens and title = 'summary' group by k) x on x.k = d.k)"""


#: What records ground digests in: rp (conv_id, ord, norm, nw, nt, cw, ct, src) a row a repository, and real files.
GROUND = f"""
    rw as (select conv_id, ord, string_split(lower(repo), '/')[-1] as norm, {words("repo")} as nw,
                  list_concat(list_concat({words("msg")}, case when len(files) > 0 then {words("files[1]")} else [] end), case when shown then {words("patch")} else [] end) as cw, msg, files from r),
    rt as (select *, {tokens("nw")} as nt, {tokens("cw")} as ct from rw),
    rp as (select *, list_distinct(list_concat(nt, ct)) as src, row_number() over (partition by conv_id, norm order by ord) as nth from rt)"""
_FILES = rf"list_filter(list_transform(regexp_extract_all(coalesce(%s, ''), '\b\w[\w/-]*\.[A-Za-z]{{1,10}}\b'), lambda x: lower(x)), lambda x: list_contains({_list(CODE)}, string_split(x, '.')[-1]))"


def mentions(x: str) -> str:
    return f"list_transform({_FILES % x}, lambda x: string_split(x, '/')[-1])"


def scored(of: str) -> str:
    """Scores sco (k, conv_id, format ... total) of relation of (k, conv_id, digest, previous, cut), unrounded."""
    d = lambda x: f"{x}::double"
    return f"""{parsed(of)}, {GROUND},
    al as (select conv_id, count(*) as n_repos, list(norm) as allowed, list_distinct(flatten(list(src))) as src, list_distinct(flatten(list(list_concat(cw, nw)))) as surface,
                  flatten(list(list_concat(list_transform(files, lambda f: string_split(lower(f), '/')[-1]), {mentions("msg")}))) as real from rp group by conv_id),
    sw as (select k, summary, {words("summary")} as w from summ),
    st as (select o.k, o.conv_id, o.digest, o.previous, o.cut, summary, w, {tokens("w")} as tok, {grams("w", 10)} as runs, {grams("w", 3)} as tri, coalesce(n_repos, 0) as n_repos,
                  coalesce(allowed, []) as allowed, coalesce(src, []) as src, coalesce(surface, []) as surface, coalesce(real, []) as real
           from {of} o join sw on sw.k = o.k left join al on al.conv_id = o.conv_id),
    xw as (select sec.k, conv_id, pos, name, norm, body, {words("body")} as w from sec join {of} o on o.k = sec.k),
    xs as (select *, {tokens("w")} as tok, {grams("w", 10)} as runs, {grams("w", 3)} as tri from xw),
    hits as (select xs.k, rp.ord, len(xs.tok) as n, len(list_intersect(xs.tok, rp.src)) as ov, len(list_intersect(xs.tok, list_distinct(list_concat(rp.ct, rp.nt)))) as og, len(rp.ct) as nc
             from xs join rp on rp.conv_id = xs.conv_id and rp.norm = xs.norm and rp.nth = 1),
    cg as (select k, ord, max(case when n >= 3 and ov >= 2 then least({d("1")}, {d("ov")} / greatest(2, least(4, n * 3 // 4))) else {d("0")} end) as cov,
                  max(least({d("1")}, {d("og")} / greatest(2, least(5, nc))) * case when n >= 6 and og > {d("0.6")} * n then {d("0.5")} else {d("1")} end) as gro from hits group by k, ord),
    cv as (select k, sum(cov) as cov, sum(gro) as gro from cg group by k),
    hs as (select xs.k, count(*) as n, count(*) filter (list_contains(st.allowed, norm)) as valid, count(distinct name) as names, list(body) as bodies,
                  bool_or(len(xs.w) >= 12 and len(list_distinct(xs.tri)) / len(xs.tri) < {d("0.5")}) as loops from xs join st on st.k = xs.k group by xs.k),
    li as (select x.k, bool_or(len(list_intersect(x.tok, y.tok)) / len(list_distinct(list_concat(x.tok, y.tok))) > {d("0.6")}) as alike
           from xs x join xs y on x.k = y.k and x.pos < y.pos where len(x.tok) >= 6 and len(y.tok) >= 6 group by x.k),
    er as (select xs.k, xs.conv_id, xs.norm, string_split(list_filter(xs.runs, lambda g: list_contains(st.runs, g))[1], ' ') as run from xs join st on st.k = xs.k where list_has_any(xs.runs, st.runs)),
    ec as (select k, bool_or(not coalesce(len(list_filter(run, lambda w: {_CONTENT})) > 0 and len(list_filter(run, lambda w: {_CONTENT} and not list_contains(coalesce(rp.cw, []), w))) = 0, false)) as echo
           from er left join rp on rp.conv_id = er.conv_id and rp.norm = er.norm and rp.nth = 1 group by k),
    pr as (select st.*, coalesce(hs.n, 0) as headers, coalesce(valid, 0) as valid, coalesce(names, 0) as names, list_concat([summary], coalesce(bodies, [])) as prose, coalesce(loops, false) as loops,
                  coalesce(alike, false) as alike, coalesce(echo, false) as echo, coalesce(cov, 0) as cov, coalesce(gro, 0) as gro
           from st left join hs on hs.k = st.k left join li on li.k = st.k left join ec on ec.k = st.k left join cv on cv.k = st.k),
    pw as (select *, flatten(list_transform(prose, lambda t: {mentions("t")})) as named,
                  list_distinct(flatten(list_transform(prose, lambda t: regexp_extract_all(t, '(?i)\\b(gpt(?:[- ]?\\d[\\w.]*)?|chatgpt|openai|anthropic|claude|gemini|bard|grok|mistral|deepseek|qwen(?:\\d[\\w.]*)?|cohere)\\b')))) as models,
                  flatten(list_transform(prose, lambda t: list_transform(regexp_extract_all(t, '(?i)\\b(\\d{{1,3}}|two|three|four|one)\\s+(?:active\\s+|git\\s+)*(?:repos?|repositories?|projects?)\\b', 1), lambda x: lower(x)))) as claims
           from pr),
    px as (select *, ((case when len(regexp_extract_all(summary, '\\S+')) >= 10 and len(list_intersect(tok, src)) >= 2 then 1 else 0 end) + (case when contains(digest, '## Per-Repo Activity') then 1 else 0 end)
                      + case when headers > 0 then {d("valid")} / headers else 0 end) / {d("3")} as format,
                  case when n_repos = 0 then {d("1")} else cov / len(list_distinct(allowed)) end as coverage, case when n_repos = 0 then {d("0")} else gro / len(list_distinct(allowed)) end as grounding,
                  {d("0.5")} * ({" + ".join(f"contains(lower(digest), '{b}')::int" for b in ("next steps", "you should", "todo:", "as an ai"))}) as p_banned,
                  least({d("0.5")}, {d("0.3")} * len(list_filter(named, lambda m: m <> 'node.js' and not list_contains(real, m)))) as p_files,
                  least({d("0.5")}, {d("0.3")} * len(list_filter(models, lambda m: not list_contains(surface, regexp_replace(lower(m), '[^a-z0-9]', '', 'g')) and not list_contains(surface, regexp_extract(lower(m), '[a-z0-9_]+'))))) as p_models,
                  least({d("0.5")}, {d("0.3")} * len(list_filter(claims, lambda x: coalesce(try_cast(x as int), list_position(['one', 'two', 'three', 'four'], x)) <> n_repos))) as p_counts,
                  case when names < headers then {d("0.5")} else 0 end as p_repeated_headers, least({d("0.75")}, {d("0.35")} * (headers - valid)) as p_invented_headers,
                  case when alike then {d("0.3")} else 0 end as p_alike, case when echo then {d("0.3")} else 0 end as p_echo,
                  case when loops or len(w) >= 12 and len(list_distinct(tri)) / len(tri) < {d("0.5")} then {d("0.4")} else 0 end as p_loop,
                  case when previous is not null and list_has_any({grams(words("digest"), 10)}, {grams(words("previous"), 10)}) then {d("0.3")} else 0 end as p_lifted,
                  case when cut then {d("0.5")} else 0 end as p_cut from pw),
    py as (select *, least({d("1")}, least({d("1")}, p_banned + p_files + p_models + p_counts + p_repeated_headers + p_invented_headers + p_alike + p_echo + p_loop + p_lifted) + p_cut) as penalties from px),
    sco as (select *, greatest({d("0")}, {d("0.30")} * format + {d("0.45")} * coverage + {d("0.25")} * grounding - penalties) as total from py)"""


_FOUND = ("format", "coverage", "grounding", "p_banned", "p_files", "p_models", "p_counts", "p_repeated_headers", "p_invented_headers", "p_alike", "p_echo", "p_loop", "p_lifted", "p_cut", "penalties", "total")


def _pick(*parts: str) -> str:
    """Spark's functions.text.drawn in SQL."""
    return f"('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 8))::bigint"


def _join(x: str) -> str:
    return f"array_to_string({x}, {_NL})"


def _blocks(of: str) -> str:
    """mu (conv_id, mutation, tier, digest): every mutation of the digests of relation of (conv_id, digest), and base."""
    insert = lambda at, line: f"case when {at} is null then digest else {_join(f'list_concat(list_concat(l[1:{at} - 1], [{line!r}]), l[{at}:])')} end"
    each = {
        "truncate_50": ("must_cost", _join("l[1:floor(len(l) * 0.5)::int]")),
        "truncate_75": ("must_cost", _join("l[1:floor(len(l) * 0.75)::int]")),
        "duplicate_section": ("must_cost", f"case when nb = 0 then digest else regexp_replace(digest, '\\n+$', '') || {_NL} || {_join('bl[nb]')} end"),
        "fabricate_file_body": (
            "must_cost",
            f"case when nb = 0 then digest else {_join(f'list_concat(list_concat(list_concat(pre, bl[1][1:said]), [{FAKE!r}]), list_concat(bl[1][said + 1:], flatten(bl[2:])))')} end",
        ),
        "fabricate_file_summary": ("must_cost", insert("first_said", FAKE)),
        "ungrounded_summary": ("must_cost", f"case when su is null or pe is null then digest else {_join(f'list_concat(list_concat(l[1:su - 1], {_list(["## Summary", "", UNGROUNDED])}), l[pe:])')} end"),
        "fake_repo_spam": ("must_cost", _join("list_concat(list_concat(pre, flatten(bl)), flatten(list_transform(range(0, 5), lambda j: list_concat([base[1] || '-clone' || j], base[2:]))))")),
        "strip_per_repo_header": ("must_cost", _join("list_filter(l, lambda x: not starts_with(x, '## Per-Repo'))")),
        "word_soup_bodies": (
            "must_cost",
            _join(
                "list_concat(pre, flatten(list_transform(range(0, nb), lambda j: [bl[j + 1][1], '', "
                f"array_to_string(list_transform(range(1, 15), lambda q: {_list(SOUP)}[{_pick('salt', 'j', 'q')} % {len(SOUP)} + 1]), ' '), ''])))"
            ),
        ),
        "orphan_prose": ("must_cost", insert("(pe + 1)", GHOST)),
        "drop_section": (
            "must_not_pay", f"case when nb = 0 then digest else {_join(f'list_concat(pre, flatten(list_transform(list_filter(range(0, nb), lambda j: j <> victim), lambda j: bl[j + 1])))')} end",
        ),
        "swap_bodies": ("must_not_pay", f"case when nb >= 2 then {_join(f'list_concat(pre, list_transform(range(0, nb), lambda j: bl[j + 1][1] || {_join("bl[(j + 1) % nb + 1][2:]")}))')} end"),
        "shuffle_sections": (
            "neutral", _join(f"list_concat(pre, flatten(list_transform(list_sort(list_transform(range(0, nb), lambda j: {{'k': {_pick('salt', 'j')}, 'i': j}})), lambda x: bl[x.i + 1])))"),
        ),
        "base": ("base", "digest"),
    }
    rows = " union all ".join(f"select conv_id, '{m}' as mutation, '{t}' as tier, {x} as digest from m4" for m, (t, x) in each.items())
    return rf"""
    m0 as (select conv_id, digest, md5('0:' || digest) as salt, string_split(regexp_replace(digest, '\n$', ''), {_NL}) as l from {of}),
    m1 as (select *, list_filter(range(1, len(l) + 1), lambda i: starts_with(l[i], '### ')) as heads, list_filter(range(1, len(l) + 1), lambda i: starts_with(l[i], '## Summary'))[1] as su,
                  list_filter(range(1, len(l) + 1), lambda i: starts_with(l[i], '## Per-Repo'))[1] as pe from m0),
    m2 as (select *, len(heads) as nb, case when len(heads) > 0 then l[1:heads[1] - 1] else l end as pre,
                  list_transform(range(1, len(heads) + 1), lambda j: l[heads[j]:coalesce(heads[j + 1], len(l) + 1) - 1]) as bl,
                  list_filter(range(1, len(l) + 1), lambda i: i > su and {strip('l[i]')} <> '')[1] as first_said from m1),
    m3 as (select *, coalesce(list_filter(range(2, len(bl[1]) + 1), lambda i: {strip('bl[1][i]')} <> '')[1], len(bl[1])) as said,
                  case when nb > 0 then bl[nb] else {_list(["### nobody/nowhere", "", "Stuff happened."])} end as base from m2),
    m4 as (select *, {_pick('salt', "'drop'")} % greatest(nb, 1) as victim from m3),
    mu as ({rows})"""


# Fixed value.
FILL = "banana mango kayak umbrella giraffe volcano ticket window quartz nomadic lantern".split()


def _prose(most: int, *k: str) -> str:
    return f"array_to_string(list_transform(range(1, ({_pick("'1'", *k)} % {most + 1} + 1)::bigint), lambda q: {_list([*SOUP, *FILL])}[{_pick("'0'", 'q', *k)} % {len(SOUP) + len(FILL)} + 1]), ' ')"


def _skeleton(key: str, of: str) -> str:
    """Sections of relation of (key, repos) as a list, one to three times over."""
    return f"""select *, array_to_string(flatten(list_transform(range(1, ({_pick("'2'", key)} % 3 + 2)::bigint), lambda c: list_transform(range(1, len(repos) + 1),
               lambda j: '### ' || repos[j] || {_NL} || {_NL} || {_prose(25, key, '(j - 1)', 'c')}))), {_NL} || {_NL}) as secs from {of}"""


def _cut(key: str, of: str) -> str:
    """Relation of (key, digest, ...) with three in ten digests cut."""
    ls = rf"string_split(regexp_replace(digest, '\n$', ''), {_NL})"
    share = f"{_pick(repr('4'), key)}::double / 4294967296::double"
    return f"""select * replace (case when {_pick("'3'", key)} % 10 < 3 then case when digest = '' then '' else {_join(f"{ls}[1:floor(len({ls}) * ({share}))::int]")} end else digest end as digest) from {of}"""


_REPOS = "rl as (select conv_id, coalesce(repos, []) as repos from ids left join (select conv_id, list(repo order by ord) as repos from r group by conv_id) using (conv_id))"
_SOUPS = f"""
    ra as (select *, row_number() over (order by md5('0:' || conv_id)) - 1 as place, count(*) over () as n from rl),
    sm as (select s::int as sample, conv_id, repos from (select unnest(range(0, 300)) as s) join ra on place = s % least(n, 300)),
    sk as ({_skeleton("sample", "sm")}),
    sd as (select sample, conv_id, repos, '# Developer Journal' || {_NL} || {_NL} || '## Summary' || {_NL} || {_NL} || {_prose(30, "sample")} || {_NL} || {_NL} || '## Per-Repo Activity' || {_NL} || {_NL} || secs as digest from sk),
    own as (select sample as k, conv_id, digest, null::varchar as previous, false as cut from ({_cut("sample", "sd")}))"""


def _turn(what: str, n: int) -> str:
    return f"({_pick(repr('5'), 'conv_id', repr(what))} % {n})"


#: Records and digests of BASE made odd. Lines of odd digests end in several ways; what ends a line is a line feed to the parser.
_ODD = f"""
    sk as ({_skeleton("conv_id", "rl")}),
    sp as (select *, '## Summary' || {_NL} || {_NL} || {_prose(30, "conv_id", "'s'")} || {_NL} || {_NL} as said, {_turn("summary", 7)} as su from sk),
    sd as (select conv_id, case when {_turn("title", 5)} = 0 then '' else '# Developer Journal' || {_NL} || {_NL} end || case su when 0 then '' when 1 then said || said when 2 then '' else said end
                  || case when {_turn("per", 6)} = 0 then '' else '## Per-Repo Activity' || {_NL} || {_NL} end || case when {_turn("stray", 4)} = 0 then {_prose(12, "conv_id", "'p'")} || {_NL} || {_NL} else '' end
                  || secs || case when su = 2 then {_NL} || {_NL} || said else '' end as digest from sp),
    oe as (select * replace (replace(digest, {_NL}, [chr(10), chr(13) || chr(10), chr(13), chr(11), chr(10)][({_turn("ends", 5)} + 1)::int]) as digest) from ({_cut("conv_id", "sd")})),
    own as (select conv_id as k, conv_id, regexp_replace(digest, '\r\n|\r|\x0B', {_NL}, 'g') as digest, null::varchar as previous, false as cut from oe)"""
_ODD_BASE = BASE.replace(" r as (select", " r0 as (select") + f""",
    r as (select conv_id, ord, case when kind = 2 then '' else repo end as repo, case when kind in (1, 3) then '' else msg end as msg, case when kind in (1, 3) then [] else files end as files,
                 case when kind in (1, 3) then '' else patch end as patch, shown from (select *, {_turn("record", 6)} as kind from r0) where kind <> 4)"""
_ODD_BASE = _ODD_BASE.replace("from r group by conv_id)", "from r0 group by conv_id)")
_ODD_SCORED = f"with {_ODD_BASE}, {_REPOS.replace('from r group', 'from r0 group')}, {_ODD}, {scored('own')}"

ORACLE_SQL = {
    "q_score": f"""
        with {BASE}, own as (select conv_id as k, dg.conv_id, digest, previous, cut from dg join prev using (conv_id)), {scored("own")}
        select conv_id, {", ".join(f"round({c}::double + 1e-10::double, 6) as {c}" for c in _FOUND)} from sco""",
    "q_sections": f"with {BASE}, own as (select conv_id as k, digest from dg), {parsed('own')} select sec.k as conv_id, pos as place, summary, name, body from sec join summ on summ.k = sec.k",
    "q_mutated": f"with {BASE}, {_blocks('dg')} select conv_id, mutation, tier, md5(digest) as text, length(digest)::int as n_chars from mu where digest is not null",
    "q_mutations": f"""
        with {BASE}, {_blocks("dg")}, own as (select mutation || ':' || conv_id as k, conv_id, digest, null::varchar as previous, false as cut from mu where digest is not null), {scored("own")},
        bs as (select conv_id, total as base from sco where k = 'base:' || conv_id),
        de as (select mutation, tier, s.total - base as delta from sco s join bs using (conv_id) join mu on s.k = mu.mutation || ':' || mu.conv_id where mutation <> 'base')
        select mutation, tier, round(avg(delta) + 1e-10::double, 6) as mean_delta, round(min(delta) + 1e-10::double, 6) as min_delta, round(max(delta) + 1e-10::double, 6) as max_delta,
               count(*) filter (case tier when 'must_cost' then delta > -0.02::double when 'must_not_pay' then delta > 0.02::double else abs(delta) > 0.05::double end) as violations
        from de group by mutation, tier""",
    "q_soup": f"with {BASE}, {_REPOS}, {_SOUPS}, {scored('own')} select k as sample, n_repos::int as n_repos, round(total::double + 1e-10::double, 6) as total, total > 0.55::double as over from sco",
    "q_odd": f"{_ODD_SCORED} select conv_id, {', '.join(f'round({c}::double + 1e-10::double, 6) as {c}' for c in _FOUND)} from sco",
    "q_properties": f"""
        {_ODD_SCORED},
        iv as (select conv_id, unnest([
          {{'i': 'total_within_bounds', 'a': true, 'h': total between 0 and 1}},
          {{'i': 'parts_within_bounds', 'a': true, 'h': format between 0 and 1 and coverage between 0 and 1 and grounding between 0 and 1 and penalties between 0 and 1}},
          {{'i': 'nothing_to_cover', 'a': n_repos = 0, 'h': coverage = 1 and grounding = 0}},
          {{'i': 'words_of_nothing_stay_low', 'a': n_repos > 0, 'h': total <= 0.55::double}},
          {{'i': 'penalties_only_cost', 'a': true, 'h': total <= 0.30::double * format + 0.45::double * coverage + 0.25::double * grounding}},
          {{'i': 'penalties_cover_each', 'a': true, 'h': penalties >= greatest({", ".join(c for c in _FOUND if c.startswith("p_"))}) - 1e-12::double}}]) as x from sco)
        select x.i as invariant, count(*) as checked, count(*) filter (not x.h) as broken, min(conv_id) filter (not x.h) as first from iv where x.a group by x.i""",
    "q_step_means": f"""
        with {BASE}, own as (select conv_id as k, dg.conv_id, digest, previous, cut from dg join prev using (conv_id)), {scored("own")}
        select conv_id // 8 as step, {", ".join(f"round(avg({c}::double) + 1e-10::double, 6) as {c}" for c in ("format", "coverage", "grounding", "penalties", "total"))},
               round(avg(cut::int::double) + 1e-10::double, 6) as truncated_rate from sco group by 1""",
    "q_grounding": f"""
        with {BASE}, {GROUND},
        rf as (select conv_id, array_to_string(list_distinct_in_order, ',') as files from (
          select conv_id, list_filter(f, lambda x, i: list_position(f, x) = i) as list_distinct_in_order from (
            select conv_id, flatten(list(list_concat(list_transform(files, lambda f: string_split(lower(f), '/')[-1]), {mentions("msg")}) order by ord)) as f from rp group by conv_id)))
        select rp.conv_id, (row_number() over (partition by rp.conv_id order by ord) - 1)::int as place, rf.files, norm, 1 as n_commits,
               md5(array_to_string(list_sort(src), ' ')) as source, md5(array_to_string(list_sort(list_distinct(cw)), ' ')) as surface
        from rp join rf using (conv_id)""",
    "q_prompt": f"""
        with {BASE},
        cm as (select conv_id, ord, '**' || repo || '**' || {_NL} || '- : ' || split_part(msg, {_NL}, 1) || {_NL}
                      || case when len(files) > 0 then '  ' || files[1] || ' +1 -0, ' || files[2] || ' +1 -0' || {_NL}
                              || case when shown then '  diff ' || files[1] || ':' || {_NL} || '    ' || patch || {_NL} || '  diff ' || files[2] || ':' || {_NL} || '    +sealed' || {_NL} else '' end else '' end
                      || {_NL} as t from r),
        pt as (select conv_id, 'GitHub commits for user, ' || conv_id || ' (last 1 day(s)):' || {_NL} || string_agg(t, '' order by ord)
                      || '{corpus.INSTRUCTION.replace("{user}", "user").replace("{example}", "project").replace("'", "''")}' as prompt from cm group by conv_id)
        select conv_id, md5(prompt) as prompt, length(prompt)::int as n_chars from pt""",
    "q_target": f"""
        with {BASE},
        t as (select conv_id, case conv_id % 3 when 2 then null when 0 then regexp_replace(digest, '### me/', '### ', 'g')
                                   else regexp_replace(substr(digest, length('# Developer Journal') + 3), '### me/', '### ', 'g') end as t from dg)
        select conv_id, md5(t) as target, length(t)::int as n_chars from t""",
}
