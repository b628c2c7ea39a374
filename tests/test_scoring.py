import json

import pytest
from pyspark.sql import functions as F

from dayscribe.functions import text as T
from dayscribe.operators import activity, mutate, report, scoring, sections

from . import oracle
from .fixtures import ACTIVITY, GOOD, LONG, ODD, VARIANTS

#: Records that lack this or that: no repositories, no name, no commits, commits and files without a field, names that meet.
RECORDS = [
    ACTIVITY, [], [("", None)], [("sea/buoy", None)], [("sea/buoy", []), ("", [{"message": None}])],
    [("sea/buoy", [{"url": "u"}, {"sha": "9f", "files": [{"additions": 4}, {"filename": "", "patch": "+x"}, {"filename": " Kelp/Map.RS "}]}])],
    [("old/buoy", [{"message": "moor"}]), ("new/Buoy", [{"message": "frozen tide readings"}] * 7)],
]


def frame(spark, rows, extra=()):
    """rows: (id, digest, record, *extra values)."""
    data = [(k, d, json.dumps([{"repo": r, "commits": c} for r, c in rec]), *more) for k, d, rec, *more in rows]
    df = spark.createDataFrame(data, ", ".join(["id int", "digest string", "record string", *extra]))
    return df.withColumn("activity", F.from_json("record", activity.ACTIVITY)).drop("record")


def test_scores_equal_the_plain_ones(spark):
    rows = [(k, d, r) for k, (d, r) in enumerate((d, r) for r in RECORDS for d in VARIANTS)]
    got = {r.id: r for r in scoring.score(frame(spark, rows), detail=True).collect()}
    for k, d, r in rows:
        want = oracle.score(d, [(x, c or []) for x, c in r])
        have = (got[k].format, got[k].coverage, got[k].grounding, got[k].penalties, got[k].total)
        assert have == pytest.approx(want, abs=1e-9), (k, d[:80], r)
        assert 0 <= got[k].total <= 1


def test_flags_and_previous(spark):
    rows = [(0, GOOD, ACTIVITY, True, None), (1, GOOD, ACTIVITY, False, GOOD), (2, GOOD, ACTIVITY, None, "other words"), (3, None, None or [], False, None)]
    got = {r.id: r for r in scoring.score(frame(spark, rows, ("cut boolean", "before string")), previous="before", truncated="cut").collect()}
    for k, cut, before in ((0, True, None), (1, False, GOOD), (2, False, "other words")):
        assert got[k].total == pytest.approx(oracle.score(GOOD, ACTIVITY, cut, before)[4])
    assert got[3].total == pytest.approx(oracle.score("", [])[4])


@pytest.mark.parametrize("n,charged", [(9, False), (10, True)])
def test_echo_boundary(spark, n, charged):
    run = " ".join(f"zebra{k}" for k in range(n))
    d = GOOD.replace("Work on", run + ". Work on").replace("Beacon lamps dim", run + ". Beacon lamps dim")
    assert (scoring.score(frame(spark, [(0, d, ACTIVITY)]), detail=True).first().p_echo > 0) == charged


def test_sections_equal_the_plain_ones(spark):
    df = spark.createDataFrame([(k, d) for k, d in enumerate(VARIANTS)], "id int, digest string")
    for r in sections.with_sections(df).collect():
        assert (r.summary, [(s.name, s.body) for s in r.sections]) == oracle.sections(VARIANTS[r.id])


def test_lexical_functions(spark):
    texts = ["voilé.js naïve/ä-b.py vite.config.ts e.g. 1.2.3 Foo/Bar.PY", "libraries class using bus fixed", LONG, "", None, "12 active git repos, Two projects and 5 repository"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", T.file_mentions("t").alias("f"), T.content_tokens("t").alias("c"), T.count_claims("t").alias("n"), T.word_count("t").alias("w"), T.norm_repo("t").alias("r")).collect()
    for r in rows:
        t = r.t or ""
        assert r.f == oracle.files(t) and set(r.c) == oracle.tokens(t) and r.w == len(t.split()) and r.r == oracle.norm(t)
    assert rows[-1].n == [12, 2]
    stems = spark.createDataFrame([(w,) for w in ("libraries", "class", "using", "bus")], "w string").select(T.stem(F.col("w"))).collect()
    assert [r[0] for r in stems] == ["librar", "clas", "us", "bus"]


def test_odd_inputs_score_within_bounds(spark):
    """Every odd digest with every record, and every mutation of them: a score from 0 to 1, the plain one."""
    rows = [(k, d, r) for k, (d, r) in enumerate((d, r) for r in RECORDS for d in [*ODD, GOOD])]
    df = frame(spark, rows)
    made = mutate.mutated(df).collect()
    assert len({(r.id, r.mutation) for r in made}) == len(made) and {r.mutation for r in made} == {"base", *mutate.MUTATIONS}
    got = scoring.score(mutate.mutated(df)).collect()
    of = {k: r for k, _, r in rows}
    for r in got:
        want = oracle.score(r.digest, [(x, c or []) for x, c in of[r.id]])[4]
        assert 0 <= r.total <= 1 and r.total == pytest.approx(want, abs=1e-9), (r.id, r.mutation)


def test_mutation_deltas_equal_the_plain_ones(spark):
    """The report over several digests, each change against the plain scorer's."""
    rows = [(k, d, ACTIVITY) for k, d in enumerate((GOOD, GOOD.replace("### lantern", "### ghost"), GOOD + "\n\nnode.js and three repos"))]
    df = frame(spark, rows)
    plain = lambda d: oracle.score(d, ACTIVITY)[4]
    base, tiers = {k: plain(d) for k, d, _ in rows}, {n: t for n, (t, _) in mutate.MUTATIONS.items()}
    want = {}
    for r in mutate.mutated(df).filter("mutation <> 'base'").collect():
        delta = plain(r.digest) - base[r.id]
        bad = {"must_cost": delta > -0.02, "must_not_pay": delta > 0.02, "neutral": abs(delta) > 0.05}[tiers[r.mutation]]
        want.setdefault(r.mutation, []).append((delta, bad))
    table = {r.mutation: r for r in report.mutation_report(mutate.deltas(df, "id")).collect()}
    assert set(table) == set(want)
    for name, each in want.items():
        r, d = table[name], [x for x, _ in each]
        assert (r.mean_delta, r.min_delta, r.max_delta) == pytest.approx((sum(d) / len(d), min(d), max(d)), abs=1e-9) and r.violations == sum(b for _, b in each)


def test_mutations_cost(spark):
    out = mutate.deltas(frame(spark, [(0, GOOD, ACTIVITY)]), "id")
    got = {r.mutation: r for r in out.collect()}
    assert set(got) == set(mutate.MUTATIONS)
    soft = {"truncate_75"}  # may leave a short digest whole
    assert not [m for m, r in got.items() if r.violates and m not in soft]
    table = report.mutation_report(out).collect()
    assert sum(r.violations for r in table) <= 1
    undefined = mutate.mutated(spark.createDataFrame([("## Summary\nx",)], "digest string"), names=("swap_bodies",))
    assert [r.mutation for r in undefined.collect()] == ["base"]


@pytest.mark.parametrize("n,records", [(300, 1), (60, 7), (5, 7), (0, 7), (9, 0)])
def test_soup_stays_low(spark, n, records):
    """Exactly n samples over the records in turn, the same on a rerun, and none over the ceiling."""
    rows = [(k, GOOD, [(f"sea/{k}", [{"message": f"moor {k}"}]), *ACTIVITY]) for k in range(records)]
    df = frame(spark, rows or [(0, GOOD, ACTIVITY)]).filter(f"id < {records}")
    soup = mutate.soup_digests(spark, df, n)
    found = soup.collect()
    assert sorted(r.sample for r in found) == list(range(n if records else 0))
    assert sorted(map(str, found)) == sorted(map(str, mutate.soup_digests(spark, df.repartition(3), n).collect()))
    if records and n:
        used = [r.activity[0].repo for r in found]
        assert max(map(used.count, used)) <= -(-n // records) and len(set(used)) == min(n, records)
        top = report.ceiling_check(scoring.score(soup)).first()
        assert top.highest <= 0.55 and top.over == 0
