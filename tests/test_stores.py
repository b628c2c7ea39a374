"""Tables of versions, streams, quarantine, file order, the kept dimension, and the joins that stand in for a record's arrays."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dayscribe.functions import text as T
from dayscribe.operators import activity, corpus, guard, mutate, relational, scoring
from dayscribe.sources import files as src
from dayscribe.sources import responses, versions
from dayscribe.streaming import flush
from dayscribe.streaming import guard as stream_guard

from .fixtures import ACTIVITY, GOOD, ODD, VARIANTS
from .test_scoring import RECORDS, frame


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n long")


def found(df):
    return sorted(r[0] for r in df.collect())


def test_readers_keep_their_version(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert versions.latest(spark, folder) == 0 and found(versions.read(spark, folder, schema="n long")) == []
    with pytest.raises(FileNotFoundError):
        versions.read(spark, folder)
    assert versions.append(numbers(spark, 1, 2), folder) == 1
    first = versions.read(spark, folder)
    assert versions.append(numbers(spark, 3), folder) == 2
    second = versions.read(spark, folder)
    assert versions.rewrite(second.select((F.col("n") * 10).alias("n")), folder, 2) == 3
    assert (found(first), found(second), found(versions.read(spark, folder)), found(versions.read(spark, folder, 1))) == ([1, 2], [1, 2, 3], [10, 20, 30], [1, 2])


def test_writers_at_once(spark, tmp_path, monkeypatch):
    """An append that another overtakes takes the next number; a rewrite of what has changed since raises and changes nothing."""
    folder, commit, other = str(tmp_path / "t"), versions._commit, []
    versions.append(numbers(spark, 1), folder)

    def overtaken(spark, at, version, content):
        if not other:
            other.append(version)
            versions.append(numbers(spark, 7), folder)
        return commit(spark, at, version, content)

    monkeypatch.setattr(versions, "_commit", overtaken)
    assert versions.append(numbers(spark, 2), folder) == 3 and found(versions.read(spark, folder)) == [1, 2, 7]
    other.clear()
    with pytest.raises(versions.Changed):
        versions.rewrite(numbers(spark, 0), folder, 3)
    assert found(versions.read(spark, folder)) == [1, 2, 7, 7]
    with pytest.raises(versions.Changed):
        versions.rewrite(numbers(spark, 0), folder, 1)


def test_a_dead_writer_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    versions.append(numbers(spark, 1), folder)

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(versions, "_commit", dies)
        with pytest.raises(OSError):
            versions.append(numbers(spark, 2), folder)
    assert found(versions.read(spark, folder)) == [1] and versions.append(numbers(spark, 3), folder) == 2
    assert found(versions.read(spark, folder)) == [1, 3]


def test_batches_count_once(spark, tmp_path, monkeypatch):
    """A stream that dies after its rows are in the table and before its own checkpoint runs the batch again."""
    folder, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    for k in range(3):
        numbers(spark, k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    append, seen = versions.append, []

    def dies(rows, at, writer, batch):
        append(rows, at, writer, batch)
        seen.append(batch)
        if seen == [0, 1]:
            raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(versions, "append", dies)
        with pytest.raises(Exception, match="gone"):
            flush.flushed(stream, folder, checkpoint).awaitTermination()
        flush.flushed(stream, folder, checkpoint).awaitTermination()
    assert 1 in seen[2:] and found(versions.read(spark, folder)) == [0, 1, 2]
    version = versions.latest(spark, folder)
    assert versions.append(numbers(spark, 9), folder, "flush", 2) == version and versions.append(numbers(spark, 9), folder, "other", 0) == version + 1


def test_the_guard_takes_up_where_it_stopped(spark, tmp_path):
    ticks = []
    for run in range(12):
        for step in range(11):
            gain, drop = (0.04 * step, -0.09 * step) if run % 3 == 0 and step > 2 else (0.1, 0.2)
            ticks.append((f"r{run}", step, gain, drop, 30.0 if run % 4 == 1 else 90.0, [None, 100, 0][run % 3], 0.9 if run % 5 == 2 and step > 7 else 0.1))
    schema = "run string, step long, train_reward double, spotcheck_total double, tokens double, ref_tokens long, truncated_rate double"
    df = spark.createDataFrame(ticks, schema)
    want = sorted(map(tuple, guard.first_abort(df).collect()))
    assert len({w[2] for w in want}) == 3
    for parts in (1, 4, 11):
        assert sorted(map(tuple, stream_guard.replayed(df, str(tmp_path / str(parts)), parts).collect())) == want
    assert stream_guard.replayed(df.limit(0), str(tmp_path / "none")).count() == 0


def test_files_are_rows_or_have_a_reason(spark, tmp_path):
    side = json.dumps({"me/x": {"commits": [{"sha": "0123456789", "message": "moor"}]}})
    body = "# Developer Journal\n\n## Summary\n\nOne.\n"
    texts = {
        "2026-01-01-7d.md": body, "2026-01-01-7d-commits.json": side, "2026-01-02-7d.md": body, "2026-01-03-7d.md": body, "2026-01-03-7d-commits.json": "{broken",
        "2026-01-04-7d.md": "nothing", "2026-01-04-7d-commits.json": side, "2026-01-05-7d.md": body, "2026-01-05-7d-commits.json": '{"me/x": {"commits": []}}',
        "draft.md": body, "2026-01-06-7d.md": "\n", "2026-01-06-7d-commits.json": " ", "2026-01-07-7d-commits.json": side,
    }
    for name, text in texts.items():
        (tmp_path / "plain").mkdir(exist_ok=True)
        (tmp_path / "plain" / name).write_text(text)
    src.write_texts(spark.createDataFrame(list(texts.items()), "name string, text string"), str(tmp_path / "named"))
    want = {"2026-01-01-7d.md": None, "2026-01-02-7d.md": "no sidecar", "2026-01-03-7d.md": "sidecar", "2026-01-04-7d.md": "no body", "2026-01-05-7d.md": "no commits", "2026-01-06-7d.md": "sidecar", "draft.md": "name"}
    for folder, by_name in (("plain", False), ("named", True)):
        pairs, seen = src.observed(src.read_pairs(spark, str(tmp_path / folder), "me", by_name=by_name))
        rows = pairs.collect()
        assert {r.name: r.reason for r in rows} == want and {r.name for r in rows if r.split == "eval"} == {"2026-01-01-7d.md"}
        assert seen.get == {"files": 7, "usable": 1, **{k: Counter(want.values())[k] for k in src.REASONS}}
        assert [r.date for r in src.read_digests(spark, str(tmp_path / folder), "me", by_name=by_name).collect()] == ["2026-01-01"]


def test_numbers_follow_files_and_lines(spark, tmp_path):
    """Files of many splits, empty ones, and several to a task."""
    lines, k = [], 0
    for f in range(9):
        own = [f"{f}-{j} " + "x" * (j % 50) for j in range([0, 1, 700, 30, 5, 0, 1200, 3, 2][f])]
        (tmp_path / f"part-{f}.txt").write_text("".join(x + "\n" for x in own))
        lines += own
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted((r.number, r.value) for r in src.numbered_lines(spark, str(tmp_path)).collect())
            assert got == list(enumerate(lines))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    folder = str(tmp_path / "rows")
    spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(folder)
    assert all(r.id == r._number for r in src.numbered_rows(spark, folder).collect())


def test_only_new_commits_are_fetched(spark, tmp_path):
    asked = []
    answers = spark.createDataFrame([("a/x", f"s{k}", 404 if k == 3 else 200, json.dumps({"files": [{"filename": f"f{k}.py"}]})) for k in range(6)], "repo string, sha string, status int, body string")

    def fetch(wanted):
        asked.append(sorted(r.sha for r in wanted.collect()))
        return responses.files_of(answers)(wanted)

    def records(*days):
        rows = [(k, json.dumps([{"repo": "a/x", "commits": [{"sha": s, "message": "m"} for s in shas]}])) for k, shas in enumerate(days)]
        return spark.createDataFrame(rows, "day int, j string").select("day", F.from_json("j", activity.ACTIVITY).alias("activity"))

    def names(df):
        return {r.day: [[f.filename for f in c.files] for x in r.activity for c in x.commits] for r in df.collect()}

    folder = str(tmp_path / "files")
    assert names(activity.enrich(records(["s0", "s3"], ["s0"]), folder, fetch, "day")) == {0: [["f0.py"], []], 1: [["f0.py"]]}
    assert names(activity.enrich(records(["s3", "s1"], ["s0", "gone"], []), folder, fetch, "day")) == {0: [[], ["f1.py"]], 1: [["f0.py"], []], 2: []}
    assert names(activity.enrich(records(["s1"]), folder, fetch, "day")) == {0: [["f1.py"]]}
    assert asked == [["s0", "s3"], ["gone", "s1"]]


@pytest.mark.parametrize("status,body", [(500, "{}"), (None, "{}"), (200, "<html>"), (200, None)])
def test_other_answers_end_the_run(spark, status, body):
    answers = spark.createDataFrame([("a/x", "s", status, body)], "repo string, sha string, status int, body string")
    with pytest.raises(Exception, match="a/x@s"):
        responses.files_of(answers)(answers.select("repo", "sha")).collect()


@pytest.mark.parametrize("bucket", [3, 1 << 20])
def test_previous_over_ranges(spark, bucket):
    """Also ties, one date of many, and rows without a date."""
    rows = [(k, [None, "2026-01-05", "2026-01-02", "2026-01-02", f"2026-02-{k % 28 + 1:02d}"][k % 5], f"t{k}" if k % 7 else None) for k in range(90)]
    rows += [(k, "2026-01-03", f"t{k}") for k in range(100, 140)]
    df = spark.createDataFrame(rows, "id int, date string, text string").repartition(4)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    want = {r[0]: before[2] if before else None for r, before in zip(order, [None, *order])}
    assert {r.id: r.previous for r in corpus.with_previous(df, "date", "id", "text", bucket).collect()} == want
    assert corpus.with_previous(df.limit(0), "date", "id", "text", bucket).count() == 0


def test_joins_equal_the_arrays(spark):
    rows = [(k, d, r) for k, (d, r) in enumerate((d, r) for r in RECORDS for d in [*VARIANTS, *ODD[:4]])]
    df = frame(spark, rows)
    want = {r.id: r for r in scoring.score(df, detail=True).collect()}
    got = {r.id: r for r in relational.coverage_and_grounding(df, "id").collect()}
    assert set(got) == set(want) and all((r.coverage, r.grounding) == pytest.approx((want[k].coverage, want[k].grounding), abs=1e-12) for k, r in got.items())
    assert {r.id: min(0.5, 0.3 * r.n_invented) for r in relational.invented_files(df, "id").collect()} == pytest.approx({k: r.p_files for k, r in want.items()})
    assert {r.id: r.alike for r in relational.alike_sections(df, "id").collect()} == {k: r.p_alike > 0 for k, r in want.items()}


def test_a_record_of_many_commits(spark):
    """20,000 commits that share words, in one record, beside small ones: no task gets more than a share of its tokens."""
    words = "harbor lantern beacon anchor pilot chart storm gull reef quay mast sail".split()
    commits = [{"sha": str(k), "message": f"moor the {words[k % 12]} at buoy{k % 500} with rope{k}"} for k in range(20_000)]
    body = "Moored the harbor and the lantern at buoy7 with rope19 while storm and reef held the quay for long."
    big = "\n\n".join(["# Developer Journal\n\n## Summary\n\nMoored.\n\n## Per-Repo Activity", f"### sea/buoy\n\n{body}", "### sea/none\n\nNothing of it."])
    df = frame(spark, [(0, big, [("sea/buoy", commits)]), (1, GOOD, ACTIVITY)])
    got = {r.id: r for r in relational.coverage_and_grounding(df, "id").collect()}
    own = {w for w in ("harbor", "lantern", "buoy7", "rope19", "moor", "storm", "reef", "quay")}
    tokens = {r[0] for r in spark.sql("select 1").select(F.explode(T.content_tokens(F.lit(body)))).collect()}
    assert len(own & tokens) >= 7 and got[0].coverage == 1.0
    best = max(min(1.0, len(tokens & ({"moor", words[k % 12], f"buoy{k % 500}", f"rope{k}"} | {"sea", "buoy"})) / 4) for k in range(20_000))
    assert got[0].grounding == pytest.approx(best)


def test_invariants_tell_what_breaks(spark):
    rows = [(k, 0.5, 0.5, 0.5, 0.1, 0.4, 1) for k in range(5)] + [(7, 0.5, 0.5, 0.5, 0.1, 1.4, 1), (6, None, 0.5, 0.5, 0.1, None, 1), (8, 1.0, 0.0, 0.0, 0.0, 0.3, 0)]
    df = spark.createDataFrame(rows, "id int, format double, coverage double, grounding double, penalties double, total double, n int")
    df = df.withColumn("activity", F.array_repeat(F.lit(1), F.col("n")))
    for c in scoring.COMPONENTS:
        df = df.withColumn(f"p_{c}", F.when(F.col("id") == 3, 0.3).otherwise(0.0))
    got = {r.invariant: (r.checked, r.broken, r.first) for r in mutate.invariants(df, "id").collect()}
    assert got["total_within_bounds"] == (8, 2, 6) and got["parts_within_bounds"] == (8, 1, 6) and got["nothing_to_cover"] == (1, 1, 8)
    assert got["words_of_nothing_stay_low"] == (7, 2, 6) and got["penalties_cover_each"] == (8, 1, 3) and got["penalties_only_cost"] == (8, 2, 6)


def test_odd_digests(spark):
    """Odd in each way, the same on a rerun, and scored as the plain scorer does."""
    from . import oracle

    rows = [(k, GOOD, [(f"sea/{k}", [{"message": f"moor {k}", "files": [{"filename": "a.py"}]}]), *ACTIVITY]) for k in range(200)]
    df = frame(spark, rows)
    odd = mutate.odd_digests(df, "id")
    got = {r.id: r for r in odd.collect()}
    assert got == {r.id: r for r in mutate.odd_digests(df.repartition(5), "id").collect()} and set(got) == set(range(200))
    texts, acts = [r.digest for r in got.values()], [r.activity for r in got.values()]
    assert all(any(e in t for t in texts) for e in ("\r\n", "\x0b")) and any("Journal" not in t for t in texts) and any(t.count("## Summary") == 2 for t in texts)
    assert {0, len(rows[0][2])} == {len(a) for a in acts} and any(a and a[0].repo == "" for a in acts) and any(a and a[0].commits is None for a in acts)
    for r in scoring.score(odd).collect():
        plain = [(x.repo, [c.asDict(True) for c in x.commits or []]) for x in r.activity]
        assert r.total == pytest.approx(oracle.score(r.digest, plain)[4], abs=1e-9)
    assert all(r.broken == 0 for r in mutate.invariants(scoring.score(odd, detail=True), "id").collect())


def test_draws_read_few_rows(spark):
    df = spark.range(5000).withColumn("activity", F.array(F.col("id")))
    import hashlib

    order = sorted(range(5000), key=lambda k: hashlib.md5(f"3:{k}".encode()).hexdigest())
    for n in (0, 1, 40, 5000, 6000):
        got = corpus.lowest_drawn(df, n, F.lit(3), F.col("id")).select("id", "_place").collect()
        assert sorted((r._place, r.id) for r in got) == list(enumerate(order[:n]))


def test_no_query_writes_from_the_driver():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("records", "stores", "scored", "catalog"):
        with open(f"{here}/dayscribe/plans/{name}.py") as f:
            assert "_jvm" not in f.read()
