"""Decontamination, periodic runs and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dayscribe.llm import decontam, periodic, spelling


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_planted(text, doc_id):
    words = text.split()
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q):
                run = words[i : i + size]
                if not any(run[d:] == run[: size - d] for d in range(1, q)):
                    out.append((i, size, q))
            i = max(i + 1, j)
    return sorted(out)


def plain_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain_variants(n):
    near = {w: [v for v in n if plain_near(w, v)] for w in n}
    best = {w: min(own, key=lambda v: (-n[v], v)) for w, own in near.items() if own}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


@pytest.mark.parametrize("broadcast", [200_000, 0])
@pytest.mark.parametrize("window", [10, 5, 1])
def test_occurrences(spark, monkeypatch, broadcast, window):
    """Also where the benchmark is too large to broadcast."""
    monkeypatch.setattr(decontam, "BROADCAST", broadcast)
    r = random.Random(window)
    some = lambda most, letters: " ".join(r.choice(letters) for _ in range(r.randrange(most)))
    docs = [(k, some(80, "abc")) for k in range(60)] + [(k, some(80, "abcdefgh")) for k in range(60, 120)] + [(200, "a " * 500)]
    items = [(k, some(13, "abc")) for k in range(20)] + [(50, "a " * 30), (51, "a " * 30), (52, "never seen")]
    own, of = decontam.windows(spark.createDataFrame(items, "item_id long, text string"), window=window)
    named = {r.window: r.text for r in own.collect()}
    want = Counter()
    for k, t in docs:
        w = t.split()
        want += Counter((k, i, x) for x in named.values() for i in range(len(w)) if w[i : i + len(x.split())] == x.split())
    rows = spark.createDataFrame([(k, len(t.split()), " ".join(t.split())) for k, t in docs], "row long, n int, text string")
    assert Counter((x.row, x.start, named[x.window]) for x in decontam.occurrences(rows, own, window).collect()) == want
    assert {(x.item_id, named[x.window]) for x in of.collect()} == {
        (k, " ".join(w[i : i + window])) for k, t in items for w in [t.split()] for i in range(max(1, len(w) - window + 1)) if w
    }


def test_native(spark):
    """No Python on executors."""
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = decontam.contaminated(docs, docs.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("small", [64, 4, 2])
def test_runs_of_one_text(monkeypatch, small):
    monkeypatch.setattr(periodic, "SMALL", small)
    r = random.Random(small)
    for k in range(600):
        words = [b"%d" % r.randrange(r.choice((1, 2, 3, 10, 50))) for _ in range(r.choice((0, 1, 5, 20, 100, 700 if k % 20 == 0 else 60)))]
        if words and r.random() < 0.7:
            words = periodic.planted(words, 10 * r.randrange(1 << 28))
        if len(words) > 20 and r.random() < 0.3:
            a, p = r.randrange(len(words)), r.randrange(1, max(2, len(words) // 8))
            words[a:a] = words[a : a + p] * r.randrange(9)
        ids = periodic.numbered(words)
        found = periodic.small_runs(ids, small)
        for low, high in periodic.ranges(len(words), r.choice((3, 1 << 16))):
            found += periodic.large_runs(ids, low, high) if low >= small else []
        assert sorted(found) == plain_runs(words)


def test_a_long_text_of_one_word():
    ids = periodic.numbered([b"ha"] * 300_000)
    assert periodic.small_runs(ids) == [(0, 300_000, 1)] and periodic.large_runs(ids, 64, len(ids)) == []


def test_ranges_of_shifts_by_themselves(spark):
    """Long texts, dealt by ranges, give what short ones give, copies and all."""
    r = random.Random(2)
    rows = [(k, " ".join(f"w{r.randrange(4 + k)}" for _ in range(40 * k))) for k in range(30)] + [(None, None), (31, ""), (32, "ab " * 900), (32, "ab " * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("mine")).withColumn("runs", F.lit("mine")).repartition(3)
    plant = F.crc32(F.col("doc_id").cast("string"))
    want = Counter(map(tuple, periodic.runs(df, plant=plant).collect()))
    assert len(rows) == sum(want.values()) and Counter(map(tuple, periodic.runs(df, plant=plant, long=100).collect())) == want


@pytest.mark.parametrize("block", [4, 1024])
def test_variants(spark, block):
    r = random.Random(block)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(6, 9))) for _ in range(250)} | {"banana", "bananana", "anananan", "nanananan", "aaaaaa", "aaaaaaa", "aaaaaaaa"}
    n = {w: int(10 ** r.uniform(0.7, 4)) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert {tuple(x) for x in spelling.variants(df, block=block).collect()} == plain_variants(n)


def test_counted(spark):
    docs = [(1, "Beacons beacons BEACONS, beacons-beacons x"), (None, None), (2, ""), (3, "Éclairs éclairs " * 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("mine"))
    assert {tuple(x) for x in spelling.counted(df).collect()} == {("beacons", 5), ("Éclairs", 5), ("éclairs", 5)}
