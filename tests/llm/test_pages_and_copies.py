"""Broken and large pages, names within articles, wrappers beside groups of pages; hot fingerprints."""

import time

import pytest
from pyspark.sql import functions as F

from dayscribe.llm import html_text, simhash

from .test_operators import DOC, PAGES, host_pages, prose

BROKEN = {
    "tags that never end": "<a " * 350_000, "quotes around every end": '<a ">" ' * 150_000, "quotes of two kinds": "<a x='\">" * 120_000, "ends of what isn't open": "<div>" * 30_000 + "</table>" * 30_000,
    "ends behind a block": "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "blocks in inline markup": "<b>" * 60_000 + "<hr>" * 60_000, "a script that never ends": "<script>" + "</script " * 100_000,
    "comments": "<!-- " * 200_000, "lists": "<li><dt>" * 60_000, "signs": "<" * 1_000_000,
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_pages_take_time_as_they_are_long(name):
    """A megabyte of each in a second or so; in time that grows with the square of its length it would be hours."""
    began = time.time()
    html_text.parse(BROKEN[name])
    assert time.time() - began < 10


@pytest.mark.parametrize("html,text", [
    ('<p>one <a title="a>b">two</a> three', "one two three"), ("a <b class='x>y'>b</b", "a b</b"), ('<p title="never ends>told<p>more', "told\n\nmore"),
    ("<script>if (a</b) x</script>told", "told"), ("<!doctype html><!-- <p>no -->yes<!-- no", "yes"), ("<p>5 < 6 <7 >", "5 < 6 <7 >"), ("<i>a<div>b</i>c</div>d", "a\n\nbc\n\nd"),
])
def test_markup(html, text):
    assert html_text.extract(html) == text


NAMED = [
    '<blockquote class="alert">Mind the {0} tide</blockquote>', '<p class="social">Pilots of {0} met</p>', '<p class="comment">I think {0} is late</p>', '<table class="menu"><tr><td>Fish {0}</td></tr></table>',
    '<p>Seen <span class="notice">at {0}</span> dawn</p>',
]


def test_names_within_articles(spark):
    """What varies in an article is its text, whatever a paragraph is called; what is constant there, and adverts, go by name."""
    fixed = '<p class="notice">Subscribe to the harbor news</p><p class="ad">Rope from {0} for less</p><div class="related">See {0}</div>'
    rows = [(k, f"http://a.example/{k}", "<body><nav>menu</nav><article><p>" + prose(k, 60) + "</p>" + "".join(NAMED).format(f"w{k}") + fixed.format(f"w{k}") + "</article></body>") for k in range(12)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    for k in range(12):
        w = f"w{k}"
        assert got[k].split("\n\n") == [prose(k, 60), f"Mind the {w} tide", f"Pilots of {w} met", f"I think {w} is late", f"Fish {w}", f"Seen at {w} dawn"]


@pytest.mark.parametrize("group", [3, 1024])
def test_wrappers_beside_groups_of_pages(spark, monkeypatch, group):
    """Wrappers too large to broadcast give the same texts; so do copies, repeated rows and pages without a host."""
    monkeypatch.setattr(html_text, "GROUP", group)
    rows, _ = host_pages()
    rows += [(100 + k, "http://h.example/copy", rows[0][2]) for k in range(20)] + [rows[3], (None, None, None), (200, "no host", "<p>x"), (201, "http://Other.example/", "<p>y"), (202, "http://e.example", None)]
    df = spark.createDataFrame(rows, PAGES).withColumn("_group", F.lit("mine")).repartition(5)
    want = sorted(map(str, html_text.main_text(df).collect()))
    assert sorted(map(str, html_text.main_text(df, broadcast_bytes=0).collect())) == want and len(want) == len(rows)


def test_a_host_of_unlike_pages(spark, monkeypatch):
    """The wrapper has no more nodes than it may; pages that it leaves out are decided each by itself."""
    monkeypatch.setattr(html_text, "NODES", 60)
    shapes = ["".join(f"<div class={'abcdefgh'[(k >> j) & 7]}x>" for j in range(6)) + prose(k, 9) + "</div>" * 6 for k in range(64)]
    rows = [(k, "http://h.example/", f"<body>{x}</body>") for k, x in enumerate(shapes)]
    rows += [(100 + k, "http://h.example/", f"<body><nav>menu {k}</nav><article><p>{prose(900 + k, 30)}</article></body>") for k in range(30)]
    df = spark.createDataFrame(rows, PAGES)
    (wrapper,) = html_text.wrappers(df).collect()
    assert wrapper.tree.count("\n") < 60 and wrapper.pages == len(rows)
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert all(got[100 + k] == prose(900 + k, 30) for k in range(30)) and all(got[k] == prose(k, 9) for k in range(64))


def test_a_hot_fingerprint(spark):
    """A hundred thousand empty texts and as many copies beside others: their rows aren't one task's."""
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "").otherwise("one and the same text").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(300_000 + k, prose(k, 40), None, None, 1) for k in range(50)], DOC).select("doc_id", "text"))
    rows = simhash.near_duplicates(docs)
    got = {(r.component_id, r.n) for r in rows.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {(0, 100_000), (1, 100_000)} <= got and sum(n for _, n in got) == 200_050
    kept = simhash.dedup(docs)
    assert kept.count() == len(got)
    # The join that hands each row its component: its largest partition holds few of the rows that were shuffled.
    sizes = rows.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert max(r["count"] for r in sizes) < 150_000


def plain_host(pages):
    """Main texts of a host's pages, each a list of containers side by side, each of them a list of blocks, by the rules as stated:
    a block on nine of ten pages is constant; the content is the container with at least half of the weight, constant text
    counting a quarter; beside it small containers and constant blocks go, and within it the latter unless they are much of it."""
    n = len(pages)
    on = [{b: sum(b in page[k] for page in pages) for page in pages for b in page[k]} for k in range(len(pages[0]))]
    fixed = [{b for b, m in own.items() if m >= max(5, 0.9 * n)} for own in on]
    constant = [sum(len(b) * on[k][b] for b in fixed[k]) for k in range(len(on))]
    varying = [sum(len(b) * m for b, m in on[k].items() if b not in fixed[k]) for k in range(len(on))]
    mass = [v + 0.25 * c for v, c in zip(varying, constant)]
    best = max(range(len(mass)), key=lambda k: (mass[k], -k))
    core = [best] if 2 * mass[best] >= sum(mass) else list(range(len(mass)))
    kept = [k for k in range(len(mass)) if k in core or mass[k] >= 0.1 * mass[best]]
    kept = core if len(core) > 1 else kept
    copies = sum(constant[k] for k in core) > 0.25 * sum(varying[k] + constant[k] for k in core)
    return ["\n\n".join(b for k in kept for b in page[k] if not (b in fixed[k] and not (k in core and copies))) for page in pages]


@pytest.mark.parametrize("seed", range(8))
def test_a_host_by_the_rules_as_stated(spark, seed):
    """Random hosts without names: what is constant, which container is the content, which others stay."""
    import random

    r = random.Random(seed)
    slots, n = r.randrange(2, 6), r.choice((6, 11, 30))
    shape = [(r.choice((2, 10, 60)), r.choice((0.0, 0.5, 0.95, 1.0)), r.randrange(1, 4)) for _ in range(slots)]
    shared = [[prose(5000 + 100 * seed + 10 * k + j, size) for j in range(m)] for k, (size, _, m) in enumerate(shape)]
    pages = []
    for p in range(n):
        page = []
        for k, (size, odds, m) in enumerate(shape):
            blocks = [shared[k][j] if r.random() < odds else f"{prose(r.randrange(10**9), size)} {p} {k} {j}" for j in range(m)]
            page.append(list(dict.fromkeys(blocks)))
        pages.append(page)
    rows = [(p, "http://h.example/", "<body>" + "".join("<div>" + "".join(f"<p>{b}</p>" for b in own) + "</div>" for own in page) + "</body>") for p, page in enumerate(pages)]
    got = {x.page_id: x.text for x in html_text.main_text(spark.createDataFrame(rows, PAGES), names=False).collect()}
    assert got == dict(enumerate(plain_host(pages)))
