"""Each query, as registered, on odd tables (nulls, empty texts, ties, repeated rows and ids, columns whose names
operators use inside) and on empty ones, against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dayscribe.llm import html_text, langid, mixing, periodic, queries, tokens

from .test_new_operators import plain_planted, plain_runs, plain_variants, plain_words
from .test_operators import DOC, PAGES, documents, plain_fingerprint, plain_targets, prose, roots, vectors

CLASHES = ("digest", "keep_id", "place", "row", "h", "size", "fp", "position", "none", "component_id", "bucket", "start", "part", "ids", "host", "rule", "label", "lang_pred", "k1", "tree")
VECTORS = "vec_id long, embedding array<double>, label int"
ITEMS = "item_id long, text string"


def rows_of_documents():
    """The odd documents, ids that two texts share, and rows that repeat; sequences that the token files need keep ids apart."""
    near = prose(7, 400)
    more = [(400, near.replace("tide", "tidal", 1), "en", "s0", 1), (400, "another text of that id", None, None, 1), (None, "no id either", "fr", None, 1)]
    return documents() + more


def rows_of_items():
    """Whole items and short ones, some that occur, one in all, equal ones, ones without words, id or text."""
    long = prose(5, 30000).split()
    found = [(k, " ".join(long[700 * k : 700 * k + 8 + 3 * k])) for k in range(6)]
    more = [(20, "Lantern"), (21, "no id"), (22, "one AND the: same"), (23, "zebra harbor"), (24, None), (25, " .,; "), (26, "日本"), (27, "words here, upper"), (28, "upper case words here")]
    apart = [(30, "the sea " * 40), (31, f"{prose(7, 400)} and then other words of a kind that nobody here ever wrote down at all"), (None, "d\x1c日本"), (None, "one and the same")]
    return found + more + apart + [found[4], (40, found[4][1]), (41, found[4][1].upper().replace(" ", " -- "))]


def rows_of_pages():
    page = "<html><body><div class=top>Harbor news</div><nav><a href=x>{0}</a></nav><article><h1>{1}</h1><p>{2}<p>&amp; so on {0}<p>Share this page</article><div class=ad>{3}</div></body></html>"
    rows = [(k, f"https://M.Harbor.example/{'en' if k % 2 else 'de'}/{k}?a={k}", page.format(prose(k, 2), prose(50 + k, 3), prose(90 + k, 30), prose(130 + k, 4))) for k in range(12)]
    return rows + [(3, rows[3][1], rows[3][2]), (90, None, None), (91, "", ""), (92, "http://x.org/es/1", "<p>one</p>"), (None, "ftp://y.net/de/2", "two"), (94, "no host", "<div>three")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    tables = {"documents": (rows_of_documents(), DOC), "pages": (rows_of_pages(), PAGES), "embeddings": (vectors(), VECTORS), "benchmark": (rows_of_items(), ITEMS)}
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        for c in CLASHES:
            if c not in df.columns:
                df = df.withColumn(c, F.lit("mine"))
        df.repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("nothing"))
    for name, schema in (("documents", DOC), ("pages", PAGES), ("embeddings", VECTORS), ("benchmark", ITEMS)):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def encoded():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_no_row(spark, nothing, name):
    assert queries.QUERIES[name](spark, nothing).count() == 0


def test_op1(spark, odd):
    rows = queries.QUERIES["op1_language_id"](spark, odd).collect()
    given = rows_of_documents()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, *_ in given)
    model = langid.learn(spark.read.parquet(f"{odd}/documents.parquet"))
    want = defaultdict(list)
    for (d, t, *_), (lang, score) in zip(given, langid.Parser(model)([t or "" for _, t, *_ in given])):
        want[d].append((lang, round(score, 9)))
    got = defaultdict(list)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        got[r.doc_id].append((r.lang_pred, round(r.score, 9)))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}
    assert {lang for d in (300, 301, 302, 308) for lang, _ in got[d]} == {"und"}


def test_op2(spark, odd):
    groups = defaultdict(list)
    for d, t, *_ in rows_of_documents():
        groups[t or ""].append(d)
    last = {t: max(own, key=lambda x: -1 if x is None else x) for t, own in groups.items()}
    want = Counter((d, last[t], len(own), hashlib.sha256(t.encode()).hexdigest()) for t, own in groups.items() for d in own)
    rows = queries.QUERIES["op2_exact_dedup"](spark, odd).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)


def groups_of(given):
    a = np.array([plain_fingerprint(t) for _, t, *_ in given], np.uint64)
    return a, roots(len(a), [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4) if j > i])


def test_op4(spark, odd):
    given = rows_of_documents()
    fps, group = groups_of(given)
    low = defaultdict(list)
    for (d, *_), g in zip(given, group):
        low[g] += [] if d is None else [d]
    want = Counter((d, f"{int(fp):016x}", min(low[g], default=None)) for (d, *_), fp, g in zip(given, fps, group))
    assert Counter(map(tuple, queries.QUERIES["op4_simhash_near_dedup"](spark, odd).collect())) == want


def test_op5(spark, odd):
    import re

    given = rows_of_documents()
    count = lambda t: len(re.findall(mixing.WORD, t or ""))
    sizes = Counter()
    for _, t, _, s, _ in given:
        sizes[s] += count(t)
    aims = plain_targets(dict(sizes))
    rows = queries.QUERIES["op5_source_mixing"](spark, odd).collect()
    assert Counter((r.doc_id, r.size, r.source, r.source_size) for r in rows) == Counter((d, count(t), s, sizes[s]) for d, t, _, s, _ in given)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert all(r.target == pytest.approx(aims[s]) and r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0) for r in own)
        assert abs(sum(r.taken for r in own) - aims[s]) <= 2 * max(r.size for r in own)
    assert sorted(map(str, rows)) == sorted(map(str, queries.QUERIES["op5_source_mixing"](spark, odd).collect()))


def test_op6(spark, odd, encoded):
    want = Counter((d, len(encoded(t)) + 1) for d, t, *_ in rows_of_documents())
    assert Counter(map(tuple, queries.QUERIES["op6_token_counts"](spark, odd).collect())) == want


def test_op7(spark, odd, encoded):
    rows = sorted(queries.QUERIES["op7_token_files"](spark, odd).collect(), key=lambda r: r.start)
    given = defaultdict(list)
    for d, t, *_ in rows_of_documents():
        ids = [*encoded(t), 2]
        given[d].append((len(ids), crc(ids)))
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        given[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(given.values())
    order = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert order == sorted(order)


def test_op8(spark, odd):
    rows = queries.QUERIES["op8_main_text"](spark, odd).collect()
    want = Counter()
    for k, url, html in rows_of_pages():
        if url and "Harbor" in url:
            text = f"{prose(50 + k, 3)}\n\n{prose(90 + k, 30)}\n\n& so on {prose(k, 2)}"  # what all pages share is left out
        else:
            text = html_text.extract(html)  # hosts of few pages: each by itself
        want[k, url, text, len(text)] += 1
    assert Counter(map(tuple, rows)) == want


def test_op9(spark, odd):
    import re

    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    want = Counter()
    for k, url, _ in rows_of_pages():
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        raw = re.split("[/?#]", rest)[0]
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), raw), re.match("[^?#]*", rest[len(raw) :])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[(k, host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None)] += 1
    rows = queries.QUERIES["op9_url_filter"](spark, odd).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in rows) == want
    assert all(r.verdict in ("allow", "block") for r in rows) and {r.verdict for r in rows if r.page_id == 90} == {"allow"}


def packed(rows):
    """The pieces' sequences hold no gap, and are whole but for powers of two."""
    sequences = defaultdict(list)
    for r in rows:
        assert r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
    held = []
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        held.append(own[-1][0] + own[-1][1])
    assert max(held) <= 1024 and all(n & (n - 1) == 0 for n in held if n != 1024) and sum(n != 1024 for n in held) <= 10


def test_op10(spark, odd, encoded):
    rows = queries.QUERIES["op10_packing"](spark, odd).collect()
    packed(rows)
    want = defaultdict(list)
    for d, t, *_ in rows_of_documents():
        want[d].append([*encoded(t), 0])
    for d, own in want.items():
        found = [r for r in rows if r.doc_id == d]
        assert sum(r.length for r in found) == sum(map(len, own)) and {r.doc_tokens for r in found} == {len(x) for x in own}
        if len(own) == 1:
            at = 0
            for r in sorted(found, key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == crc(own[0][at : at + r.length])
                at += r.length


def test_op11(spark, odd):
    items = [(k, plain_words(t)) for k, t in rows_of_items()]
    want = Counter()
    for d, t, *_ in rows_of_documents():
        w, hit, own = plain_words(t), set(), set()
        places = {n: defaultdict(list) for n in {min(len(x), 10) for _, x in items if x}}
        for n, at in places.items():
            for i in range(len(w) - n + 1):
                at[tuple(w[i : i + n])].append(i)
        for k, x in items:
            n = min(len(x), 10)
            for j in range(len(x) - n + 1 if n else 0):
                for i in places[n].get(tuple(x[j : j + n]), ()):
                    hit.update(range(i, i + n))
                    own |= {str(k)} if k is not None else set()
        want[d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)] += 1
    rows = queries.QUERIES["op11_decontamination"](spark, odd).collect()
    assert Counter(map(tuple, rows)) == want and len({r.n_items for r in rows}) > 3


def test_op12(spark, odd):
    want = Counter()
    for d, t, *_ in rows_of_documents():
        words, kept, listed, best = plain_planted((t or "").encode(), d), [], [], None
        runs = plain_runs(words) if len(words) < 3000 else periodic.small_runs(periodic.numbered(words)) + periodic.large_runs(periodic.numbered(words), 64, len(words))
        for a, n, q in sorted(runs, key=lambda r: (r[0], r[2])):
            listed.append(f"{a},{n},{q}\n")
            if best is None or n * best[2] > best[1] * q:
                best = (a, n, q)
        kept = [w for i, w in enumerate(words) if not any(a + q <= i < a + n for a, n, q in runs)]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        want[(d, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(listed).encode()), sha(b" ".join(kept)))] += 1
    rows = queries.QUERIES["op12_periodic_runs"](spark, odd).collect()
    assert Counter(map(tuple, rows)) == want and any(r.n_runs for r in rows)


def test_op13(spark, odd):
    import re

    n = Counter()
    for d, t, *_ in rows_of_documents():
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 6
    n = {w: k for w, k in n.items() if k >= 5}
    want = plain_variants(n)
    assert {tuple(r) for r in queries.QUERIES["op13_spelling_variants"](spark, odd).collect()} == want and want


def test_pipeline(spark, odd, encoded):
    """All stages on odd rows: what may go goes, what mustn't stays, and the pieces hold what the mix takes."""
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns, given = docs.columns, rows_of_documents()
    texts = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    first, second, third, fourth, last = (stage for _, stage in corpus_pipeline.STAGES)
    told = first(spark, docs, odd).cache()
    now = [(d, t, *rest) for d, t, *rest in given if any(c.isalpha() for c in t or "")]
    assert told.columns == columns and texts(told) == Counter((d, t) for d, t, *_ in now)
    once = second(spark, told, odd).cache()
    best = {}
    for d, t, *rest in now:
        if t not in best or (best[t][0] is None or d is not None and d > best[t][0]):
            best[t] = (d, t, *rest)
    assert once.columns == columns and texts(once) == Counter((d, t) for d, t, *_ in best.values())
    apart = third(spark, once, odd).cache()
    now = list(best.values())
    _, group = groups_of(now)
    of = {(d, t): g for (d, t, *_), g in zip(now, group)}
    low = defaultdict(list)
    for (d, *_), g in zip(now, group):
        low[g].append(float("inf") if d is None else d)
    kept = apart.collect()
    assert apart.columns == columns and sorted(of[r.doc_id, r.text] for r in kept) == sorted(low)
    assert all((float("inf") if r.doc_id is None else r.doc_id) == min(low[of[r.doc_id, r.text]]) for r in kept)
    mixed = fourth(spark, apart, odd).cache()
    copies = Counter({(r.doc_id, r.size): r.copies for r in mixing.assign(apart).collect()})
    taken = texts(mixed)
    assert mixed.columns == columns and set(taken) <= {(r.doc_id, r.text) for r in kept} and sum(taken.values()) == sum(copies.values())
    rows = last(spark, mixed, odd).collect()
    packed(rows)
    tokens_of = Counter()
    for (d, t), n in taken.items():
        tokens_of[d] += n * (len(encoded(t)) + 1)
    found = Counter()
    for r in rows:
        found[r.doc_id] += r.length
    assert found == tokens_of
    whole = corpus_pipeline.run(spark, odd)
    assert whole.agg(F.sum("length")).first()[0] == sum(found.values())
