"""Runs of words that repeat with a period, by comparing a text's word numbers with themselves at every shift.

At shift q a run of period q and LEAST_EXPONENT times its length is a stretch of equal places at least
(LEAST_EXPONENT - 1) * q long. Small shifts are compared whole, over all texts of a batch at once. Shifts from SMALL on are
compared an octave at a time at places so far apart that no such stretch can lie between two of them; where they hit, the
stretch is followed to both ends. Texts of over LONG bytes are read once for each range of shifts, each by a task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: A run is at least so many words long, and so many periods.
LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Shifts under this are compared whole.
SMALL = 64
#: Places of larger shifts are compared by this many words at once, or fewer.
GRAM = 4
#: Texts of more bytes are dealt into ranges of shifts.
LONG = 1 << 20
#: Words whose small shifts are compared at once.
BATCH = 1 << 20
RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def numbered(words: list[bytes]):
    """The words as numbers, equal ones alike."""
    import numpy as np

    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _stretch(ids, q: int, at: int) -> tuple[int, int]:
    """The longest [start, end) of places around at that equal those q words on; at is one of them."""
    import numpy as np

    def follow(a, b, most):
        """How many words from a and b on are equal, most at most."""
        done, step = 0, 256
        while done < most:
            step = min(step, most - done)
            other = np.flatnonzero(a[done : done + step] != b[done : done + step])
            if len(other):
                return done + int(other[0])
            done, step = done + step, step * 4
        return done

    after = follow(ids[at:], ids[at + q :], len(ids) - q - at)
    before = follow(ids[:at][::-1], ids[q : q + at][::-1], at)
    return at - before, at + after


def _smallest(ids, start: int, q: int) -> int:
    """The smallest period of a run with period q that begins at start and is at least twice as long."""
    import numpy as np

    block, p, rest, f = ids[start : start + 2 * q], q, q, 2
    while rest > 1:
        if rest % f:
            f = f + 1 if f * f <= rest else rest
            continue
        rest //= f
        while p % f == 0 and np.array_equal(block[:q], block[p // f : p // f + q]):
            p //= f
    return p


def small_runs(ids, most: int = SMALL) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) with a period below most in ids, which may hold several texts, each with numbers of its
    own; start counts from the first text."""
    import numpy as np

    out = []
    for q in range(1, min(most, len(ids) // LEAST_EXPONENT + 1)):
        need = max(LEAST_WORDS, LEAST_EXPONENT * q) - q
        same = np.flatnonzero(ids[:-q] == ids[q:])
        if len(same) < need:
            continue
        cut = np.flatnonzero(np.diff(same) != 1)
        first, last = np.r_[0, cut + 1], np.r_[cut, len(same) - 1]
        long = last - first + 1 >= need
        for a, b in zip(same[first[long]].tolist(), same[last[long]].tolist()):
            if _smallest(ids, a, q) == q:
                out.append((a, b + 1 - a + q, q))
    return out


def large_runs(ids, low: int, high: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one text with a period from low to high - 1, low being SMALL or more."""
    import numpy as np

    n, out, known, found = len(ids), [], [], set()
    if n < LEAST_EXPONENT * low:
        return out
    # A place's gram: equal exactly if the next words are, GRAM of them or as many as 63 bits hold.
    bits = max(1, int(ids.max()).bit_length())
    size = min(GRAM, 63 // bits)
    grams = sum(ids[k : n - size + 1 + k] << (k * bits) for k in range(size))
    while low < min(high, n // LEAST_EXPONENT + 1):
        top = min(2 * low, high, n // LEAST_EXPONENT + 1)
        step = (LEAST_EXPONENT - 1) * low - size + 1
        for m in range(0, len(grams) - low, step):
            there = grams[m + low : m + top]
            for q in (np.flatnonzero(there == grams[m]) + low).tolist():
                # Within a run of a smaller period that divides q, and well inside of it, all of that period is known.
                if any(q % p == 0 and a <= max(0, m - 2 * q) and b >= min(n, m + 3 * q) for a, b, p in known):
                    continue
                a, b = _stretch(ids, q, m)
                b += q
                if b - a < LEAST_EXPONENT * q or (a, q) in found:
                    continue
                found.add((a, q))
                p = _smallest(ids, a, q)
                if p == q:
                    out.append((a, b - a, q))
                elif (a, b, p) not in known:
                    known.append((a, b, p))
        low = top
    return out


def ranges(n: int, width: int = 1 << 16) -> list[tuple[int, int]]:
    """Ranges of shifts of a text of at most n words: the small ones, then octaves, larger ones cut into parts."""
    out, low, top = [(1, SMALL)], SMALL, n // LEAST_EXPONENT + 1
    while low < top:
        high = min(2 * low, top)
        out += [(a, min(a + width, high)) for a in range(low, high, width)]
        low = high
    return out


def finished(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The values of RESULT for a text's words and all its runs."""
    import hashlib
    from fractions import Fraction

    import numpy as np

    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        r = np.array(runs)
        np.add.at(gone, r[:, 0] + r[:, 2], 1)
        np.add.at(gone, r[:, 0] + r[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()
    start, length, period = best or (None, None, None)
    return len(runs), start, length, period, 1000 * length // period if best else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def planted(words: list[bytes], h: int | None) -> list[bytes]:
    """The words with a repeating tail where the number says so; as they are where it is null."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * -(-(n - a) // p))[: n - a]


def _words(text: bytes | None, h: int | None) -> list[bytes]:
    return planted((text or b"").split(), h)


def _whole(batches):
    """Rows (key, text, h) to (key, *RESULT), all ranges of shifts at once."""
    import numpy as np
    import pyarrow as pa

    def done(keys, texts):
        ids, base = [], 0
        for words in texts:
            own = numbered(words)
            ids.append(own + base)
            base += len(words)
        ends = np.cumsum([len(x) for x in ids])
        every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        runs: list[list] = [[] for _ in texts]
        for a, n, q in small_runs(every):
            k = int(np.searchsorted(ends, a, "right"))
            runs[k].append((a - int(ends[k] - len(ids[k])), n, q))
        for k, own in enumerate(ids):
            runs[k] += large_runs(own - own.min() if len(own) else own, SMALL, len(own))
        rows = [finished(w, r) for w, r in zip(texts, runs)]
        types = [pa.int64()] * 5 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], ["key", *[c.split()[0] for c in RESULT.split(", ")]])

    for batch in batches:
        keys, texts, size = [], [], 0
        for key, text, h in zip(*[c for c in batch.columns]):
            keys.append(key.as_py())
            texts.append(_words(text.as_py(), h.as_py()))
            size += len(texts[-1])
            if size >= BATCH:
                yield done(keys, texts)
                keys, texts, size = [], [], 0
        if keys:
            yield done(keys, texts)


def _ranged(batches):
    """Rows (row, text, h, low, high) to runs (row, start, length, period) with a period in that range."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for row, text, h, low, high in zip(*batch.columns):
            ids = numbered(_words(text.as_py(), h.as_py()))
            low, high = low.as_py(), high.as_py()
            runs = small_runs(ids, high) if low < SMALL else large_runs(ids, low, high)
            found = np.array(runs, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(found), pa.int64()), *[pa.array(found[:, k]) for k in range(3)]], ["row", "start", "length", "period"])


def _gathered(batches):
    """Rows (key, text, h, runs) to (key, *RESULT)."""
    import pyarrow as pa

    types = [pa.int64()] * 5 + [pa.string()] * 2
    for batch in batches:
        for key, text, h, runs in zip(*batch.columns):
            row = finished(_words(text.as_py(), h.as_py()), [(r["start"], r["length"], r["period"]) for r in runs.as_py() or []])
            yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.int64()), *[pa.array([v], t) for v, t in zip(row, types)]], ["key", *[c.split()[0] for c in RESULT.split(", ")]])


def runs(docs: DataFrame, text: str = "text", id_col: str = "doc_id", plant=None, long: int = LONG) -> DataFrame:
    """One row for each row of docs: doc_id, n_runs, the run with the greatest exponent (start, length, period, exponent_milli;
    ties: smallest start, then period; nulls if none), runs_sha256 and collapsed_sha256.

    A run is a stretch of words, as long as can be, with smallest period q and at least LEAST_WORDS words and
    LEAST_EXPONENT * q; collapsed, of every run only the first q words are kept. plant, a column of an unsigned number or
    null, makes a text repeat itself as planted says. Null and empty texts have no words and no runs. Repeated rows
    come each, an empty table gives none. Texts of over long bytes are compared by ranges of shifts, in tasks of their own."""
    plant = F.lit(None).cast("long") if plant is None else plant.cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text).cast("binary").alias("text"), plant.alias("h"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    small = rows.filter(size <= long).mapInArrow(_whole, f"key long, {RESULT}")
    large = staged(rows.filter(size > long).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    # A word takes two bytes at least, with the space after it.
    of = F.udf(lambda n: [{"low": a, "high": b} for a, b in ranges(n // 2 + 1)], "array<struct<low:int,high:int>>")
    dealt = large.select("row", "text", "h", F.inline(of(F.octet_length("text")))).select("row", "text", "h", "low", "high")
    dealt = dealt.repartition("row", "low")
    found = dealt.mapInArrow(_ranged, "row long, start long, length long, period long")
    found = staged(found.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs")), "long-runs")
    long_rows = large.join(found, "row", "left").select("key", "text", "h", "runs").mapInArrow(_gathered, f"key long, {RESULT}")
    return small.unionByName(long_rows).withColumnRenamed("key", "doc_id")
