"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives, at any place of a new text, the longest match in
that text: a phrase. The language that needs the fewest phrases wins, each phrase counted at the bits needed to
point into that language's training text (log2 of its length), per character of the new text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the labelled sample: characters a language, of one document, and languages, those with the most text.
SAMPLE, EXCERPT, LANGUAGES = 60_000, 3_000, 256
#: Texts are parsed in stretches of so many symbols, many stretches at a time, and put together exactly.
WIDTH = 256


@dataclass
class Model:
    """Suffix automata of the languages in one table, a state being a number of its own. Its transition by symbol c is
    at cell[state + c]: the state in the upper half, where it leads in the lower one; another state there says
    that there is none. From start there is none at all: a parse begins there, and again after a symbol that a language doesn't have."""

    langs: list[str]
    letters: dict[str, int]
    lengths: list[int]
    start: int = 0
    cell: object = None
    first: object = None  # by symbol and language: the state after a phrase's first symbol


def _automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Suffix automaton: the transitions of each state; state 0 is the root and all states accept."""
    size, link, step = [0], [-1], [{}]
    last = 0
    for c in symbols:
        now = len(size)
        size.append(size[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[now] = q
            else:
                twin = len(size)
                size.append(size[p] + 1)
                link.append(link[q])
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return step


def _packed(steps: list[list[dict]], symbols: int):
    """(start, cell, first) of all automata. States with several transitions are laid out first, each at the first number
    from a spot of its own on that no state has and with which its symbols fall on free cells; those with one fill what is left."""
    import numpy as np

    edges = sum(len(to) for step in steps for to in step)
    span = edges + edges // 4 + 1
    start = span + symbols  # its cells are nobody's
    taken, used = bytearray(start + symbols + 1), bytearray(start + symbols + 1)
    numbers = [[0] * len(step) for step in steps]
    many = sorted(((k, i, to) for k, step in enumerate(steps) for i, to in enumerate(step) if len(to) > 1), key=lambda x: (-len(x[2]), x[0], x[1]))
    for k, i, to in many:
        at = (k * 40_503 + i) * 2654435761 % span
        while used[at] or any(taken[at + c] for c in to):
            at = at + 1 if at < span - 1 else 0
        used[at], numbers[k][i] = 1, at
        for c in to:
            taken[at + c] = 1
    free, aside, slot = iter(range(symbols, start)), [], 0
    for k, step in enumerate(steps):
        for i, to in enumerate(step):
            if len(to) == 1:
                (c,) = to
                found = next((x for x in aside[-8:] if not used[x - c]), None)
                if found is not None:
                    aside.remove(found)
                else:
                    while (found := next(free, None)) is not None and (taken[found] or used[found - c]):
                        if not taken[found]:
                            aside.append(found)
                    if found is None:
                        found = next(x for x in range(symbols, start + symbols) if not taken[x] and not used[x - c])
                taken[found], used[found - c], numbers[k][i] = 1, 1, found - c
    for k, step in enumerate(steps):
        for i, to in enumerate(step):
            if not to:
                slot = next(x for x in range(slot, start) if not used[x])
                used[slot], numbers[k][i] = 1, slot
    cell = np.full(start + symbols + 1, -1 << 32, np.int64)
    for own, step in zip(numbers, steps):
        flat = np.array([(own[i] + c, own[i], own[t]) for i, to in enumerate(step) for c, t in to.items()], np.int64).reshape(-1, 3)
        cell[flat[:, 0]] = flat[:, 1] << 32 | flat[:, 2]
    first = np.full((symbols, len(steps)), start, np.int64)
    for k, (own, step) in enumerate(zip(numbers, steps)):
        for c, t in step[0].items():
            first[c, k] = own[t]
    return start, cell, first


def _symbol_table(letters: dict[str, int]):
    """Code point -> symbol: 0 for all but letters, 1 for a letter that no language has, else the letter's own."""
    import numpy as np

    table = np.zeros(0x110000, np.uint16 if len(letters) < 65_000 else np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = letters.get(low if len(low) == 1 else c, 1)
    return table


def _symbols(texts: list[str], table, block: int = 1 << 22):
    """Symbols of all texts in a row, runs of symbol 0 as one, and each text's number of symbols."""
    import numpy as np

    lengths = np.array([len(t) for t in texts], np.int64)
    whole = "".join(texts) if len(texts) != 1 else texts[0]
    look = lambda t: table[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")]
    s = np.concatenate([look(whole[k : k + block]) for k in range(0, len(whole), block)] or [table[:0]])
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    keep[starts] = True
    if len(starts):
        lengths[lengths > 0] = np.add.reduceat(keep, starts, dtype=np.int64)
    return s[keep], lengths


def sample(labelled: DataFrame, text: str, lang: str, id_col: str, chars: int = SAMPLE, excerpt: int = EXCERPT, languages: int = LANGUAGES) -> list[tuple[str, str]]:
    """A bounded sample of (lang, text): about 2 * chars characters a language, of excerpt a document at most, in hash
    order, of the languages with the most text.

    Rows are drawn by id and text, so copies of one text are drawn apart, and equal excerpts come once."""
    own = labelled.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    held = own.select("lang", F.least(F.length("text"), F.lit(excerpt)).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    share = F.least(F.lit(1.0), F.lit(2.0 * chars) / F.col("n"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(5), "id", "text"), 11) / float(1 << 53)
    drawn = own.join(F.broadcast(held), "lang").filter(place <= share)
    rows = drawn.groupBy("lang", F.substring("text", 1, excerpt).alias("text")).agg(F.min(place).alias("place")).collect()
    return [(r.lang, r.text) for r in sorted(rows, key=lambda r: (r.lang, r.place, r.text))]


def fit(rows: list[tuple[str, str]], chars: int = SAMPLE) -> Model:
    """Automata of the rows (lang, text): the same number of characters for all languages that have them. All letters
    of the sample are told apart, whatever their script."""
    import numpy as np

    seen = sorted({c for _, t in rows for x in t.lower() for c in x if c.isalpha()})
    known = {c: k + 2 for k, c in enumerate(seen)}
    table, model, steps = _symbol_table(known), Model([], known, []), []
    for lang in sorted({r[0] for r in rows}):
        s, _ = _symbols([t + " " for x, t in rows if x == lang], table)
        if (s != 0).any():
            s = s[:chars]
            model.langs.append(lang)
            model.lengths.append(len(s))
            steps.append(_automaton(s.tolist()))
    model.start, model.cell, model.first = _packed(steps, len(known) + 2)
    return model


class Parser:
    """Counts the phrases of texts under each of a model's languages, all languages and many stretches in lockstep."""

    def __init__(self, model: Model):
        self.model, self.table = model, _symbol_table(model.letters)

    def _step(self, state, c, lang=None):
        """The next states by symbols c, and which of them begin a phrase. state: by place and language, or lang names each one's."""
        import numpy as np

        m = self.model
        cell = m.cell.take(state + (c[:, None] if lang is None else c))
        miss = (cell >> 32) != state
        first = m.first.take(c, 0) if lang is None else m.first[c, lang]
        return np.where(miss, first, cell & 0xFFFFFFFF), miss

    def phrases(self, texts: list[str]):
        """The number of phrases of each text under each language, the number of symbols, and whether it has a letter.

        A phrase is the longest match from where the last one ended; a symbol that a language doesn't have is one of its
        own. Stretches are parsed as if a phrase began with each. Then the phrase that a stretch before was in is carried on
        until a phrase of both ways begins at one place: from there on they are the same. A parse that never meets the
        stretch's own is carried through as many stretches as it takes."""
        import numpy as np

        s, lengths = _symbols(texts, self.table)
        letters = lengths > 0
        if letters.any():
            letters[letters] = np.add.reduceat(s != 0, (np.cumsum(lengths) - lengths)[letters], dtype=np.int64) > 0
        k, width = len(self.model.langs), WIDTH
        stretches = -(-lengths // width)
        of = np.repeat(np.arange(len(texts)), stretches)
        within = np.arange(len(of)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        at = (np.cumsum(lengths) - lengths)[of] + within * width
        left = np.minimum(width, lengths[of] - within * width)
        counts = np.zeros((len(texts), k), np.int64)
        carried = np.full(k, self.model.start, np.int64)
        some = max(64, (1 << 24) // (width * k))
        for begin in range(0, len(of), some):
            own = slice(begin, begin + some)
            found, carried = self._run(s, at[own], left[own], within[own] > 0, carried)
            np.add.at(counts, of[own], found)
        return counts.T, lengths, letters

    def _run(self, s, at, left, goes_on, carried):
        """Phrases that begin in each of consecutive stretches, by language, and the states after the last of them."""
        import numpy as np

        n, k = len(at), len(self.model.langs)
        order = np.argsort(-left, kind="stable")
        begins = np.zeros((WIDTH, n, k), bool)
        state = np.full((n, k), self.model.start, np.int64)
        sorted_at, ends = at[order], -left[order]
        for t in range(int(left.max())):
            active = int(np.searchsorted(ends, -t))
            state[:active], begins[t, :active] = self._step(state[:active], s.take(sorted_at[:active] + t).astype(np.int64))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        begins, exits = begins[:, place], state[place]
        counts = begins.sum(0)
        # Each stretch anew from where the one before left off, until both ways begin a phrase at one place.
        i, lang = (x.ravel() for x in np.meshgrid(np.flatnonzero(goes_on), np.arange(k), indexing="ij"))
        now = np.vstack([carried[None], exits[:-1]])[i, lang]
        new, old = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        lost = []
        for t in range(WIDTH):
            done = left[i] <= t
            if done.any():
                # At the end of a text there is nothing to meet; else the next stretch begins in a state not known yet.
                counts[i[done], lang[done]] += new[done] - old[done]
                i, lang, now, new, old = (x[~done] for x in (i, lang, now, new, old))
            if not len(i):
                break
            now, miss = self._step(now, s.take(at[i] + t).astype(np.int64), lang)
            mine = begins[t, i, lang]
            new, old = new + miss, old + mine
            met = miss & mine
            if met.any():
                counts[i[met], lang[met]] += new[met] - old[met]
                i, lang, now, new, old = (x[~met] for x in (i, lang, now, new, old))
        counts[i, lang] += new - old
        whole = left[i] == WIDTH
        lost = sorted(zip(lang[whole].tolist(), i[whole].tolist(), now[whole].tolist()))
        cell = memoryview(self.model.cell)
        seen = (-1, -1)
        for q, j, here in lost:
            if (q, j) <= seen:
                continue  # carried through already
            first = memoryview(np.ascontiguousarray(self.model.first[:, q]))
            # Through the stretches after it, until both ways meet or the text ends.
            while True:
                exits[j, q], seen = here, (q, j)
                j += 1
                if j == n or not goes_on[j]:
                    break
                total, met = 0, False
                for t, c in enumerate(s[at[j] : at[j] + left[j]].tolist()):
                    found = cell[here + c]
                    if found >> 32 == here:
                        here = found & 0xFFFFFFFF
                        continue
                    here, total = first[c], total + 1
                    if begins[t, j, q]:
                        met = True
                        break
                counts[j, q] = total + int(begins[t + 1 :, j, q].sum()) if met else total
                if met:
                    seen = (q, j)
                    break
        return counts, exits[-1]

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        """(lang, score) of each text: `und` and 0 without letters. Of equal languages the first by name wins."""
        import numpy as np

        m = self.model
        if not m.langs or not texts:
            return [("und", 0.0)] * len(texts)
        total, lengths, letters = self.phrases(texts)
        bits = total * np.log2(np.maximum(m.lengths, 2))[:, None] / np.maximum(lengths, 1)
        best = bits.argmin(0)
        # Odds of the languages over as much text as tells them apart, at most 40 symbols.
        odds = 2.0 ** ((bits.min(0) - bits) * np.minimum(lengths, 40))
        score = 1.0 / odds.sum(0)
        return [(m.langs[b], float(x)) if ok else ("und", 0.0) for b, x, ok in zip(best, score, letters)]


def _chunks(texts, most: int = 1 << 21):
    """Consecutive texts of about so many characters together, a text always whole."""
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t)
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


def predictor(spark, model: Model):
    """A column function: text -> struct(lang_pred, score). Null and texts without letters: `und`, 0."""
    held, own = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import sys
        import types

        kept = sys.modules.setdefault("_dayscribe_worker", types.ModuleType("_dayscribe_worker"))
        if getattr(kept, "key", None) != own:
            kept.value, kept.key = None, own
            kept.value = Parser(held.value)
        parse = kept.value
        for texts in batches:
            rows = [r for some in _chunks([t or "" for t in texts]) for r in parse(some)]
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    return predict


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", folds: int = 5, **bounds) -> Model:
    """A model of the labelled documents outside the held-out fold (crc32 of the id as text, mod folds, is 0); a null id is in none.
    bounds: chars, excerpt and languages of the sample."""
    held = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0
    rows = sample(docs.filter(~held), text, lang, id_col, **bounds)
    return fit(rows, bounds.get("chars", SAMPLE))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", folds: int = 5) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score. Learns from docs itself. Null text, and text
    without a letter, is `und` with score 0; a letter of a script that no language has makes phrases of one symbol.

    Repeated rows are each predicted, alike. A null id is outside the held-out fold's training rows and returned with held_out false. Without labelled
    text, and for an empty table, all predictions are `und`."""
    predict = predictor(docs.sparkSession, learn(docs, text, lang, id_col, folds))
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), predict(F.col(text)).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def identified(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """docs without those whose language can't be told (`und`: null, empty or without a letter); columns unchanged,
    whatever their names. Repeated rows stay or go together. Without labelled text, rows with a
    letter stay."""
    model = learn(docs, text, lang, id_col)
    if not model.langs:
        return docs.filter(F.col(text).rlike(r"\p{L}"))
    predict = predictor(docs.sparkSession, model)
    return docs.filter(predict(F.col(text))["lang_pred"] != "und")
