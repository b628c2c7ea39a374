"""Lexical column functions: words, content tokens, n-grams, and the references a digest can make."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Results depend on these very words, extensions, names and patterns.
STOPWORDS = tuple(
    "a an and are as at be been but by can did do does for from had has have how i in into is it its "
    "just like more new not of on or our out over should so some such than that the their them then there these they this "
    "to up use used using was we were what when which while who will with would you your also added fix fixed fixes "
    "update updated updates change changes changed "
    "name version private public main module modules scripts type types author "
    "engines description dependencies devdependencies peerdependencies license".split()
)
SUFFIXES = ("ing", "ies", "ed", "es", "s")
BANNED = ("next steps", "you should", "todo:", "as an ai")
CODE_EXTENSIONS = tuple(
    "js jsx ts tsx py go rs c h cpp hpp java kt kts svelte vue json yaml yml md css html xml sh toml sql rb php dart gradle cfg ini env proto".split()
)
NOT_FILES = tuple("node.js vue.js react.js next.js nuxt.js d3.js three.js express.js socket.io chart.js vite.js llama.cpp".split())
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
WORD = r"[a-z0-9_]+"
FILE_MENTION = r"(?U)\b[\w][\w/-]*\.([A-Za-z]{1,10})\b"
COUNT_CLAIM = rf"(?iU)\b(\d{{1,3}}|{'|'.join(NUMBERS)})\s+(?:active\s+|git\s+)*(?:repos?|repositories?|projects?)\b"
MODEL_NAME = (
    r"(?iU)\b(gpt(?:[- ]?\d[\w.]*)?|chatgpt|openai|anthropic|claude|gemini|bard|grok|mistral|deepseek|qwen(?:\d[\w.]*)?|gemma\d*|cohere|llama(?!\.?cpp))\b"
)
# End of the fixed values.
SPACE = r"[\s\x1c-\x1f\x85]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: str | Column) -> Column:
    """The text, empty where null."""
    return F.coalesce(col(c), F.lit(""))


def no_words() -> Column:
    return F.array().cast("array<string>")


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def barrier(df: DataFrame) -> DataFrame:
    """Same rows and columns behind a generator, past which the optimizer neither copies nor moves expressions.

    Without it a token array read inside a lambda is substituted by the tokenisation itself, once an element."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def words(c: str | Column) -> Column:
    return find_all(F.lower(text(c)), WORD)


def strip(c: str | Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(text(c), rf"(?U)^{SPACE}+", ""), rf"(?U){SPACE}+\z", "")


def lines(c: str | Column) -> Column:
    """Lines at every line boundary; a boundary at the end starts no further line."""
    parts = F.split(text(c), LINE_END, -1)
    n = F.size(parts)
    return F.when(text(c) == "", no_words()).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), n - 1)).otherwise(parts)


def word_count(c: str | Column) -> Column:
    """Number of runs between white space."""
    return F.size(find_all(text(c), rf"(?U)[^\s\x1c-\x1f\x85]+"))


def stem(w: Column) -> Column:
    """The word without the first of the suffixes that it has, if it's longer than 4."""
    out = w
    for s in reversed(SUFFIXES):
        out = F.when(w.endswith(s), F.substring(w, F.lit(1), F.length(w) - len(s))).otherwise(out)
    return F.when(F.length(w) > 4, out).otherwise(w)


def is_content(w: Column) -> Column:
    return (F.length(w) >= 3) & ~w.isin(*STOPWORDS)


def content_tokens(c: str | Column) -> Column:
    """Distinct stemmed content words in order of appearance; length and stop list are tested before stemming."""
    return F.array_distinct(F.transform(F.filter(words(c), is_content), stem))


def norm_repo(c: str | Column) -> Column:
    """Last segment of the name, without outer white space, in lower case."""
    return F.element_at(F.split(F.lower(strip(c)), "/"), -1)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if either is empty."""
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def ngrams(w: Column, n: int) -> Column:
    """Runs of n words joined by a space, in order; none if there are fewer."""
    at = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
    return F.when(F.size(w) >= n, F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(no_words())


def word_keys(w: Column, seed: int = 0) -> Column:
    """A 64-bit hash of each word."""
    return F.transform(w, lambda x: F.xxhash64(F.lit(seed), x))


def run_keys(w: Column, n: int) -> Column:
    """A 64-bit hash of each run of n words, in order; none if there are fewer. w, words or, better for long runs, their keys, must
    be a materialised column (see barrier). No run is ever put together as a text."""
    at = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
    # Few words are looked up one by one; more are cut out together.
    run = lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(n)]) if n <= 4 else F.xxhash64(F.slice(w, i, F.lit(n)))
    return F.when(F.size(w) >= n, F.transform(at, run)).otherwise(F.array().cast("array<bigint>"))


def trigrams(w: Column) -> tuple[Column, Column]:
    """Numbers of distinct and of all trigrams of the words. w must be a materialised column (see barrier)."""
    return F.size(F.array_distinct(run_keys(w, 3))), F.greatest(F.size(w) - 2, F.lit(0))


def repetition_ratio(w: Column) -> Column:
    """Distinct over all trigrams of the words; 1 under 12 words. w must be a materialised column (see barrier)."""
    distinct, every = trigrams(w)
    return F.when(F.size(w) < 12, 1.0).otherwise(distinct / F.greatest(every, F.lit(1)))


def drawn(*parts: Column) -> Column:
    """A number from 0 to 2**32 - 1 that depends on the parts only: the first 32 bits of the md5 of them, set apart by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def shared_run(a: Column, b: Column) -> Column:
    """First n-gram of b that a has too, null if none."""
    both = F.array_intersect(b, a)
    return F.when(F.size(both) > 0, F.element_at(both, 1))


def is_quoted(run: Column, surface: Column) -> Column:
    """Whether the run has content words and all are in the surface vocabulary."""
    content = F.filter(F.split(run, " "), is_content)
    return (F.size(content) > 0) & F.forall(content, lambda w: F.array_contains(surface, w))


def file_mentions(c: str | Column) -> Column:
    """Base names, in lower case, of all mentions that end in a code extension; repeats count."""
    found = F.transform(find_all(text(c), FILE_MENTION), F.lower)
    mine = F.filter(found, lambda m: F.element_at(F.split(m, r"\."), -1).isin(*CODE_EXTENSIONS))
    return F.transform(mine, lambda m: F.element_at(F.split(m, "/"), -1))


def count_claims(c: str | Column) -> Column:
    """Numbers of repositories or projects that the text claims."""
    said = F.transform(find_all(text(c), COUNT_CLAIM, 1), F.lower)
    value = lambda w: functools.reduce(lambda out, k: F.when(w == NUMBERS[k], k).otherwise(out), range(len(NUMBERS)), w.try_cast("int"))
    return F.transform(said, value)


def model_names(c: str | Column) -> Column:
    return find_all(text(c), MODEL_NAME)


def bar(value: Column, width: int = 24, full: str = "█", empty: str = "░") -> Column:
    """A bar of width blocks for a value from 0 to 1."""
    n = F.bround(value * width).cast("int")
    return F.concat(F.repeat(F.lit(full), n), F.repeat(F.lit(empty), width - n))


def total(parts: list[Column]) -> Column:
    return functools.reduce(operator.add, parts)
