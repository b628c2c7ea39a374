"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for what no rule decides.

The trees are trained on labelled URLs, a table of the caller's. Where none is given, the URLs of the table itself
that a rule decides are the labelled ones, their verdicts the labels: nothing about URLs is written down here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)
def host(url: str | Column) -> Column:
    """What follows the first :// up to /, ? or #, A-Z lower-cased; empty if null or without ://."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path starts the
    url's; null if none fits. Of equal rules the first counts. The rules are a short list; each is one test."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


#: Bound of the labelled sample that the trees are fitted on: URLs, each counted once, of the smallest hashes.
SAMPLE = 20_000
FEATURES = (
    "length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "parameters", "query_length",
    "domain", "second_domain", "extension",
)


def parts(url: Column) -> Column:
    """struct of what the features of a url are made of: all after the first ://, its host, path and query, and its
    suffixes: the last label of the host, the last two, and the path's extension. A url without :// counts as path."""
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    name = host(url)
    route = F.when(url.contains("://"), path(url)).otherwise(F.regexp_extract(url, r"(?s)^[^?#]*", 0))
    return F.struct(
        rest.alias("rest"), name.alias("host"), route.alias("path"), F.regexp_extract(rest, r"(?s)\?([^#]*)", 1).alias("query"), F.substring_index(name, ".", -1).alias("domain"),
        F.substring_index(name, ".", -2).alias("second"), F.lower(F.regexp_extract(route, r"(?s)\.([^./]*)$", 1)).alias("extension"),
    )


@dataclass
class Model:
    """Gradient-boosted trees, and the log odds of the suffixes seen in training: for domains, two-label domains, extensions."""

    odds: tuple = ({}, {}, {})
    base: float = 0.0
    trees: list = field(default_factory=list)


def _counts(texts):
    """Of each text: its bytes, and how often each byte is in it."""
    import numpy as np

    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    at = np.repeat(np.arange(len(data)) * 256, sizes) + np.frombuffer(b"".join(data), np.uint8)
    return sizes, np.bincount(at, minlength=256 * len(data)).reshape(-1, 256)


def features(rows: pd.DataFrame, model: Model):
    """FEATURES of rows of parts(), a row of numbers each; many rows at once."""
    import numpy as np

    def spread(n, seen):
        share = seen / np.maximum(n, 1)[:, None]
        return -(share * np.log2(np.where(seen > 0, share, 1))).sum(1)

    digits = slice(ord("0"), ord("9") + 1)
    n, seen = _counts(rows["rest"])
    m, name = _counts(rows["host"])
    p, route = _counts(rows["path"])
    q, query = _counts(rows["query"])
    odds = [rows[c].map(known).fillna(0.0).to_numpy(float) for c, known in zip(("domain", "second", "extension"), model.odds)]
    return np.column_stack([
        n, m, p, name[:, ord(".")], route[:, ord("/")], seen[:, digits].sum(1) / np.maximum(n, 1), name[:, digits].sum(1) / np.maximum(m, 1), spread(n, seen), spread(m, name),
        query[:, ord("&")] + (q > 0), q, *odds,
    ]).astype(float)


def fit(rows: pd.DataFrame, rounds: int = 60, rate: float = 0.2, depth: int = 3, bins: int = 32, least: int = 20) -> Model:
    """Logistic boosting on histograms. rows: those of parts() and label (1 for block), a bounded sample: training is
    on the driver. Without rows, and with labels of one kind, the model says what the labels say; allow without any."""
    import numpy as np

    model = Model(base=-10.0)
    if not len(rows):
        return model
    y = rows["label"].to_numpy(float)
    seen = []
    for c in ("domain", "second", "extension"):
        each = pd.DataFrame({"k": rows[c], "y": y}).groupby("k")["y"].agg(["sum", "count"])
        each = each[each["count"] >= 3]
        seen.append(dict(zip(each.index, np.log((each["sum"] + 0.5) / (each["count"] - each["sum"] + 0.5)))))
    model.odds = tuple(seen)
    x = features(rows, model)
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model.base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    at = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)])  # value <= cut goes left
    total = np.full(len(y), model.base)

    def grow(own, g, h, left):
        best = split(own, g, h, at, cuts, least) if left else None
        if best is None:
            value = float(-rate * g[own].sum() / (h[own].sum() + 1.0))
            total[own] += value
            return value
        k, cut = best
        go = at[k, own] <= cut
        return (k, float(cuts[k][cut]), grow(own[go], g, h, left - 1), grow(own[~go], g, h, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        model.trees.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth))
    return model


def split(own, g, h, at, cuts, least: int):
    """(feature, cut) of the largest gain for rows own, at least so many on each side; None if there is no gain."""
    import numpy as np

    best, gain = None, 1e-6
    gg, hh = g[own].sum(), h[own].sum()
    for k, q in enumerate(cuts):
        if not len(q):
            continue
        a, b, n = (np.bincount(at[k, own], w, len(q) + 1).cumsum()[:-1] for w in (g[own], h[own], None))
        now = a * a / (b + 1) + (gg - a) ** 2 / (hh - b + 1) - gg * gg / (hh + 1)
        now[(n < least) | (len(own) - n < least)] = 0
        if now.max() > gain:
            best, gain = (k, int(now.argmax())), now.max()
    return best


def probability(rows: pd.DataFrame, model: Model):
    """Probability of each row of parts() that it is to be blocked."""
    import numpy as np

    x = features(rows, model)
    total = np.full(len(x), model.base)

    def down(tree, own):
        if not isinstance(tree, tuple):
            total[own] += tree
        elif len(own):
            go = x[own, tree[0]] <= tree[1]
            down(tree[2], own[go])
            down(tree[3], own[~go])

    for t in model.trees:
        down(t, np.arange(len(x)))
    return 1 / (1 + np.exp(-total))


def ruled(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """(url, label) of the urls that a rule decides: 1 for block."""
    found = rule(host(url), path(url), rules)["verdict"]
    return pages.select(F.col(url).alias("url"), F.when(found.isNotNull(), (found == "block").cast("int")).alias("label")).filter("label is not null")


def learn(labelled: DataFrame, sample: int = SAMPLE, **how) -> Model:
    """Trees from labelled (url, label), label 1 for block. Each url and label counts once however often it is there;
    of more than sample those of the smallest hashes are taken, so every part of the table has its share."""
    each = staged(labelled.filter("url is not null and label is not null").select("url", F.col("label").cast("int").alias("label")).distinct(), "labelled")
    bound = min(1.0, 1.5 * sample / max(each.count(), 1))
    drawn = each.withColumn("h", F.xxhash64(F.lit(9), "url", "label")).filter(F.shiftrightunsigned("h", 11) / float(1 << 53) <= bound)
    rows = drawn.orderBy("h", "url", "label").limit(sample).select(parts(F.col("url")).alias("x"), "label").select("x.*", "label")
    return fit(pd.DataFrame([r.asDict() for r in rows.collect()], columns=rows.columns), **how)


def judge(pages: DataFrame, url: str = "url", id_col: str = "page_id", rules=RULES, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule (null if none fits), verdict (allow or block), p_block
    (null where a rule decides).

    The trees judge urls without a rule; they are trained on labelled (url, label), or on pages' own urls that a rule
    decides. A null url has empty host and path and is allowed; a url without :// has them too, and the trees'
    verdict. Without labels all is allowed. An empty table gives none."""
    held = pages.sparkSession.sparkContext.broadcast(learn(ruled(pages, url, rules) if labelled is None else labelled))

    @F.pandas_udf("double")
    def p_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for rows in batches:
            out, own = pd.Series(0.0, index=rows.index), rows["rest"].notna()
            out[own] = probability(rows[own], held.value)
            yield out

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), host(url).alias("host"), path(url).alias("path"))
    rows = rows.withColumn("found", rule(F.col("host"), F.col("path"), rules))
    asked = F.col("found").isNull() & F.col("url").isNotNull()
    rows = rows.withColumn("p_block", F.when(asked, p_block(parts(F.when(asked, F.col("url"))))))
    own = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "p_block")
