"""URL verdicts: allow and block rules, and gradient-boosted trees over lexical features for what no rule fits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, hash_sample, stash

#: (verdict, host, path) of the query's rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Labelled rows that a model is fitted on: those of the least hashes, if there are more.
SAMPLE = 20_000
#: Rows of the whole share that each suffix's own share is pulled by.
PULL = 20
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "marks", "entropy", "parameters", "query_length", "fragment", "secure", "suffix_rate", "suffix_share", "tail_rate")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; then up to ?, # or the end."""
    at = F.locate("://", url)
    rest = F.substr(url, at + 3)
    known = url.isNotNull() & (at > 0)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.when(known, ascii_lower(host)).otherwise(""), F.when(known, path).otherwise("")


def fitting_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule, as host and path, that fits, and its verdict; nulls if none does. A rule fits its host and
    all subdomains, where the URL's path starts with its own. Equally long rules: the first by code point."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, own, start in reversed(ranked):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def url_features(urls: DataFrame) -> DataFrame:
    """urls (url, host, path) with the lexical features, and the suffix and path head that counts go by."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = lambda c: F.regexp_count(c, F.lit("[0-9]"))
    letters = F.filter(F.split(url, ""), lambda c: c != "")
    sorted_ = F.array_sort(letters)
    # Runs of the sorted characters are the counts that the entropy is of.
    state = F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit(0.0).alias("s"))
    share = lambda n: F.when(n > 0, n * F.log2(F.greatest(n, F.lit(1)).cast("double"))).otherwise(0.0)
    step = lambda a, c: F.when(c == a["c"], F.struct(c.alias("c"), (a["n"] + 1).alias("n"), a["s"].alias("s"))).otherwise(F.struct(c.alias("c"), F.lit(1).alias("n"), (a["s"] + share(a["n"])).alias("s")))
    folded = F.aggregate(sorted_, state, step, lambda a: a["s"] + share(a["n"]))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    out = urls.withColumns({
        "length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")), "labels": F.size(F.split("host", r"\.")),
        "digit_ratio": digits(url) / n, "host_digits": digits("host"), "hyphens": F.regexp_count("host", F.lit("-")),
        "marks": F.regexp_count(url, F.lit("[^A-Za-z0-9/.:]")), "entropy": F.log2(n) - folded / n,
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "query_length": F.length(query),
        "fragment": F.contains(url, F.lit("#")).cast("int"), "secure": F.startswith(url, F.lit("https")).cast("int"),
        "suffix": F.substring_index("host", ".", -2), "tail": F.concat_ws("/", F.substring_index("host", ".", -1), F.substring_index(F.substring_index("path", "/", 2), "/", -1)),
    })
    return out.withColumns({c: F.col(c).cast("double") for c in FEATURES[:14]})


class Trees:
    """Gradient-boosted regression trees on logistic loss, over quantile bins of the features."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 8, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.base, self.cuts, self.trees = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Without rows, or with rows of one class only, the model says that class (no rows: 0.5)."""
        mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        self.base = math.log(mean / (1 - mean))
        if not len(y) or y.min() == y.max():
            return self
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self.rate * self._walk(tree, x)
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple]:
        """Nodes (feature, cut, left, right) or (-1, value, 0, 0), the root first."""
        nodes: list[tuple] = [()]
        todo = [(0, np.arange(len(g)), 0)]
        while todo:
            at, rows, depth = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-9, -1, 0)
            if depth < self.depth and len(rows) >= 2 * self.least:
                for f in range(binned.shape[1]):
                    width = len(self.cuts[f]) + 1
                    b = binned[rows, f]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, width))[:-1] for w in (g[rows], h[rows], None))
                    gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                    gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), f, int(gain.argmax()))
            if best[1] < 0:
                nodes[at] = (-1, gs / (hs + self.ridge), 0, 0)
                continue
            _, f, k = best
            low = binned[rows, f] <= k
            nodes[at] = (f, float(self.cuts[f][k]), len(nodes), len(nodes) + 1)
            todo += [(len(nodes), rows[low], depth + 1), (len(nodes) + 1, rows[~low], depth + 1)]
            nodes += [(), ()]
        return nodes

    @staticmethod
    def _walk(tree: list[tuple], x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            f, value, left, right = tree[at]
            if f < 0:
                out[rows] = value
            else:
                low = x[rows, f] <= value
                todo += [(left, rows[low]), (right, rows[~low])]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self.rate * self._walk(tree, x)
        return 1 / (1 + np.exp(-score))


def rates(labelled: DataFrame, by: str) -> tuple[DataFrame, float]:
    """(by, by_rate, by_share) of every value of a column among labelled rows: the share blocked, pulled towards that of
    all rows by PULL rows, and the value's share of the rows; and the share blocked of all rows."""
    total, bad = labelled.agg(F.count("*"), F.sum("y")).first()
    mean = (bad or 0) / max(1, total)
    held = labelled.groupBy(by).agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
    return held.select(by, ((F.col("bad") + PULL * mean) / (F.col("n") + PULL)).alias(f"{by}_rate"), (F.col("n") / max(1, total)).alias(f"{by}_share")), mean


def with_rates(urls: DataFrame, suffix: tuple[DataFrame, float], tail: tuple[DataFrame, float]) -> DataFrame:
    """urls (suffix, tail) with suffix_rate, suffix_share and tail_rate; values that no labelled row has: the share of
    all, and 0. Spark picks the joins, by the tables' sizes; one value's rows may be dealt to several tasks."""
    out = urls.join(suffix[0], "suffix", "left").join(tail[0].drop("tail_share"), "tail", "left")
    return out.withColumns({"suffix_rate": F.coalesce("suffix_rate", F.lit(suffix[1])), "suffix_share": F.coalesce("suffix_share", F.lit(0.0)), "tail_rate": F.coalesce("tail_rate", F.lit(tail[1]))})


def url_verdicts(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple = RULES, sample: int = SAMPLE, block_from: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row: the verdict of the longest fitting rule, else that of
    trees trained on the URLs that the rules label, which block from a probability of block_from (score).

    The trees are fitted on the driver over at most `sample` labelled rows (those of the least hashes of the URL);
    the suffix statistics count all labelled rows and all suffixes, as tables that the rows are joined with. If no
    rule labels a row, or all labels are alike, the trees say what they know: 0.5 (block) or that label.

    Null URL, or one without ://: empty host and path, no rule, judged by the trees as an empty URL is. Repeated rows
    come out repeated; null ids are kept. No rows: none. Other columns don't matter.
    """
    held = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    held = held.withColumns({"host": host, "path": path})
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    held = stash(url_features(held.withColumns({"rule": rule, "fixed": verdict})), "urls")
    labelled = held.where("fixed is not null").withColumn("y", (F.col("fixed") == "block").cast("int"))
    suffix, tail = ((stash(rows, by), mean) for by in ("suffix", "tail") for rows, mean in [rates(labelled, by)])
    picked = hash_sample(labelled, sample, "url", "page_id").select(*FEATURES[:14], "suffix", "tail", "y")
    model = fit_trees(with_rates(picked, suffix, tail).select(*FEATURES, "y").toPandas(), (suffix[1], 0.0, tail[1]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.probability(np.column_stack([batch.column(c).to_numpy() for c in FEATURES]))
            fixed = batch.column("fixed").to_pylist()
            said = [f or ("block" if s >= block_from else "allow") for f, s in zip(fixed, score, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(said, pa.string()), pa.array(score, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    rows = with_rates(held, suffix, tail).select("page_id", "host", "path", "rule", "fixed", *FEATURES)
    return rows.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, score double")


def fit_trees(rows, unknown: tuple[float, float, float]) -> Trees:
    """Trees over labelled feature rows (y: 1 is block). Every row counts twice, once with the statistics of a suffix
    that no labelled URL has: so the trees also learn what the other features say where the statistics say nothing."""
    own = rows[list(FEATURES)].to_numpy(float)
    apart = own.copy()
    apart[:, 14:] = unknown
    return Trees().fit(np.concatenate((own, apart)), np.tile(rows["y"].to_numpy(float), 2))
