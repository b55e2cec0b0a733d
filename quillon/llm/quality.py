"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k over their ratio."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, hash_sample, small_parts, stash, utf8
from .tokens import mix, windows

#: Buckets that n-grams are hashed to, and the longest n-grams.
BUCKETS, ORDER = 1 << 14, 2
#: Labelled documents that the target model is fitted on, at most: those of the least hashes of their ids.
SAMPLE = 50_000
#: Counts by which a bucket's target estimate is drawn to the raw model's: what is rare says little either way.
SMOOTH = 30.0
#: N-grams without evidence that every text is given, so that a short one is judged with care.
NEUTRAL = 20
#: N-grams of the passage that a text's weight is of: a text weighs as so much of it would, however long it is.
PASSAGE = 100
#: Rows that the last step of the threshold search may rank in one task.
RANKED = 20_000
SEED = 7


def ngram_buckets(text: bytes, buckets: int = BUCKETS, order: int = ORDER) -> Iterator[np.ndarray]:
    """Buckets of all n-grams, n up to order, of the text's tokens (runs of letters and digits, runs of other marks; A-Z
    as a-z), in portions."""
    before = np.empty(0, np.uint64)
    for h, _, _ in windows(text, True):
        joined = np.concatenate((before, h))
        own = h
        yield (mix(own) >> np.uint64(33)).astype(np.int64) % buckets
        for n in range(2, order + 1):
            skip = max(0, len(before) - (n - 1))
            x = joined[skip:]
            if len(x) < n:
                continue
            own = x[: len(x) - n + 1].copy()
            for k in range(1, n):
                own = mix(own * np.uint64(0x9E3779B97F4A7C15) + x[k : len(x) - n + 1 + k])
            yield (own >> np.uint64(33)).astype(np.int64) % buckets
        before = joined[len(joined) - min(len(joined), order - 1) :]


@dataclass(frozen=True)
class RatioModel:
    """Log ratio of a bucket's probability under the target model and under the raw model, and the documents that
    the target model was fitted on."""

    log_ratio: np.ndarray
    documents: int

    def score(self, text: bytes) -> float:
        """The mean log ratio of the text's n-grams (and NEUTRAL more of ratio 1)."""
        total, n = 0.0, NEUTRAL
        for b in ngram_buckets(text, len(self.log_ratio)):
            total, n = total + float(self.log_ratio[b].sum()), n + len(b)
        return total / n

    @property
    def margin(self) -> float:
        """A mean this far below 0 is no evidence against a text yet: the models' own error, which falls with the
        root of the documents fitted on."""
        return 0.01 + 1 / math.sqrt(1 + self.documents)


def fit_ratio(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, buckets: int = BUCKETS) -> RatioModel:
    """The raw model counts the n-grams of all documents; the target model those of documents labelled quality 1, of at
    most `sample` of them. Both are counted in one pass that moves no text. Without target documents or any
    documents the ratio is 0 everywhere."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    picked = {r[0] for r in hash_sample(good, sample, "doc_id").collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in small_parts(batches):
            for k, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                for b in ngram_buckets(t, buckets):
                    own = np.bincount(b, minlength=buckets)
                    raw += own
                    if k in picked:
                        target += own
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(target[some]), pa.array(raw[some])], ["bucket", "target", "raw"])

    held = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = held.mapInArrow(count, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas()
    target, raw = np.zeros(buckets), np.zeros(buckets)
    at = rows["bucket"].to_numpy(int)
    target[at], raw[at] = rows["target"], rows["raw"]
    if not target.sum():
        return RatioModel(np.zeros(buckets), 0)
    expected = raw * (target.sum() / raw.sum())
    return RatioModel(np.log((target + SMOOTH) / (expected + SMOOTH)), len(picked))


def gumbel(doc_id: int | None, seed: int = SEED, text_hash: int = 0) -> float:
    """Gumbel noise of a document, the same in every run; without an id it is its text's."""
    x = mix(np.array([(doc_id if doc_id is not None else ~text_hash) & 0xFFFFFFFFFFFFFFFF], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    u = (float(mix(x)[0] >> np.uint64(11)) + 0.5) / float(1 << 53)
    return -math.log(-math.log(u))


def importance(docs: DataFrame, model: RatioModel, doc_id: str = "doc_id", text: str = "text", passage: int = PASSAGE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, log_ratio, key): the mean log ratio of each whole text's n-grams, and the key that sampling goes
    by: the log importance weight of a passage of so many n-grams of the text, and Gumbel noise."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches):
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            s = np.array([model.score(t) for t in utf8(batch.column(1))], float)
            key = s * passage + np.array([gumbel(k, seed, h) for k, h in zip(ids, hashes, strict=True)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array(key)], ["doc_id", "text_hash", "log_ratio", "key"])

    held = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return held.withColumn("text_hash", F.xxhash64("text")).mapInArrow(score, "doc_id long, text_hash long, log_ratio double, key double")


def top_k(rows: DataFrame, k: int, key: str = "key", tie: str = "doc_id") -> DataFrame:
    """rows with kept: true for k of them, those of the largest keys; equal keys by the smallest tie (nulls last). Rows of
    equal key and tie are kept or not together, so these may make it more than k.

    No sort of all rows: a histogram finds the range that the k-th key lies in, again and again within it, until
    few rows are left there or all have one key. Only these are ranked, by their (key, tie), each pair once with its
    count: keys that hold noise of the tie are of few ties each.
    """
    total = rows.count()
    if k >= total or k <= 0:
        return rows.withColumn("kept", F.lit(k > 0))
    low, high = rows.agg(F.min(key), F.max(key)).first()
    above = 0
    while low < high:
        width = (high - low) / 1024
        if width <= 0 or low + width <= low:
            break
        held = rows.where((F.col(key) >= low) & (F.col(key) <= high))
        bin_ = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(1023))
        counts = {r["b"]: r for r in held.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()}
        for b in sorted(counts, reverse=True):
            if above + counts[b]["n"] >= k:
                low, high, inside = counts[b]["low"], counts[b]["high"], counts[b]["n"]
                break
            above += counts[b]["n"]
        if inside <= RANKED:
            break
    edge = rows.where((F.col(key) >= low) & (F.col(key) <= high)).groupBy(key, tie).agg(F.count("*").alias("__n"))
    order = Window.orderBy(F.desc(key), F.col(tie).asc_nulls_last())
    edge = edge.withColumn("__before", F.sum("__n").over(order) - F.col("__n")).where(F.col("__before") < k - above)
    edge = edge.select(F.col(key).alias("__key"), F.col(tie).alias("__tie"), F.lit(True).alias("__in"))
    out = rows.join(edge, (F.col(key) == F.col("__key")) & F.col(tie).eqNullSafe(F.col("__tie")), "left")
    return out.withColumn("kept", (F.col(key) > high) | F.coalesce("__in", F.lit(False))).drop("__key", "__tie", "__in")


def resample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: int | None = None, passage: int = PASSAGE, seed: int = SEED, margin: float | None = None) -> DataFrame:
    """(doc_id, text_hash, log_ratio, key, kept) for each row of docs: importance resampling towards the documents labelled
    quality 1. The weight of a text is the ratio of the target and the raw model's probabilities of a passage of
    `passage` n-grams with the text's own makeup: its log is `passage` times the mean over the text's n-grams (the sum
    over a whole text would rank texts by their length). A document's key is its log weight plus Gumbel noise, and the
    `keep` largest keys are kept: a sample without replacement in proportion to the weights. Another seed gives
    another sample. keep defaults to the number of documents whose mean is at least -margin, and margin to the model's
    own: as many as have no evidence against them, drawn among all.

    Null and empty texts have weight 0, so they count as likely. Rows without an id have the noise of their text. Repeated rows have equal
    keys and are kept or not together (rows of equal key and id may bring the count above keep). Empty labels: all
    weights are 0 and all rows are kept. No rows: none. Other columns don't matter.
    """
    model = fit_ratio(docs, labels, doc_id, text)
    rows = stash(importance(docs, model, doc_id, text, passage, seed), "weights")
    keep = rows.where(F.col("log_ratio") >= -(model.margin if margin is None else margin)).count() if keep is None else keep
    return top_k(rows, keep)


def kept_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **kind) -> DataFrame:
    """The rows of docs that resampling keeps, with docs' columns. A row is known by its id and its text's hash, so rows that
    share an id, or have none, are kept or not each by its own text; only equal rows go together. The join may shuffle texts."""
    own, hashed = fresh_name("kept", docs), fresh_name("kept_hash", docs)
    kept = resample(docs, labels, doc_id, text, **kind).where("kept").select(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed)).distinct()
    same = (F.xxhash64(F.col(text).cast("string")) == F.col(hashed)) & F.col(doc_id).cast("long").eqNullSafe(F.col(own))
    return docs.join(kept, same, "left_semi")
