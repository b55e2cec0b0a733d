"""Window features of stays from their events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.exprs import column_suffixes

STATISTICS = ("count", "observed", "missing", "min", "mean", "max", "first", "last", "delta", "slope", "hours_since_last")


def in_window(hours: str = "hours", start: float = 0.0, end: float = 24.0):
    """Closed at both ends; a missing time is outside."""
    return F.coalesce((F.col(hours) >= start) & (F.col(hours) <= end), F.lit(False))


def token_statistics(events: DataFrame, predict: float = 24.0, least_for_slope: int = 2, places: int = 9) -> DataFrame:
    """Per stay and token of events (stay_id, event_id, token, value, hours) in [0, predict]: the statistics. first and
    last are the numbers of the least and largest (time, id); the slope needs least_for_slope numbers at more than one
    time. One grouping, all of it partial aggregates."""
    numeric = F.col("value").isNotNull()
    at = F.struct("hours", "event_id")
    held = events.where(in_window(end=predict) & F.col("token").isNotNull())
    out = held.groupBy("stay_id", "token").agg(
        F.count("*").alias("count"), F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"),
        F.min_by("value", F.when(numeric, at)).alias("first"), F.max_by("value", F.when(numeric, at)).alias("last"),
        F.when(F.count("value") >= least_for_slope, F.regr_slope("value", "hours")).alias("slope"), (predict - F.max("hours")).alias("hours_since_last"))
    rounded = {c: F.round(c, places) for c in ("mean", "slope", "hours_since_last")}
    return out.withColumns({"observed": F.lit(1).cast("long"), "missing": F.lit(0).cast("long"), "delta": F.round(F.col("last") - F.col("first"), places)} | rounded)


def _joined(stays: DataFrame, wide: DataFrame, tokens: list[str]) -> tuple[DataFrame, str]:
    """stays with one struct column of the pivoted cells, under a name that stays lacks: tokens may be called like its columns."""
    own = "cells"
    while own in stays.columns:
        own += "_"
    return stays.join(wide.select("stay_id", F.struct(*[F.col(f"`{t}`") for t in tokens]).alias(own)), "stay_id", "left"), own


def wide_features(stays: DataFrame, statistics: DataFrame, tokens: list[str], prefix: str, which: tuple[str, ...] = STATISTICS) -> DataFrame:
    """Stays with a column for each token and statistic. A stay without the token has count and observed 0,
    missing 1, and nulls. The long form is pivoted, so a wide token list is no wide expression."""
    suffix = column_suffixes(tokens)
    cells = F.struct(*which)
    wide = statistics.where(F.col("token").isin(*tokens)).groupBy("stay_id").pivot("token", tokens).agg(F.first(cells))
    held, own = _joined(stays, wide, tokens)
    zero = {"count": 0, "observed": 0, "missing": 1}
    columns = {}
    for t in tokens:
        for s in which:
            c = F.col(own)[t][s]
            columns[f"{prefix}_{suffix[t]}_{s}"] = F.coalesce(c, F.lit(zero[s])).cast("long") if s in zero else c
    return held.withColumns(columns).drop(own)


def domain_counts(events: DataFrame, predict: float = 24.0) -> DataFrame:
    """Per stay and event type in [0, predict]: events, distinct tokens, and whether there is any."""
    held = events.where(in_window(end=predict))
    return held.groupBy("stay_id", "event_type").agg(F.count("*").alias("events"), F.count_distinct("token").alias("tokens"), (F.count("*") > 0).alias("any_event"))


def top_tokens(rows: DataFrame, token: str, n: int, fit: str = "train") -> DataFrame:
    """The tokens of most distinct fitting stays (ties by token)."""
    held = rows.where((F.col("split") == fit) & F.col(token).isNotNull())
    return held.groupBy(token).agg(F.count_distinct("stay_id").alias("stays")).orderBy(F.desc("stays"), token).limit(n)


def presence(stays: DataFrame, rows: DataFrame, token: str, vocabulary: list[str], prefix: str) -> DataFrame:
    """A 0/1 column for each token of a fitted vocabulary."""
    suffix = column_suffixes(vocabulary)
    wide = rows.where(F.col(token).isin(*vocabulary)).groupBy("stay_id").pivot(token, vocabulary).agg(F.max(F.lit(1)))
    held, own = _joined(stays, wide, vocabulary)
    return held.withColumns({f"{prefix}_{suffix[v]}_present": F.coalesce(F.col(own)[v], F.lit(0)) for v in vocabulary}).drop(own)


def out_of_vocabulary(rows: DataFrame, token: str, vocabulary: list[str]) -> DataFrame:
    """Per source and split: rows, rows and distinct tokens outside the vocabulary."""
    out = F.col(token).isNotNull() & ~F.col(token).isin(*vocabulary)
    return rows.groupBy("source", "split").agg(F.count("*").alias("row_count"), F.count_if(F.coalesce(out, F.lit(False))).alias("oov_rows"), F.count_distinct(F.when(out, F.col(token))).alias("oov_tokens"))


def excluded_events(events: DataFrame, predict: float = 24.0, left_out: tuple[str, ...] = ()) -> DataFrame:
    """Per event type, the events without a time, before 0, after predict, and of a type left out."""
    h = F.col("hours")
    return events.groupBy("event_type").agg(F.count("*").alias("events"), F.count_if(h.isNull()).alias("without_time"), F.count_if(F.coalesce(h < 0, F.lit(False))).alias("before_start"), F.count_if(F.coalesce(h > predict, F.lit(False))).alias("after_prediction"), F.count_if(F.col("event_type").isin(*left_out) if left_out else F.lit(False)).alias("type_left_out"))


def event_sequence(events: DataFrame, predict: float = 24.0, left_out: tuple[str, ...] = ("medication",)) -> DataFrame:
    """The events before the prediction, numbered in their stay by time, type and id."""
    held = events.where(in_window(end=predict))
    if left_out:
        held = held.where(~F.col("event_type").isin(*left_out))
    order = Window.partitionBy("stay_id").orderBy("hours", F.col("event_type").asc_nulls_last(), F.col("event_id").asc_nulls_last())
    return held.withColumn("position", F.row_number().over(order).cast("long"))
