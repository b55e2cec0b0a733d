"""Samples, feature pipelines and models over ranking rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.exprs import hash_uniform, patient_fold
from quillon.sources.scratch import stash

from .metrics import ranking_metrics

#: Columns that are no features, and beginnings of such names.
NO_FEATURES = ("source", "split", "stay_id", "patient_id", "group_id", "label", "label_events", "candidate")
NO_FEATURE_STARTS = ("label_", "o_")
NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean", "decimal")
#: The column of alike_rows that says how many rows are one.
ALIKE = "__alike"


def sampled_rows(rows: DataFrame, seed: int, ratio: float = 5.0) -> DataFrame:
    """All positives, and of the negatives of a condition with a positive a share of ratio x positives / negatives,
    by hash. The counts are a small lookup, and the choice is made on narrow rows, before any features are joined."""
    counts = rows.groupBy("condition").agg(F.count_if("label").alias("__p"), F.count_if(~F.col("label")).alias("__n"))
    drawn = hash_uniform(F.concat_ws("|", F.lit(str(seed)), "group_id", "candidate"))
    share = F.least(F.lit(1.0), F.try_divide(ratio * F.col("__p"), F.col("__n").cast("double")))
    kept = F.col("label") | ((F.col("__p") > 0) & F.coalesce(drawn < share, F.lit(False)))
    return rows.join(counts, "condition").where(kept).drop("__p", "__n")


def capped_negatives(rows: DataFrame, seed: int, ratio: int = 5, least: int = 10) -> DataFrame:
    """Rows of groups with a positive; of a group's negatives, the max(least, ratio x positives) of the
    least hashes."""
    group = Window.partitionBy("group_id")
    order = Window.partitionBy("group_id", "label").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "group_id", "candidate")), "candidate")
    held = rows.withColumns({"__p": F.sum(F.col("label").cast("int")).over(group), "__at": F.row_number().over(order)})
    return held.where((F.col("__p") > 0) & (F.col("label") | (F.col("__at") <= F.greatest(F.lit(least), ratio * F.col("__p"))))).drop("__p", "__at")


@dataclass(frozen=True)
class FeatureSpec:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)


def feature_spec(df: DataFrame, denied: tuple[str, ...] = NO_FEATURES) -> FeatureSpec:
    """Numeric and text columns by the schema, without those of the deny list."""
    fine = [(n, t) for n, t in df.dtypes if n not in denied and n != ALIKE and not n.startswith(NO_FEATURE_STARTS)]
    return FeatureSpec([n for n, t in fine if t.startswith(NUMERIC)], [n for n, t in fine if t == "string"])


def alike_rows(rows: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The features and labels of rows, written once; rows that are alike in all of them are one, with their number (ALIKE).
    A model of these weights is that of the rows, and its iterations pass over no more than what differs."""
    if ALIKE in rows.columns:
        return rows
    label = ["label"] if "label" in rows.columns else []
    return stash(rows.groupBy(*spec.numeric, *spec.categorical, *label).agg(F.count("*").alias(ALIKE)), "alike")


def alike_groups(groups: DataFrame, seed: int, folds: int) -> DataFrame:
    """Ranking groups of training.ranking_groups; those that are alike in source, split, condition, the patient's fold and the
    labels are one, with their number (ALIKE), the least patient and an id of its own. Features and scores follow from
    condition, candidate and fold, so what is fitted on or measured from these is that of all groups; they are written once."""
    slim = F.transform("members", lambda m: F.struct(m["candidate"].alias("candidate"), m["candidate_rank"].alias("candidate_rank"), m["label"].alias("label")))
    held = groups.select("source", "split", "condition", patient_fold(F.col("patient_id"), seed, folds).alias("fold"), "patient_id", slim.alias("members"))
    out = held.groupBy("source", "split", "condition", "fold", "members").agg(F.min("patient_id").alias("patient_id"), F.count("*").alias(ALIKE))
    labels = F.array_join(F.transform("members", lambda m: m["label"].cast("int").cast("string")), "")
    return stash(out.withColumn("group_id", F.concat_ws("|", "condition", F.coalesce(F.col("fold"), F.lit(-1)), labels)).drop("fold"), "alike")


def numbers(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in spec.numeric} | {c: F.coalesce(F.col(c), F.lit("missing")) for c in spec.categorical})


def medians(df: DataFrame, spec: FeatureSpec) -> dict[str, float]:
    """Exact medians of the numeric features, of rows or of alike_rows; 0 where there is none."""
    if not spec.numeric:
        return {}
    times = F.col(ALIKE) if ALIKE in df.columns else F.lit(1)
    row = df.agg(*[F.percentile(F.col(c).cast("double"), F.lit(0.5), times).alias(c) for c in spec.numeric]).first()
    return {c: 0.0 if row[c] is None else row[c] for c in spec.numeric}


def _moments(alike: DataFrame, columns: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Means and sample deviations of columns without nulls; 0 where there is none."""
    if not columns:
        return {}, {}
    n, total = F.col(ALIKE), F.sum(ALIKE)
    own = alike.agg(*[F.try_divide(F.sum(n * F.col(c)), total).alias(c) for c in columns]).first()
    means = {c: own[c] or 0.0 for c in columns}
    own = alike.agg(*[F.sqrt(F.try_divide(F.sum(n * (F.col(c) - F.lit(means[c])) ** 2), total - 1)).alias(c) for c in columns]).first()
    return means, {c: own[c] or 0.0 for c in columns}


@dataclass
class Preprocessor:
    """Medians for missing numbers, standard scores; `missing` for missing texts, one-hot, unknown texts apart."""

    spec: FeatureSpec
    fills: dict[str, float]
    means: dict[str, float]
    deviations: dict[str, float]
    stages: PipelineModel

    @classmethod
    def fit(cls, df: DataFrame, spec: FeatureSpec | None = None) -> Preprocessor:
        """Fitted on rows, or on alike_rows of them."""
        spec = spec or feature_spec(df)
        alike = alike_rows(df, spec)
        fills = medians(alike, spec)
        own = numbers(alike, spec).na.fill(fills)
        means, deviations = _moments(own, spec.numeric)
        stages: list = []
        if spec.categorical:
            for c in spec.categorical:  # numbered as StringIndexer does, the most frequent first
                known = own.groupBy(c).agg(F.sum(ALIKE).alias("__n")).orderBy(F.desc("__n"), c).collect()
                stages.append(StringIndexerModel.from_labels([r[0] for r in known], c, f"{c}__i", "keep"))
            stages.append(OneHotEncoder(inputCols=[f"{c}__i" for c in spec.categorical], outputCols=[f"{c}__v" for c in spec.categorical], dropLast=False))
        stages.append(VectorAssembler(inputCols=[f"{c}__v" for c in spec.categorical] + [f"{c}__s" for c in spec.numeric], outputCol="features"))
        out = cls(spec, fills, means, deviations, PipelineModel([]))
        out.stages = Pipeline(stages=stages).fit(out._scaled(own))
        return out

    def _scaled(self, df: DataFrame) -> DataFrame:
        score = lambda c: (F.col(c) - F.lit(self.means[c])) / F.lit(self.deviations[c]) if self.deviations[c] else F.lit(0.0)
        return df.withColumns({f"{c}__s": score(c) for c in self.spec.numeric})

    def transform(self, df: DataFrame) -> DataFrame:
        """df's own columns, and features."""
        held = df.withColumn("__own", F.struct(*df.columns))
        out = self.stages.transform(self._scaled(numbers(held, self.spec).na.fill(self.fills)))
        return out.select("__own.*", "features")


def fit_linear(train: DataFrame, prep: Preprocessor, ridge: float = 1e-4):
    """A logistic model of the label, fitted on rows, or on alike_rows of them."""
    alike = alike_rows(train, prep.spec)
    own = prep.transform(alike).withColumn("target", F.col("label").cast("double"))
    # Spark takes n - sum(w^2) / n of weighted rows for the n - 1 in the variances that the penalty is scaled by.
    n, squares = alike.agg(F.sum(F.col(ALIKE).cast("double")), F.sum(F.col(ALIKE).cast("double") ** 2)).first()
    ridge *= max(0.0, (n - squares / n) / (n - 1)) if n and n > 1 else 1.0
    return LogisticRegression(featuresCol="features", labelCol="target", weightCol=ALIKE, regParam=ridge, maxIter=50).fit(own)


def fit_trees(train: DataFrame, prep: Preprocessor, rounds: int = 20, depth: int = 5, seed: int = 1):
    """Boosted trees of the label (Spark's own, so scores differ from other libraries' trees), fitted on rows, or on
    alike_rows of them."""
    own = prep.transform(alike_rows(train, prep.spec)).withColumn("target", F.col("label").cast("double"))
    return GBTClassifier(featuresCol="features", labelCol="target", weightCol=ALIKE, maxIter=rounds, maxDepth=depth, seed=seed).fit(own)


def model_scores(rows: DataFrame, prep: Preprocessor, models: dict) -> DataFrame:
    """Rows scored by each model, one row for each, in one pass over the rows."""
    held = prep.transform(rows)
    for name, model in models.items():
        out = model.setFeaturesCol("features").setProbabilityCol(f"__p_{name}").setRawPredictionCol(f"__r_{name}").setPredictionCol(f"__c_{name}").transform(held)
        held = out.withColumn(f"__s_{name}", vector_to_array(F.col(f"__p_{name}"))[1]).drop(f"__p_{name}", f"__r_{name}", f"__c_{name}")
    scores = F.inline(F.array(*[F.struct(F.lit(n).alias("baseline"), F.col(f"__s_{n}").alias("score")) for n in models]))
    return held.select("source", "split", "stay_id", "group_id", "condition", "candidate", "candidate_rank", "label", scores)


def ranking_frame(rows: DataFrame, features: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """What a ranker is fitted on: the group, the label as 0 or 1 and the features (under other names, if so
    named), a group's rows together in one partition and in the catalog's order, with their place and the group's size."""
    group = Window.partitionBy("group_id")
    order = group.orderBy(F.col("candidate_rank").asc_nulls_last(), F.col("candidate").asc_nulls_last())
    held = rows.withColumns({"place": F.row_number().over(order).cast("long"), "group_size": F.count("*").over(group)})
    named = [F.col(f).alias((rename or {}).get(f, f)) for f in features]
    return held.select("group_id", "candidate", "place", "group_size", F.col("label").cast("int").alias("target"), *named).sortWithinPartitions("group_id", "place")


def fit_pairwise_ranker(train: DataFrame, prep: Preprocessor, seed: int = 1, per_positive: int = 5, ridge: float = 1e-4):
    """D42 by pairwise differences: a logistic model of which of two rows of a group is the positive, without intercept.
    The boosted ranker is ranker.fit_ranker; this one is linear. Its scores order a group's rows. Each
    positive meets the per_positive negatives of its group of the least hashes, so pairs grow with the positives."""
    own = prep.transform(capped_negatives(train, seed, per_positive, per_positive)).select("group_id", "candidate", "label", vector_to_array("features").alias("x"))
    a = own.where("label").select("group_id", F.col("candidate").alias("p"), F.col("x").alias("xp"))
    b = own.where("not label").select("group_id", F.col("candidate").alias("n"), F.col("x").alias("xn"))
    pairs = a.join(b, "group_id")
    from pyspark.ml.functions import array_to_vector

    difference = F.zip_with("xp", "xn", lambda p, n: p - n)
    up = F.pmod(F.xxhash64("group_id", "p", "n"), F.lit(2)) == 0
    signed = F.transform(difference, lambda v: F.when(up, v).otherwise(-v))
    return LogisticRegression(featuresCol="features", labelCol="target", fitIntercept=False, regParam=ridge, maxIter=50).fit(pairs.select(array_to_vector(signed).alias("features"), up.cast("double").alias("target")))


def cross_validated(rows: DataFrame, spec: FeatureSpec, fit, folds: int, seed: int, k: int, name: str = "model") -> DataFrame:
    """Ranking metrics of rows scored by models that did not see their patient: fit(train, prep) for each fold."""
    held = rows.withColumn("__fold", patient_fold(F.col("patient_id"), seed, folds))
    parts = None
    for fold in range(folds):
        train, rest = held.where(F.col("__fold") != fold), held.where(F.col("__fold") == fold)
        prep = Preprocessor.fit(train, spec)
        own = model_scores(rest, prep, {name: fit(train, prep)})
        parts = own if parts is None else parts.union(own)
    return ranking_metrics(parts, k)
