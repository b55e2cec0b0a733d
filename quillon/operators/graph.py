"""Concept graphs from fitting rows, their shape, and features of candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.scratch import shared_folder

EDGE = ["src_type", "src_id", "dst_type", "dst_id", "relation", "support"]


def node_key(kind, token):
    """The key of a concept: its type and token."""
    return F.concat(kind, F.lit("|"), token)


def graph_edges(rows: DataFrame, context: DataFrame, dev: str = "dev", fit: str = "train", predict: float = 24.0) -> DataFrame:
    """Typed edges with the number of groups or stays that support them, from fitting rows only: a condition with
    each candidate its groups have, with each context token (lab, vital, intervention) that its stays have up to the
    prediction, and two candidates of one group (once, in text order). rows are ranking rows; context has stay_id,
    event_type, token, hours."""
    own = rows.where((F.col("source") == dev) & (F.col("split") == fit))
    hits = own.where("label").groupBy("group_id").agg(F.collect_set(F.struct("condition", "candidate")).alias("hits"))
    stays = own.select("stay_id", "condition").distinct()
    seen = window_tokens(context, predict).repartition("stay_id").distinct()
    return _edges(hits, stays.join(seen, "stay_id").select("condition", "type", "id"))


def window_tokens(context: DataFrame, predict: float) -> DataFrame:
    """(stay_id, type, id) of the lab, vital and intervention tokens up to the prediction, repeated as they are."""
    inside = context.where((F.col("hours") >= 0) & (F.col("hours") <= predict) & F.col("event_type").isin("lab", "vital", "intervention"))
    return inside.select("stay_id", F.col("event_type").alias("type"), F.col("token").alias("id"))


def group_edges(groups: DataFrame, dev: str = "dev", fit: str = "train") -> DataFrame:
    """D20 from training.ranking_groups with context: nothing moves but the counts of a task."""
    own = groups.where((F.col("source") == dev) & (F.col("split") == fit) & F.col("first"))
    had = F.transform(F.filter("members", lambda m: m["label"]), lambda m: F.struct(F.col("condition").alias("condition"), m["candidate"].alias("candidate")))
    return _edges(own.select(had.alias("hits")), own.select("condition", F.inline("seen")))


def _edges(hits: DataFrame, seen: DataFrame) -> DataFrame:
    """Edges from each group's distinct (condition, candidate) and the distinct tokens of each stay and condition: counting rows
    is counting groups or stays."""
    count = F.count("*").alias("support")
    to_candidate = hits.select(F.inline("hits")).groupBy("condition", "candidate").agg(count)
    to_context = seen.groupBy("condition", F.col("type").alias("event_type"), F.col("id").alias("token")).agg(count)
    items = hits.select(F.array_sort(F.array_distinct(F.filter(F.col("hits").getField("candidate"), lambda c: c.isNotNull()))).alias("items")).where(F.size("items") > 1)
    first = items.select("items", F.posexplode("items").alias("at", "a"))
    pairs = first.select("a", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("b")).groupBy("a", "b").agg(count)
    edge = lambda df, st, s, dt, d, r: df.select(st.alias("src_type"), F.col(s).alias("src_id"), dt.alias("dst_type"), F.col(d).alias("dst_id"), r.alias("relation"), "support")
    parts = [
        edge(to_candidate, F.lit("condition"), "condition", F.lit("medication"), "candidate", F.lit("condition_medication")),
        edge(to_context, F.lit("condition"), "condition", F.col("event_type"), "token", F.concat(F.lit("condition_"), "event_type")),
        edge(pairs, F.lit("medication"), "a", F.lit("medication"), "b", F.lit("medication_medication")),
    ]
    return reduce(DataFrame.union, parts)


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges of each relation and their support."""
    return edges.groupBy("relation").agg(F.count("*").alias("edges"), F.sum("support").alias("total_support"), F.min("support").alias("least_support"), F.max("support").alias("largest_support"), F.round(F.avg("support"), 6).alias("mean_support"))


def endpoints(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: (type, id, relation, support, other)."""
    out = edges.select(F.col("src_type").alias("type"), F.col("src_id").alias("id"), "relation", "support", node_key(F.col("dst_type"), F.col("dst_id")).alias("other"))
    back = edges.select(F.col("dst_type").alias("type"), F.col("dst_id").alias("id"), "relation", "support", node_key(F.col("src_type"), F.col("src_id")).alias("other"))
    return out.union(back)


def node_counts(edges: DataFrame) -> DataFrame:
    """Distinct nodes of each type."""
    return endpoints(edges).select("type", "id").distinct().groupBy("type").agg(F.count("*").alias("nodes"))


def degree_summary(edges: DataFrame) -> DataFrame:
    """Degrees (distinct neighbours) of each type's nodes."""
    per = endpoints(edges).groupBy("type", "id").agg(F.count_distinct("other").alias("degree"))
    return per.groupBy("type").agg(F.count("*").alias("nodes"), F.min("degree").alias("least_degree"), F.max("degree").alias("largest_degree"), F.round(F.avg("degree"), 6).alias("mean_degree"))


def scope_audit(edges: DataFrame, scope: list[str]) -> DataFrame:
    """Edges by what they were fitted on."""
    return edges.groupBy(*scope).agg(F.count("*").alias("edges"))


def density(edges: DataFrame) -> DataFrame:
    """Edges of each relation over those possible between its node types (n (n - 1) / 2 within a type); null if none
    is possible."""
    nodes = node_counts(edges)
    src, dst = nodes.select(F.col("type").alias("src_type"), F.col("nodes").alias("n")), nodes.select(F.col("type").alias("dst_type"), F.col("nodes").alias("m"))
    per = edges.groupBy("relation", "src_type", "dst_type").agg(F.count("*").alias("edges")).join(src, "src_type").join(dst, "dst_type")
    possible = F.when(F.col("src_type") == F.col("dst_type"), F.col("n") * (F.col("n") - 1) / 2.0).otherwise((F.col("n") * F.col("m")).cast("double"))
    return per.select("relation", "edges", possible.alias("possible"), F.round(F.try_divide(F.col("edges").cast("double"), possible), 9).alias("density"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component), the component being the least node reachable. Each round every node takes the least label
    of its neighbours and then that label's own, so rounds grow with the logarithm of the diameter; each is cut off
    by a checkpoint in the session's checkpoint folder."""
    shared_folder(edges.sparkSession)  # sets the checkpoint folder where it may
    both = edges.select(node_key(F.col("src_type"), F.col("src_id")).alias("a"), node_key(F.col("dst_type"), F.col("dst_id")).alias("b"))
    both = both.union(both.select("b", "a")).distinct().checkpoint()
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")).checkpoint()
    for _ in range(rounds):
        offered = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("offer"))
        step = label.join(offered, "node").select("node", F.least("component", "offer").alias("next"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("component")).checkpoint()
        changed = new.join(label.withColumnRenamed("component", "was"), "node").where("component <> was").limit(1).count()
        label = new
        if not changed:
            return label
    raise RuntimeError("components did not settle")


def component_summary(edges: DataFrame) -> dict:
    """The number of components, and the nodes of the largest."""
    sizes = components(edges).groupBy("component").count()
    row = sizes.agg(F.count("*").alias("components"), F.max("count").alias("largest"), F.sum("count").alias("nodes")).first()
    return {"components": row.components, "largest": row.largest or 0, "nodes": row.nodes or 0}


def coverage(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Per source and split, rows whose condition, candidate and pair the graph has, and the shares."""
    nodes = endpoints(edges).select("type", "id").distinct()
    conditions = nodes.where("type = 'condition'").select(F.col("id").alias("condition"), F.lit(True).alias("known_condition"))
    candidates = nodes.where("type = 'medication'").select(F.col("id").alias("candidate"), F.lit(True).alias("known_candidate"))
    pairs = edges.where("relation = 'condition_medication'").select(F.col("src_id").alias("condition"), F.col("dst_id").alias("candidate"), F.lit(True).alias("known_pair"))
    held = rows.join(conditions, "condition", "left").join(candidates, "candidate", "left").join(pairs, ["condition", "candidate"], "left")
    out = held.groupBy("source", "split").agg(F.count("*").alias("row_count"), *[F.count_if(F.col(f"known_{k}")).alias(f"{k}_rows") for k in ("condition", "candidate", "pair")])
    rate = lambda c: F.round(F.try_divide(F.col(c).cast("double"), F.col("row_count").cast("double")), 9)
    return out.withColumns({"pair_rate": rate("pair_rows"), "cold_start_rate": F.round(1.0 - rate("candidate_rows"), 9)})


def graph_features(rows: DataFrame, edges: DataFrame, least_support: int = 1) -> DataFrame:
    """Rows with features of their condition and candidate in the graph of edges of at least least_support: support
    of the pair, its logarithm and share of the condition's, degrees and supports of either by relation, and three
    membership flags; 0 where the graph knows nothing. Lookups are as large as the vocabulary."""
    held = edges.where(F.col("support") >= least_support)
    pair = held.where("relation = 'condition_medication'").select(F.col("src_id").alias("condition"), F.col("dst_id").alias("candidate"), F.col("support").alias("pair_support"))
    ends = endpoints(held)
    relations = ["condition_medication", "condition_lab", "condition_vital", "condition_intervention", "medication_medication"]

    def of(kind: str, name: str, which: list[str]) -> DataFrame:
        sums = [F.count_if(F.col("relation") == r).alias(f"{name}_{r}_degree") for r in which] + [F.coalesce(F.sum(F.when(F.col("relation") == r, F.col("support"))), F.lit(0)).alias(f"{name}_{r}_support") for r in which]
        return ends.where(F.col("type") == kind).groupBy(F.col("id").alias(name)).agg(*sums).withColumn(f"{name}_in_graph", F.lit(1))

    by_condition, by_candidate = of("condition", "condition", relations[:4]), of("medication", "candidate", [relations[0], relations[4]])
    out = rows.join(pair, ["condition", "candidate"], "left").join(by_condition, "condition", "left").join(by_candidate, "candidate", "left")
    new = [c for c in out.columns if c not in rows.columns]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in new})
    share = F.coalesce(F.try_divide(F.col("pair_support").cast("double"), F.col("condition_condition_medication_support").cast("double")), F.lit(0.0))
    return out.withColumns({"pair_log_support": F.round(F.log1p("pair_support"), 9), "pair_support_share": F.round(share, 9), "pair_in_graph": (F.col("pair_support") > 0).cast("long")})


def feature_summary(features: DataFrame, columns: list[str]) -> DataFrame:
    """The mean and null share of each column, one row."""
    parts = [F.round(F.avg(c), 6).alias(f"{c}_mean") for c in columns] + [F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias(f"{c}_null_rate") for c in columns]
    return features.agg(F.count("*").alias("row_count"), *parts)


def gate_row(edges: DataFrame, components: DataFrame, least_nodes: int = 2) -> DataFrame:
    """D24 as a table: a graph's edges, those from conditions to medications, the nodes of its largest component, and
    whether it is fit for use."""
    counts = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("relation") == "condition_medication").alias("pair_edges"))
    largest = components.groupBy("component").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("largest_component"))
    fit = (F.col("pair_edges") > 0) & (F.col("largest_component") >= least_nodes)
    return counts.crossJoin(F.broadcast(largest)).withColumn("status", F.when(fit, "passed").otherwise("blocked"))


def graph_gate(edges: int, condition_candidate_edges: int, largest_component: int, audit_passed: bool) -> dict:
    """Whether a graph is fit for use, and what is against it."""
    faults = [name for name, bad in (("no_edges", edges == 0), ("no_condition_medication_edges", condition_candidate_edges == 0), ("no_connected_component", largest_component <= 1), ("leakage_audit_failed", not audit_passed)) if bad]
    return {"status": "blocked" if faults else "passed", "faults": faults}
