"""A subgraph for each ranking group, as nodes, edges, candidates and an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import endpoints

GROUP = ["source", "split", "stay_id", "group_id"]
ROLES = ("query_condition", "candidate", "context")


def subgraph_nodes(rows: DataFrame, context: DataFrame, edges: DataFrame, predict: float = 24.0) -> DataFrame:
    """A group's condition, its candidates, and the tokens its stay has up to the prediction that an edge joins
    with the condition; numbered from 0 by role, type and id; cold_start where the graph lacks the node. A group's
    nodes are one row's work: a vocabulary bounds them."""
    seen = context.where((F.col("hours") >= 0) & (F.col("hours") <= predict)).select("stay_id", F.col("event_type").alias("type"), F.col("token").alias("id"))
    seen = seen.repartition("stay_id").groupBy("stay_id").agg(F.collect_set(F.struct("type", "id")).alias("seen"))
    groups = rows.groupBy(*GROUP, "condition").agg(F.collect_set(F.struct("candidate")).alias("members"))
    return node_rows(group_nodes(groups.join(seen, "stay_id", "left"), edges), edges)


def group_nodes(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Groups (of training.ranking_groups with context: members, seen) with their nodes (order, type, id) in order, and what an
    edge joins with their condition. The lookup has a row a condition; Spark broadcasts it by its size (hand over
    written edges)."""
    near = edges.where("src_type = 'condition' and dst_type <> 'medication'").groupBy(F.col("src_id").alias("condition")).agg(F.collect_set(F.struct(F.col("dst_type").alias("type"), F.col("dst_id").alias("id"))).alias("near"))
    node = lambda order, kind, token: F.struct(F.lit(order).alias("order"), kind.alias("type"), token.alias("id"))
    one = F.array(node(0, F.lit("condition"), F.col("condition")))
    two = F.array_distinct(F.transform("members", lambda m: node(1, F.lit("medication"), m["candidate"])))
    three = F.transform(F.filter(F.coalesce("seen", F.array()), lambda s: F.exists("near", lambda n: (n["type"] == s["type"]) & (n["id"] == s["id"]))), lambda s: node(2, s["type"], s["id"]))
    nodes = F.array_sort(F.concat(one, two, F.coalesce(three, F.array())))
    return groups.join(near, "condition", "left").withColumn("nodes", nodes).drop("near", "seen")


def _known(edges: DataFrame) -> DataFrame:
    return endpoints(edges).select("type", "id").distinct()


def node_rows(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes of group_nodes, a row each."""
    nodes = groups.select(*GROUP, F.posexplode("nodes").alias("at", "n")).select(*GROUP, F.col("at").cast("long").alias("node_index"), F.element_at(F.array(*map(F.lit, ROLES)), F.col("n.order") + 1).alias("role"), "n.type", "n.id")
    nodes = nodes.join(_known(edges).withColumn("in_graph", F.lit(True)), ["type", "id"], "left")
    return nodes.select(*GROUP, "node_index", "role", "type", "id", F.coalesce("in_graph", F.lit(False)).alias("in_graph"), F.col("in_graph").isNull().alias("cold_start"))


def _met(groups: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """The condition with each other node of its group, and each candidate with each candidate, a row each."""
    first = groups.select(*GROUP, *more, "nodes", F.posexplode(F.filter("nodes", lambda n: n["order"] < 2)).alias("src_index", "s"))
    return first.select(*GROUP, *more, "src_index", "s", F.posexplode("nodes").alias("dst_index", "t")).where("s.order = 0 or t.order = 1")


def edge_rows(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """J20 from group_nodes: each pair of a group's nodes is looked up in the edge list, which a vocabulary bounds (Spark
    broadcasts it by its size). Nothing moves."""
    listed = edges.where("src_type in ('condition', 'medication')")
    on = (F.col("s.type") == F.col("src_type")) & (F.col("s.id") == F.col("src_id")) & (F.col("t.type") == F.col("dst_type")) & (F.col("t.id") == F.col("dst_id"))
    return _met(groups).join(listed, on).select(*GROUP, F.col("src_index").cast("long").alias("src_index"), F.col("dst_index").cast("long").alias("dst_index"), "src_type", "src_id", "dst_type", "dst_id", "relation", "support")


def candidate_rows(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """D26 from group_nodes: a group's candidates with their node."""
    known = _known(edges).where("type = 'medication'").select(F.col("id").alias("candidate"), F.lit(True).alias("in_graph"))
    # Candidates stand behind the condition, in the order of the nodes.
    at = F.array_position(F.transform("nodes", lambda n: F.when(n["order"] == 1, n["id"])), F.col("candidate")) - 1
    rows = groups.select(*GROUP, "condition", "nodes", F.inline("members")).where(F.col("candidate").isNotNull()).withColumn("node_index", at)
    return rows.join(known, "candidate", "left").select(*GROUP, "condition", "candidate", "node_index", "candidate_rank", "label", F.col("in_graph").isNull().alias("cold_start"))


def index_rows(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """A30 from group_nodes: a group's nodes and pairs of nodes are looked up where they stand, and a task hands on a row
    a group."""
    nodes = groups.select(*GROUP, "members", "nodes")
    cold = node_rows(groups, edges).where("cold_start").groupBy("group_id").agg(F.count("*").alias("cold_nodes"))
    own = edge_rows(groups, edges).groupBy("group_id").agg(F.count("*").alias("edges"))
    both = cold.select("group_id", "cold_nodes", F.lit(0).alias("edges")).union(own.select("group_id", F.lit(0), "edges")).groupBy("group_id").agg(F.sum("cold_nodes").alias("cold_nodes"), F.sum("edges").alias("edges"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    size = lambda c: F.size(c).cast("long")
    return nodes.join(both, "group_id", "left").select(*GROUP, size("nodes").alias("nodes"), none("edges"), size("members").alias("candidates"), size(F.filter("members", lambda m: m["label"])).alias("positives"), none("cold_nodes"))


def subgraph_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph's edges from a group's condition to its other nodes, and those among its candidates.

    The condition and the candidates of a group meet its other nodes by the group, which the catalog and the context
    vocabulary bound, as integers; each pair is then looked up in the edge list, which a vocabulary bounds too (Spark
    broadcasts it by its size). nodes and edges are read twice and once: hand over written tables.
    """
    concept = lambda kind, token: F.xxhash64(kind, token)
    listed = edges.where("src_type in ('condition', 'medication')").withColumns({"src": concept("src_type", "src_id"), "dst": concept("dst_type", "dst_id")})
    own = nodes.select(*GROUP, "node_index", "role", concept("type", "id").alias("node"))
    left = own.where("role in ('query_condition', 'candidate')").select(*GROUP, F.col("node_index").alias("src_index"), F.col("role").alias("src_role"), F.col("node").alias("src"))
    right = own.select("group_id", F.col("node_index").alias("dst_index"), F.col("role").alias("dst_role"), F.col("node").alias("dst"))
    met = left.join(right, "group_id").where("src_role = 'query_condition' or dst_role = 'candidate'")
    return met.join(listed, ["src", "dst"]).select(*GROUP, "src_index", "dst_index", "src_type", "src_id", "dst_type", "dst_id", "relation", "support")


def subgraph_candidates(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """A group's candidates with their node."""
    own = nodes.where("role = 'candidate'").select("group_id", F.col("id").alias("candidate"), "node_index", "cold_start")
    return rows.join(own, ["group_id", "candidate"]).select(*GROUP, "condition", "candidate", "node_index", "candidate_rank", "label", "cold_start")


def subgraph_index(nodes: DataFrame, edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Nodes, edges, candidates, positives and cold nodes of each group."""
    n = nodes.groupBy(*GROUP).agg(F.count("*").alias("nodes"), F.count_if("cold_start").alias("cold_nodes"))
    e = edges.groupBy("group_id").agg(F.count("*").alias("edges"))
    c = candidates.groupBy("group_id").agg(F.count("*").alias("candidates"), F.count_if("label").alias("positives"))
    out = n.join(e, "group_id", "left").join(c, "group_id", "left")
    return out.select(*GROUP, "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("positives", F.lit(0)).alias("positives"), "cold_nodes")
