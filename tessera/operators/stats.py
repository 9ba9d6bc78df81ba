"""Aggregates over a graph: statistics, coverage, quality, structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import casefold
from tessera.operators.lookup import closed
from tessera.operators.scope import scoped
from tessera.plans.graph import Graph, prop
from tessera.plans.ontology import Ontology


def by_type(g: Graph) -> DataFrame:
    """(kind, type, n)."""
    count = lambda df, kind: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(g.nodes, "node").unionByName(count(g.edges, "edge"))


def stats(g: Graph, today: str) -> DataFrame:
    """One row: nodes, edges, namespaces, sourced and proposed facts, first and last valid_from, nodes expired by today."""
    fact = lambda df, kind: df.select(F.lit(kind).alias("kind"), (F.size("src") > 0).alias("sourced"), "valid_from", "valid_to", "ns")
    facts = fact(g.nodes, "node").unionByName(fact(g.edges, "edge"))
    names = facts.select(F.explode("ns").alias("ns")).agg(F.count_distinct("ns").alias("namespaces"))
    counted = facts.agg(
        F.count_if(F.col("kind") == "node").alias("nodes"),
        F.count_if(F.col("kind") == "edge").alias("edges"),
        F.count_if("sourced").alias("sourced"),
        F.count_if(~F.col("sourced")).alias("proposed"),
        F.min("valid_from").alias("oldest"),
        F.max("valid_from").alias("newest"),
        F.count_if((F.col("kind") == "node") & (F.col("valid_to") <= F.lit(today).cast("date"))).alias("expired"),
    )
    return counted.crossJoin(F.broadcast(names))  # one row each


def topic_hit(topic: str) -> Column:
    """Whether a node's id, type or a property value holds a topic, whatever the case."""
    t = F.lit(topic.lower())
    return F.contains(F.lower("id"), t) | F.contains(F.lower("type"), t) | F.exists(F.map_values("props"), lambda v: F.contains(F.lower(v), t))


def topic_coverage(g: Graph, scope: list[str], topic: str, first: int = 20) -> DataFrame:
    """(type, n, ids): visible nodes whose id, type or a property value holds the topic; ids: the first of all, joined, on every row."""
    found = scoped(g, scope).nodes.where(topic_hit(topic))
    ids = found.orderBy("id").limit(first).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    return found.groupBy("type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(ids))


def _ratio(hit: Column, none: float = 1.0) -> Column:
    return F.when(F.count("*") == 0, none).otherwise(F.round(F.count_if(hit) / F.count("*"), 4))


def _populated(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def display_label(ontology: Ontology) -> Column:
    """The type's display property, else name, else title."""
    own: Column = F.lit(None).cast("string")
    for display in sorted({x[3] for x in ontology.node_types.values()}):
        own = F.when(F.col("type").isin([t for t, x in ontology.node_types.items() if x[3] == display]), prop(display)).otherwise(own)
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(prop("name"), F.lit("")), prop("title"))


def duplicate_labels(g: Graph, ontology: Ontology) -> DataFrame:
    """(type, label, n): labels, white space and case aside, that several nodes of a type have."""
    label = F.trim(F.regexp_replace(display_label(ontology), r"(?U)\s+", " "))
    folded = F.when(label.rlike(r"[^\x00-\x7F]"), casefold(label)).otherwise(F.lower(label))
    named = g.nodes.where(_populated(display_label(ontology))).select("type", folded.alias("label"))
    return named.groupBy("type", "label").agg(F.count("*").alias("n")).where("n > 1")


def content_quality(g: Graph, ontology: Ontology) -> DataFrame:
    """One row: coverage of labels, summaries and descriptions, share of generic edges, surplus nodes of equal label."""
    nodes = g.nodes.agg(
        _ratio(_populated(display_label(ontology))).alias("node_label_coverage"),
        _ratio(_populated(prop("summary"))).alias("node_summary_coverage"),
        _ratio(_populated(prop("description"))).alias("node_description_coverage"),
    )
    edges = g.edges.agg(_ratio(_populated(prop("description"))).alias("edge_description_coverage"), _ratio(F.col("type") == "relates_to", 0.0).alias("generic_edge_ratio"))
    surplus = duplicate_labels(g, ontology).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_label_count"))
    return nodes.crossJoin(F.broadcast(edges)).crossJoin(F.broadcast(surplus))  # one row each


def quality_warnings(quality: DataFrame) -> DataFrame:
    """quality with warn: summaries or edge descriptions that are missing, over half of the edges generic, or labels that repeat."""
    missing = (F.col("node_summary_coverage") < 1.0) | (F.col("edge_description_coverage") < 1.0)
    return quality.withColumn("warn", missing | (F.col("generic_edge_ratio") > 0.5) | (F.col("duplicate_label_count") > 0))


def structure_report(g: Graph) -> DataFrame:
    """One row: nodes, edges, edges a node, density, share of dangling edges."""
    n = g.nodes.agg(F.count("*").alias("nodes"))
    e = g.edges.agg(F.count("*").alias("edges"))
    whole = closed(g).edges.agg(F.count("*").alias("whole"))
    nodes, edges = F.col("nodes"), F.col("edges")
    per = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / b), 4)
    row = n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(whole))  # one row each
    return row.select("nodes", "edges", per(edges, nodes).alias("edges_per_node"), per(edges, nodes * (nodes - 1)).alias("density"), per(edges - F.col("whole"), edges).alias("dangling_rate"))


def coverage_gaps(g: Graph) -> DataFrame:
    """(ns, n, gap): nodes by namespace; a gap has under a quarter of the mean and under three."""
    counts = g.nodes.select(F.explode("ns").alias("ns")).groupBy("ns").agg(F.count("*").alias("n"))
    mean = counts.agg(F.avg("n").alias("mean"))
    return counts.crossJoin(F.broadcast(mean)).select("ns", "n", ((F.col("n") < 0.25 * F.col("mean")) & (F.col("n") < 3)).alias("gap"))
