"""Point reads, adjacency and the temporal queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.graph import Graph


def active(at: Column | str, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    """Half-open: valid_from <= at < valid_to, null being unbounded."""
    t = F.lit(at).cast("date") if isinstance(at, str) else at
    return (F.col(valid_from).isNull() | (F.col(valid_from) <= t)) & (F.col(valid_to).isNull() | (t < F.col(valid_to)))


def active_at(facts: DataFrame, at: str | None) -> DataFrame:
    """The facts active at a date; None filters nothing."""
    return facts if at is None else facts.where(active(at))


def resolve_ids(g: Graph, ids: DataFrame) -> DataFrame:
    """(asked, id): ids (column asked) with an alias replaced by its node, one hop."""
    return ids.join(g.aliases().withColumnRenamed("alias", "asked"), "asked", "left").select("asked", F.coalesce("id", "asked").alias("id"))


def canonical(g: Graph, id_: str) -> str:
    """The id of the node that an id or alias means, one hop; one row at most comes to the driver, so that reads of the node
    and its edges are filters by a constant."""
    found = g.aliases().where(F.col("alias") == id_).first()
    return found["id"] if found else id_


def get_node(g: Graph, id_: str) -> DataFrame:
    """The node with an id or alias, with resolved_from: the alias asked for, if it was one."""
    own = canonical(g, id_)
    return g.nodes.where(F.col("id") == own).withColumn("resolved_from", F.lit(id_ if own != id_ else None).cast("string"))


def get_edge(g: Graph, id_: str) -> DataFrame:
    return g.edges.where(F.col("id") == id_)


def out_edges(g: Graph, id_: str, edge_type: str | None = None) -> DataFrame:
    found = g.edges.where(F.col("from_id") == id_)
    return found if edge_type is None else found.where(F.col("type") == edge_type)


def in_edges(g: Graph, id_: str, edge_type: str | None = None) -> DataFrame:
    found = g.edges.where(F.col("to_id") == id_)
    return found if edge_type is None else found.where(F.col("type") == edge_type)


def snapshot(g: Graph, at: str) -> Graph:
    """Nodes and edges active at a date, each by its own dates."""
    return Graph(active_at(g.nodes, at), active_at(g.edges, at))


def closed(g: Graph) -> Graph:
    """The edges of g whose two ends are nodes of g."""
    ids = g.nodes.select("id")
    edges = g.edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return Graph(g.nodes, edges.select(*g.edges.columns))


def history(g: Graph, id_: str) -> DataFrame:
    """The node with an id or alias, then its edges in order of valid_from (unbounded first, outgoing before incoming, then id).

    kind, direction, id, type, valid_from, valid_to, other."""
    return history_of(g, canonical(g, id_))


def history_of(g: Graph, id_: str) -> DataFrame:
    """history() of a node's own id."""
    null = F.lit(None).cast("string")
    node = g.nodes.where(F.col("id") == id_).select(F.lit("node").alias("kind"), null.alias("direction"), "id", "type", "valid_from", "valid_to", null.alias("other"), F.lit(0).alias("side"))
    edge = lambda df, way, other, side: df.select(F.lit("edge").alias("kind"), F.lit(way).alias("direction"), "id", "type", "valid_from", "valid_to", F.col(other).alias("other"), F.lit(side).alias("side"))
    rows = node.unionByName(edge(out_edges(g, id_), "out", "to_id", 1)).unionByName(edge(in_edges(g, id_), "in", "from_id", 2))
    # one node's facts, by range partitions
    return rows.orderBy(F.desc("kind"), F.col("valid_from").asc_nulls_first(), "side", "id").drop("side")


def changes(g: Graph, since: str, until: str) -> DataFrame:
    """Edges that began or ended within [since, until); an edge can do both. change: began or ended."""
    a, b = F.lit(since).cast("date"), F.lit(until).cast("date")
    within = lambda c: (F.col(c) >= a) & (F.col(c) < b)
    began = g.edges.where(within("valid_from")).withColumn("change", F.lit("began"))
    return began.unionByName(g.edges.where(within("valid_to")).withColumn("change", F.lit("ended")))


def temporal_query(g: Graph, mode: str, **params: str) -> DataFrame | Graph:
    """snapshot(time), history(id) or changes(from, to), with the arguments each needs."""
    needs = {"snapshot": ("time",), "history": ("id",), "changes": ("from", "to")}
    if mode not in needs:
        raise ValueError(f"unknown mode {mode!r}: one of {', '.join(needs)}")
    if missing := [x for x in needs[mode] if not params.get(x)]:
        raise ValueError(f"{mode} needs {', '.join(missing)}")
    if mode == "snapshot":
        return snapshot(g, params["time"])
    return history(g, params["id"]) if mode == "history" else changes(g, params["from"], params["to"])
