"""The write side: proposals are validated against the visible graph, stamped, and become journal entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.journal import clamped
from tessera.operators.lookup import resolve_ids
from tessera.operators.scope import scoped
from tessera.plans.graph import Graph
from tessera.plans.ontology import Ontology

PROPOSAL = "operation string, kind string, id string, type string, from_id string, to_id string, props map<string,string>, confidence double"


def checked(proposals: DataFrame, g: Graph, scope: list[str], ontology: Ontology) -> DataFrame:
    """proposals with error: why one can't be journalled, else null.

    create needs a known type and an id that is not there; link needs two visible ends that its type allows; update
    needs a visible node; merge needs two different visible nodes of one type."""
    spark = proposals.sparkSession
    seen = scoped(g, scope).nodes.select("id", "type")
    node = lambda c: seen.select(F.col("id").alias(c), F.col("type").alias(f"{c}_type"))
    ends = F.broadcast(ontology.ends(spark).select(F.col("edge_type").alias("type"), F.col("from_type").alias("from_id_type"), F.col("to_type").alias("to_id_type"), F.lit(True).alias("legal")))
    joined = proposals.join(node("id"), "id", "left").join(node("from_id"), "from_id", "left").join(node("to_id"), "to_id", "left").join(ends, ["type", "from_id_type", "to_id_type"], "left")
    op = F.col("operation")
    error = (
        F.when(~op.isin("create", "link", "update", "merge"), "unknown operation")
        .when((op == "create") & (F.col("id").isNull() | (F.trim("id") == "")), "no id")
        .when((op == "create") & ~F.coalesce(F.col("type").isin(*ontology.node_types), F.lit(False)), "unknown node type")
        .when((op == "create") & F.col("id_type").isNotNull(), "already there")
        .when((op == "update") & F.col("id_type").isNull(), "no such node")
        .when(op.isin("link", "merge") & (F.col("from_id_type").isNull() | F.col("to_id_type").isNull()), "end not visible")
        .when((op == "link") & ~F.coalesce(F.col("type").isin(*ontology.edge_types), F.lit(False)), "unknown edge type")
        .when((op == "link") & F.col("legal").isNull() & (F.col("type") != "same_as"), "ends not allowed")
        .when((op == "merge") & (F.col("from_id") == F.col("to_id")), "one node")
        .when((op == "merge") & (F.col("from_id_type") != F.col("to_id_type")), "different types")
    )
    return joined.withColumn("error", error).select(*proposals.columns, "error")


def entries(valid: DataFrame, *, agent: str, ns: str, proposed_at: str, device: str | None = None) -> DataFrame:
    """Journal entries of proposals: the server's namespace overrides the caller's, confidence is held within 0 and 1, merges count as certain."""
    if "*" in ns:
        raise ValueError("the namespace to write to must be one namespace")
    op = F.col("operation")
    key = F.sha2(F.concat_ws("|", F.lit(agent), F.lit(proposed_at), "operation", F.coalesce("id", F.lit("")), F.coalesce("type", F.lit("")), F.coalesce("from_id", F.lit("")), F.coalesce("to_id", F.lit(""))), 256)
    none = F.lit(None).cast("date")
    return valid.select(
        F.substring(key, 1, 32).alias("entry_id"), F.lit(agent).alias("agent"), F.lit(device).cast("string").alias("device"), F.lit(ns).alias("ns"),
        F.when(op == "merge", 1.0).otherwise(clamped(F.col("confidence"))).alias("confidence"), F.lit(proposed_at).alias("proposed_at"), F.lit("pending").alias("status"),
        F.when(op.isin("create", "update"), "node").otherwise("edge").alias("kind"), F.when(op.isin("create", "update"), F.col("id")).otherwise("").alias("id"),
        F.when(op == "merge", "same_as").otherwise(F.col("type")).alias("type"), "from_id", "to_id", F.array(F.lit(ns)).alias("fact_ns"), none.alias("valid_from"), none.alias("valid_to"),
        F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"), F.array().cast("array<string>").alias("src"),
    )


def review_error(kind: Column, fact_ids: Column) -> Column:
    """Why a review note (kind, ids of facts) can't be taken: a contradiction names exactly two facts, any note one at least."""
    return F.when(F.size(fact_ids) == 0, "no facts").when((kind == "contradiction") & (F.size(fact_ids) != 2), "a contradiction is between two facts")


def canonical_proposals(proposals: DataFrame, g: Graph) -> DataFrame:
    """proposals with aliases in their ids replaced."""
    out = proposals
    for c in ("id", "from_id", "to_id"):
        asked = proposals.select(F.col(c).alias("asked")).where("asked is not null").distinct()
        out = out.join(resolve_ids(g, asked).select(F.col("asked").alias(c), F.col("id").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return out.select(*proposals.columns)


def merged_json(ours: Column, theirs: Column) -> Column:
    """Two JSON objects as one, theirs winning, objects one level down united; null unless both are objects.

    Values keep their types: they are variants, from parsing to writing. Keys come out sorted."""
    kind = "map<string,variant>"
    parsed = lambda c: F.when(F.trim(c).startswith("{"), F.from_json(c, kind))
    a, b = parsed(ours), parsed(theirs)
    inner = lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT<")), F.from_json(F.to_json(v), kind))

    def united(x: Column, y: Column) -> Column:
        """y over x."""
        return F.map_concat(F.map_filter(x, lambda k, _: ~F.array_contains(F.map_keys(y), k)), y)

    def value(k: Column) -> Column:
        x, y = F.try_element_at(a, k), F.try_element_at(b, k)
        both = x.isNotNull() & y.isNotNull() & inner(x).isNotNull() & inner(y).isNotNull()
        return F.when(both, F.parse_json(F.to_json(united(inner(x), inner(y))))).otherwise(F.coalesce(y, x))

    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    return F.to_json(F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), value(k).alias("value")))))


#: Paths that a conflict may take from either side.
SNAPSHOTS = ("graph/", "wiki/", "cache/")


def conflict_class(path: Column, snapshots: tuple[str, ...] = SNAPSHOTS) -> Column:
    """snapshot for what can be made again, durable for the rest."""
    hit: Column = F.lit(False)
    for p in snapshots:
        hit = hit | F.startswith(path, F.lit(p))
    return F.when(hit, "snapshot").otherwise("durable")
