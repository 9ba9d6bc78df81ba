"""Change journals: confidence gate, upsert, replay, statuses, and unions of journal files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.resolve import merged_props
from tessera.plans.ontology import Ontology

LOW, HIGH = 0.5, 0.8
ENTRY = "entry_id string, agent string, device string, ns string, confidence double, proposed_at string, status string, kind string, id string, type string, from_id string, to_id string, fact_ns array<string>, valid_from date, valid_to date, props map<string,string>, src array<string>"


def entry_key(prefix: str = "") -> Column:
    return F.coalesce(F.nullif(F.col(f"{prefix}entry_id"), F.lit("")), F.col(f"{prefix}proposed_at"))


def gate(confidence: Column, replaying: Column | None = None) -> Column:
    """quarantined below 0.5, flagged below 0.8, else merged; what is replayed passes as replayed."""
    by = F.when(confidence < LOW, "quarantined").when(confidence < HIGH, "flagged").otherwise("merged")
    return by if replaying is None else F.when(replaying, "replayed").otherwise(by)


def clamped(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def decided(entries: DataFrame, nodes: DataFrame, ontology: Ontology | None = None, replay: bool = False) -> DataFrame:
    """Entries in play with replaying, verdict (merged, flagged, replayed, quarantined) and reason.

    Nodes come before edges, so an edge's ends are judged against the nodes that were there and those that entries
    bring; a new node only counts if its own entry passes."""
    replaying = F.col("status").isin("merged", "flagged") if replay else F.lit(False)
    own = entries.where((F.col("status") == "pending") | replaying).withColumn("replaying", replaying)
    whole = F.col("id").isNotNull() & F.col("type").isNotNull() & F.col("kind").isin("node", "edge") & ((F.col("kind") == "node") | (F.col("from_id").isNotNull() & F.col("to_id").isNotNull()))
    reason = F.when(~F.coalesce(whole, F.lit(False)), "invalid fact schema").when((F.col("confidence") < LOW) & ~F.col("replaying"), "low confidence")
    if ontology is not None:
        reason = reason.when((F.col("kind") == "node") & ~F.col("type").isin(*ontology.node_types), F.concat(F.lit("unknown node type: "), "type"))
    judged = own.withColumn("reason", reason)
    if ontology is not None:
        order = F.struct(F.lit(1).alias("a"), entry_key().alias("b"), F.col("agent").alias("c"))
        brought = judged.where("kind = 'node' and reason is null").select("id", "type", order.alias("o"))
        held = nodes.select("id", "type", F.struct(F.lit(0).alias("a"), F.lit("").alias("b"), F.lit("").alias("c")).alias("o")).unionByName(brought).groupBy("id").agg(F.min_by("type", "o").alias("t"))
        ends = F.broadcast(ontology.ends(entries.sparkSession).select(F.col("edge_type").alias("type"), "from_type", "to_type", F.lit(True).alias("legal")))
        a, b = held.select(F.col("id").alias("from_id"), F.col("t").alias("from_type")), held.select(F.col("id").alias("to_id"), F.col("t").alias("to_type"))
        judged = judged.join(a, "from_id", "left").join(b, "to_id", "left").join(ends, ["type", "from_type", "to_type"], "left")
        bad = (F.col("kind") == "edge") & (F.col("type") != "same_as") & F.col("legal").isNull()
        judged = judged.withColumn("reason", F.coalesce("reason", F.when(bad, "invalid edge endpoints"))).drop("from_type", "to_type", "legal")
    return judged.withColumn("verdict", F.when(F.col("reason").isNotNull(), "quarantined").otherwise(gate(F.col("confidence"), F.col("replaying"))))


def provenance() -> Column:
    return F.struct("agent", "confidence", "proposed_at", F.nullif(F.col("device"), F.lit("")).alias("device"))


def merge_nodes(nodes: DataFrame, accepted: DataFrame) -> DataFrame:
    """nodes with accepted node entries: known ids keep type, dates and provenance, and take properties, sources and namespaces;
    new ids come as they are, with provenance. Replayed entries never override a property."""
    old = nodes.select("id", "type", "valid_from", "valid_to", "ns", "src", "props", F.col("provenance"), F.lit(False).alias("replaying"), F.struct(F.lit(0).alias("a"), F.lit("").alias("b"), F.lit("").alias("c")).alias("o"))
    new = accepted.where("kind = 'node'").select("id", "type", "valid_from", "valid_to", F.col("fact_ns").alias("ns"), "src", "props", provenance().alias("provenance"), "replaying", F.struct(F.lit(1).alias("a"), entry_key().alias("b"), F.col("agent").alias("c")).alias("o"))
    rows = old.unionByName(new)
    u = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    first = rows.groupBy("id").agg(F.min_by(F.struct("type", "valid_from", "valid_to", "provenance"), "o").alias("f"), u("ns"), u("src"), F.count("*").alias("facts"))
    return first.join(merged_props(rows, ["id"], "o", "replaying"), "id", "left").select("id", "f.*", "ns", "src", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"), "facts")


def merge_edges(edges: DataFrame, accepted: DataFrame) -> DataFrame:
    """edges with accepted edge entries: one for each (from, to, type, dates); sources are joined, namespaces are the first's."""
    iso = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    zero = F.struct(F.lit(0).alias("a"), F.col("id").alias("b"), F.lit("").alias("c"))
    old = edges.select("id", "type", "from_id", "to_id", "valid_from", "valid_to", "ns", "src", "props", F.col("provenance"), F.lit(False).alias("replaying"), zero.alias("o"))
    new = accepted.where("kind = 'edge'").select("id", "type", "from_id", "to_id", "valid_from", "valid_to", F.col("fact_ns").alias("ns"), "src", "props", provenance().alias("provenance"), "replaying", F.struct(F.lit(1).alias("a"), entry_key().alias("b"), F.col("agent").alias("c")).alias("o"))
    rows = old.unionByName(new).withColumns({"_f": iso("valid_from"), "_t": iso("valid_to")})
    keys = ["from_id", "to_id", "type", "_f", "_t"]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct("id", "valid_from", "valid_to", "ns", "provenance"), "o").alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("src")))).alias("src"), F.count("*").alias("facts"))
    return first.join(merged_props(rows, keys, "o", "replaying"), keys, "left").select("f.id", "type", "from_id", "to_id", "f.valid_from", "f.valid_to", "f.ns", "src", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"), "f.provenance", "facts")


def merge_journals(nodes: DataFrame, edges: DataFrame, entries: DataFrame, ontology: Ontology | None = None, replay: bool = False) -> dict[str, DataFrame]:
    """nodes, edges and decisions (entries with verdict and reason)."""
    made = decided(entries, nodes, ontology, replay)
    passed = made.where("verdict <> 'quarantined'")
    return {"nodes": merge_nodes(nodes, passed), "edges": merge_edges(edges, passed), "decisions": made}


def new_status(verdict: Column, manual: bool = True) -> Column:
    """What an entry's status becomes: by hand, flagged counts as merged and low as quarantined; automatically, flagged stays flagged and low stays pending."""
    if manual:
        return F.when(verdict == "quarantined", "quarantined").otherwise("merged")
    return F.when(verdict == "flagged", "flagged").when(verdict == "quarantined", "pending").otherwise("merged")


def with_statuses(entries: DataFrame, decisions: DataFrame, manual: bool = True) -> DataFrame:
    """entries with the status of pending ones rewritten by key."""
    found = decisions.where("verdict <> 'replayed'").select(entry_key().alias("_k"), new_status(F.col("verdict"), manual).alias("_s")).groupBy("_k").agg(F.max("_s").alias("_s"))
    keyed = entries.withColumn("_k", entry_key()).join(found, "_k", "left")
    return keyed.withColumn("status", F.when((F.col("status") == "pending") & F.col("_s").isNotNull(), F.col("_s")).otherwise(F.col("status"))).drop("_k", "_s")


def union_first(ours: DataFrame, theirs: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of two files by key, the first of ours (by order) before theirs."""
    both = ours.withColumn("_side", F.lit(0)).unionByName(theirs.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    row = F.struct(*[c for c in both.columns if c != "_side"])
    return both.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min_by(row, F.struct("_side", *order)).alias("r")).select("r.*")
