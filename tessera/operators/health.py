"""Graph health: lint, self-heal, suggestions, contributions, status, and summaries of errors and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.redaction import redacted
from tessera.functions.text import normal_id
from tessera.operators.components import drop_stored, stored, stored_in_turns, together
from tessera.operators.lookup import closed
from tessera.operators.scope import PUBLIC
from tessera.operators.stats import coverage_gaps
from tessera.operators.traversal import links_of, on_cycle
from tessera.plans.graph import Graph, prop


def orphans(g: Graph) -> DataFrame:
    """(id): nodes without an edge."""
    # ends are made distinct before the exchange, where hubs count once
    return g.nodes.select("id").join(links_of(g.edges).select(F.col("a").alias("id")).distinct(), "id", "left_anti")


def dangling(g: Graph) -> DataFrame:
    """(id, missing): edges with an end that is no node; missing: those ends, joined."""
    ids = g.nodes.select(F.col("id").alias("node"), F.lit(True).alias("known"))
    a, b = ids.select(F.col("node").alias("from_id"), F.col("known").alias("ka")), ids.select(F.col("node").alias("to_id"), F.col("known").alias("kb"))
    gone = F.concat_ws(",", F.when(F.col("ka").isNull(), F.col("from_id")), F.when(F.col("kb").isNull(), F.col("to_id")))
    return g.edges.join(a, "from_id", "left").join(b, "to_id", "left").where("ka is null or kb is null").select("id", gone.alias("missing"))


def stale(g: Graph, today: str) -> DataFrame:
    """(id): edges whose validity ended before today."""
    return g.edges.where(F.col("valid_to") < F.lit(today).cast("date")).select("id")


def contradictions(nodes: DataFrame) -> DataFrame:
    """(id, versions): ids that raw rows give several property sets."""
    from tessera.functions.text import sorted_map

    return nodes.groupBy("id").agg(F.count_distinct(F.to_json(sorted_map(F.col("props")))).alias("versions")).where("versions > 1")


def lint(g: Graph, today: str) -> DataFrame:
    """(check, id): every finding."""
    tag = lambda df, check, c="id": df.select(F.lit(check).alias("check"), F.col(c).alias("id"))
    return (
        tag(orphans(g), "orphan")
        .unionByName(tag(dangling(g), "missing_endpoint"))
        .unionByName(tag(stale(g, today), "stale"))
        .unionByName(tag(coverage_gaps(g).where("gap"), "coverage_gap", "ns"))
        .unionByName(tag(contradictions(g.nodes), "contradiction"))
    )


def healed_edges(g: Graph) -> DataFrame:
    """Edges without the dangling, the first (by id) of those that agree in type, ends and dates."""
    w = Window.partitionBy("type", "from_id", "to_id", "valid_from", "valid_to").orderBy("id")
    return closed(g).edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def self_heal(g: Graph) -> tuple[Graph, DataFrame]:
    """The graph with dangling and duplicate edges removed, and (action, id): removed, deduped; flagged cycles and orphans."""
    ids = stored(g.nodes.select("id").distinct(), "ids", "zstd")
    judged = _judged(g, ids)
    kept = judged.where("whole AND id = first")
    tag = lambda df, what: df.select(F.lit(what).alias("action"), "id")
    report = (
        tag(judged.where("NOT whole"), "removed")
        .unionByName(tag(judged.where("whole AND id <> first"), "deduped"))
        .unionByName(tag(on_cycle(kept), "circular_dependency"))
        .unionByName(tag(orphans(Graph(ids, kept)), "orphan"))
    )
    return Graph(g.nodes, healed_edges(g)), report


def _judged(g: Graph, ids: DataFrame) -> DataFrame:
    """(id, from_id, to_id, whole, first): every edge, whether both its ends are among ids, and the first id of those that agree with it.

    Only the columns that tell are exchanged, once for each end, and written in between; the second exchange, by from_id, also serves to find those that agree."""
    key = ["type", "from_id", "to_id", "valid_from", "valid_to"]
    known = lambda end: ids.select(F.col("id").alias(end), F.lit(True).alias(f"known_{end}"))
    bare = stored(g.edges.select("id", *key), "bare", "zstd")
    half = stored_in_turns(bare, "to_id", lambda part: part.join(known("to_id"), "to_id", "left"), "half")
    drop_stored(bare)
    whole = F.col("known_from_id").isNotNull() & F.col("known_to_id").isNotNull()
    first = F.min("id").over(Window.partitionBy(*key))
    both = lambda part: part.join(known("from_id"), "from_id", "left").select("id", "from_id", "to_id", whole.alias("whole"), first.alias("first"))
    judged = stored_in_turns(together(half), "from_id", both, "judged")
    drop_stored(*half)
    return together(judged)


def suggestions(g: Graph) -> DataFrame:
    """(kind, id): nodes with one source at most (under_sourced), and those of them without valid_from (gap)."""
    few = g.nodes.where(F.size("src") <= 1)
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id")
    return tag(few, "under_sourced").unionByName(tag(few.where("valid_from is null"), "gap"))


def contribution(g: Graph, me: str, shareable: list[str]) -> DataFrame:
    """(id, type): nodes of shareable types that only my namespace (and the public one) has, by normalised id."""
    key = normal_id(F.col("id"))
    held = g.nodes.select(key.alias("key"), F.explode("ns").alias("ns")).groupBy("key").agg(F.collect_set("ns").alias("all"))
    mine = g.nodes.where(F.array_contains("ns", me) & F.col("type").isin(shareable)).withColumn("key", key)
    alone = held.where(F.size(F.array_except("all", F.array(F.lit(me), F.lit(PUBLIC)))) == 0)
    return mine.join(alone, "key", "left_semi").select("id", "type")


def status(g: Graph, entries: DataFrame, today: str) -> DataFrame:
    """One row: nodes, edges, namespaces, lint findings, pending journal entries."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    row = one(g.nodes, "nodes").crossJoin(F.broadcast(one(g.edges, "edges")))
    row = row.crossJoin(F.broadcast(g.nodes.select(F.explode("ns").alias("ns")).agg(F.count_distinct("ns").alias("namespaces"))))
    return row.crossJoin(F.broadcast(one(lint(g, today), "lint_issues"))).crossJoin(F.broadcast(entries.agg(F.count_if(F.col("status") == "pending").alias("pending"))))


def systemic_errors(errors: DataFrame) -> DataFrame:
    """One row: errors, distinct messages, the commonest and its count, and systemic: three or more, of one message or with one that makes up 80 %."""
    counts = errors.groupBy("message").agg(F.count("*").alias("n"))
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("errors"), F.count("*").alias("messages"), F.max("n").alias("most"), F.max_by("message", F.struct("n", "message")).alias("top"))
    return row.withColumn("systemic", (F.col("errors") >= 3) & ((F.col("messages") == 1) | (F.col("most") >= 0.8 * F.col("errors"))))


def error_signatures(errors: DataFrame) -> DataFrame:
    """(signature, n): errors by the first 16 hex digits of sha256(event|type|component)."""
    return errors.groupBy(F.substring(F.sha2(F.concat_ws("|", "event", "error_type", "component"), 256), 1, 16).alias("signature")).agg(F.count("*").alias("n"))


def log_tail(lines: DataFrame, n: int, least: tuple[str, ...] | None = None) -> DataFrame:
    """The last n log lines (by pos), without secrets; least: only these levels."""
    kept = lines if least is None else lines.where(F.col("level").isin(*least))
    return kept.orderBy(F.desc("pos")).limit(n).withColumn("text", redacted(F.col("text")))


def carried_aliases(nodes: DataFrame) -> DataFrame:
    """(alias, canonical) that the last publication holds in merged_ids."""
    return nodes.select(F.explode(F.from_json(prop("merged_ids"), "array<string>")).alias("alias"), F.col("id").alias("canonical"))
