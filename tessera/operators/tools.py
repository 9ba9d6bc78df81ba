"""What a client calls: search over nodes and facts at once, and the context of a graph."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import stored
from tessera.operators.lookup import active_at, resolve_ids
from tessera.operators.scope import scoped
from tessera.operators.search import scoped_search
from tessera.operators.stats import by_type, stats, topic_hit
from tessera.operators.traversal import CAP, touching, typed_hops
from tessera.plans.graph import Graph, prop
from tessera.plans.ontology import Ontology

KINDS = ("nodes", "facts", "both")


def as_of_date(said: str, today: str) -> str | None:
    """'' is today, 'all' is no filter (None), else the ISO date that the text starts with."""
    said = (said or "").strip()
    if said.lower() == "all":
        return None
    return date.fromisoformat(said[:10] if said else today).isoformat()


def compact_fact(*, date_format: str = "yyyy-MM-dd") -> list[Column]:
    """A fact as a client needs it: id, type, ends, description (empty if it has none), dates as text, sources."""
    iso = lambda c: F.date_format(c, date_format).alias(c)
    return [F.col("id"), F.col("type"), F.col("from_id").alias("from"), F.col("to_id").alias("to"), F.coalesce(prop("description"), F.lit("")).alias("description"), iso("valid_from"), iso("valid_to"), F.col("src")]


@dataclass(frozen=True)
class Found:
    """nodes: (rank, id, type, name). facts: (rank, score, the compact fact, neighbors array of compact facts)."""

    nodes: DataFrame | None
    facts: DataFrame | None


def search_tool(g: Graph, scope: list[str], query: str, limit: int = 10, *, kind: str = "both", center: str = "", as_of: str = "", today: str, mode: str = "scan", hops: int = CAP) -> Found:
    """Nodes, facts or both, each with its own limit; every fact comes with the typed hops around it, one deep.

    center: an id or alias to rank by distance from. as_of: see as_of_date(). rank counts from 0."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    at, center = as_of_date(as_of, today), center.strip() or None
    nodes = facts = None
    if kind != "facts":
        found = scoped_search(g, scope, query, limit, kind="nodes", center=center, as_of=at, mode=mode)
        nodes = _ranked(found, [F.coalesce("dist", F.lit(99)), F.col("place")]).select("rank", "id", "type", prop("name").alias("name"))
    if kind != "nodes":
        found = stored(scoped_search(g, scope, query, limit, kind="facts", center=center, as_of=at, mode=mode), "found")
        seen = active_at(scoped(g.with_edges(touching(g.edges, found)), scope).edges, at)
        around = typed_hops(F.broadcast(found), seen, hops).select("seed", "hop", "rank")
        packed = around.join(seen.withColumnRenamed("id", "hop").select("hop", *[c for c in seen.columns if c != "id"]), "hop")
        fact = packed.withColumnRenamed("hop", "id").select("seed", "rank", F.struct(*compact_fact()).alias("fact"))
        listed = fact.groupBy("seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "fact"))), lambda x: x["fact"]).alias("neighbors"))
        own = _ranked(found, [-F.col("score"), F.col("place")]).select("rank", "score", *compact_fact())
        empty = F.array().cast(listed.schema["neighbors"].dataType)
        facts = own.join(listed, F.col("id") == F.col("seed"), "left").select(*own.columns, F.coalesce("neighbors", empty).alias("neighbors"))
    return Found(nodes, facts)


def _ranked(found: DataFrame, order: list[Column]) -> DataFrame:
    """found, which a limit has cut, with rank from 0 in an order: the place among the sorted keys of all rows."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col("id"))
    keyed = found.withColumn("_key", key)
    keys = keyed.agg(F.array_sort(F.collect_list("_key")).alias("_keys"))
    return keyed.crossJoin(F.broadcast(keys)).withColumn("rank", F.array_position("_keys", F.col("_key")) - 1).drop("_key", "_keys")


def scoped_stats(g: Graph, scope: list[str], today: str, topic: str = "", first: int = 20) -> DataFrame:
    """(section, item, n) of the visible graph: totals, node and edge types, namespaces, provenance of nodes, freshness of nodes
    (days since 1970 as n) and, with a topic, what of it the nodes hold: the count, by type, and the first ids (n is their place)."""
    seen = scoped(g, scope)
    total = stats(seen, today)
    long = lambda section, item, n: F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"), n.cast("long").alias("n"))
    days = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    node = seen.nodes.agg(F.count_if(F.size("src") > 0).alias("curator"), F.count_if(F.size("src") == 0).alias("agent"), F.min("valid_from").alias("first"), F.max("valid_from").alias("last"))
    rows = [long("total", "nodes", F.col("nodes")), long("total", "edges", F.col("edges")), long("provenance", "curator", F.col("curator")), long("provenance", "agent", F.col("agent")), long("freshness", "expired", F.col("expired"))]
    rows += [long("freshness", "oldest", days(F.col("first"))), long("freshness", "newest", days(F.col("last")))]
    out = total.crossJoin(F.broadcast(node)).select(F.inline(F.array(*rows)))
    out = out.unionByName(by_type(seen).select(F.concat("kind", F.lit("_type")).alias("section"), F.col("type").alias("item"), "n"))
    names = seen.nodes.select(F.explode("ns").alias("item")).union(seen.edges.select(F.explode("ns"))).groupBy("item").agg(F.count("*").alias("n"))
    out = out.unionByName(names.select(F.lit("namespace").alias("section"), "item", "n"))
    if topic:
        hit = seen.nodes.where(topic_hit(topic))
        out = out.unionByName(hit.agg(F.count("*").alias("n")).select(F.lit("topic").alias("section"), F.lit(topic).alias("item"), "n"))
        out = out.unionByName(hit.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("topic_type").alias("section"), F.col("type").alias("item"), "n"))
        ids = hit.select("id").orderBy("id").limit(first).agg(F.array_sort(F.collect_list("id")).alias("ids"))
        out = out.unionByName(ids.select(F.posexplode("ids").alias("n", "item")).select(F.lit("topic_id").alias("section"), "item", F.col("n").cast("long")))
    return out


def context(g: Graph, scope: list[str], ontology: Ontology, today: str, *, section: str = "all", topic: str = "", entries: DataFrame | None = None, manifest: DataFrame | None = None) -> dict[str, DataFrame]:
    """schema (element, type, detail), namespaces (ns: the whole scope, whether or not the data has them), status (section, item, n):
    scoped_stats() with pending journal entries and the counters of the last compilation. section: one of these, or all."""
    known = ("schema", "namespaces", "status")
    if section not in (*known, "all"):
        raise ValueError(f"unknown section {section!r}")
    spark, out = g.nodes.sparkSession, {}
    for name in known if section == "all" else (section,):
        if name == "schema":
            rows = [("node", t, x[0]) for t, x in ontology.node_types.items()] + [("edge", t, f"{'|'.join(x[0])} -> {'|'.join(x[1])}") for t, x in ontology.edge_types.items()]
            out[name] = spark.createDataFrame(rows, "element string, type string, detail string")
        elif name == "namespaces":
            out[name] = spark.createDataFrame([(x,) for x in sorted(set(scope))], "ns string")
        else:
            found = scoped_stats(g, scope, today, topic)
            pending = entries.agg(F.count_if(F.col("status") == "pending").alias("n")) if entries is not None else spark.range(1).select(F.lit(0).cast("long").alias("n"))
            found = found.unionByName(pending.select(F.lit("journal").alias("section"), F.lit("pending").alias("item"), "n"))
            if manifest is not None:
                counters = [F.struct(F.lit("compile").alias("section"), F.lit(c).alias("item"), F.col(c).cast("long").alias("n")) for c in ("merged_count", "quarantined_count")]
                found = found.unionByName(manifest.select(F.inline(F.array(*counters))))
            out[name] = found
    return out


def resolved_rows(g: Graph, ids: DataFrame) -> DataFrame:
    """The nodes of ids (column asked; ids or aliases), with asked: many lookups as one join."""
    return resolve_ids(g, ids).join(g.nodes, "id")
