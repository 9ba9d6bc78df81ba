"""One query for each operator over the sample graph and tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import evaluate, health, journal, lookup, pages, resolve, scope, search, sessions, stats, traversal
from tessera.plans.graph import Graph
from tessera.plans.ontology import Ontology
from tessera.sources import files
from tessera.sources.graph_view import GRAPH_SQL, sample_graph

AT, SINCE, UNTIL, TODAY = "1998-06-30", "1997-01-01", "1997-03-01", "1999-01-01"
ALLOWED = ["eu*", "middle east"]
SCOPE = ["europe", "middle east", "public"]
VIEW = Ontology().with_ends(("member_of", "service", "team"), ("in_domain", "team", "domain"), ("depends_on", "goal", "project"), ("contributes_to", "service", "project"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def on_graph(sql: str) -> str:
    return GRAPH_SQL + sql


_IN = "('europe', 'middle east', 'public')"
SCOPED = f""",
sn AS MATERIALIZED (SELECT * FROM nodes WHERE ns IN {_IN}),
se AS MATERIALIZED (SELECT * FROM edges WHERE ns IN {_IN} AND from_id IN (SELECT id FROM sn) AND to_id IN (SELECT id FROM sn))
"""


def live(at: str, t: str = "") -> str:
    return f"({t}vf IS NULL OR {t}vf <= DATE '{at}') AND ({t}vt IS NULL OR DATE '{at}' < {t}vt)"


def facts(g: Graph) -> DataFrame:
    return g.nodes.select(F.lit("node").alias("kind"), "id", "type").unionByName(g.edges.select(F.lit("edge").alias("kind"), "id", "type"))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- lookups and time


@query("snapshot_at", on_graph(f"SELECT 'node' AS kind, id, type FROM nodes WHERE {live(AT)} UNION ALL SELECT 'edge', id, type FROM edges WHERE {live(AT)}"))
def snapshot_at(spark, d):
    return facts(lookup.snapshot(sample_graph(spark, d), AT))


@query("scoped_snapshot", on_graph(f""",
an AS (SELECT * FROM nodes WHERE ns IN {_IN} AND {live(AT)})
SELECT 'node' AS kind, id, type FROM an UNION ALL
SELECT 'edge', id, type FROM edges WHERE ns IN {_IN} AND {live(AT)} AND from_id IN (SELECT id FROM an) AND to_id IN (SELECT id FROM an)"""))  # fmt: skip
def scoped_snapshot(spark, d):
    g = sample_graph(spark, d)
    return facts(scope.scoped_snapshot(g, SCOPE, AT))


HISTORY_COLUMNS = ["kind", "direction", "id", "type", "CAST(valid_from AS STRING) AS valid_from", "CAST(valid_to AS STRING) AS valid_to", "other"]


def _history_sql(nodes: str, edges: str, id_: str) -> str:
    return f"""
SELECT 'node' AS kind, NULL AS direction, id, type, CAST(vf AS VARCHAR) AS valid_from, CAST(vt AS VARCHAR) AS valid_to, NULL AS other FROM {nodes} WHERE id = '{id_}'
UNION ALL SELECT 'edge', 'out', id, type, CAST(vf AS VARCHAR), CAST(vt AS VARCHAR), to_id FROM {edges} WHERE from_id = '{id_}'
UNION ALL SELECT 'edge', 'in', id, type, CAST(vf AS VARCHAR), CAST(vt AS VARCHAR), from_id FROM {edges} WHERE to_id = '{id_}'"""


@query("history", on_graph(_history_sql("nodes", "edges", "cust:42")))
def history(spark, d):
    return lookup.history(sample_graph(spark, d), "cust:42").selectExpr(*HISTORY_COLUMNS)


@query("history_by_alias", on_graph(_history_sql("nodes", "edges", "part:100")))
def history_by_alias(spark, d):
    return lookup.history(_with_aliases(sample_graph(spark, d)), "old-part:100").selectExpr(*HISTORY_COLUMNS)


@query("scoped_history_by_alias", on_graph(SCOPED + _history_sql("sn", "se", "part:100")))
def scoped_history_by_alias(spark, d):
    return scope.scoped_history(_with_aliases(sample_graph(spark, d)), SCOPE, "old-part:100").selectExpr(*HISTORY_COLUMNS)


@query("scoped_history", on_graph(SCOPED + _history_sql("sn", "se", "part:7")))
def scoped_history(spark, d):
    return scope.scoped_history(sample_graph(spark, d), SCOPE, "part:7").selectExpr(*HISTORY_COLUMNS)


def _changes_sql(edges: str) -> str:
    w = lambda c: f"{c} >= DATE '{SINCE}' AND {c} < DATE '{UNTIL}'"
    return f"SELECT 'began' AS change, id, type FROM {edges} WHERE {w('vf')} UNION ALL SELECT 'ended', id, type FROM {edges} WHERE {w('vt')}"


@query("changes_began_ended", on_graph(_changes_sql("edges")))
def changes(spark, d):
    return lookup.changes(sample_graph(spark, d), SINCE, UNTIL).select("change", "id", "type")


@query("scoped_changes", on_graph(SCOPED + _changes_sql("se")))
def scoped_changes(spark, d):
    return scope.scoped_changes(sample_graph(spark, d), SCOPE, SINCE, UNTIL).select("change", "id", "type")


@query("out_edges_typed", on_graph("SELECT id, to_id FROM edges WHERE from_id = 'supp:7' AND type = 'contributes_to'"))
def out_edges(spark, d):
    return lookup.out_edges(sample_graph(spark, d), "supp:7", "contributes_to").select("id", "to_id")


@query("in_edges_any", on_graph("SELECT id, type, from_id FROM edges WHERE to_id = 'nation:3'"))
def in_edges(spark, d):
    return lookup.in_edges(sample_graph(spark, d), "nation:3").select("id", "type", "from_id")


def _with_aliases(g: Graph) -> Graph:
    """Parts whose key ends in 00 have absorbed an older id."""
    old = F.concat(F.lit('["old-'), "id", F.lit('"]'))
    return Graph(g.nodes.withColumn("props", F.when(F.col("id").rlike(r"^part:\d*00$"), F.map_concat("props", F.create_map(F.lit("merged_ids"), old))).otherwise(F.col("props"))), g.edges)


@query("get_node_by_alias", on_graph("SELECT id, type, name, 'old-part:100' AS resolved_from FROM nodes WHERE id = 'part:100'"))
def get_node(spark, d):
    return lookup.get_node(_with_aliases(sample_graph(spark, d)), "old-part:100").select("id", "type", F.col("props")["name"].alias("name"), "resolved_from")


@query("edge_by_id", on_graph("SELECT id, type, from_id, to_id FROM edges WHERE id = (SELECT min(id) FROM edges WHERE from_id = 'cust:42')"))
def edge_by_id(spark, d):
    g = sample_graph(spark, d)
    return lookup.get_edge(g, lookup.out_edges(g, "cust:42").agg(F.min("id")).first()[0] or "").select("id", "type", "from_id", "to_id")


@query("scoped_points", on_graph(SCOPED + """SELECT 'node' AS kind, id FROM sn WHERE id IN ('nation:3', 'nation:0', 'part:100')
UNION ALL SELECT 'edge', id FROM se WHERE id IN (SELECT min(id) FROM edges WHERE from_id = 'cust:42' UNION SELECT min(id) FROM edges WHERE from_id = 'supp:7')"""))  # fmt: skip
def scoped_points(spark, d):
    """Three nodes, one of them asked for by its alias, and two edges, as far as they are visible."""
    g = _with_aliases(sample_graph(spark, d))
    some = [lookup.out_edges(g, x).agg(F.min("id")).first()[0] or "" for x in ("cust:42", "supp:7")]
    out = [scope.scoped_node(g, SCOPE, x).select(F.lit("node").alias("kind"), "id") for x in ("nation:3", "nation:0", "old-part:100")]
    out += [scope.scoped_edge(g, SCOPE, x).select(F.lit("edge").alias("kind"), "id") for x in some]
    return reduce(DataFrame.unionByName, out)


@query("aliases", on_graph("SELECT 'old-' || id AS alias, id FROM nodes WHERE regexp_matches(id, '^part:[0-9]*00$')"))
def aliases(spark, d):
    return _with_aliases(sample_graph(spark, d)).aliases()


# ---------------------------------------------------------------- scopes


@query("ns_expand_glob", "SELECT DISTINCT lower(r_name) AS ns FROM region WHERE lower(r_name) LIKE 'eu%' OR lower(r_name) = 'middle east'")
def ns_expand(spark, d):
    return scope.expand_namespaces(sample_graph(spark, d), ALLOWED)


@query("namespaces", "SELECT DISTINCT lower(r_name) AS ns FROM region UNION SELECT 'public'")
def namespaces(spark, d):
    return scope.namespaces(sample_graph(spark, d))


@query("scoped_facts", on_graph(SCOPED + "SELECT 'node' AS kind, id, type FROM sn UNION ALL SELECT 'edge', id, type FROM se"))
def scoped_facts(spark, d):
    g = sample_graph(spark, d)
    return facts(scope.scoped(g, scope.effective(g, ALLOWED)))


# ---------------------------------------------------------------- traversal


def _walk(nodes: str, edges: str, start: str, cap: int, after: str, starts: str | None = None) -> str:
    """dist(id, dist): hops up to cap, level by level; the start must be in `starts` (nodes unless given)."""
    out = f", links AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT from_id AS a, to_id AS b FROM {edges} UNION ALL SELECT to_id, from_id FROM {edges}) SEMI JOIN {nodes} ON b = {nodes}.id), l0 AS MATERIALIZED (SELECT id, 0 AS dist FROM {starts or nodes} WHERE id = '{start}')"
    for i in range(1, cap + 1):
        out += f", n{i} AS MATERIALIZED (SELECT DISTINCT b AS id FROM links JOIN l{i - 1} ON a = id AND dist = {i - 1}), l{i} AS MATERIALIZED (SELECT * FROM l{i - 1} UNION ALL SELECT id, {i} FROM n{i} ANTI JOIN l{i - 1} USING (id))"
    return out + f", dist AS (SELECT id, CAST(dist AS INTEGER) AS dist FROM l{cap})" + after


_MET = ", near AS MATERIALIZED (SELECT id FROM dist WHERE dist < {depth}), met AS MATERIALIZED (SELECT edges.id FROM edges SEMI JOIN near ON from_id = near.id UNION SELECT edges.id FROM edges SEMI JOIN near ON to_id = near.id)"


def _both(nodes, edges, dist: bool = True):
    shown = [F.col("dist")] if dist else []
    return nodes.select(F.lit("node").alias("kind"), "id", *shown).unionByName(edges.select(F.lit("edge").alias("kind"), "id", *([F.lit(-1).alias("dist")] if dist else [])))


def _neighbors(name: str, depth: int, start: str, asked: str | None = None) -> None:
    sql = _walk("nodes", "edges", start, depth, _MET.format(depth=depth) + " SELECT 'node' AS kind, id, dist FROM dist UNION ALL SELECT 'edge', id, -1 FROM met")

    @query(name, on_graph(sql))
    def neighbors(spark, d):
        return _both(*traversal.neighbors(_with_aliases(sample_graph(spark, d)), asked or start, depth=depth))


_neighbors("neighbors_d1", 1, "nation:3")
_neighbors("neighbors_d2", 2, "cust:42")
_neighbors("neighbors_d3", 3, "ord:77")
_neighbors("neighbors_by_alias", 2, "part:100", "old-part:100")


def _scoped_neighbors(start: str) -> str:
    kept = f", kept AS MATERIALIZED (SELECT dist.id FROM dist SEMI JOIN sn USING (id)) SELECT 'node' AS kind, id FROM kept UNION ALL SELECT 'edge', e.id FROM (SELECT * FROM edges WHERE ns IN {_IN}) e SEMI JOIN met ON e.id = met.id SEMI JOIN kept a ON from_id = a.id SEMI JOIN kept b ON to_id = b.id"
    return on_graph(SCOPED + _walk("nodes", "edges", start, 2, _MET.format(depth=2) + kept, "sn"))


@query("scoped_neighbors", _scoped_neighbors("part:7"))
def scoped_neighbors(spark, d):
    return _both(*traversal.scoped_neighbors(sample_graph(spark, d), SCOPE, "part:7", depth=2), dist=False)


@query("scoped_neighbors_by_alias", _scoped_neighbors("part:100"))
def scoped_neighbors_by_alias(spark, d):
    return _both(*traversal.scoped_neighbors(_with_aliases(sample_graph(spark, d)), SCOPE, "old-part:100", depth=2), dist=False)


@query("scoped_neighbors_hidden_start", _scoped_neighbors("nation:0"))
def scoped_neighbors_hidden_start(spark, d):
    """nation:0 is African: its customers can't be asked for through it."""
    return _both(*traversal.scoped_neighbors(sample_graph(spark, d), SCOPE, "nation:0", depth=2), dist=False)


@query("distances_cap4", on_graph(_walk("nodes", "edges", "region:1", 4, " SELECT id, dist FROM dist")))
def distances(spark, d):
    g = sample_graph(spark, d)
    return traversal.distances(g.nodes, g.edges, ["region:1"])


@query("distances_by_alias", on_graph(_walk("nodes", "edges", "part:100", 2, " SELECT id, dist FROM dist")))
def distances_by_alias(spark, d):
    g = _with_aliases(sample_graph(spark, d))
    return traversal.distances(g.nodes, g.edges, [lookup.canonical(g, "old-part:100")], 2)


_AS_OF = f", an AS MATERIALIZED (SELECT * FROM sn WHERE {live(AT)}), ae AS MATERIALIZED (SELECT * FROM se WHERE {live(AT)})"


@query("scoped_distances_asof", on_graph(SCOPED + _AS_OF + _walk("sn", "ae", "region:3", 4, " SELECT id, dist FROM dist", "an")))
def scoped_distances(spark, d):
    return traversal.scoped_distances(sample_graph(spark, d), SCOPE, "region:3", AT)


@query("scoped_distances_by_alias", on_graph(SCOPED + _AS_OF + _walk("sn", "ae", "part:100", 4, " SELECT id, dist FROM dist", "an")))
def scoped_distances_by_alias(spark, d):
    return traversal.scoped_distances(_with_aliases(sample_graph(spark, d)), SCOPE, "old-part:100", AT)


_HOPS = """
ends AS (SELECT id, from_id AS e FROM edges UNION SELECT id, to_id FROM edges),
hop AS (SELECT DISTINCT s.id AS seed, h.id AS hop, h.type AS hop_type FROM (SELECT * FROM ends WHERE id IN (SELECT id FROM seeds)) s JOIN (SELECT ends.*, type FROM ends JOIN edges USING (id) WHERE type <> 'relates_to') h ON s.e = h.e AND s.id <> h.id),
ranked AS (SELECT seed, hop, hop_type, CAST(row_number() OVER (PARTITION BY seed ORDER BY hop) AS INTEGER) AS rank FROM hop)"""


@query("typed_hops_top4", on_graph(f", seeds AS (SELECT id FROM edges WHERE from_id = 'cust:42'), {_HOPS} SELECT * FROM ranked WHERE rank <= 4"))
def typed_hops(spark, d):
    g = sample_graph(spark, d)
    return traversal.typed_hops(lookup.out_edges(g, "cust:42"), g.edges)


@query("hub_top10", on_graph("""
SELECT id, coalesce(name, title, id) AS label, count(*) AS degree FROM nodes JOIN (SELECT from_id AS e FROM edges UNION ALL SELECT to_id FROM edges) ON id = e
GROUP BY id, name, title ORDER BY degree DESC, lower(coalesce(name, title, id)), id LIMIT 10"""))  # fmt: skip
def hub_top10(spark, d):
    return traversal.hubs(sample_graph(spark, d))


@query("directed_cycles", """
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_partkey IN (SELECT l_suppkey FROM lineitem)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT 'supp:' || a AS id FROM r WHERE a = b""")  # fmt: skip
def directed_cycles(spark, d):
    """Suppliers and parts of every line, their ids shared, so that there are cycles."""
    rows = table(spark, d, "lineitem")
    return traversal.on_cycle(rows.select(F.concat(F.lit("supp:"), F.col("l_suppkey")).alias("from_id"), F.concat(F.lit("supp:"), F.col("l_partkey")).alias("to_id")))


# ---------------------------------------------------------------- search


_NODE_BODY = "concat_ws(' ', id, type, coalesce(name, ''), concat_ws(' ', brand, priority, segment, status, summary, title))"
_EDGE_BODY = "concat_ws(' ', e.id, e.type, from_id, to_id, coalesce(a.name, a.title, ''), coalesce(b.name, b.title, ''), concat_ws(' ', description, lines, note, reason))"
_EDGES = "edges e LEFT JOIN nodes a ON a.id = from_id LEFT JOIN nodes b ON b.id = to_id"


@query("node_text_scan", on_graph(f"SELECT id, type, CAST(row_number() OVER (ORDER BY type, id) - 1 AS INTEGER) AS place FROM nodes WHERE contains(lower({_NODE_BODY}), 'brand#17') ORDER BY type, id LIMIT 40"))
def node_text_scan(spark, d):
    return search.search(search.node_text(sample_graph(spark, d).nodes), "Brand#17", 40).select("id", "type", "place")


@query("edge_text_scan", on_graph(f"SELECT e.id, e.type, CAST(row_number() OVER (ORDER BY e.type, e.id) - 1 AS INTEGER) AS place FROM {_EDGES} WHERE contains(lower({_EDGE_BODY}), 'blue bolt') ORDER BY e.type, e.id LIMIT 40"))
def edge_text_scan(spark, d):
    g = sample_graph(spark, d)
    return search.search(search.edge_text(g.edges, g.nodes), "blue bolt", 40).select("id", "type", "place")


@query("term_and_search", on_graph(r"""
, t AS (SELECT id, type, ' ' || trim(regexp_replace(lower(""" + _NODE_BODY + r"""), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS x FROM nodes)
SELECT id, type FROM t WHERE contains(x, ' brand 4 ') AND contains(x, ' bolt ') ORDER BY type, id LIMIT 25"""))  # fmt: skip
def term_search(spark, d):
    return search.search(search.node_text(sample_graph(spark, d).nodes), "brand#4 bolt", 25, "terms").select("id", "type")


_FOUND_FACTS = f"found AS MATERIALIZED (SELECT e.*, row_number() OVER (ORDER BY e.type, e.id) - 1 AS place FROM {_EDGES} WHERE contains(lower({_EDGE_BODY}), 'gear') ORDER BY e.type, e.id LIMIT 80)"
_SCORE = "1.0 / (10 + place) * (0.5 + CASE WHEN type = 'relates_to' THEN 0.15 ELSE 1.0 END) * (0.5 + coalesce(1.0 / (1 + least(da, db)), 0.45))"


def _facts_sql(more: str, edges: str = "found", limit: int = 10) -> str:
    return more + f"""
, near AS (SELECT f.*, x.dist AS da, y.dist AS db FROM {edges} f LEFT JOIN dist x ON x.id = from_id LEFT JOIN dist y ON y.id = to_id)
, top AS (SELECT id, type, round({_SCORE}, 9) AS score FROM near ORDER BY {_SCORE} DESC, place LIMIT {limit}) SELECT * FROM top"""


@query("rank_facts", on_graph(_facts_sql(", " + _FOUND_FACTS + _walk("nodes", "edges", "part:7", 2, ""))))
def rank_facts(spark, d):
    g = sample_graph(spark, d)
    found = search.search_edges(g, "gear", 80)
    return search.rank_facts(found, traversal.distances(g.nodes, g.edges, ["part:7"], 2), 10).select("id", "type", F.round("score", 9).alias("score"))


_FOUND_NODES = f"found AS MATERIALIZED (SELECT nodes.*, row_number() OVER (ORDER BY type, id) - 1 AS place FROM nodes WHERE contains(lower({_NODE_BODY}), 'gear') ORDER BY type, id LIMIT 80)"


@query("rank_nodes", on_graph(", " + _FOUND_NODES + _walk("nodes", "edges", "part:3", 3, " SELECT f.id, d.dist FROM found f LEFT JOIN dist d USING (id) ORDER BY coalesce(d.dist, 99), place LIMIT 10")))
def rank_nodes(spark, d):
    g = sample_graph(spark, d)
    found = search.search(search.node_text(g.nodes), "gear", 80)
    return search.rank_nodes(found, traversal.distances(g.nodes, g.edges, ["part:3"], 3), 10).select("id", "dist")


@query("scoped_search_nodes", on_graph(f"{SCOPED}, {_FOUND_NODES.replace('gear', 'customer#').replace('LIMIT 80', 'LIMIT 160')} SELECT id, type FROM found WHERE id IN (SELECT id FROM sn) AND {live(AT)} ORDER BY place LIMIT 20"))
def scoped_search_nodes(spark, d):
    return search.scoped_search(sample_graph(spark, d), SCOPE, "Customer#", 20, as_of=AT).select("id", "type")


@query("scoped_search_facts", on_graph(_facts_sql(SCOPED + f", {_FOUND_FACTS}, seen AS MATERIALIZED (SELECT * FROM found WHERE id IN (SELECT id FROM se) AND {live(AT)})" + _AS_OF + _walk("sn", "ae", "part:3", 4, "", "an"), "seen")))
def scoped_search_facts(spark, d):
    return search.scoped_search(sample_graph(spark, d), SCOPE, "gear", 10, kind="facts", center="part:3", as_of=AT).select("id", "type", F.round("score", 9).alias("score"))


@query("search_packed", on_graph(_facts_sql(SCOPED + f", {_FOUND_FACTS}, seen AS MATERIALIZED (SELECT * FROM found WHERE id IN (SELECT id FROM se)), dist AS (SELECT NULL AS id, NULL AS dist WHERE false)", "seen").replace("SELECT * FROM top", "") + ", seeds AS (SELECT id FROM top), " + _HOPS.replace("FROM edges", "FROM se").replace("JOIN edges", "JOIN se").replace("ends AS (SELECT id, from_id AS e FROM se UNION SELECT id, to_id FROM se)", "ends AS (SELECT id, from_id AS e FROM se UNION SELECT id, to_id FROM se)") + " SELECT id, score, (SELECT string_agg(hop, ',' ORDER BY rank) FROM ranked WHERE seed = top.id AND rank <= 4) AS hops FROM top"))
def search_packed(spark, d):
    found = search.search_packed(sample_graph(spark, d), SCOPE, "gear", 10)
    return found.select("id", F.round("score", 9).alias("score"), F.array_join(F.transform("hops", lambda h: h["hop"]), ",").alias("hops"))


@query("raw_text_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'token') ORDER BY doc_id LIMIT 3")
def raw_text(spark, d):
    return search.raw_text_search(table(spark, d, "documents"), ["License", "token"], 3, "doc_id").select("doc_id")


# ---------------------------------------------------------------- aggregates


@query("graph_stats_by_type", on_graph("SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type"))
def stats_by_type(spark, d):
    return stats.by_type(sample_graph(spark, d))


@query("graph_stats", on_graph(f"""
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM nodes) + (SELECT count(*) FROM edges) AS sourced, 0::BIGINT AS proposed,
least((SELECT min(vf) FROM nodes), (SELECT min(vf) FROM edges))::VARCHAR AS oldest, greatest((SELECT max(vf) FROM nodes), (SELECT max(vf) FROM edges))::VARCHAR AS newest,
(SELECT count(*) FROM nodes WHERE vt <= DATE '{TODAY}') AS expired, (SELECT count(DISTINCT ns) FROM (SELECT ns FROM nodes UNION ALL SELECT ns FROM edges)) AS namespaces"""))  # fmt: skip
def graph_stats(spark, d):
    return stats.stats(sample_graph(spark, d), TODAY).withColumns({c: F.col(c).cast("string") for c in ("oldest", "newest")})


@query("topic_coverage", on_graph(f"""{SCOPED}, hit AS (SELECT * FROM sn WHERE contains(lower(concat_ws(chr(1), id, type, name, title, brand, summary, segment, status, priority)), 'build'))
SELECT type, count(*) AS n, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM hit ORDER BY id LIMIT 20)) AS ids FROM hit GROUP BY type"""))  # fmt: skip
def topic_coverage(spark, d):
    return stats.topic_coverage(sample_graph(spark, d), SCOPE, "build")


@query("content_quality", on_graph("""
, l AS (SELECT type, lower(CASE WHEN type = 'goal' THEN title ELSE name END) AS label FROM nodes)
SELECT (SELECT round(count(label) / count(*), 4) FROM l) AS node_label_coverage, (SELECT round(count(summary) / count(*), 4) FROM nodes) AS node_summary_coverage, 0.0::DOUBLE AS node_description_coverage,
(SELECT round(count(description) / count(*), 4) FROM edges) AS edge_description_coverage, (SELECT round(count(*) FILTER (type = 'relates_to') / count(*), 4) FROM edges) AS generic_edge_ratio,
(SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM l GROUP BY type, label HAVING count(*) > 1)) AS duplicate_label_count"""))  # fmt: skip
def content_quality(spark, d):
    return stats.content_quality(sample_graph(spark, d), VIEW)


@query("duplicate_labels", on_graph("SELECT type, lower(CASE WHEN type = 'goal' THEN title ELSE name END) AS label, count(*) AS n FROM nodes GROUP BY ALL HAVING count(*) > 1"))
def duplicate_labels(spark, d):
    return stats.duplicate_labels(sample_graph(spark, d), VIEW)


def _thinned(g: Graph) -> Graph:
    """The graph without the nodes of parts whose key ends in 5; edges to them dangle."""
    return Graph(g.nodes.where(~F.col("id").rlike(r"^part:\d*5$")), g.edges)


THINNED = ", tn AS MATERIALIZED (SELECT * FROM nodes WHERE NOT regexp_matches(id, '^part:[0-9]*5$')), te AS MATERIALIZED (SELECT * FROM edges WHERE from_id IN (SELECT id FROM tn) AND to_id IN (SELECT id FROM tn)) "


@query("structure_report", on_graph(THINNED + """, c AS (SELECT (SELECT count(*) FROM tn) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM te) AS whole)
SELECT nodes, edges, round(edges / nodes, 4) AS edges_per_node, round(edges / (nodes * (nodes - 1)), 4) AS density, round((edges - whole) / edges, 4) AS dangling_rate FROM c"""))  # fmt: skip
def structure_report(spark, d):
    return stats.structure_report(_thinned(sample_graph(spark, d)))


@query("coverage_gaps", on_graph(", c AS (SELECT ns, count(*) AS n FROM nodes GROUP BY ns) SELECT ns, n, n < 0.25 * (SELECT avg(n) FROM c) AND n < 3 AS gap FROM c"))
def coverage_gaps(spark, d):
    return stats.coverage_gaps(sample_graph(spark, d))


# ---------------------------------------------------------------- health


@query("orphans", on_graph("SELECT id FROM nodes WHERE id NOT IN (SELECT from_id FROM edges UNION SELECT to_id FROM edges)"))
def orphans(spark, d):
    return health.orphans(sample_graph(spark, d))


@query("dangling_edges", on_graph(THINNED + "SELECT id, concat_ws(',', CASE WHEN from_id NOT IN (SELECT id FROM tn) THEN from_id END, CASE WHEN to_id NOT IN (SELECT id FROM tn) THEN to_id END) AS missing FROM edges WHERE from_id NOT IN (SELECT id FROM tn) OR to_id NOT IN (SELECT id FROM tn)"))
def dangling(spark, d):
    return health.dangling(_thinned(sample_graph(spark, d)))


@query("stale_edges", on_graph(f"SELECT id FROM edges WHERE vt < DATE '{TODAY}'"))
def stale(spark, d):
    return health.stale(sample_graph(spark, d), TODAY)


@query("lint", on_graph(THINNED + f"""
, c AS (SELECT ns, count(*) AS n FROM tn GROUP BY ns)
SELECT 'orphan' AS "check", id FROM tn WHERE id NOT IN (SELECT from_id FROM edges UNION SELECT to_id FROM edges)
UNION ALL SELECT 'missing_endpoint', id FROM edges WHERE id NOT IN (SELECT id FROM te)
UNION ALL SELECT 'stale', id FROM edges WHERE vt < DATE '1995-06-01'
UNION ALL SELECT 'coverage_gap', ns FROM c WHERE n < 0.25 * (SELECT avg(n) FROM c) AND n < 3"""))  # fmt: skip
def lint(spark, d):
    return health.lint(_thinned(sample_graph(spark, d)), "1995-06-01")


def _doubled(g: Graph) -> Graph:
    """The thinned graph with a second copy of each pursues edge."""
    copy = g.edges.where("type = 'pursues'").withColumn("id", F.concat(F.lit("z:"), "id"))
    return _thinned(Graph(g.nodes, g.edges.unionByName(copy)))


@query("self_heal_edges", on_graph(THINNED + "SELECT id FROM te"))
def self_heal_edges(spark, d):
    return health.healed_edges(_doubled(sample_graph(spark, d))).select("id")


@query("self_heal_report", on_graph(THINNED + """
SELECT 'removed' AS action, id FROM edges WHERE id NOT IN (SELECT id FROM te)
UNION ALL SELECT 'deduped', 'z:' || id FROM edges WHERE type = 'pursues'
UNION ALL SELECT 'orphan', id FROM tn WHERE id NOT IN (SELECT from_id FROM te UNION SELECT to_id FROM te)"""))  # fmt: skip
def self_heal_report(spark, d):
    return health.self_heal(_doubled(sample_graph(spark, d)))[1]


@query("contribution_gaps", on_graph("SELECT id, type FROM nodes WHERE ns = 'asia' AND type IN ('person', 'team')"))
def contribution(spark, d):
    return health.contribution(sample_graph(spark, d), "asia", ["person", "team"])


@query("suggest_under_sourced", on_graph("SELECT 'under_sourced' AS kind, id FROM nodes UNION ALL SELECT 'gap', id FROM nodes WHERE vf IS NULL"))
def suggest(spark, d):
    return health.suggestions(sample_graph(spark, d))


_ERRORS = "SELECT event_type AS message, CAST(user_id % 5 AS VARCHAR) AS component, 'E' || (event_id % 3) AS error_type, event_type AS event FROM events"


def _errors(spark, d):
    rows = table(spark, d, "events")
    return rows.select(F.col("event_type").alias("message"), (F.col("user_id") % 5).cast("string").alias("component"), F.concat(F.lit("E"), (F.col("event_id") % 3).cast("string")).alias("error_type"), F.col("event_type").alias("event"))


@query("systemic_errors", f"WITH e AS ({_ERRORS}), c AS (SELECT message, count(*) AS n FROM e GROUP BY 1) SELECT sum(n)::BIGINT AS errors, count(*) AS messages, max(n) AS most, max_by(message, n) AS top, sum(n) >= 3 AND (count(*) = 1 OR max(n) >= 0.8 * sum(n)) AS systemic FROM c")
def systemic_errors(spark, d):
    return health.systemic_errors(_errors(spark, d))


@query("error_signatures", f"WITH e AS ({_ERRORS}) SELECT substr(sha256(concat_ws('|', event, error_type, component)), 1, 16) AS signature, count(*) AS n FROM e GROUP BY 1")
def error_signatures(spark, d):
    return health.error_signatures(_errors(spark, d))
