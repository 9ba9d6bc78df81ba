"""Queries over tools, proposals, journals, transcripts, publication and answers, and the same in SQL. Importing it registers them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import answers, evaluate, health, journal, propose, resolve, search, sessions, stats, tools
from tessera.operators.components import own_dir
from tessera.plans import compile as building
from tessera.plans import data_queries as data
from tessera.plans import publication
from tessera.plans.queries import _AS_OF, _FOUND_FACTS, _FOUND_NODES, _HOPS, AT, SCOPE, SCOPED, SQL, TODAY, VIEW, _facts_sql, _walk, _with_aliases, live, on_graph, query, table
from tessera.plans.stream_queries import _MAIL
from tessera.sources import files, transcripts
from tessera.sources.graph_view import sample_graph
from tessera.streaming import streams

# ---------------------------------------------------------------- tools


_TOOL = (
    SCOPED + _AS_OF + _walk("sn", "ae", "part:3", 4, "", "an") + ", " + _FOUND_NODES.replace("found AS", "fnodes AS").replace("gear", "gear")
    + f", nrank AS (SELECT f.id, row_number() OVER (ORDER BY coalesce(d.dist, 99), place) - 1 AS rank FROM fnodes f LEFT JOIN dist d USING (id) WHERE f.id IN (SELECT id FROM sn) AND {live(AT)})"
    + f", {_FOUND_FACTS}, seen AS MATERIALIZED (SELECT * FROM found WHERE id IN (SELECT id FROM se) AND {live(AT)})"
)


@query("search_tool", on_graph(
    _facts_sql(_TOOL, "seen").replace(" SELECT * FROM top", "") + ", seeds AS (SELECT id FROM top), " + _HOPS.replace("FROM edges", "FROM ae").replace("JOIN edges", "JOIN ae")
    + """, frank AS (SELECT id, row_number() OVER (ORDER BY score DESC) - 1 AS rank FROM top)
SELECT 'node' AS kind, rank, id, NULL AS neighbors FROM nrank WHERE rank < 10
UNION ALL SELECT 'fact', rank, id, coalesce((SELECT string_agg(hop, ',' ORDER BY r.rank) FROM ranked r WHERE seed = frank.id AND r.rank <= 4), '') FROM frank"""))  # fmt: skip
def search_tool(spark, d):
    found = tools.search_tool(sample_graph(spark, d), SCOPE, "gear", 10, center="part:3", as_of=AT, today=TODAY)
    nodes = found.nodes.select(F.lit("node").alias("kind"), "rank", "id", F.lit(None).cast("string").alias("neighbors"))
    return nodes.unionByName(found.facts.select(F.lit("fact").alias("kind"), "rank", "id", F.array_join(F.transform("neighbors", lambda x: x["id"]), ",").alias("neighbors")))


@query("compact_facts", on_graph(SCOPED + "SELECT id, type, from_id AS \"from\", to_id AS \"to\", coalesce(description, '') AS description, vf::VARCHAR AS valid_from, vt::VARCHAR AS valid_to, src FROM se"))
def compact_facts(spark, d):
    from tessera.operators.scope import scoped

    return scoped(sample_graph(spark, d), SCOPE).edges.select(*tools.compact_fact()).withColumn("src", F.array_join("src", ","))


_BUILD = "contains(lower(concat_ws(chr(1), id, type, name, title, brand, summary, segment, status, priority)), 'build')"
_STATUS = f"""
, hit AS (SELECT * FROM sn WHERE {_BUILD}), st AS (
SELECT 'total' AS section, 'nodes' AS item, count(*) AS n FROM sn UNION ALL SELECT 'total', 'edges', count(*) FROM se
UNION ALL SELECT 'provenance', 'curator', count(*) FROM sn UNION ALL SELECT 'provenance', 'agent', 0
UNION ALL SELECT 'freshness', 'oldest', datediff('day', DATE '1970-01-01', min(vf)) FROM sn UNION ALL SELECT 'freshness', 'newest', datediff('day', DATE '1970-01-01', max(vf)) FROM sn
UNION ALL SELECT 'freshness', 'expired', count(*) FROM sn WHERE vt <= DATE '{TODAY}'
UNION ALL SELECT 'node_type', type, count(*) FROM sn GROUP BY type UNION ALL SELECT 'edge_type', type, count(*) FROM se GROUP BY type
UNION ALL SELECT 'namespace', ns, count(*) FROM (SELECT ns FROM sn UNION ALL SELECT ns FROM se) GROUP BY ns
UNION ALL SELECT 'topic', 'build', count(*) FROM hit UNION ALL SELECT 'topic_type', type, count(*) FROM hit GROUP BY type
UNION ALL SELECT 'topic_id', id, row_number() OVER (ORDER BY id) - 1 FROM (SELECT id FROM hit ORDER BY id LIMIT 20))
"""


@query("scoped_stats", on_graph(SCOPED + _STATUS + "SELECT section, item, n::BIGINT AS n FROM st"))
def scoped_stats(spark, d):
    return tools.scoped_stats(sample_graph(spark, d), SCOPE, TODAY, "build")


def _entries(spark, d):
    """Journal entries of the events: a status by type, a confidence by id."""
    return table(spark, d, "events").select(F.col("event_id").cast("string").alias("entry_id"), F.when(F.col("event_type") == "click", "pending").otherwise("accepted").alias("status"))


@query("context_tool", on_graph(SCOPED + _STATUS + "SELECT section, item, n::BIGINT AS n FROM st UNION ALL SELECT 'journal', 'pending', count(*) FROM events WHERE event_type = 'click' UNION ALL SELECT 'compile', 'merged_count', 3 UNION ALL SELECT 'compile', 'quarantined_count', 2 UNION ALL SELECT 'scope', ns, 1 FROM (VALUES ('europe'), ('middle east'), ('public')) AS v(ns)"))
def context_tool(spark, d):
    g = sample_graph(spark, d)
    counters = spark.range(1).select(F.lit(3).alias("merged_count"), F.lit(2).alias("quarantined_count"))
    found = tools.context(g, SCOPE, VIEW, TODAY, topic="build", entries=_entries(spark, d), manifest=counters)
    return found["status"].unionByName(found["namespaces"].select(F.lit("scope").alias("section"), F.col("ns").alias("item"), F.lit(1).cast("long").alias("n")))


@query("lookup_many", on_graph("SELECT 'old-' || id AS asked, id, type FROM nodes WHERE regexp_matches(id, '^part:[0-9]*00$') UNION ALL SELECT id, id, type FROM nodes WHERE type = 'team'"))
def lookup_many(spark, d):
    g = _with_aliases(sample_graph(spark, d))
    asked = g.aliases().select(F.col("alias").alias("asked")).union(g.nodes.where("type = 'team'").select("id")).union(spark.createDataFrame([("nobody",)], "asked string"))
    return tools.resolved_rows(g, asked).select("asked", "id", "type")


@query("status", on_graph(f"""
, c AS (SELECT ns, count(*) AS n FROM nodes GROUP BY ns)
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM c) AS namespaces,
(SELECT count(*) FROM nodes ANTI JOIN (SELECT from_id AS id FROM edges UNION SELECT to_id FROM edges) USING (id)) + (SELECT count(*) FROM edges WHERE vt < DATE '{TODAY}') + (SELECT count(*) FROM c WHERE n < 0.25 * (SELECT avg(n) FROM c) AND n < 3) AS lint_issues,
(SELECT count(*) FROM events WHERE event_type = 'click') AS pending"""))  # fmt: skip
def status(spark, d):
    return health.status(sample_graph(spark, d), _entries(spark, d), TODAY)


@query("quality_warnings", on_graph("SELECT true AS needs_attention, true AS schema_outdated"))
def quality_warnings(spark, d):
    from tessera.operators import pages

    g = sample_graph(spark, d)
    found = publication.schema_warning(publication.manifest(g, VIEW).withColumn("schema_version", F.lit(VIEW.version - 1)), VIEW)
    return pages.quality_warning(stats.content_quality(g, VIEW)).select("needs_attention").crossJoin(F.broadcast(found.select("schema_outdated")))


@query("quality_bars", """
WITH q AS (SELECT l_orderkey AS id, avg((l_quantity > 2)::INT) AS summaries, avg((l_tax > 0)::INT) AS told, avg((l_linenumber <= 2)::INT) AS generic, count(*) - count(DISTINCT l_suppkey) AS surplus FROM lineitem GROUP BY 1)
SELECT id, summaries < 1 OR told < 1 OR generic > 0.5 OR surplus > 0 AS warn FROM q""")  # fmt: skip
def quality_bars(spark, d):
    """Warnings for the qualities of every order's lines, on both sides of each bar; labels and node descriptions don't count."""
    share = lambda c: F.avg(c.cast("int"))
    q = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        share(F.col("l_quantity") > 2).alias("node_summary_coverage"), share(F.col("l_tax") > 0).alias("edge_description_coverage"), share(F.col("l_linenumber") <= 2).alias("generic_edge_ratio"),
        (F.count("*") - F.count_distinct("l_suppkey")).alias("duplicate_label_count"), F.lit(0.0).alias("node_label_coverage"), F.lit(0.0).alias("node_description_coverage"),
    )
    return stats.quality_warnings(q).select("id", "warn")


@query("manifest_summary", on_graph("""
SELECT 'loaded' AS status, 'unknown' AS compiled_at, 'run' AS run_id, 12 AS hash_length, 7::BIGINT AS chunk_count, (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count,
1::BIGINT AS error_count, 2::BIGINT AS quarantined_count, 0::BIGINT AS flagged_count, 3::BIGINT AS merged_count"""))  # fmt: skip
def manifest_summary(spark, d):
    found = publication.manifest_summary(publication.manifest(sample_graph(spark, d), VIEW, run_id="run", chunks=7, errors=1, quarantined=2, merged=3))
    return found.withColumn("facts_hash_prefix", F.length("facts_hash_prefix")).withColumnRenamed("facts_hash_prefix", "hash_length")


# ---------------------------------------------------------------- publication and compilation


@query("published_graph", on_graph("SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type"))
def published_graph(spark, d):
    """Published twice, and read through the pointer by a reader that has seen the first version."""
    g, root = sample_graph(spark, d), f"{own_dir(spark)}/published-{uuid.uuid4().hex}"
    found = lambda written: publication.manifest(written, VIEW, turns=4)
    publication.publish_graph(g.with_edges(g.edges.limit(0)), root, "1", found)
    reader = publication.Published(spark, root)
    reader.graph()
    publication.publish_graph(g, root, "2", found)
    return stats.by_type(reader.graph())


@query("compile_in_steps", _MAIL + "SELECT 'person:' || u AS id, 'person' AS type, u AS name FROM p UNION SELECT 'team:' || h, 'team', h FROM p")
def compile_in_steps(spark, d):
    """Three groups of texts, published after each: the last version is what one pass gives."""
    root = f"{own_dir(spark)}/compiled-{uuid.uuid4().hex}"
    list(publication.compile_in_steps(data._docs(spark, d), building.email_rules, root, steps=3))
    return publication.Published(spark, root).graph().nodes.select("id", "type", F.try_element_at("props", F.lit("name")).alias("name"))


_PROPS = "'{{' || concat_ws(',', {}) || '}}'"
_pairs = lambda names: ", ".join(f"""'"{n}":"' || {n} || '"'""" for n in names)
_DATE = lambda c: f"""coalesce('"' || {c} || '"', 'null')"""
_TAIL = """',"provenance":null,"src":["' || src || '"],"""


@query("fact_lines", on_graph(f"""
SELECT 'node' AS kind, type, id, '{{"id":"' || id || '","kind":"node","ns":["' || ns || '"],"props":' || {_PROPS.format(_pairs(("brand", "name", "priority", "segment", "status", "summary", "title")))} || {_TAIL}"type":"' || type || '","valid_from":' || {_DATE("vf")} || ',"valid_to":' || {_DATE("vt")} || '}}' AS line FROM nodes
UNION ALL SELECT 'edge', type, id, '{{"from":"' || from_id || '","id":"' || id || '","kind":"edge","ns":["' || ns || '"],"props":' || {_PROPS.format(_pairs(("description", "lines", "note", "reason")))} || {_TAIL}"to":"' || to_id || '","type":"' || type || '","valid_from":' || {_DATE("vf")} || ',"valid_to":' || {_DATE("vt")} || '}}' FROM edges"""))  # fmt: skip
def fact_lines(spark, d):
    return files.fact_lines(sample_graph(spark, d)).select("kind", "type", "id", "line")


# ---------------------------------------------------------------- text, names, logs


@query("prose", r"SELECT doc_id, sha256(array_to_string(list_filter(list_transform(regexp_split_to_array(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n[ \t]*\n+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10))) AS sha FROM documents")
def prose(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(fn.prose(F.col("text")), 256).alias("sha"))


@query("safe_keys", r"WITH k AS (SELECT doc_id, regexp_replace(regexp_replace(substr(text, 1, 40), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS k FROM documents) SELECT doc_id, CASE WHEN k = '' THEN 'session' ELSE k END AS key FROM k")
def safe_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.safe_key(F.substring("text", 1, 40)).alias("key"))


@query("question_keywords", r"""
WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, '?.!', ''), '\s+'), lambda w: w <> '') AS ws FROM benchmark),
k AS (SELECT item_id, list_filter(ws, lambda w: regexp_matches(w, '^\p{Lu}') AND NOT list_contains(string_split('""" + " ".join(search.NO_NAMES) + r"""', ' '), w)) AS names,
  list_transform(list_filter(ws, lambda w: NOT regexp_matches(w, '^\p{Lu}') AND length(w) > 2 AND NOT list_contains(string_split('""" + " ".join(search.NO_CONTENT) + r"""', ' '), lower(w))), lambda w: lower(w)) AS rest FROM t)
SELECT item_id, array_to_string((names || rest[1:3])[1:8], ' ') AS keywords FROM k""")  # fmt: skip
def question_keywords(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(search.keywords(F.col("text")), " ").alias("keywords"))


@query("name_aliases", "WITH p AS (SELECT 'part:' || p_partkey AS id, lower(p_name) AS k FROM part) SELECT id AS alias, canonical FROM (SELECT id, min(id) OVER (PARTITION BY k) AS canonical FROM p) WHERE id <> canonical")
def name_aliases(spark, d):
    g = sample_graph(spark, d)
    names = table(spark, d, "part").select(F.upper("p_name").alias("canonical_name"), F.array("p_name").alias("variants")).distinct()
    return resolve.name_aliases(g.nodes.where("type = 'project'"), names)


@query("carried_aliases", SQL["aliases"].replace("AS alias, id FROM", "AS alias, id AS canonical FROM"))
def carried_aliases(spark, d):
    return health.carried_aliases(_with_aliases(sample_graph(spark, d)).nodes)


@query("merged_texts", """
WITH r AS (SELECT p_brand AS brand, p_type AS s, p_name AS n, p_partkey AS o FROM part),
w AS (SELECT brand, s, n, o, CASE WHEN o % 3 = 0 THEN '- ' || n || ' of ' || s || chr(10) || chr(10) || 'all' ELSE n END AS t FROM r),
s AS (SELECT brand, arg_max(s, (len(list_distinct(string_split(lower(s), ' '))), length(s), lower(s))) AS summary FROM r GROUP BY brand),
p AS MATERIALIZED (SELECT brand, x, min((o, i)) AS place FROM (SELECT brand, o, unnest(string_split(t, chr(10) || chr(10))) AS x, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS i FROM w) GROUP BY ALL),
held AS MATERIALIZED (SELECT a.brand, a.x, a.place, b.x AS whole, b.place AS wat FROM p a JOIN p b ON a.brand = b.brand AND a.x <> b.x AND contains(lower(b.x), lower(a.x))),
stay AS (SELECT * FROM p ANTI JOIN held USING (brand, x)),
won AS (SELECT brand, whole AS x, min(place) AS first FROM (SELECT brand, x, place, arg_min(whole, wat) AS whole FROM held h WHERE EXISTS (FROM stay WHERE stay.brand = h.brand AND stay.x = whole) GROUP BY ALL) GROUP BY ALL),
n AS (SELECT brand, string_agg(x, chr(10) || chr(10) ORDER BY least(place, coalesce(first, place)), place) AS description FROM stay LEFT JOIN won USING (brand, x) GROUP BY brand)
SELECT brand, summary, description, last FROM s JOIN n USING (brand) JOIN (SELECT brand, arg_max(n, o) AS last FROM r GROUP BY brand) USING (brand)""")  # fmt: skip
def merged_texts(spark, d):
    """Of a brand's parts: the richest summary, the paragraphs of all descriptions, some of which hold others, and the last name."""
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("- "), "p_name", F.lit(" of "), "p_type", F.lit("\n\nall"))).otherwise(F.col("p_name"))
    rows = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("o"), F.create_map(F.lit("summary"), "p_type", F.lit("description"), text, F.lit("last"), "p_name").alias("props"))
    return resolve.merged_props(rows, ["brand"], "o").select("brand", *[F.col("props")[k].alias(k) for k in ("summary", "description", "last")])


@query("log_tail", "SELECT event_id, 'user ' || user_id || ' password=[REDACTED]' AS text FROM events WHERE event_type IN ('error', 'view') ORDER BY event_id DESC LIMIT 50")
def log_tail(spark, d):
    lines = table(spark, d, "events").select("event_id", F.col("event_id").alias("pos"), F.col("event_type").alias("level"), F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" password=p"), F.col("event_id").cast("string")).alias("text"))
    return health.log_tail(lines, 50, ("error", "view")).select("event_id", "text")


@query("conflict_classes", "SELECT doc_id, CASE WHEN source IN ('graph', 'wiki', 'cache') OR doc_id % 3 = 0 THEN 'snapshot' ELSE 'durable' END AS class FROM documents")
def conflict_classes(spark, d):
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("graph/")).otherwise(F.concat("source", F.lit("/"))), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", propose.conflict_class(path).alias("class"))


@query("changed_files", "SELECT source || '/' || doc_id || '.md' AS path FROM documents WHERE lang <> 'en' OR contains(text, 'license')")
def changed_files(spark, d):
    """The manifest lacks texts that aren't English, and has another hash for those that name a license."""
    docs = data._docs(spark, d).withColumn("hash", F.sha2("text", 256))
    held = table(spark, d, "documents").where("lang = 'en'").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.when(F.contains("text", F.lit("license")), "old").otherwise(F.sha2("text", 256)).alias("hash"))
    return files.changed_files(docs, held).select("path")


@query("source_texts", on_graph("SELECT DISTINCT string_split(src, ':')[1] AS path FROM edges WHERE from_id IN ('cust:42', 'supp:7', 'nation:3', 'part:10') OR to_id = 'part:10' ORDER BY path LIMIT 5"))
def source_texts(spark, d):
    edges = sample_graph(spark, d).edges.where("from_id in ('cust:42', 'supp:7', 'nation:3', 'part:10') or to_id = 'part:10'")
    docs = spark.createDataFrame([(f"{t}.md", t) for t in ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")], "path string, text string")
    return search.source_texts(edges, docs).select("path")


# ---------------------------------------------------------------- proposals and journals


def _proposals(spark, d):
    n4 = F.col("event_id") % 4
    text = lambda c: F.col(c).cast("string")
    return table(spark, d, "events").select(
        "event_id", F.when(n4 == 0, "create").when(n4 == 1, "link").when(n4 == 2, "update").otherwise("merge").alias("operation"), F.lit("x").alias("kind"),
        F.when(n4.isin(0, 2), F.concat(F.lit("old-part:"), (F.col("user_id") % 9 * 100).cast("string"))).alias("id"), F.when(n4 == 1, "depends_on").otherwise("project").alias("type"),
        F.when(n4.isin(1, 3), F.concat(F.lit("part:"), text("user_id"))).alias("from_id"), F.when(n4.isin(1, 3), F.concat(F.lit("old-part:"), (F.col("event_id") % 7 * 100).cast("string"))).alias("to_id"),
        F.create_map(F.lit("n"), text("event_id")).alias("props"), (F.col("event_id") % 30 / 20.0 - 0.2).alias("confidence"),
    )


_P = """
WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'link' WHEN 2 THEN 'update' ELSE 'merge' END AS op, CASE WHEN event_id % 4 IN (0, 2) THEN 'old-part:' || (user_id % 9 * 100) END AS id,
  CASE WHEN event_id % 4 = 1 THEN 'depends_on' ELSE 'project' END AS type, CASE WHEN event_id % 4 IN (1, 3) THEN 'part:' || user_id END AS from_id, CASE WHEN event_id % 4 IN (1, 3) THEN 'old-part:' || (event_id % 7 * 100) END AS to_id,
  (event_id % 30) / 20.0 - 0.2 AS confidence FROM events)
"""


@query("canonical_proposals", _P + ", k AS (SELECT 'part:' || p_partkey AS id FROM part WHERE p_partkey % 100 = 0 AND p_partkey > 9) SELECT event_id, coalesce(a.id, p.id) AS id, from_id, coalesce(b.id, to_id) AS to_id FROM p LEFT JOIN k a ON 'old-' || a.id = p.id LEFT JOIN k b ON 'old-' || b.id = to_id")
def canonical_proposals(spark, d):
    return propose.canonical_proposals(_proposals(spark, d), _with_aliases(sample_graph(spark, d))).select("event_id", "id", "from_id", "to_id")


@query("journal_entries", _P + """
SELECT substr(sha256(concat_ws('|', 'agent', 't1', op, coalesce(id, ''), coalesce(type, ''), coalesce(from_id, ''), coalesce(to_id, ''))), 1, 32) AS entry_id, 'team' AS ns, CASE WHEN op = 'merge' THEN 1.0 ELSE round(least(1.0, greatest(0.0, confidence)), 9) END AS confidence,
CASE WHEN op IN ('create', 'update') THEN 'node' ELSE 'edge' END AS kind, CASE WHEN op IN ('create', 'update') THEN id ELSE '' END AS id, CASE WHEN op = 'merge' THEN 'same_as' ELSE type END AS type, from_id, to_id, event_id::VARCHAR AS n FROM p""")  # fmt: skip
def journal_entries(spark, d):
    made = propose.entries(_proposals(spark, d), agent="agent", ns="team", proposed_at="t1")
    return made.select("entry_id", "ns", F.round("confidence", 9).alias("confidence"), "kind", "id", "type", "from_id", "to_id", F.col("props")["n"].alias("n"))


@query("review_errors", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'no facts' WHEN event_type = 'click' AND event_id % 4 <> 2 THEN 'a contradiction is between two facts' END AS error FROM events")
def review_errors(spark, d):
    kind = F.when(F.col("event_type") == "click", "contradiction").otherwise("note")
    facts = F.slice(F.array(*[F.lit(f"f{i}") for i in range(3)]), 1, (F.col("event_id") % 4).cast("int"))
    return table(spark, d, "events").select("event_id", propose.review_error(kind, facts).alias("error"))


@query("parsed_journal", """
SELECT event_id::VARCHAR AS entry_id, CASE WHEN event_type = 'click' THEN 'node' ELSE 'edge' END AS kind, 'f' || event_id AS id, CASE WHEN event_type <> 'click' THEN 'a' END AS from_id, round(event_id % 100 / 100.0, 9) AS confidence, true AS good FROM events WHERE event_type <> 'error'
UNION ALL SELECT NULL, NULL, NULL, NULL, count(*), false FROM events WHERE event_type = 'error'""")  # fmt: skip
def parsed_journal(spark, d):
    """Errors are lines that are no entry; they are counted."""
    n = F.col("event_id").cast("string")
    fact = F.when(F.col("event_type") == "click", F.concat(F.lit('{"kind":"node","id":"f'), n, F.lit('","type":"t"}'))).otherwise(F.concat(F.lit('{"kind":"edge","id":"f'), n, F.lit('","type":"t","from":"a","to":"b"}')))
    line = F.concat(F.lit('{"entry_id":"'), n, F.lit('","confidence":'), (F.col("event_id") % 100 / 100.0).cast("string"), F.lit(',"fact":'), fact, F.lit("}"))
    lines = table(spark, d, "events").select(F.when(F.col("event_type") == "error", F.concat(F.lit('{"entry_id": '), n)).otherwise(line).alias("value"))
    good = files.parsed_journal(lines).select("entry_id", "kind", "id", "from_id", F.round("confidence", 9).alias("confidence"), F.lit(True).alias("good"))
    bad = files.bad_journal_lines(lines).agg(F.count("*").cast("double").alias("confidence"))
    null = F.lit(None).cast("string")
    return good.unionByName(bad.select(null.alias("entry_id"), null.alias("kind"), null.alias("id"), null.alias("from_id"), "confidence", F.lit(False).alias("good")))


# ---------------------------------------------------------------- events and streams


@query("event_keys", r"""
WITH e AS (SELECT event_id, repeat('s' || user_id || '-', (event_id % 40)::INTEGER) AS s, '{"n":' || event_id || '}' AS p FROM events)
SELECT event_id, 'agent/' || CASE WHEN s = '' THEN substr(sha256(p), 1, 12) WHEN length(s) > 80 THEN substr(s, 1, 80) || '-' || substr(sha256(s), 1, 12) ELSE s END AS key FROM e""")  # fmt: skip
def event_keys(spark, d):
    n = F.col("event_id").cast("string")
    session = F.expr("repeat(concat('s', user_id, '-'), cast(event_id % 40 as int))")
    return table(spark, d, "events").select("event_id", streams.event_key(F.lit("agent"), session, F.concat(F.lit('{"n":'), n, F.lit("}"))).alias("key"))


@query("payloads", "SELECT event_id, event_id % 3 <> 2 AND event_id % 5 <> 0 AS accepted, CASE WHEN event_id % 3 <> 2 THEN 'u' || user_id END AS session FROM events")
def payloads(spark, d):
    """The session is at the top or under properties; lists and objects that are too large are no payloads."""
    inner = F.concat(F.lit('{"session_id":"u'), F.col("user_id").cast("string"), F.lit('"'))
    pad = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(',"pad":"'), F.expr(f"repeat('x', {streams.MOST_BYTES})"), F.lit('"'))).otherwise("")
    body = F.when(F.col("event_id") % 3 == 0, F.concat(inner, pad, F.lit("}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"properties":'), inner, pad, F.lit("}}"))).otherwise(F.lit("[1]"))
    e = table(spark, d, "events").select("event_id", body.alias("p"))
    return e.select("event_id", F.coalesce(streams.accepted_payload(F.col("p")), F.lit(False)).alias("accepted"), streams.payload_value(F.col("p"), "sessionId", "session_id").alias("session"))


@query("drained_sessions", """
WITH e AS (SELECT 'u' || user_id AS key, epoch_us(ts) AS us, event_type = 'error' AS ends, event_id FROM events),
l AS (SELECT *, lag(us) OVER w AS b, lag(ends) OVER w AS bends FROM e WINDOW w AS (PARTITION BY key ORDER BY us, event_id)),
s AS (SELECT *, sum(CASE WHEN b IS NULL OR bends OR us - b >= 300000000 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY us, event_id) AS s FROM l),
g AS (SELECT key, s, count(*) AS n, max(us) AS last, bool_or(ends) AS ends, max(s) OVER (PARTITION BY key) AS final FROM s GROUP BY key, s)
SELECT key, CASE WHEN ends THEN 'exact' ELSE 'idle' END AS closed_by, n, last FROM g WHERE ends OR s < final OR last + 300000000 < (SELECT max(us) FROM e)""")  # fmt: skip
def drained_sessions(spark, d):
    """The stream's last sessions stay open until event time has gone past them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = streams.table_stream(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "error", "session_end").otherwise(F.col("event_type")).alias("trigger"))
    out = f"{own_dir(spark)}/drained-{uuid.uuid4().hex}"
    streams.run_available(streams.drained(e), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.parquet(out).select("key", "closed_by", "n", F.unix_micros("last_at").alias("last"))


# ---------------------------------------------------------------- transcripts


@query("transcript_composer", SQL["turn_pairing"])
def transcript_composer(spark, d):
    """Each conversation as one JSON document of a key-value table; an empty one and a foreign key are left out."""
    bubble = F.struct(F.col("turn").cast("string").alias("k"), F.struct("role", "text", F.col("turn").cast("long").alias("createdAt")).alias("v"))
    doc = table(spark, d, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(bubble)).alias("conversationMap"))
    value = F.to_json(F.struct(F.col("conv_id").alias("composerId"), F.lit(1).alias("createdAt"), "conversationMap"))
    rows = doc.select(F.concat(F.lit("composerData:"), F.col("conv_id").cast("string")).alias("key"), value.alias("value"))
    rows = rows.unionByName(spark.createDataFrame([("composerData:x", '{"composerId":"x","conversationMap":{}}'), ("other:y", '{"text":"z"}'), ("composerData:z", "[1")], "key string, value string"))
    found = sessions.turns(transcripts.bubbles(transcripts.composers(rows)), "session", "pos")
    return found.select(F.col("session").cast("long").alias("session"), "turn_no", F.sha2("user_content", 256).alias("user_sha"), F.sha2("assistant_text", 256).alias("assistant_sha"))


@query("transcript_relational", SQL["turn_pairing"])
def transcript_relational(spark, d):
    """Messages and their parts as two tables."""
    c = table(spark, d, "conversations")
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    messages = c.select(key.alias("id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("time_created"), F.to_json(F.struct("role")).alias("data"))
    parts = c.select(F.concat(key, F.lit("p")).alias("id"), key.alias("message_id"), F.col("turn").alias("time_created"), F.to_json(F.struct(F.lit("text").alias("type"), "text")).alias("data"))
    found = sessions.turns(transcripts.relational(messages, parts).where("role in ('user', 'assistant')"), "session", "pos")
    return found.select("session", "turn_no", F.sha2("user_content", 256).alias("user_sha"), F.sha2("assistant_text", 256).alias("assistant_sha"))


@query("conversation_changes", "SELECT conv_id::VARCHAR AS session FROM conversations GROUP BY conv_id HAVING sum(length(text)) % 2 = 0")
def conversation_changes(spark, d):
    """The manifest has the hashes of half of the conversations; their keys stand in another order there."""
    from tessera.operators.imports import changed_conversations

    bubble = F.struct(F.col("turn").cast("string").alias("k"), F.struct("role", "text").alias("v"))
    doc = table(spark, d, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(bubble))).alias("conversationMap"), (F.sum(F.length("text")) % 2 == 1).alias("held"))
    one, other = F.to_json(F.struct(F.col("conv_id").alias("composerId"), "conversationMap")), F.to_json(F.struct("conversationMap", F.col("conv_id").alias("composerId")))
    manifest = doc.where("held").select(F.col("conv_id").cast("string").alias("session"), transcripts.conversation_hash(other).alias("digest"))
    rows = doc.select(F.concat(F.lit("composerData:"), F.col("conv_id").cast("string")).alias("key"), one.alias("value"))
    return changed_conversations(rows, manifest).select("session")


_FILES = "WITH f AS (SELECT conv_id AS path, sum(length(text)) % 97 AS mtime FROM conversations GROUP BY conv_id)"


@query("session_by_first_record", _FILES + " SELECT arg_max(path, (mtime, path)) AS path FROM f WHERE path % 3 = 1")
def session_by_first_record(spark, d):
    files_ = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("path")).agg((F.sum(F.length("text")) % 97).alias("mtime"))
    head = table(spark, d, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("pos"), F.when(F.col("turn") == 0, F.concat(F.lit('{"type":"session_meta","payload":{"cwd":"/w'), (F.col("conv_id") % 3).cast("string"), F.lit('"}}'))).otherwise('{"cwd":"/w1"}').alias("value"))
    return transcripts.session_of(files_, transcripts.first_record_cwd(head), "/w1", fallback=False)


@query("session_by_early_lines", _FILES + " SELECT coalesce((SELECT arg_max(path, (mtime, path)) FROM f WHERE path % 5 = 2), (SELECT arg_max(path, (mtime, path)) FROM f)) AS path")
def session_by_early_lines(spark, d):
    files_ = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("path")).agg((F.sum(F.length("text")) % 97).alias("mtime"))
    # line 70 of each file names the directory too, but that is too late
    line = files_.select("path", F.explode(F.array(F.lit(3), F.lit(70))).alias("pos"))
    lines = line.select("path", "pos", F.when(F.col("pos") == 3, F.concat(F.lit('{"data":{"cwd":"/w'), (F.col("path") % 5).cast("string"), F.lit('"}}'))).otherwise('{"cwd":"/w2"}').alias("value"))
    return transcripts.session_of(files_, transcripts.early_cwd(lines), "/w2")


def _listing(spark, d, kinds: tuple[str, ...]):
    """Files of each conversation, in folders of three projects; the kinds differ in time."""
    each = table(spark, d, "conversations").groupBy("conv_id").agg((F.sum(F.length("text")) % 97).alias("mtime"))
    named = each.select("conv_id", "mtime", F.posexplode(F.array(*map(F.lit, kinds))).alias("k", "kind"))
    folder = F.concat(F.lit("/home/p/-w-my-app"), (F.col("conv_id") % 3).cast("string"), F.lit("/"))
    # the first kind lies in the project's folder, the others in its session folders; every fifth session has no file of the last kind
    listed = named.where(f"k < {len(kinds) - 1} OR conv_id % 5 > 0")
    return listed.select("conv_id", "k", F.concat(folder, F.when(F.col("k") == 0, F.lit("s")).otherwise(F.lit("d/s")), F.col("conv_id").cast("string"), "kind").alias("path"), (F.col("mtime") + F.col("k") * (F.col("conv_id") % 7)).alias("mtime"))


@query("session_by_project", "WITH f AS (SELECT conv_id, sum(length(text)) % 97 AS mtime FROM conversations GROUP BY conv_id), n AS (SELECT '/home/p/-w-my-app1/s' || conv_id || '.jsonl' AS path, mtime FROM f WHERE conv_id % 3 = 1) SELECT arg_max(path, (mtime, path)) AS path FROM n")
def session_by_project(spark, d):
    found = transcripts.project_transcripts(_listing(spark, d, (".jsonl", ".jsonl")), "/home/p", transcripts.project_slug("/w/my_app1"))
    return transcripts.newest(found)


@query("session_by_summary_time", """WITH f AS (SELECT conv_id, sum(length(text)) % 97 AS m FROM conversations GROUP BY conv_id),
n AS (SELECT '/home/p/%2Fw' || conv_id % 2 || '/s' || conv_id AS path, CASE WHEN conv_id % 5 > 0 THEN m + conv_id % 7 ELSE m END AS mtime FROM f WHERE conv_id % 2 = 1 AND conv_id % 4 > 1)
SELECT arg_max(path, (mtime, path)) AS path FROM n""")  # fmt: skip
def session_by_summary_time(spark, d):
    each = table(spark, d, "conversations").groupBy("conv_id").agg((F.sum(F.length("text")) % 97).alias("m"))
    folder = F.concat(F.lit("/home/p/"), F.concat(F.lit(transcripts.url_name("/w")), (F.col("conv_id") % 2).cast("string")), F.lit("/s"), F.col("conv_id").cast("string"), F.lit("/"))
    file = lambda name, mtime: each.select("conv_id", F.concat(folder, F.lit(name)).alias("path"), mtime.alias("mtime"))
    # some have a history alone, some a summary alone, which is no session
    files_ = file(transcripts.CHAT, F.col("m")).where("conv_id % 4 > 1").unionByName(file(transcripts.SUMMARY, F.col("m") + F.col("conv_id") % 7).where("conv_id % 5 > 0"))
    return transcripts.newest(transcripts.session_folders(files_, "/home/p", transcripts.url_name("/w") + "1"))


@query("session_without_sidecars", "WITH f AS (SELECT conv_id, sum(length(text)) % 97 AS mtime FROM conversations GROUP BY conv_id) SELECT arg_max('/home/p/-w-my-app' || conv_id % 3 || '/s' || conv_id || '.jsonl', (mtime, '/home/p/-w-my-app' || conv_id % 3 || '/s' || conv_id || '.jsonl')) AS path FROM f")
def session_without_sidecars(spark, d):
    """The files beside transcripts are newer."""
    return transcripts.newest(transcripts.main_transcripts(_listing(spark, d, (".jsonl", *transcripts.SIDECARS))))


@query("rendered_batches", data.TURNS + r"""
SELECT session, 0 AS batch, sha256(rtrim('---' || chr(10) || 'source: n' || chr(10) || 'session: ' || session || chr(10) || 'batch: 000' || chr(10) || 'turns: ' || count(*) || chr(10) || '---' || chr(10) || chr(10) ||
string_agg('## Turn ' || turn_no || chr(10) || chr(10) || CASE WHEN user_content <> '' THEN '**User:** ' || user_content || chr(10) || chr(10) ELSE '' END || CASE WHEN assistant_text <> '' THEN '**Assistant:** ' || assistant_text || chr(10) || chr(10) ELSE '' END, '' ORDER BY turn_no), chr(10) || ' ') || chr(10)) AS sha FROM t GROUP BY session""")  # fmt: skip
def rendered_batches(spark, d):
    found = sessions.turns(table(spark, d, "conversations"))
    return sessions.rendered(found, sessions.batches(found, 10**9, 0), "n").select("session", "batch", F.sha2("body", 256).alias("sha"))


@query("session_documents", """
SELECT 'c' || conv_id || '/session_01.md' AS path, sha256('# Session 1 — d' || conv_id || chr(10) || chr(10) || string_agg('**' || role || ':** ' || text, chr(10) || chr(10) ORDER BY turn) || chr(10)) AS sha FROM conversations GROUP BY conv_id""")
def session_documents(spark, d):
    turn = F.struct("turn", F.col("role").alias("speaker"), "text")
    samples = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    samples = samples.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("sample_id"), F.lit(1).alias("session_no"), F.concat(F.lit("d"), F.col("conv_id").cast("string")).alias("date"), "turns")
    return answers.session_documents(samples).select("path", F.sha2("text", 256).alias("sha"))


@query("qa_questions", "SELECT item_id::VARCHAR AS sample_id, no, text || no AS question, no + 4 AS category, CASE WHEN no = 1 THEN 'bad' ELSE 'good' END AS gold FROM benchmark, (VALUES (0), (1)) AS v(no)")
def qa_questions(spark, d):
    one = lambda no: F.struct(F.concat("text", F.lit(str(no))).alias("question"), F.lit("good").alias("answer"), F.lit("bad").alias("adversarial_answer"), F.lit(4 + no).alias("category"))
    return transcripts.qa_questions(table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("sample_id"), F.array(one(0), one(1)).alias("qa")))


# ---------------------------------------------------------------- evaluation


@query("edge_types_at", on_graph("""
, q AS (SELECT n_nationkey AS question, DATE '1992-01-01' + (n_nationkey * 100)::INTEGER AS t, CASE WHEN n_nationkey % 2 = 0 THEN ['pursues', 'member_of'] END AS present, CASE WHEN n_nationkey % 3 = 0 THEN ['depends_on'] ELSE ['unknown'] END AS absent FROM nation),
h AS (SELECT question, list(DISTINCT type) AS types FROM q LEFT JOIN edges ON (vf IS NULL OR vf <= t) AND (vt IS NULL OR t < vt) GROUP BY question)
SELECT question, (present IS NULL OR list_has_all(types, present)) AND NOT list_has_any(types, absent) AS passed FROM q JOIN h USING (question)"""))  # fmt: skip
def edge_types_at(spark, d):
    n = F.col("n_nationkey").cast("int")
    q = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("question"), F.date_add(F.lit("1992-01-01").cast("date"), n * 100).alias("time"),
        F.when(n % 2 == 0, F.array(F.lit("pursues"), F.lit("member_of"))).alias("present"), F.when(n % 3 == 0, F.array(F.lit("depends_on"))).otherwise(F.array(F.lit("unknown"))).alias("absent"),
    )
    return evaluate.edge_types_at(q, sample_graph(spark, d).edges).select("question", "passed")


_ND = "concat_ws(' ', id, type, coalesce(name, ''), concat_ws(' ', brand, priority, segment, status, summary, title), vf::VARCHAR, vt::VARCHAR)"


@query("qa_evidence", on_graph(f"""
, w AS (SELECT n_name AS question, lower(n_name) AS kw, n_nationkey % 2 + 1 AS depth FROM nation),
nt AS (SELECT id, type, concat_ws(' ', id, type, coalesce(name, ''), concat_ws(' ', brand, priority, segment, status, summary, title)) AS body FROM nodes),
et AS (SELECT e.id, e.type, e.from_id, e.to_id, concat_ws(' ', e.id, e.type, e.from_id, e.to_id, coalesce(a.name, a.title, ''), coalesce(b.name, b.title, ''), concat_ws(' ', e.description, e.lines, e.note, e.reason)) AS body FROM edges e LEFT JOIN nodes a ON a.id = from_id LEFT JOIN nodes b ON b.id = to_id),
hn AS (SELECT question, id FROM (SELECT question, nt.id, row_number() OVER (PARTITION BY question ORDER BY type, nt.id) AS no FROM w JOIN nt ON contains(lower(body), kw)) WHERE no <= 5),
hf AS MATERIALIZED (SELECT question, id, from_id, to_id FROM (SELECT question, et.*, row_number() OVER (PARTITION BY question ORDER BY type, et.id) AS no FROM w JOIN et ON contains(lower(body), kw)) WHERE no <= 5),
r0 AS MATERIALIZED (SELECT question, id FROM hn UNION SELECT question, from_id FROM hf UNION SELECT question, to_id FROM hf),
bi AS MATERIALIZED (SELECT id AS e, from_id AS a, to_id AS b FROM edges UNION ALL SELECT id, to_id, from_id FROM edges),
s1 AS MATERIALIZED (SELECT question, e, b FROM r0 JOIN bi ON id = a), r1 AS MATERIALIZED (SELECT * FROM r0 UNION SELECT question, b FROM s1),
s2 AS MATERIALIZED (SELECT n.question, e, b FROM (SELECT * FROM r1 EXCEPT SELECT * FROM r0) n JOIN w ON w.question = n.question AND depth >= 2 JOIN bi ON n.id = a),
r AS (SELECT * FROM r1 UNION SELECT question, b FROM s2), f AS (SELECT question, id FROM hf UNION SELECT question, e FROM s1 UNION SELECT question, e FROM s2),
t AS MATERIALIZED (SELECT id, {_ND} AS t FROM nodes),
ft AS (SELECT e.id, concat_ws(' ', e.type, from_id, to_id, a.t, b.t, concat_ws(' ', e.description, e.lines, e.note, e.reason), e.vf::VARCHAR, e.vt::VARCHAR) AS t FROM edges e LEFT JOIN t a ON a.id = from_id LEFT JOIN t b ON b.id = to_id)
SELECT question, sum(c)::BIGINT AS facts, sum(n)::BIGINT AS chars FROM (SELECT question, 1 AS c, length(t) AS n FROM r JOIN t USING (id) UNION ALL SELECT question, 1, length(t) FROM f JOIN ft USING (id)) GROUP BY question"""))  # fmt: skip
def qa_evidence(spark, d):
    """What each nation's name leads to, one or two hops away: how many texts, and their length."""
    words = table(spark, d, "nation").select(F.col("n_name").alias("question"), F.col("n_name").alias("word"))
    depths = table(spark, d, "nation").select(F.col("n_name").alias("question"), (F.col("n_nationkey") % 2 + 1).alias("depth"))
    found = answers.evidence(sample_graph(spark, d), words, depths)
    parts = F.split("found", "\n")
    return found.select("question", F.size(parts).cast("long").alias("facts"), (F.length("found") - F.size(parts) + 1).cast("long").alias("chars"))


@query("qa_sources", """
WITH t AS (SELECT source || '/' || doc_id || '.md' AS path, text FROM documents), w AS (SELECT n_nationkey::VARCHAR AS question, x AS kw FROM nation, (SELECT unnest(['license', 'gnu general', 'zz', 'copyright']) AS x)),
h AS (SELECT question, path, text, row_number() OVER (PARTITION BY question, kw ORDER BY path) AS no FROM w JOIN t ON contains(lower(text), kw) WHERE question::INTEGER % 2 = 0)
SELECT question, count(*) AS texts, sum(length(text))::BIGINT AS chars FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY path) AS k FROM (SELECT DISTINCT question, path, text FROM h WHERE no <= 3)) WHERE k <= 3 GROUP BY question""")  # fmt: skip
def qa_sources(spark, d):
    """The fallback to raw texts: the first three that hold any of the keywords, for half of the questions."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("question"))
    words = nation.withColumn("word", F.explode(F.array(*[F.lit(x) for x in ("License", "GNU general", "zz", "copyright")])))
    depths = nation.select("question", F.lit(1).alias("depth"), (F.col("question").cast("int") % 2 == 0).alias("raw"))
    g = sample_graph(spark, d)
    empty = g.with_edges(g.edges.limit(0))
    docs = data._docs(spark, d).withColumn("text", F.translate("text", "\n", "\x01"))
    found = answers.evidence(type(g)(empty.nodes.limit(0), empty.edges), words, depths, docs=docs)
    parts = F.split("found", "\n")
    return found.select("question", F.size(parts).cast("long").alias("texts"), (F.length("found") - F.size(parts) + 1).cast("long").alias("chars"))


@query("resolve_pending", "SELECT id, last FROM (" + SQL["journal_upsert_nodes"] + ")")
def resolve_pending(spark, d):
    """All pending entries merged, resolved and published; what readers then see."""
    from tessera.plans.graph import Graph
    from tessera.plans.ontology import Ontology

    nodes, edges = data._held(spark, d)
    root = f"{own_dir(spark)}/resolved-{uuid.uuid4().hex}"
    publication.resolve_pending(Graph(nodes, edges), data._entries(spark, d), root, "1", ontology=Ontology())
    return publication.Published(spark, root).graph().nodes.select("id", F.col("props")["last"].alias("last"))


@query("incremental_resolution", SQL["resolve_pending"])
def incremental_resolution(spark, d):
    """The same journal as a stream of three micro-batches, each of which folds only the groups that it touches."""
    from tessera.operators.journal import ENTRY
    from tessera.plans.graph import Graph
    from tessera.plans.incremental import IncrementalGraph

    root = f"{own_dir(spark)}/incremental-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64("entry_id"), F.lit(3))  # not in the order of entries
    data._entries(spark, d).withColumn("_part", part).repartition(3, "_part").drop("_part").write.parquet(f"{root}/feed")
    nodes, edges = data._held(spark, d)
    state = IncrementalGraph(spark, f"{root}/graph", buckets=8)
    state.load(Graph(nodes, edges))
    state.follow(spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(f"{root}/feed"))
    return state.graph().nodes.select("id", F.col("props")["last"].alias("last"))


_CUT = "CASE WHEN length({0}) <= 4000 THEN {0} ELSE substr({0}, 1, 4000) || chr(10) || '…[truncated]' || chr(10) END"


@query("deep_import", data.TURNS + rf"""
SELECT session::VARCHAR AS session, 'n/' || session || '-batch-01.md' AS path, length(rtrim('---' || chr(10) || 'source: n' || chr(10) || 'session: ' || session || chr(10) || 'batch: 000' || chr(10) || 'turns: ' || count(*) || chr(10) || '---' || chr(10) || chr(10) ||
string_agg('## Turn ' || turn_no || chr(10) || chr(10) || CASE WHEN user_content <> '' THEN '**User:** ' || {_CUT.format("user_content")} || chr(10) || chr(10) ELSE '' END || CASE WHEN assistant_text <> '' THEN '**Assistant:** ' || {_CUT.format("assistant_text")} || chr(10) || chr(10) ELSE '' END, '' ORDER BY turn_no), chr(10) || ' ') || chr(10))::VARCHAR AS body FROM t GROUP BY session""")  # fmt: skip
def deep_import(spark, d):
    """Every conversation as one batch; the provider tells how long it is."""
    from tessera.operators.imports import imported_sessions

    messages = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), "role", "text", F.array().cast("array<string>").alias("tools"))
    none = spark.createDataFrame([], "session string, digest string")
    return imported_sessions(messages, none, lambda t: str(len(t)), namespace="n", max_chars=10**9, overlap=0)[0].select("session", "path", "body")
