"""Queries over resolution, journals, files, sessions, scores and pages, and the same in SQL. Importing it registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.functions.redaction import redacted
from tessera.operators import evaluate, journal, pages, resolve, sessions
from tessera.plans.graph import Graph
from tessera.plans.ontology import Ontology
from tessera.plans.queries import VIEW, on_graph, query, table
from tessera.sources import files
from tessera.sources.graph_view import sample_graph

def none():
    return F.create_map().cast("map<string,string>")


# ---------------------------------------------------------------- resolution


def _candidates(spark, d) -> Graph:
    """Documents as candidate nodes, same_as edges between equal texts, and edges that can't all stay."""
    docs = table(spark, d, "documents")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("first"))
    doc = lambda c: F.concat(F.lit("Doc_"), F.col(c).cast("string"))
    svc = F.concat(F.lit("svc:"), "source")
    src = F.array(F.concat(F.lit("raw/"), "source", F.lit(".md:"), F.col("doc_id").cast("string")))
    fact = lambda id_, type_, props: [id_.alias("id"), type_.alias("type"), F.array("lang").alias("ns"), F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), props.alias("props"), src.alias("src")]
    kind = F.when(F.col("doc_id") % 97 == 0, "mystery").otherwise("document")
    nodes = docs.select(*fact(doc("doc_id"), kind, F.create_map(F.lit("name"), F.concat(F.lit("Document "), F.col("doc_id").cast("string"))))).unionByName(
        docs.where("doc_id % 3 = 1").select(*fact(svc, F.lit("service"), F.create_map(F.lit("name"), F.col("source"))))
    )
    edge = lambda df, tag, type_, a, b: df.select(*fact(F.concat(F.lit(tag), F.col("doc_id").cast("string")), F.lit(type_), none()), a.alias("from_id"), b.alias("to_id"))
    same = docs.join(first, "text").where("doc_id <> first")
    edges = (
        edge(same, "s", "same_as", doc("doc_id"), doc("first"))
        .unionByName(edge(docs, "d", "documents", doc("doc_id"), svc))
        .unionByName(edge(docs.where("doc_id % 50 = 0"), "x", "documents", doc("doc_id"), F.lit("svc:none")))
        .unionByName(edge(docs.where("doc_id % 60 = 1"), "w", "documents", svc, doc("doc_id")))
    )
    return Graph(nodes, edges)


CANDIDATES = """
WITH c AS MATERIALIZED (SELECT *, doc_id % 97 = 0 AS odd, 'raw/' || source || '.md:' || doc_id AS src, min(doc_id) OVER (PARTITION BY text) AS first0 FROM documents),
-- same_as links among documents of known type; a group without its first document links through the edges to it
k AS MATERIALIZED (SELECT *, CASE WHEN first0 % 97 <> 0 THEN first0
    ELSE (SELECT min(x.doc_id) FROM c x WHERE x.text = c.text AND NOT x.odd AND length('doc-' || x.doc_id) = (SELECT min(length('doc-' || y.doc_id)) FROM c y WHERE y.text = c.text AND NOT y.odd)) END AS first FROM c),
m AS MATERIALIZED (SELECT 'Doc_' || doc_id AS id, 'doc-' || first AS cid, * FROM k),
svc AS (SELECT 'svc:' || source AS id, source, lang, src FROM c WHERE doc_id % 3 = 1),
e AS MATERIALIZED (
  SELECT 's' || doc_id AS id, 'same_as' AS type, 'Doc_' || doc_id AS f, 'Doc_' || first0 AS t, lang, src FROM c WHERE doc_id <> first0
  UNION ALL SELECT 'd' || doc_id, 'documents', 'Doc_' || doc_id, 'svc:' || source, lang, src FROM c
  UNION ALL SELECT 'x' || doc_id, 'documents', 'Doc_' || doc_id, 'svc:none', lang, src FROM c WHERE doc_id % 50 = 0
  UNION ALL SELECT 'w' || doc_id, 'documents', 'svc:' || source, 'Doc_' || doc_id, lang, src FROM c WHERE doc_id % 60 = 1),
n AS MATERIALIZED (SELECT cid AS id, 'document' AS type FROM m WHERE NOT odd UNION SELECT id, 'service' FROM svc),
r AS MATERIALIZED (
  SELECT e.id, e.type, coalesce(a.cid, e.f) AS f, coalesce(b.cid, e.t) AS t, e.lang, e.src FROM e LEFT JOIN m a ON a.id = e.f LEFT JOIN m b ON b.id = e.t),
j AS MATERIALIZED (
  SELECT r.*, CASE WHEN x.id IS NULL OR y.id IS NULL THEN 'dangling endpoint' WHEN f = t THEN 'self-loop'
    WHEN r.type <> 'same_as' AND NOT (x.type = 'document' AND y.type = 'service') THEN 'invalid edge endpoints' END AS reason
  FROM r LEFT JOIN n x ON x.id = f LEFT JOIN n y ON y.id = t)
"""


@query("normalize_ids", "SELECT DISTINCT lower(regexp_replace(source || '__' || lang || ' -' || (doc_id % 9), '[-_\\s]+', '-', 'g')) AS id FROM documents")
def normalize_ids(spark, d):
    raw = F.concat("source", F.lit("__"), F.upper("lang"), F.lit(" -"), (F.col("doc_id") % 9).cast("string"))
    return table(spark, d, "documents").select(fn.normal_id(raw, compose=True).alias("id")).distinct()


@query("alias_components", CANDIDATES + "SELECT id AS alias, cid AS canonical FROM m WHERE NOT odd")
def alias_components(spark, d):
    g = _candidates(spark, d)
    known = g.nodes.where(F.col("type") != "mystery")
    found = resolve.alias_map(known, g.edges)
    return found.join(known.select(F.col("id").alias("alias")).distinct(), "alias", "left_semi")


@query("resolve_nodes", CANDIDATES + """
SELECT cid AS id, 'document' AS type, max_by('Document ' || doc_id, src) AS name, string_agg(DISTINCT src, ',' ORDER BY src) AS src, string_agg(DISTINCT lang, ',' ORDER BY lang) AS ns,
  '["' || string_agg(id, '","' ORDER BY id) || '"]' AS merged_ids FROM m WHERE NOT odd GROUP BY cid
UNION ALL SELECT id, 'service', max(source), string_agg(DISTINCT src, ',' ORDER BY src), string_agg(DISTINCT lang, ',' ORDER BY lang), NULL FROM svc GROUP BY id""")  # fmt: skip
def resolve_nodes(spark, d):
    g = _candidates(spark, d)
    n = resolve.resolve(g.nodes, g.edges, ontology=Ontology())["nodes"]
    return n.select("id", "type", F.try_element_at("props", F.lit("name")).alias("name"), F.array_join("src", ",").alias("src"), F.array_join("ns", ",").alias("ns"), F.try_element_at("props", F.lit("merged_ids")).alias("merged_ids"))


@query("resolve_edges", CANDIDATES + """
, g AS (SELECT type, f, t, string_agg(DISTINCT src, ',' ORDER BY src) AS src, count(*) AS copies FROM j WHERE reason IS NULL GROUP BY ALL)
SELECT 'e_' || type || '_' || lpad(CAST(row_number() OVER (ORDER BY type, f, t) AS VARCHAR), greatest(4, length(CAST(row_number() OVER (ORDER BY type, f, t) AS VARCHAR)))::INTEGER, '0') AS id, type, f AS from_id, t AS to_id, src, copies FROM g""")  # fmt: skip
def resolve_edges(spark, d):
    g = _candidates(spark, d)
    return resolve.resolve(g.nodes, g.edges, ontology=Ontology())["edges"].select("id", "type", "from_id", "to_id", F.array_join("src", ",").alias("src"), "copies")


@query("quarantine_reasons", CANDIDATES + "SELECT 'edge' AS kind, id, reason FROM j WHERE reason IS NOT NULL UNION ALL SELECT 'node', id, 'unknown node type (mystery)' FROM m WHERE odd")
def quarantine(spark, d):
    g = _candidates(spark, d)
    return resolve.resolve(g.nodes, g.edges, ontology=Ontology())["quarantine"]


# ---------------------------------------------------------------- journals


def _entries(spark, d):
    """Changes that users' events propose: views and clicks make nodes, other events link users."""
    e = table(spark, d, "events")
    user = lambda c: F.concat(F.lit("user:"), c.cast("string"))
    node = F.col("event_type").isin("click", "view")
    n = F.col("event_id")
    return e.select(
        F.when(n % 2 == 0, F.concat(F.lit("e"), F.lpad(n.cast("string"), 8, "0"))).otherwise("").alias("entry_id"), F.concat(F.lit("agent"), (n % 3).cast("string")).alias("agent"), F.lit(None).cast("string").alias("device"),
        F.lit("team").alias("ns"), ((n % 101) / 100.0).alias("confidence"), F.concat(F.lit("t"), F.lpad(n.cast("string"), 8, "0")).alias("proposed_at"),
        F.when(n % 7 == 0, "merged").when(n % 13 == 0, "flagged").otherwise("pending").alias("status"),
        F.when(node, "node").otherwise("edge").alias("kind"), F.when(node, user(F.col("user_id"))).otherwise("").alias("id"),
        F.when(n % 31 == 0, "mystery").when(node, "person").otherwise("collaborates_with").alias("type"),
        F.when(~node, user(F.col("user_id"))).alias("from_id"), F.when(~node, user((F.col("user_id") * 3 + 1) % 200)).alias("to_id"), F.array(F.lit("team")).alias("fact_ns"),
        F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.create_map(F.lit("last"), n.cast("string")).alias("props"), F.array().cast("array<string>").alias("src"),
    )


def _held(spark, d):
    e = table(spark, d, "events").where("user_id < 60").select("user_id").distinct()
    fact = [F.lit("person").alias("type"), F.array(F.lit("public")).alias("ns"), F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.create_map(F.lit("last"), F.lit("0"), F.lit("name"), F.concat(F.lit("User "), F.col("user_id").cast("string"))).alias("props"), F.array(F.lit("users.md:1")).alias("src"), F.lit(None).cast("struct<agent:string,confidence:double,proposed_at:string,device:string>").alias("provenance")]
    nodes = e.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("id"), *fact)
    return nodes, nodes.limit(0).withColumns({"from_id": F.lit(""), "to_id": F.lit("")})


ENTRIES = """
WITH j AS MATERIALIZED (
  SELECT event_id AS n, CASE WHEN event_id % 2 = 0 THEN 'e' || lpad(CAST(event_id AS VARCHAR), 8, '0') ELSE 't' || lpad(CAST(event_id AS VARCHAR), 8, '0') END AS k, 'agent' || (event_id % 3) AS agent, (event_id % 101) / 100.0 AS confidence,
    CASE WHEN event_id % 7 = 0 THEN 'merged' WHEN event_id % 13 = 0 THEN 'flagged' ELSE 'pending' END AS status, CASE WHEN event_type IN ('click', 'view') THEN 'node' ELSE 'edge' END AS kind,
    CASE WHEN event_id % 31 = 0 THEN 'mystery' WHEN event_type IN ('click', 'view') THEN 'person' ELSE 'collaborates_with' END AS type,
    'user:' || user_id AS u, 'user:' || ((user_id * 3 + 1) % 200) AS v FROM events),
held AS (SELECT DISTINCT 'user:' || user_id AS id FROM events WHERE user_id < 60),
play AS (SELECT *, status <> 'pending' AS replaying FROM j WHERE status = 'pending' OR {replay}),
first AS (SELECT *, CASE WHEN confidence < 0.5 AND NOT replaying THEN 'low confidence' WHEN kind = 'node' AND type = 'mystery' THEN 'unknown node type: mystery' END AS r0 FROM play),
known AS (SELECT id FROM held UNION SELECT u FROM first WHERE kind = 'node' AND r0 IS NULL),
made AS MATERIALIZED (SELECT *, coalesce(r0, CASE WHEN kind = 'edge' AND NOT (type = 'collaborates_with' AND u IN (SELECT id FROM known) AND v IN (SELECT id FROM known)) THEN 'invalid edge endpoints' END) AS reason FROM first),
verdicts AS MATERIALIZED (SELECT *, CASE WHEN reason IS NOT NULL THEN 'quarantined' WHEN replaying THEN 'replayed' WHEN confidence < 0.8 THEN 'flagged' ELSE 'merged' END AS verdict FROM made)
"""


def entries_sql(select: str, replay: bool = False) -> str:
    return ENTRIES.replace("{replay}", "true" if replay else "false") + select


@query("journal_gate", entries_sql("SELECT k, verdict, reason FROM verdicts"))
def journal_gate(spark, d):
    return journal.decided(_entries(spark, d), _held(spark, d)[0], Ontology()).select(journal.entry_key().alias("k"), "verdict", "reason")


def _nodes_sql(replay: bool) -> str:
    late = "CASE WHEN replaying THEN 1 ELSE 0 END"
    return entries_sql(f"""
, x AS (SELECT id, 'held' AS agent, '0' AS last, 0 AS side, '' AS k, '' AS a, 0 AS late FROM held UNION ALL SELECT u, agent, CAST(n AS VARCHAR), 1, k, agent, {late} FROM verdicts WHERE kind = 'node' AND verdict <> 'quarantined')
SELECT id, CASE WHEN arg_min(agent, side || k || a) = 'held' THEN NULL ELSE arg_min(agent, side || k || a) END AS agent, count(*) AS facts,
  CASE WHEN min(late) = 1 THEN arg_min(last, side || k || a) ELSE arg_max(last, side || k || a) FILTER (late = 0) END AS last,
  CASE WHEN bool_or(side = 0) AND bool_or(side = 1) THEN 'public,team' WHEN bool_or(side = 0) THEN 'public' ELSE 'team' END AS ns FROM x GROUP BY id""", replay)  # fmt: skip


def _merged_nodes(spark, d, replay: bool):
    nodes, edges = _held(spark, d)
    out = journal.merge_journals(nodes, edges, _entries(spark, d), Ontology(), replay)["nodes"]
    return out.select("id", F.col("provenance.agent").alias("agent"), "facts", F.col("props")["last"].alias("last"), F.array_join("ns", ",").alias("ns"))


@query("journal_upsert_nodes", _nodes_sql(False))
def journal_nodes(spark, d):
    return _merged_nodes(spark, d, False)


@query("journal_replay_nodes", _nodes_sql(True))
def journal_replay(spark, d):
    return _merged_nodes(spark, d, True)


@query("journal_upsert_edges", entries_sql("SELECT u AS from_id, v AS to_id, type, count(*) AS facts, arg_min(agent, k || agent) AS agent FROM verdicts WHERE kind = 'edge' AND verdict <> 'quarantined' GROUP BY ALL"))
def journal_edges(spark, d):
    nodes, edges = _held(spark, d)
    out = journal.merge_journals(nodes, edges, _entries(spark, d), Ontology())["edges"]
    return out.select("from_id", "to_id", "type", "facts", F.col("provenance.agent").alias("agent"))


def _status(name: str, manual: bool) -> None:
    new = "CASE WHEN verdict = 'quarantined' THEN 'quarantined' ELSE 'merged' END" if manual else "CASE verdict WHEN 'flagged' THEN 'flagged' WHEN 'quarantined' THEN 'pending' ELSE 'merged' END"

    @query(name, entries_sql(f"SELECT j.k, coalesce({new.replace('verdict', 'w.verdict')}, j.status) AS status FROM j LEFT JOIN verdicts w ON w.n = j.n".replace("coalesce(CASE WHEN w.", "coalesce(CASE WHEN w.verdict IS NULL THEN NULL WHEN w.").replace("coalesce(CASE w.verdict", "coalesce(CASE w.verdict").replace("ELSE 'merged' END, j.status", "WHEN w.verdict IS NOT NULL THEN 'merged' END, j.status" if manual else "WHEN 'merged' THEN 'merged' END, j.status")))
    def status(spark, d):
        e = _entries(spark, d)
        return journal.with_statuses(e, journal.decided(e, _held(spark, d)[0], Ontology()), manual).select(journal.entry_key().alias("k"), "status")


_status("journal_status_manual", True)
_status("journal_status_auto", False)


@query("jsonl_union", "SELECT id, min_by(origin, side * 1000000000000 + n) AS origin FROM (SELECT user_id AS id, 'ours' AS origin, 0 AS side, event_id AS n FROM events WHERE event_type <> 'error' UNION ALL SELECT user_id, 'theirs', 1, event_id FROM events WHERE event_type <> 'click') GROUP BY 1")
def jsonl_union(spark, d):
    """Our events are all but errors, theirs all but clicks: every event is on a side, most are on both."""
    e = table(spark, d, "events")
    side = lambda name, w: e.where(w).select(F.col("user_id").alias("id"), F.lit(name).alias("origin"), F.col("event_id").alias("n"))
    return journal.union_first(side("ours", "event_type <> 'error'"), side("theirs", "event_type <> 'click'"), ["id"], ["n"]).select("id", "origin")


# ---------------------------------------------------------------- files


def _docs(spark, d):
    return table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")


CHUNKS = r"""
WITH l AS (SELECT source || '/' || doc_id || '.md' AS path, source, string_split(text, chr(10)) AS ls FROM documents),
c AS MATERIALIZED (SELECT path, source, s, least(s + 9, len(ls)) AS e, array_to_string(ls[s:s + 9], chr(10)) AS text FROM (SELECT *, unnest(range(1, len(ls) + 1, 10)) AS s FROM l)),
chunk AS MATERIALIZED (SELECT path, CAST(s AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line, source AS namespace, path || ':' || s AS src, sha256(path || chr(10) || text) AS hash FROM c WHERE regexp_matches(text, '\S'))
"""


@query("chunks", CHUNKS + "SELECT * FROM chunk")
def chunks(spark, d):
    return files.chunks(_docs(spark, d), 10).drop("text")


@query("chunk_run_id", CHUNKS + """
, p AS (SELECT path, sha256(string_agg(hash, '' ORDER BY start_line)) AS h FROM chunk GROUP BY path), q AS (SELECT substr(h, 1, 2) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM p GROUP BY 1)
SELECT substr(sha256('5' || string_agg(h, '' ORDER BY h)), 1, 16) AS run_id FROM q""")  # fmt: skip
def run_id(spark, d):
    return files.run_id(files.chunks(_docs(spark, d), 10), 5)


@query("chunk_fact_map", CHUNKS + "SELECT substr(hash, 1, 16) AS chunk, string_agg(DISTINCT 'doc:' || (doc_id % 100), ',' ORDER BY 'doc:' || (doc_id % 100)) AS facts FROM chunk JOIN documents ON src = source || '/' || doc_id || '.md:1' GROUP BY 1")
def chunk_fact_map(spark, d):
    facts = table(spark, d, "documents").select(F.concat(F.lit("doc:"), (F.col("doc_id") % 100).cast("string")).alias("id"), F.array(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md:1"))).alias("src"))
    return files.chunk_facts(files.chunks(_docs(spark, d), 10), facts)


@query("uncached_chunks", CHUNKS + "SELECT src FROM chunk WHERE NOT (substr(hash, 1, 1) < '8')")
def uncached(spark, d):
    cut = files.chunks(_docs(spark, d), 10)
    return files.uncached(cut, cut.where("substring(hash, 1, 1) < '8'").select("hash")).select("src")


# ---------------------------------------------------------------- sessions


TURNS = """
WITH m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations WHERE role IN ('user', 'assistant')),
t AS MATERIALIZED (SELECT conv_id AS session, CAST(no AS BIGINT) AS turn_no, max(CASE WHEN role = 'user' THEN text END) AS user_content, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10) || chr(10) ORDER BY turn), '') AS assistant_text FROM m WHERE no > 0 GROUP BY ALL)
"""


def _turns(spark, d):
    return sessions.turns(table(spark, d, "conversations"))


@query("turn_pairing", TURNS + "SELECT session, turn_no, sha256(user_content) AS user_sha, sha256(assistant_text) AS assistant_sha FROM t")
def turn_pairing(spark, d):
    return _turns(spark, d).select("session", "turn_no", F.sha2("user_content", 256).alias("user_sha"), F.sha2("assistant_text", 256).alias("assistant_sha"))


@query("turn_clip", TURNS + "SELECT session, turn_no, CASE WHEN length(user_content) <= 40 THEN user_content ELSE user_content[:40] || chr(10) || '…[truncated]' || chr(10) END AS user_content FROM t")
def turn_clip(spark, d):
    return sessions.clipped_turns(_turns(spark, d), 40).select("session", "turn_no", "user_content")


@query("session_digest", TURNS + "SELECT session, sha256(string_agg(user_content || chr(0) || assistant_text || chr(0) || chr(1), '' ORDER BY turn_no)) AS digest FROM t GROUP BY 1")
def session_digest(spark, d):
    return sessions.digests(_turns(spark, d))


BATCHES = """
, s AS MATERIALIZED (SELECT session, turn_no AS no, length(user_content) + length(assistant_text) AS size, max(turn_no) OVER (PARTITION BY session) AS last FROM t),
b(session, batch, a, z, chars, last, closed) AS (
  SELECT session, 0, no, no, size, last, false FROM s WHERE no = 1
  UNION ALL
  SELECT b.session, CASE WHEN fits THEN b.batch ELSE b.batch + 1 END, CASE WHEN fits THEN b.a ELSE greatest(b.a + 1, b.z + 1 - 1) END, CASE WHEN fits THEN b.z + 1 ELSE greatest(b.a + 1, b.z + 1 - 1) END,
    CASE WHEN fits THEN b.chars + n.size ELSE (SELECT size FROM s q WHERE q.session = b.session AND q.no = greatest(b.a + 1, b.z)) END, b.last, false
  FROM (SELECT b.*, b.chars + n.size <= 900 AS fits FROM b JOIN s n ON n.session = b.session AND n.no = b.z + 1) b JOIN s n ON n.session = b.session AND n.no = b.z + 1)
SELECT session, CAST(batch AS INTEGER) AS batch, a AS first_turn, max(z) AS last_turn, CAST(max(z) - a + 1 AS INTEGER) AS n_turns, max(chars)::BIGINT AS chars FROM b GROUP BY session, batch, a"""


@query("turn_batches", TURNS.replace("WITH m", "WITH RECURSIVE m") + BATCHES)
def turn_batches(spark, d):
    return sessions.batches(_turns(spark, d), 900, 1)


@query("session_retention", "WITH f AS (SELECT event_type AS ns, user_id AS session, max(ts) AS newest FROM events GROUP BY 1, 2) SELECT ns, session, row_number() OVER (PARTITION BY ns ORDER BY newest DESC, session DESC) <= 5 AS kept FROM f")
def retention(spark, d):
    files_ = table(spark, d, "events").select(F.col("event_type").alias("ns"), F.col("user_id").alias("session"), F.col("ts").alias("mtime"))
    return sessions.retained(files_).select("ns", "session", "kept")


@query("latest_imports", "SELECT event_type AS ns, arg_max(user_id, (ts, user_id)) AS session FROM events GROUP BY 1")
def latest_imports(spark, d):
    return sessions.latest(table(spark, d, "events").select(F.col("event_type").alias("ns"), F.col("user_id").alias("session"), F.col("ts").alias("mtime")))


@query("session_window_batch", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts, 1, TIMESTAMP '1900-01-01') OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 300 SECOND THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, CAST(min(ts) AS VARCHAR) AS started, count(*) AS n FROM s GROUP BY user_id, s""")  # fmt: skip
def session_window_batch(spark, d):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return sessions.idle_sessions(table(spark, d, "events")).select("user_id", F.col("started").cast("string").alias("started"), "n")


# ---------------------------------------------------------------- text and scores


#: A text's own secrets, as SQL finds them.
_REDACTED = "text"
for _pattern, _by in (
    (r"(?i)((?:api[-_]?key|access[-_]?token|auth[-_]?token|password|passwd|secret)\s*[:=]\s*)[^\s;,]+", r"\1[REDACTED]"),
    (r"(?i)(\bbearer\s+)[-\w.~+/=]+", r"\1[REDACTED]"),
    (r"(?i)(https?://)[^@/\s]+@", r"\1[REDACTED]@"),
    (r"(?i)([&?](?:api[-_]?key|access[-_]?token|token|key|secret|password)=)[^#&\s]+", r"\1[REDACTED]"),
    (r"(?i)\b(?:sk|rk|pk|or|ds)-[-\w]{12,}\b", "[REDACTED]"),
):
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern}', '{_by}', 'g')"


@query("redact", f"""SELECT doc_id, sha256(own || masked) AS sha, masked AS ending
FROM (SELECT doc_id, {_REDACTED} AS own, ' at https://[REDACTED]@h/x?token=[REDACTED]&b=1, Bearer [REDACTED] pass-word = [REDACTED]; Api_Key:[REDACTED], (ds-' || doc_id || ') "[REDACTED]"' AS masked FROM documents)""")
def redact(spark, d):
    """Every document's text with secrets planted behind it: they go, so do its own, and nothing else changes."""
    n = F.col("doc_id").cast("string")
    long = F.sha2(n, 256)
    planted = F.concat(F.lit(" at https://u"), n, F.lit(":p@h/x?token=t"), n, F.lit("&b=1, Bearer q.w"), n, F.lit(" pass-word = p"), n, F.lit("; Api_Key:"), n, F.lit(", (ds-"), n, F.lit(') "sk-'), long, F.lit('"'))
    kept = F.concat(F.lit(" at https://[REDACTED]@h/x?token=[REDACTED]&b=1, Bearer [REDACTED] pass-word = [REDACTED]; Api_Key:[REDACTED], (ds-"), n, F.lit(') "[REDACTED]"'))
    out = table(spark, d, "documents").select("doc_id", redacted(F.concat("text", planted)).alias("out"), F.length(kept).alias("n"))
    return out.select("doc_id", F.sha2("out", 256).alias("sha"), F.right("out", F.col("n")).alias("ending"))


_TOKENS = r"list_filter(regexp_split_to_array(trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g')), '\s+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the', 'is', 'are', 'was', 'were', 'to', 'of', 'in', 'on', 'at'))"
_QA = f"""
WITH q AS (SELECT item_id, item_id % 5 AS category, {_TOKENS.format(x="b.text")} AS g, {_TOKENS.format(x="d.text")} AS f FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 3),
gt AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(g) AS w FROM q) GROUP BY ALL), ft AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(f) AS w FROM q) GROUP BY ALL),
o AS (SELECT item_id, sum(least(gt.n, ft.n)) AS hit FROM gt JOIN ft USING (item_id, w) GROUP BY 1),
s AS MATERIALIZED (SELECT q.item_id, category, CASE WHEN len(g) = 0 THEN 1.0::DOUBLE ELSE coalesce(hit, 0) / len(g) END AS recall, CASE WHEN len(g) + len(f) = 0 THEN 1.0::DOUBLE ELSE 2.0 * coalesce(hit, 0) / (len(g) + len(f)) END AS f1 FROM q LEFT JOIN o USING (item_id))
"""


def _qa(spark, d):
    b, t = table(spark, d, "benchmark"), table(spark, d, "documents")
    return b.select("item_id", F.col("text").alias("gold"), (F.col("item_id") % 5).alias("category"), (F.col("item_id") * 3).alias("doc_id")).join(t.select("doc_id", F.col("text").alias("found")), "doc_id").withColumn("adversarial", F.col("category") == 4)


@query("token_f1", _QA + "SELECT item_id, round(f1, 9) AS f1 FROM s")
def token_f1(spark, d):
    return _qa(spark, d).select("item_id", F.round(fn.token_f1(F.col("found"), F.col("gold")), 9).alias("f1"))


@query("token_recall", _QA + "SELECT item_id, round(recall, 9) AS recall FROM s")
def token_recall(spark, d):
    return _qa(spark, d).select("item_id", F.round(fn.token_recall(F.col("found"), F.col("gold")), 9).alias("recall"))


@query("qa_report", _QA + "SELECT coalesce(CAST(category AS VARCHAR), 'all') AS category, count(*) AS n, round(avg(CASE WHEN category = 4 THEN 1 - recall ELSE recall END), 9) AS mean FROM s GROUP BY ROLLUP (category)")
def qa_report(spark, d):
    r = evaluate.qa_report(evaluate.qa_scores(_qa(spark, d)))
    return r.select(F.coalesce(F.col("category").cast("string"), F.lit("all")).alias("category"), "n", F.round("mean", 9).alias("mean"))


@query("prf1_labels", """
WITH g AS (SELECT doc_id FROM labels WHERE toxic = 1), h AS (SELECT doc_id FROM labels WHERE quality = 1),
c AS (SELECT (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM h) AS got, (SELECT count(*) FROM g JOIN h USING (doc_id)) AS hit)
SELECT gold, got, hit, hit / got AS precision, hit / gold AS recall, 2.0 * hit / (got + gold) AS f1 FROM c""")  # fmt: skip
def prf1(spark, d):
    lab = table(spark, d, "labels")
    r = evaluate.precision_recall_f1(lab.where("toxic = 1").select("doc_id"), lab.where("quality = 1").select("doc_id"))
    return r


@query("coreference_f1", """
WITH g AS (SELECT text AS c, doc_id AS n FROM documents), h AS (SELECT source AS c, doc_id AS n FROM documents),
p AS (SELECT (SELECT count(*) FROM g a JOIN g b ON a.c = b.c AND a.n < b.n) AS gold, (SELECT count(*) FROM h a JOIN h b ON a.c = b.c AND a.n < b.n) AS got,
  (SELECT count(*) FROM documents a JOIN documents b ON a.text = b.text AND a.source = b.source AND a.doc_id < b.doc_id) AS hit)
SELECT gold, got, hit, round(hit / got, 9) AS precision, round(hit / gold, 9) AS recall, round(2.0 * hit / (got + gold), 9) AS f1 FROM p""")  # fmt: skip
def coreference(spark, d):
    docs = table(spark, d, "documents")
    r = evaluate.coreference_f1(docs.select(F.col("text").alias("cluster"), F.col("doc_id").alias("name")), docs.select(F.col("source").alias("cluster"), F.col("doc_id").alias("name")))
    return r.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("retrieval_check", on_graph("""
, w AS (SELECT from_id AS q, to_id AS id FROM edges WHERE type = 'pursues'), h AS (SELECT from_id AS q, to_id AS id FROM edges WHERE type = 'pursues' AND (vf IS NULL OR vf <= DATE '2000-01-01'))
SELECT w.q, count(*) AS expected, count(*) FILTER (h.id IS NULL) AS missing, count(*) FILTER (h.id IS NULL) = 0 AS passed FROM w LEFT JOIN h USING (q, id) GROUP BY 1"""))  # fmt: skip
def retrieval_check(spark, d):
    e = sample_graph(spark, d).edges.where("type = 'pursues'")
    pick = lambda df: df.select(F.col("from_id").alias("q"), F.col("to_id").alias("id"))
    return evaluate.superset(pick(e), pick(e.where("valid_from is null or valid_from <= date'2000-01-01'")), "q")


@query("extraction_report", on_graph("""
, gn AS (SELECT DISTINCT type, coalesce(name, id) AS n FROM nodes WHERE type IN ('team', 'service', 'person')), hn AS (SELECT DISTINCT type, coalesce(name, id) AS n FROM nodes WHERE type IN ('team', 'service', 'person') AND ns <> 'asia'),
ge AS (SELECT DISTINCT e.type, coalesce(a.name, a.id) AS f, coalesce(b.name, b.id) AS t, e.ns FROM edges e JOIN nodes a ON a.id = from_id JOIN nodes b ON b.id = to_id WHERE e.type = 'member_of'),
x AS (SELECT 'node' AS kind, (SELECT count(*) FROM gn) AS gold, (SELECT count(*) FROM hn) AS got, (SELECT count(*) FROM gn JOIN hn USING (type, n)) AS hit
  UNION ALL SELECT 'edge', (SELECT count(*) FROM ge), (SELECT count(*) FROM ge WHERE ns <> 'asia'), (SELECT count(*) FROM ge WHERE ns <> 'asia'))
SELECT kind, gold, got, hit, round(hit / got, 9) AS precision, round(hit / gold, 9) AS recall, round(2.0 * hit / (got + gold), 9) AS f1 FROM x"""))  # fmt: skip
def extraction_report(spark, d):
    g = sample_graph(spark, d)
    gold = Graph(g.nodes.where(F.col("type").isin("team", "service", "person")), g.edges.where("type = 'member_of'"))
    got = Graph(gold.nodes.where(~F.array_contains("ns", "asia")), gold.edges.where(~F.array_contains("ns", "asia")))
    r = evaluate.extraction_report(gold, got)
    return r.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


# ---------------------------------------------------------------- pages


@query("page_slugs", on_graph("SELECT id, replace(replace(id, ':', '-'), '/', '-') AS slug, 1::BIGINT AS n FROM nodes"))
def page_slugs(spark, d):
    return pages.slugs(sample_graph(spark, d))


_VALID = "CASE WHEN vf IS NULL AND vt IS NULL THEN 'always' WHEN vt IS NULL THEN vf || ' → present' WHEN vf IS NULL THEN 'until ' || vt ELSE vf || ' → ' || vt END"


@query("page_relations", on_graph(f"""
, x AS (SELECT from_id AS id, to_id AS other, type, true AS o, coalesce(description, reason, note) AS description, {_VALID} AS valid FROM edges UNION ALL SELECT to_id, from_id, type, false, coalesce(description, reason, note), {_VALID} FROM edges)
SELECT x.id, CASE type WHEN 'member_of' THEN CASE WHEN o THEN 'Member of' ELSE 'Has member' END WHEN 'in_domain' THEN CASE WHEN o THEN 'In domain' ELSE 'Includes' END WHEN 'pursues' THEN CASE WHEN o THEN 'Pursues' ELSE 'Pursued by' END
  WHEN 'depends_on' THEN CASE WHEN o THEN 'Depends on' ELSE 'Depended on by' END WHEN 'contributes_to' THEN CASE WHEN o THEN 'Contributes to' ELSE 'Has contributor' END ELSE 'Relates to' END AS relation,
  other, coalesce(name, title, n.id) AS other_label, x.description, valid FROM x JOIN nodes n ON n.id = other""".replace("type WHEN", "x.type WHEN")))  # fmt: skip
def page_relations(spark, d):
    return pages.relations(sample_graph(spark, d), VIEW)


@query("page_catalog", on_graph("""
, l AS (SELECT type, id, coalesce(name, title, id) AS label, row_number() OVER (PARTITION BY type ORDER BY lower(coalesce(name, title, id)), id) AS no FROM nodes)
SELECT type, CASE type WHEN 'person' THEN 'People' WHEN 'service' THEN 'Services' WHEN 'team' THEN 'Teams' WHEN 'domain' THEN 'Domains' WHEN 'goal' THEN 'Goals' ELSE 'Projects' END AS heading, count(*) AS n,
  string_agg(label, '; ' ORDER BY no) FILTER (no <= 12) AS entries FROM l GROUP BY type"""))  # fmt: skip
def page_catalog(spark, d):
    return pages.catalog(sample_graph(spark, d), VIEW)


@query("page_overview", on_graph("""
, h AS (SELECT id, count(*) AS n, coalesce(any_value(name), any_value(title), id) AS label FROM nodes JOIN (SELECT from_id AS e FROM edges UNION ALL SELECT to_id FROM edges) ON id = e GROUP BY id)
SELECT 'nodes' AS section, type AS item, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edges', type, count(*) FROM edges GROUP BY type
UNION ALL SELECT 'hubs', id, n FROM (SELECT * FROM h ORDER BY n DESC, lower(label), id LIMIT 10)"""))  # fmt: skip
def page_overview(spark, d):
    return pages.overview(sample_graph(spark, d), VIEW)


_REL = "CASE x.type WHEN 'member_of' THEN CASE WHEN o THEN 'Member of' ELSE 'Has member' END WHEN 'in_domain' THEN CASE WHEN o THEN 'In domain' ELSE 'Includes' END WHEN 'pursues' THEN CASE WHEN o THEN 'Pursues' ELSE 'Pursued by' END WHEN 'depends_on' THEN CASE WHEN o THEN 'Depends on' ELSE 'Depended on by' END WHEN 'contributes_to' THEN CASE WHEN o THEN 'Contributes to' ELSE 'Has contributor' END ELSE 'Relates to' END"
_KEYS = ("brand", "name", "priority", "segment", "status", "summary", "title")
_OWN = "list_filter([" + ", ".join(f"'{k}: \"' || {k} || '\"'" for k in _KEYS) + "], lambda v: v IS NOT NULL)"
_LABEL = "coalesce(name, title, id)"
_KIND = "CASE type WHEN 'person' THEN 'Person' WHEN 'service' THEN 'Service' WHEN 'team' THEN 'Team' WHEN 'domain' THEN 'Domain' WHEN 'goal' THEN 'Goal' ELSE 'Project' END"


@query("entity_pages", on_graph(rf"""
, x AS (SELECT id AS edge, from_id AS id, to_id AS other, type, true AS o, coalesce(description, reason, note) AS said, {_VALID} AS valid, ns, src, description, reason, note, lines FROM edges
  UNION ALL SELECT id, to_id, from_id, type, false, coalesce(description, reason, note), {_VALID}, ns, src, description, reason, note, lines FROM edges),
y AS MATERIALIZED (SELECT x.*, {_REL} AS relation, coalesce(n.name, n.title, n.id) AS title FROM x JOIN nodes n ON n.id = other),
gr AS (SELECT id, relation, o, type, string_agg('- [[' || replace(other, ':', '-') || '|' || title || ']]' || coalesce(' — ' || said, '') || CASE WHEN valid = 'always' THEN '' ELSE ' _(' || valid || ')_' END, chr(10) ORDER BY other, edge) AS ls, list_sort(list(DISTINCT replace(other, ':', '-'))) AS slugs FROM y GROUP BY ALL),
co AS (SELECT id, string_agg('### ' || relation || E'\n\n' || ls, E'\n\n' ORDER BY relation, NOT o, type) AS connections, string_agg(type || ':' || chr(10) || array_to_string(list_transform(slugs, lambda v: '  - "[[' || v || ']]"'), chr(10)), chr(10) ORDER BY type) FILTER (o) AS targets FROM gr GROUP BY id),
fa AS (SELECT id, string_agg('- `' || edge || '` — ' || relation || ' ' || title || '; namespaces: ["' || ns || '"]' || CASE WHEN valid = 'always' THEN '' ELSE '; validity: ' || valid END || '; sources: `' || src || '`' ||
  CASE WHEN coalesce(description, reason, note, lines) IS NULL THEN '' ELSE '; properties: `{{' || concat_ws(', ', '"description": "' || description || '"', '"lines": "' || lines || '"', '"note": "' || note || '"', '"reason": "' || reason || '"') || '}}`' END, chr(10) ORDER BY edge, NOT o) AS facts FROM y GROUP BY id)
SELECT nodes.id, replace(nodes.id, ':', '-') AS slug, concat_ws(E'\n\n',
  concat_ws(chr(10), '---', 'kind: "node"', 'id: "' || nodes.id || '"', 'type: "' || type || '"', 'ns: ["' || ns || '"]', 'valid_from: "' || coalesce(vf::VARCHAR, '') || '"', 'valid_to: "' || coalesce(vt::VARCHAR, '') || '"', 'sources:', '  - "' || src || '"',
    'tags: ["' || type || '", "' || ns || '", "entity"]', 'aliases: ["' || coalesce(name, title) || '"]', 'props:', array_to_string(list_transform({_OWN}, lambda v: '  ' || v), chr(10)), array_to_string({_OWN}, chr(10)), targets, '---'),
  '# ' || coalesce(name, title), '> ' || coalesce(summary, coalesce(name, title) || ' — ' || {_KIND} || '.'),
  '## At a glance' || chr(10) || chr(10) || concat_ws(chr(10), '- **Type:** ' || {_KIND}, '- **Status:** ' || status, '- **Brand:** ' || brand, '- **Priority:** ' || priority, '- **Segment:** ' || segment),
  '## Connections' || E'\n\n' || connections, CASE WHEN vf IS NOT NULL THEN '## Timeline' || E'\n\n' || concat_ws(chr(10), '- **' || vf || '**: Valid from', '- **' || vt || '**: Valid until') END,
  '## Sources' || E'\n\n- `' || src || '`', '## Technical details' || E'\n\n- **Fact ID:** `' || nodes.id || E'`\n- **Namespaces:** ["' || ns || E'"]\n- **Validity:** ' || {_VALID} || coalesce(E'\n\n### Relationship facts\n\n' || facts, '')) || chr(10) AS body
FROM nodes LEFT JOIN co ON co.id = nodes.id LEFT JOIN fa ON fa.id = nodes.id"""))  # fmt: skip
def entity_pages(spark, d):
    return pages.entity_pages(sample_graph(spark, d), VIEW)


_CATALOG_LINE = f"'- [[' || replace(id, ':', '-') || '|' || {_LABEL} || ']]' || CASE WHEN coalesce(summary, status, vf::VARCHAR) IS NULL THEN '' ELSE ' — ' || concat_ws(' · ', summary, 'status: ' || status, 'since ' || vf) END"


@query("index_sections", on_graph(rf"""
, w AS (SELECT 'Goals and projects' AS section, row_number() OVER (ORDER BY type, lower({_LABEL}), id) AS place, {_CATALOG_LINE} AS line FROM nodes WHERE type IN ('goal', 'project')),
p AS (SELECT 'People and teams' AS section, row_number() OVER (ORDER BY lower({_LABEL}), id) AS place, {_CATALOG_LINE} AS line FROM nodes WHERE type IN ('person', 'team')),
dg AS (SELECT id, count(*) AS degree FROM nodes JOIN (SELECT from_id AS e FROM edges UNION ALL SELECT to_id FROM edges) ON id = e GROUP BY id),
h AS (SELECT 'Key connected entities' AS section, row_number() OVER (ORDER BY degree DESC, lower({_LABEL}), id) AS place, '- [[' || replace(id, ':', '-') || '|' || {_LABEL} || ']] — ' || degree || ' connections' AS line FROM nodes JOIN dg USING (id)),
t AS (SELECT 'Browse by type' AS section, row_number() OVER (ORDER BY type) AS place, '- [[catalog#' || k || '|' || k || ']] (' || n || ')' AS line FROM (SELECT type, CASE type WHEN 'person' THEN 'People' WHEN 'service' THEN 'Services' WHEN 'team' THEN 'Teams' WHEN 'domain' THEN 'Domains' WHEN 'goal' THEN 'Goals' ELSE 'Projects' END AS k, count(*) AS n FROM nodes GROUP BY type))
SELECT section, CAST(place AS INTEGER) AS place, line FROM (SELECT * FROM w WHERE place <= 12 UNION ALL SELECT * FROM p WHERE place <= 12 UNION ALL SELECT * FROM h WHERE place <= 10 UNION ALL SELECT * FROM t)"""))  # fmt: skip
def index_sections(spark, d):
    return pages.index_sections(sample_graph(spark, d), VIEW)


@query("node_aliases", on_graph("SELECT id, coalesce(name, title) AS alias FROM nodes"))
def node_aliases(spark, d):
    return sample_graph(spark, d).nodes.select("id", F.explode(pages.node_aliases()).alias("alias"))
