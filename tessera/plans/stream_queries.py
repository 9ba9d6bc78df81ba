"""Queries over streams, transcripts and compilation, and the same in SQL. Importing it registers them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import journal, sessions
from tessera.operators.components import own_dir
from tessera.plans import compile as building
from tessera.plans import data_queries as data
from tessera.plans.queries import _EDGE_BODY, _EDGES, _NODE_BODY, SQL, on_graph, query, table
from tessera.sources import files, transcripts
from tessera.streaming import streams


@query("session_window_stream", SQL["session_window_batch"])
def session_window_stream(spark, d):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    found = streams.collected_sessions(streams.table_stream(spark, d, "events"))
    return found.select("user_id", F.col("started").cast("string").alias("started"), "n")


@query("session_windows_final", SQL["session_window_batch"] + " HAVING max(ts) + INTERVAL 300 SECOND <= (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND")
def session_windows_final(spark, d):
    """The sessions that the watermark, an hour behind the last event, has passed."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    root = f"{own_dir(spark)}/final-{uuid.uuid4().hex}"
    found = streams.final_sessions(streams.table_stream(spark, d, "events"), f"{root}/out", f"{root}/checkpoint")
    return found.select("user_id", F.col("started").cast("string").alias("started"), "n")


@query("journal_stream", "SELECT 'user:' || user_id AS id, count(*) AS facts, CAST(max(event_id) AS VARCHAR) AS last FROM events WHERE event_type IN ('click', 'view') AND event_id % 101 >= 50 GROUP BY 1")
def journal_stream(spark, d):
    start = spark.createDataFrame([], "id string, facts long, last long")

    def merge(held, batch):
        new = batch.where(F.col("event_type").isin("click", "view")).where(journal.gate((F.col("event_id") % 101) / 100.0) != "quarantined")
        new = new.groupBy(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("id")).agg(F.count("*").alias("facts"), F.max("event_id").alias("last"))
        return held.unionByName(new).groupBy("id").agg(F.sum("facts").alias("facts"), F.max("last").alias("last"))

    user = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    return streams.merge_stream(streams.table_stream(spark, d, "events"), start, merge, state_key=F.col("id"), entry_key=user).withColumn("last", F.col("last").cast("string"))


def _queue(e):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(
        F.concat(F.lit("agent/"), F.col("user_id").cast("string")).alias("key"), at.alias("received_at"), F.when(F.col("event_type") == "error", "session_end").otherwise(F.col("event_type")).alias("trigger"),
        (F.col("event_id") % 12).cast("int").alias("attempts"), F.when(F.col("event_id") % 12 > 0, at + 10).alias("last_attempt_at"),
    )


@query("event_queue_state", """
WITH q AS (SELECT 'agent/' || user_id AS key, epoch_us(ts) / 1e6 AS tm, CASE WHEN event_type = 'error' THEN 'session_end' ELSE event_type END AS trigger, event_id % 12 AS attempts FROM events),
t AS (SELECT max(tm) + 1 AS now FROM q), l AS (SELECT key, arg_max(q, (tm, trigger)) AS e FROM q GROUP BY 1)
SELECT key, e.trigger AS trigger, CASE WHEN e.attempts >= 10 THEN 'dropped' WHEN e.attempts > 0 AND now - (e.tm + 10) < least(300.0, 2.0 ** least(e.attempts, 8)) THEN 'retrying' WHEN e.trigger <> 'session_end' AND now - e.tm < 300 THEN 'waiting' ELSE 'due' END AS state FROM l, t""")  # fmt: skip
def event_queue_state(spark, d):
    """All events, a second after the last of them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    queue = _queue(table(spark, d, "events"))
    last = queue.agg(F.max("received_at")).first()[0]
    return streams.queue_state(streams.coalesced(queue), (last or 0.0) + 1).select("key", "trigger", "state")


_LATER = "[" + ", ".join(str(sum(min(300, 2 ** min(j, 8)) for j in range(1, i)) * 1000) for i in range(1, 11)) + "]"


def _works(key: str, event: int, trigger: str, attempt: int) -> bool:
    """An import that fails as often as its event's number says."""
    if event % 12 >= attempt:
        raise OSError("not yet")
    return True


@query("queue_attempts", f"""
WITH e AS (SELECT 'agent/' || user_id AS key, event_id, CASE WHEN event_type = 'error' THEN 'session_end' ELSE event_type END AS trigger, epoch_us(ts) // 1000 AS ms FROM events),
n AS (SELECT *, lead(ms) OVER (PARTITION BY key ORDER BY ms, event_id) AS later, ms + CASE WHEN trigger = 'session_end' THEN 0 ELSE 300000 END AS due, max(ms) OVER () AS ends FROM e),
t AS (SELECT *, due + list_extract({_LATER}, attempt) AS fell FROM (SELECT *, unnest(range(1, least(event_id % 12 + 1, 10) + 1)) AS attempt FROM n))
SELECT key, event_id, attempt::INTEGER AS attempt, CASE WHEN attempt = event_id % 12 + 1 THEN 'imported' WHEN attempt = 10 THEN 'dropped' ELSE 'failed' END AS outcome, fell AS ms FROM t WHERE fell < coalesce(later, ends)""")  # fmt: skip
def queue_attempts(spark, d):
    """Every attempt at every session of the events, replayed by their own clock; the log stops at its last event."""
    from tessera.streaming.queue import drained_to

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    trigger = F.when(F.col("event_type") == "error", "session_end").otherwise(F.col("event_type"))
    at = F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")))
    events = streams.table_stream(spark, d, "events").select(F.concat(F.lit("agent/"), F.col("user_id").cast("string")).alias("key"), "event_id", trigger.alias("trigger"), at.alias("at"))
    root = f"{own_dir(spark)}/queue-{uuid.uuid4().hex}"
    found, _ = drained_to(events, _works, f"{root}/out", f"{root}/checkpoint")
    return found.select("key", "event_id", "attempt", "outcome", F.unix_millis("at").alias("ms"))


@query("watched_changes", """
WITH n AS (SELECT c_nationkey AS nation, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS few, count(*) FILTER (WHERE c_acctbal > 0) AS rich, count(*) AS every FROM customer GROUP BY 1)
SELECT nation, 1::BIGINT AS version, 'new' AS change FROM n WHERE few > 0
UNION ALL SELECT nation, 2, CASE WHEN few = 0 THEN 'new' WHEN nation % 5 = 0 THEN 'deleted' ELSE 'changed' END FROM n WHERE nation % 5 <> 0 AND few <> rich OR nation % 5 = 0 AND few > 0""")  # fmt: skip
def watched_changes(spark, d):
    """A file a nation says how many customers of a segment it has, then how many with money; every fifth goes."""
    from tessera.sources.pointer import file_system, replace_small
    from tessera.streaming.watch import Watch

    root = f"{own_dir(spark)}/watched-{uuid.uuid4().hex}"
    counts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("some"), F.count_if(F.col("c_acctbal") > 0).alias("rich")).collect()  # a row a nation
    watch = Watch(spark, f"{root}/state", {"texts": (f"{root}/raw", "*.md")}, content=True)
    said = {}
    for step in ("some", "rich"):
        for r in counts:
            path, n = f"{root}/raw/{r['c_nationkey']}.md", r["c_nationkey"]
            if step == "rich" and n % 5 == 0:
                file_system(spark, path)[1].delete(file_system(spark, path)[0], False)
            elif (step == "rich" or r["some"]) and said.get(n) != r[step]:
                replace_small(spark, path, f"{r[step]:09d}")
                said[n] = r[step]
        watch.poll()
    out = f"{root}/out"
    watch.deliver(lambda df: df.write.mode("append").parquet(out))
    return spark.read.parquet(out).select(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("int").alias("nation"), "version", "change")


@query("debounced_changes", """
WITH RECURSIVE c AS MATERIALIZED (SELECT DISTINCT event_type AS key, epoch_us(ts) AS us FROM events),
n AS MATERIALIZED (SELECT c.key, c.us, d.us AS later FROM c ASOF JOIN c d ON c.key = d.key AND c.us + 30000000 <= d.us),
s AS (SELECT key, us FROM (SELECT *, lag(us) OVER (PARTITION BY key ORDER BY us) AS b FROM c) WHERE b IS NULL OR us - b >= 30000000),
r AS (SELECT key, us FROM s UNION SELECT r.key, later FROM r JOIN n USING (key, us))
SELECT key, us / 1e6 AS "at" FROM r""")  # fmt: skip
def debounced_changes(spark, d):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return streams.debounced(e)


@query("retry_backoff", "SELECT DISTINCT CAST(event_id % 12 AS INTEGER) AS attempts, least(300.0, 2.0 ** least(event_id % 12, 8))::DOUBLE AS seconds FROM events")
def retry_backoff(spark, d):
    n = (F.col("event_id") % 12).cast("int")
    return table(spark, d, "events").select(n.alias("attempts"), streams.backoff(n).alias("seconds")).distinct()


@query("journal_log", """
SELECT 'e' || event_id AS entry_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'merged' WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 'quarantined' ELSE 'pending' END AS status FROM events""")
def journal_log(spark, d):
    """All events as entries in two commits, with statuses before, between and after, and a folding."""
    from tessera.sources.journal_log import JournalLog

    e = table(spark, d, "events").select(F.col("event_id"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("entry_id"))
    entry = e.select("event_id", *[(F.col("entry_id") if c == "entry_id" else F.lit("pending") if c == "status" else F.lit(None)).cast(t).alias(c) for c, t in spark.createDataFrame([], journal.ENTRY).dtypes])
    said = lambda rule, s: e.where(rule).select(F.col("entry_id").alias("key"), F.lit(s).alias("new_status"))
    log = JournalLog(spark, f"{own_dir(spark)}/log-{uuid.uuid4().hex}")
    log.set_status(said("event_id % 7 = 0", "flagged"))
    log.append(entry.where("event_id % 2 = 0"))
    log.set_status(said("event_id % 3 = 0", "merged"))
    log.append(entry.where("event_id % 2 = 1"))
    log.compact()
    log.set_status(said("event_id % 3 = 0 OR event_id % 5 = 0", "quarantined"))
    return log.read().select("entry_id", "status")


#: How each format writes a message of the conversations table, as JSON.
_WRITTEN = {
    "nested": lambda r, t: F.to_json(F.struct(r.alias("type"), F.struct(r.alias("role"), F.array(F.struct(F.lit("text").alias("type"), t.alias("text"))).alias("content")).alias("message"))),
    "rollout": lambda r, t: F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), r.alias("role"), F.array(F.struct(F.lit("input_text").alias("type"), t.alias("text"))).alias("content")).alias("payload"))),
    "typed": lambda r, t: F.to_json(F.struct(r.alias("type"), t.alias("content"))),
    "dotted": lambda r, t: F.to_json(F.struct(F.concat(r, F.lit(".message")).alias("type"), F.struct(t.alias("content")).alias("data"))),
    "plain": lambda r, t: F.to_json(F.struct(F.when(r == "user", "Human").otherwise(r).alias("role"), t.alias("text"))),
}


def _transcript(kind: str) -> None:
    @query(f"transcript_{kind}", SQL["turn_pairing"])
    def transcript(spark, d):
        c = table(spark, d, "conversations")
        lines = c.select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), _WRITTEN[kind](F.col("role"), F.col("text")).alias("value"))
        found = sessions.turns(transcripts.FORMATS[kind](lines), "session", "pos")
        return found.select("session", "turn_no", F.sha2("user_content", 256).alias("user_sha"), F.sha2("assistant_text", 256).alias("assistant_sha"))


for _kind in _WRITTEN:
    _transcript(_kind)


_MAIL = r"""
WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '([a-z0-9.]+)@([a-z0-9]+)\.example\.com')) AS m FROM documents),
p AS MATERIALIZED (SELECT DISTINCT doc_id, regexp_extract(m, '^([a-z0-9.]+)@', 1) AS u, regexp_extract(m, '@([a-z0-9]+)\.', 1) AS h FROM a)
"""


@query("compile_nodes", _MAIL + "SELECT 'person:' || u AS id, 'person' AS type, u AS name FROM p UNION SELECT 'team:' || h, 'team', h FROM p")
def compile_nodes(spark, d):
    out = building.compile_graph(data._docs(spark, d), building.email_rules)
    return out["nodes"].select("id", "type", F.try_element_at("props", F.lit("name")).alias("name"))


@query("compile_edges", _MAIL + "SELECT 'member_of' AS type, 'person:' || u AS from_id, 'team:' || h AS to_id FROM p GROUP BY ALL")
def compile_edges(spark, d):
    return building.compile_graph(data._docs(spark, d), building.email_rules)["edges"].select("type", "from_id", "to_id")


# ---------------------------------------------------------------- proposals and answers


@query("proposal_checks", """
WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'link' WHEN 2 THEN 'update' ELSE 'merge' END AS op, 'cust:' || (user_id * 20) AS a, 'cust:' || (event_id % 1500) AS b FROM events),
seen AS (SELECT 'cust:' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) IN ('europe', 'middle east'))
SELECT event_id, CASE WHEN op = 'create' AND a IN (SELECT id FROM seen) THEN 'already there' WHEN op = 'update' AND a NOT IN (SELECT id FROM seen) THEN 'no such node'
  WHEN op IN ('link', 'merge') AND (a NOT IN (SELECT id FROM seen) OR b NOT IN (SELECT id FROM seen)) THEN 'end not visible' WHEN op = 'merge' AND a = b THEN 'one node' END AS error FROM p""")  # fmt: skip
def proposal_checks(spark, d):
    return _checked(spark, d, table(spark, d, "events"))


def _checked(spark, d, events):
    from tessera.operators import propose
    from tessera.plans.queries import SCOPE, VIEW
    from tessera.sources.graph_view import sample_graph

    n = F.col("event_id") % 4
    a, b = F.concat(F.lit("cust:"), (F.col("user_id") * 20).cast("string")), F.concat(F.lit("cust:"), (F.col("event_id") % 1500).cast("string"))
    p = events.select(
        "event_id", F.when(n == 0, "create").when(n == 1, "link").when(n == 2, "update").otherwise("merge").alias("operation"), F.when(n.isin(0, 2), a).alias("id"),
        F.when(n == 1, "collaborates_with").otherwise("person").alias("type"), F.when(n.isin(1, 3), a).alias("from_id"), F.when(n.isin(1, 3), b).alias("to_id"),
    )
    return propose.checked(p, sample_graph(spark, d), SCOPE, VIEW).select("event_id", "error")


@query("json_merge", """SELECT event_id, '{"a":' || user_id || ',"f":1.5,"k":{"x":1,"y":' || event_id || '},"l":[1,"2",null],"n":true,"z":"t"}' AS merged FROM events""")
def json_merge(spark, d):
    from tessera.operators import propose

    n = F.col("event_id").cast("string")
    ours = F.concat(F.lit('{"k": {"x": 1, "y": 0}, "z": "o", "l": [3], "n": true, "a": '), F.col("user_id").cast("string"), F.lit("}"))
    theirs = F.concat(F.lit('{"z": "t", "l": [1, "2", null], "f": 1.5, "k": {"y": '), n, F.lit("}}"))
    return table(spark, d, "events").select("event_id", propose.merged_json(ours, theirs).alias("merged"))


@query("index_search", SQL["term_and_search"])
def index_search(spark, d):
    from tessera.operators import search
    from tessera.sources.graph_view import sample_graph

    return search.index_search(search.token_index(search.node_text(sample_graph(spark, d).nodes)), "brand#4 bolt", 25).select("id", "type")


@query("published_index", on_graph(f"""
, t AS (SELECT 'nodes' AS kind, id, type, {_NODE_BODY} AS body FROM nodes UNION ALL SELECT 'facts', e.id, e.type, {_EDGE_BODY} FROM {_EDGES}),
x AS (SELECT kind, id, type, ' ' || trim(regexp_replace(lower(body), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' AS x FROM t),
q AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY type, id) - 1 AS INTEGER) AS place FROM x WHERE contains(x, ' blue ') AND contains(x, ' bolt '))
SELECT kind, type, id, place FROM q WHERE place < 40"""))  # fmt: skip
def published_index(spark, d):
    """Nodes and facts with two words, from the index that was published with the graph."""
    from tessera.plans import publication
    from tessera.sources.graph_view import sample_graph

    g, root = sample_graph(spark, d), f"{own_dir(spark)}/indexed-{uuid.uuid4().hex}"
    publication.publish_graph(g, root, "1", spark.range(1), index=True)
    index = publication.Published(spark, root).index()
    of = lambda kind: index.find("blue bolt", 40, kind).select(F.lit(kind).alias("kind"), "type", "id", "place")
    return of("nodes").unionByName(of("facts"))
