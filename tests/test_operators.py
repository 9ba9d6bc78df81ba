"""Boundaries and small cases of the graph operators."""

import json
import random
import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.functions.redaction import redacted
from tessera.operators import answers, evaluate, health, journal, lookup, pages, resolve, scope, search, sessions, stats, traversal
from tessera.operators.components import connected_components
from tessera.plans import publication, queries, stream_queries
from tessera.plans.compile import compile_graph, recovered
from tessera.plans.graph import EDGE_SCHEMA, NODE_SCHEMA, Graph
from tessera.plans.ontology import Ontology
from tessera.sources import files, transcripts
from tessera.streaming import streams


def node(i, type_="service", ns=("public",), vf=None, vt=None, props=None, src=("a.md:1",), pos=0):
    return (i, type_, list(ns), vf, vt, props or {}, list(src), None, pos)


def edge(i, a, b, type_="depends_on", ns=("public",), vf=None, vt=None, props=None, src=("a.md:1",), pos=0):
    return (i, type_, list(ns), vf, vt, props or {}, list(src), None, a, b, pos)


def graph(spark, nodes, edges):
    return Graph(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA))


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_half_open_validity(spark):
    g = graph(spark, [node("a"), node("b")], [edge("e", "a", "b", vf=date(2024, 1, 15), vt=date(2025, 3, 1))])
    on = lambda t: ids(lookup.snapshot(g, t).edges)
    assert on("2024-01-14") == [] and on("2024-01-15") == ["e"] and on("2025-02-28") == ["e"] and on("2025-03-01") == []
    assert [r["change"] for r in lookup.changes(g, "2024-01-01", "2025-03-02").orderBy("change").collect()] == ["began", "ended"]
    assert lookup.changes(g, "2024-01-16", "2025-03-01").count() == 0


def test_temporal_query_validates(spark):
    g = graph(spark, [node("a")], [])
    with pytest.raises(ValueError):
        lookup.temporal_query(g, "snapshot")
    with pytest.raises(ValueError):
        lookup.temporal_query(g, "other", time="2024-01-01")


def test_scopes(spark):
    g = graph(
        spark,
        [node("a", ns=["x"]), node("b", ns=["y"]), node("c", ns=["x", "y"]), node("d")],
        [edge("ab", "a", "b", ns=["x"]), edge("ac", "a", "c", ns=["x"]), edge("cd", "c", "d", ns=["z"])],
    )
    s = scope.scoped(g, ["x", "public"])
    assert ids(s.nodes) == ["a", "c", "d"] and ids(s.edges) == ["ac"]
    assert scope.effective(g, ["x*", "literal"]) == ["literal", "public", "x"]
    assert scope.effective(g, ["X*"]) == ["public"]  # case counts


def test_walks_through_hidden_nodes_but_measures_around_them(spark):
    g = graph(spark, [node("a"), node("h", ns=["secret"]), node("b")], [edge("ah", "a", "h"), edge("hb", "h", "b")])
    nodes, edges = traversal.scoped_neighbors(g, ["public"], "a", depth=2)
    assert ids(nodes) == ["a", "b"] and ids(edges) == []
    assert ids(traversal.scoped_neighbors(g, ["public"], "a", depth=2, strict=True)[0]) == ["a"]
    assert ids(traversal.scoped_distances(g, ["public"], "a")) == ["a"]


def test_random_walks(spark):
    rnd = random.Random(3)
    names = [f"n{i}" for i in range(30)]
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(40)]
    g = graph(spark, [node(n) for n in names], [edge(f"e{i}", a, b) for i, (a, b) in enumerate(pairs)])
    near = {n: set() for n in names}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    dist, level = {"n0": 0}, {"n0"}
    for d in range(1, 5):
        level = {y for x in level for y in near[x]} - dist.keys()
        dist |= dict.fromkeys(level, d)
    assert {r["id"]: r["dist"] for r in traversal.distances(g.nodes, g.edges, ["n0"]).collect()} == dist
    links = spark.createDataFrame(pairs, "a string, b string")
    root = {n: n for n in names}
    for _ in names:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in connected_components(links).collect()} == {n: root[n] for n in linked}
    reach = {n: set() for n in names}
    for _ in names:
        for a, b in pairs:
            reach[a] |= {b} | reach[b]
    assert ids(traversal.on_cycle(g.edges)) == sorted(n for n in names if n in reach[n])


def test_pages_print_every_relation(spark):
    g = graph(spark, [node("hub"), *(node(f"n{i}") for i in range(250))], [edge(f"e{i}", f"n{i}", "hub") for i in range(250)])
    body = {r["id"]: r["body"] for r in pages.entity_pages(g, Ontology()).collect()}["hub"]
    said = body.split("## Connections")[1].split("## Sources")[0]
    assert sum(x.startswith("- ") for x in said.splitlines()) == 250 and body.count("; namespaces: ") == 250


def test_pages_of_odd_nodes(spark):
    props = {"name": "A | b", "description": "First.\r\n\nSecond.", "summary": "S", "image_links": '["https://x/1.png", "ftp://no"]', "yes": "1", "tags": "own", "role_id": "r", "list": '["a", 1]'}
    g = graph(spark, [node("svc:a", props=props, vf=date(2024, 1, 1), src=()), node("t", type_="odd_type")], [edge("e", "svc:a", "gone", type_="owns", props={"note": "n"}), edge("f", "svc:a", "t", type_="tags")])
    body = {r["id"]: r["body"] for r in pages.entity_pages(g, Ontology()).collect()}
    a = body["svc:a"]
    for line in ('sources: []', '"yes": "1"', '  tags: "own"', 'list: ["a", 1]', "relation_tags:", 'owns:\n  - "[[gone]]"', "# A | b", "> S", "## About\n\nFirst.\n\nSecond.", "- **Role ID:** r", "## Images\n\n![](https://x/1.png)", "- `gone` — n", "## Timeline\n\n- **2024-01-01**: Valid from"):
        assert line in a, line
    assert "ftp" not in a.split("## Images")[1].split("##")[0] and "> t — Odd Type." in body["t"] and "## Timeline" not in body["t"] and "aliases" not in body["t"]
    assert "## Sources" not in a and 'properties: `{"note": "n"}`' in a and "[[svc-a|A \\| b]]" in body["t"]


def test_all_proposals_are_checked(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    shifted = events.withColumn("event_id", F.col("event_id") + 5000)
    assert stream_queries._checked(spark, sf, shifted).count() == events.count() == stream_queries.proposal_checks(spark, sf).count()


def test_queue_holds_every_key(spark, sf):
    keys = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    assert stream_queries.event_queue_state(spark, sf).count() == keys


def test_cycles_of_all_lineitems(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect()
    out = {}
    for a, b in rows:
        out.setdefault(a, set()).add(b)

    def reached(a):
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    want = sorted(f"supp:{a}" for a in out if a in reached(a))
    assert sorted(r["id"] for r in queries.directed_cycles(spark, sf).collect()) == want


def test_long_chain_and_empty_components(spark):
    chain = spark.range(0, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(chain).where("root <> 0").count() == 0
    assert connected_components(chain.limit(0)).count() == 0


def test_typed_hops_leave_out_generic_edges(spark):
    g = graph(spark, [node(x) for x in "abcd"], [edge("e1", "a", "b"), edge("e2", "b", "c"), edge("e3", "a", "d", type_="relates_to")])
    assert [(r["hop"], r["rank"]) for r in traversal.typed_hops(lookup.get_edge(g, "e1"), g.edges).collect()] == [("e2", 1)]


def test_search_modes(spark):
    g = graph(spark, [node("svc:pay-api", props={"name": "Pay API", "note": "billing core"}), node("svc:x", props={"name": "Other"})], [])
    text = search.node_text(g.nodes)
    assert ids(search.search(text, "pay api", 5)) == ["svc:pay-api"]
    assert ids(search.search(text, "core billing", 5)) == []
    assert ids(search.search(text, "core billing", 5, "terms")) == ["svc:pay-api"]
    assert ids(search.search(text, "pay-api", 5, "terms")) == ["svc:pay-api"]


def test_score_formula(spark):
    df = spark.createDataFrame([(0, "depends_on", 1), (2, "relates_to", None), (0, "same_as", 0), (0, "made_up", None)], "i int, t string, d int")
    got = [r[0] for r in df.select(search.fact_score(F.col("i"), F.col("t"), F.col("d"))).collect()]
    want = [1 / 10 * 1.5 * 1.0, 1 / 12 * 0.65 * 0.95, 1 / 10 * 0.7 * 1.5, 1 / 10 * 1.0 * 0.95]
    assert got == pytest.approx(want)


def test_quality_of_small_and_empty_graphs(spark):
    g = graph(spark, [node("a", props={"name": "A", "summary": "s"}), node("b", props={"name": " a "})], [edge("e", "a", "b", type_="relates_to")])
    q = stats.content_quality(g, Ontology()).first()
    assert (q.node_label_coverage, q.node_summary_coverage, q.edge_description_coverage, q.generic_edge_ratio, q.duplicate_label_count) == (1.0, 0.5, 0.0, 1.0, 1)
    q = stats.content_quality(graph(spark, [], []), Ontology()).first()
    assert (q.node_label_coverage, q.generic_edge_ratio, q.duplicate_label_count) == (1.0, 0.0, 0)


def test_resolution(spark):
    nodes = [
        node("svc:Pay_API", props={"name": "Pay", "description": "First part.", "summary": "short"}, src=("a.md:1",), ns=["x"]),
        node("svc:pay-api", props={"name": "Pay API", "description": "Second part.\n\nfirst part.", "summary": "a longer summary"}, src=("b.md:1",)),
        node("svc:old", props={"name": "Old"}, src=("c.md:1",)),
        node("person:p", type_="person"),
        node("thing:t", type_="thing"),
    ]
    edges = [
        edge("s", "svc:old", "svc:pay-api", type_="same_as"), edge("o", "person:p", "svc:old", type_="owns"), edge("o2", "person:p", "svc:Pay_API", type_="owns", src=("z.md:9",)),
        edge("d", "svc:old", "svc:gone"), edge("w", "svc:old", "person:p", type_="owns"), edge("x", "person:p", "svc:old", type_="same_as"),
    ]
    g = graph(spark, nodes, edges)
    out = resolve.resolve(g.nodes, g.edges, ontology=Ontology())
    got = {r["id"]: r for r in out["nodes"].collect()}
    assert set(got) == {"svc:pay-api", "person:p"}
    pay = got["svc:pay-api"]
    assert pay["ns"] == ["public", "x"] and pay["src"] == ["a.md:1", "b.md:1", "c.md:1"]
    assert pay["props"]["name"] == "Old" and pay["props"]["summary"] == "a longer summary"
    assert pay["props"]["description"] == "First part.\n\nSecond part."
    assert pay["props"]["merged_ids"] == '["svc:Pay_API","svc:old"]'
    assert [(r["id"], r["src"]) for r in out["edges"].collect()] == [("e_owns_0001", ["a.md:1", "z.md:9"]), ("e_same_as_0002", ["a.md:1"])]
    assert {r["id"]: r["reason"] for r in out["quarantine"].collect()} == {"thing:t": "unknown node type (thing)", "s": "self-loop", "d": "dangling endpoint", "w": "invalid edge endpoints"}


def test_alias_chains_and_cycles(spark):
    pairs = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x")]
    got = {r["alias"]: r["canonical"] for r in resolve.followed(spark.createDataFrame(pairs, "alias string, canonical string")).collect()}
    assert got == {"a": "c", "b": "c", "y": "x", "z": "x"}


def test_alias_chains_by_hand(spark):
    """Long chains, tails into cycles, loops, and repeated pairs."""
    rnd = random.Random(8)
    to = {f"N{i}": f"N{i + 1}" for i in range(100)} | {f"t{i}": f"t{i + 1}" for i in range(20)} | {"t20": "t7", "self": "self", "s": "self"}
    to |= {f"r{i}": f"r{rnd.randrange(60)}" for i in range(50)}

    def end(x):
        seen = []
        while x in to and to[x] != x and x not in seen:
            seen.append(x)
            x = to[x]
        return x if x not in seen else min(seen[seen.index(x) :], key=lambda i: (i.lower(), i))

    rows = list(to.items()) * 2
    got = {r["alias"]: r["canonical"] for r in resolve.followed(spark.createDataFrame(rows, "alias string, canonical string")).collect()}
    assert got == {a: end(a) for a in to if end(a) != a}
    assert resolve.followed(spark.createDataFrame([], "alias string, canonical string")).count() == 0


def test_gate_boundaries(spark):
    df = spark.createDataFrame([(0.8,), (0.5,), (0.4999,)], "c double")
    assert [r[0] for r in df.select(journal.gate(F.col("c"))).collect()] == ["merged", "flagged", "quarantined"]


def test_self_heal_is_idempotent(spark):
    g = graph(spark, [node("a"), node("b"), node("c")], [edge("e1", "a", "b"), edge("e2", "a", "b"), edge("e3", "b", "a"), edge("e4", "a", "gone")])
    fixed, report = health.self_heal(g)
    assert sorted((r["action"], r["id"]) for r in report.collect()) == [("circular_dependency", "a"), ("circular_dependency", "b"), ("deduped", "e2"), ("orphan", "c"), ("removed", "e4")]
    assert [r["action"] for r in health.self_heal(fixed)[1].collect() if r["action"] in ("removed", "deduped")] == []


def test_greedy_batches():
    assert list(sessions.bounds([10, 10, 10, 10], 20, 1)) == [(0, 2), (1, 3), (2, 4)]
    assert list(sessions.bounds([50, 5], 20, 2)) == [(0, 1), (1, 2)]
    assert list(sessions.bounds([], 20, 2)) == []


def test_rendered_batches(spark):
    msgs = spark.createDataFrame([("s", 0, "user", "hi"), ("s", 1, "assistant", "yo"), ("s", 2, "user", "bye")], "conv_id string, turn int, role string, text string")
    t = sessions.turns(msgs)
    body = sessions.rendered(t, sessions.batches(t, 3, 0), "n-session").orderBy("batch").first()["body"]
    assert body == "---\nsource: n-session\nsession: s\nbatch: 000\nturns: 1\n---\n\n## Turn 1\n\n**User:** hi\n\n**Assistant:** yo\n"


def test_precision_of_nothing(spark):
    none = spark.createDataFrame([], "k string")
    r = evaluate.precision_recall_f1(none, none).first()
    assert (r.precision, r.recall, r.f1) == (1.0, 1.0, 1.0)


def test_redaction(spark):
    cases = {
        "password: hunter2, bearer abc.def https://u:p@h/?token=1&x=2 sk-abcdefghijkl": "password: [REDACTED], bearer [REDACTED] https://[REDACTED]@h/?token=[REDACTED]&x=2 [REDACTED]",
        "api-key=a;b ACCESS_TOKEN = c d authToken:e,f my.passwd =g": "api-key=[REDACTED];b ACCESS_TOKEN = [REDACTED] d authToken:[REDACTED],f my.passwd =[REDACTED]",
        '{"client_secret":"x"} Authorization: Bearer t0k.en~1': '{"client_secret":[REDACTED] Authorization: Bearer [REDACTED]',
        "postgres://me@db:5432/x http://h/a@b http://h?q=a@b&key=1#f": "postgres://[REDACTED]@db:5432/x http://h/a@b http://h?q=a@b&key=[REDACTED]#f",
        "or-short for-the-or-abcdefghijklmn (pk-aaaa-bbbb-cccc)!": "or-short for-the-[REDACTED] ([REDACTED])!",
        "secret; a password is, secretary: no, monkey=1, a:b=c, 12:30": "secret; a password is, secretary: no, monkey=1, a:b=c, 12:30",
        "password:": "password:", "": "", " \n": " \n", "password =": "password =", "a=:": "a=:",
    }
    got = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, w string").select("t", "w", redacted(F.col("t")).alias("g")).collect()
    assert all(r.g == r.w for r in got), [(r.t, r.g) for r in got if r.g != r.w]
    r = spark.createDataFrame([("in /home/me/x", None)], "t string, n string").select(redacted(F.col("t"), "/home/me"), redacted(F.col("n"))).first()
    assert tuple(r) == ("in ~/x", None)


def test_facts_round_trip(spark, tmp_path):
    g = graph(spark, [node("a", vf=date(2024, 1, 1), props={"name": "A"})], [edge("e", "a", "a", props={"k": "v"})])
    files.write_facts(g, str(tmp_path / "facts"), 1)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "facts")).collect()]
    assert lines[0].startswith('{"from":"a","id":"e"') and '"valid_to":null' in lines[1]
    back = files.read_graph(spark, str(tmp_path / "facts"))
    assert ids(back.nodes) == ["a"] and back.nodes.first()["valid_from"] == date(2024, 1, 1) and back.edges.first()["props"] == {"k": "v"}
    assert len(files.facts_hash(g).first()[0]) == 16


def test_documents_and_chunks(spark, tmp_path):
    (tmp_path / "backend").mkdir()
    (tmp_path / "backend" / "a.md").write_text("\n".join(f"l{i}" for i in range(5)) + "\n")
    (tmp_path / "top.md").write_text(" \n \n")
    docs = files.read_documents(spark, str(tmp_path))
    got = files.chunks(docs, 2).orderBy("start_line").collect()
    assert [(r.path, r.start_line, r.end_line, r.namespace) for r in got] == [("backend/a.md", 1, 2, "backend"), ("backend/a.md", 3, 4, "backend"), ("backend/a.md", 5, 5, "backend")]


def test_sqlite_source(spark, tmp_path):
    import sqlite3

    con = sqlite3.connect(tmp_path / "x.db")
    con.execute("CREATE TABLE session (id TEXT, project_id TEXT, time_updated INTEGER)")
    con.executemany("INSERT INTO session VALUES (?, ?, ?)", [(f"s{i}", "p" if i % 2 else "q", i) for i in range(20)])
    con.commit()
    con.close()
    spark.dataSource.register(transcripts.SQLiteSource)
    df = spark.read.format("sqlite").schema("id string, project_id string, time_updated long").option("path", str(tmp_path / "x.db")).option("table", "session").load()
    projects = spark.createDataFrame([("p", "/w")], "id string, worktree string")
    assert df.count() == 20 and transcripts.current_session(df, projects, "/w").first()["id"] == "s19"


def test_json_recovery():
    assert recovered('Sure:\n```json\n{"nodes": [1, 2,], "s": "}"}\n``` done') == '{"nodes": [1, 2], "s": "}"}'
    assert recovered("no object") is None and recovered(None) is None


def test_compile_uses_its_cache(spark):
    docs = spark.createDataFrame([("a.md", "ann@mail1.example.com"), ("b.md", "nothing")], "path string, text string")
    from tessera.plans.compile import email_rules

    out = compile_graph(docs, email_rules)
    assert ids(out["nodes"]) == ["person:ann", "team:mail1"] and out["edges"].count() == 1

    def fails(text):
        raise RuntimeError("called")

    again = compile_graph(docs, fails, cache=out["replies"])
    assert ids(again["nodes"]) == ["person:ann", "team:mail1"] and again["replies"].where("error is not null").count() == 0
    assert compile_graph(docs, fails)["replies"].where("error like '%called%'").count() == 2


def test_drained_stream(spark, tmp_path):
    rows = [("a/1", "2024-01-01 00:00:00", "turn"), ("a/1", "2024-01-01 00:01:00", "session_end"), ("a/2", "2024-01-01 00:00:30", "turn"), ("a/3", "2024-01-01 01:00:00", "turn")]
    spark.createDataFrame(rows, "key string, at string, trigger string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at timestamp, trigger string").parquet(str(tmp_path / "in"))
    got = []
    streams.run_available(streams.drained(stream), lambda df, _: got.extend((r["key"], r["closed_by"], r["n"]) for r in df.collect()))
    assert ("a/1", "exact", 2) in got and ("a/2", "idle", 1) in got


def test_payloads(spark):
    df = spark.createDataFrame([('{"properties": {"sessionId": "s"}}',), ("[1]",)], "p string")
    assert [tuple(r) for r in df.select(streams.payload_value(F.col("p"), "session_id", "sessionId"), F.coalesce(streams.accepted_payload(F.col("p")), F.lit(False))).collect()] == [("s", True), (None, False)]


def test_same_result_for_any_number_of_partitions(spark, sf):
    from tessera.plans.data_queries import resolve_edges

    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = sorted(map(tuple, resolve_edges(spark, sf).collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert sorted(map(tuple, resolve_edges(spark, sf).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_proposals(spark):
    from tessera.operators import propose

    g = graph(spark, [node("a"), node("b", props={"merged_ids": '["old-b"]'}), node("p", type_="person"), node("h", ns=["secret"])], [])
    rows = [
        ("create", None, "n", "service", None, None, None, 2.0), ("create", None, "a", "service", None, None, None, 0.5), ("create", None, "x", "thing", None, None, None, 0.5), ("link", None, None, "depends_on", "a", "b", None, 0.9),
        ("link", None, None, "depends_on", "a", "h", None, 0.9), ("link", None, None, "owns", "a", "p", None, 0.9), ("merge", None, None, None, "a", "p", None, 0.1), ("merge", None, None, None, "a", "b", None, 0.1), ("drop", None, None, None, None, None, None, 0.1),
    ]
    p = spark.createDataFrame(rows, propose.PROPOSAL)
    got = propose.checked(p, g, ["public"], Ontology())
    assert sorted(r["error"] or "" for r in got.collect()) == ["", "", "", "already there", "different types", "end not visible", "ends not allowed", "unknown node type", "unknown operation"]
    made = propose.entries(got.where("error is null"), agent="x", ns="team", proposed_at="t1").collect()
    assert sorted((r["type"], r["confidence"], r["ns"]) for r in made) == [("depends_on", 0.9, "team"), ("same_as", 1.0, "team"), ("service", 1.0, "team")]
    alias = spark.createDataFrame([("link", None, None, "depends_on", "a", "old-b", None, 0.9)], propose.PROPOSAL)
    assert propose.canonical_proposals(alias, g).first()["to_id"] == "b"
    with pytest.raises(ValueError):
        propose.entries(got, agent="x", ns="team*", proposed_at="t")


def test_summaries_carry_context(spark):
    from tessera.operators.answers import summaries

    df = spark.createDataFrame([("s", 0, "one"), ("s", 1, "two")], "session string, batch int, body string")
    assert [r["summary"] for r in summaries(df, lambda t: t.upper()).orderBy("batch").collect()] == ["ONE", "ONE\nTWO"]


def test_dump_replaces_sessions_whole(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "session string, batch int, body string")
    files.dump_batches(df([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")]), str(tmp_path), "n")
    files.dump_batches(df([("a", 0, "w")]), str(tmp_path), "n")
    got = spark.read.text(str(tmp_path / "n"))
    assert sorted((r["session"], r["value"]) for r in got.collect()) == [("a", "w"), ("b", "z")]
    assert files.within(str(tmp_path / "n" / "x"), [str(tmp_path)]) and not files.within(str(tmp_path / ".." / "x"), [str(tmp_path)])


def test_debounce_counts_from_the_last_import(spark):
    rows = [("a", float(t)) for t in range(0, 201, 20)] + [("b", 5.0), ("b", 5.0), ("b", 34.0), ("b", 35.0), (None, 1.0), ("c", None)]
    got = streams.debounced(spark.createDataFrame(rows, "key string, at double").repartition(3)).collect()
    assert sorted(r["at"] for r in got if r["key"] == "a") == [0, 40, 80, 120, 160, 200]
    assert sorted(r["at"] for r in got if r["key"] == "b") == [5, 35] and [r["at"] for r in got if r["key"] is None] == [1.0]
    assert streams.debounced(spark.createDataFrame([], "key string, at double")).count() == 0


def test_merged_json_keeps_types(spark):
    from tessera.operators import propose

    rows = [
        ('{"version":4,"node_types":{"project":{"props":{"name":"string"}}}}', '{"version":4,"node_types":{"service":{"props":{"name":"string"}}}}'),
        ('{"n":1,"b":true,"l":[1,2],"k":{"x":1},"s":"1"}', "{}"), ('{"k":{"x":1},"m":{"a":1}}', '{"k":7,"m":null}'), ("[1]", "{}"), (None, "{}"),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(propose.merged_json(F.col("a"), F.col("b"))).collect()]
    assert got == ['{"node_types":{"project":{"props":{"name":"string"}},"service":{"props":{"name":"string"}}},"version":4}', '{"b":true,"k":{"x":1},"l":[1,2],"n":1,"s":"1"}', '{"k":7,"m":null}', None, None]


def test_aliases_and_hidden_starts(spark):
    g = graph(
        spark,
        [node("a", props={"merged_ids": '["old-a"]'}), node("b"), node("h", ns=["secret"], props={"merged_ids": '["old-h"]'})],
        [edge("ab", "a", "b"), edge("bh", "b", "h"), edge("hh", "h", "h")],
    )
    assert ids(traversal.neighbors(g, "old-a")[0]) == ["a", "b"] == ids(traversal.scoped_neighbors(g, ["public"], "old-a")[0])
    for hidden in ("h", "old-h", "gone"):
        nodes, edges = traversal.scoped_neighbors(g, ["public"], hidden)
        assert nodes.count() == edges.count() == 0 and scope.scoped_history(g, ["public"], hidden).count() == 0 and traversal.scoped_distances(g, ["public"], hidden).count() == 0
    assert [r["id"] for r in lookup.history(g, "old-h").collect()] == ["h", "hh", "bh", "hh"]
    assert {r["id"]: r["dist"] for r in traversal.scoped_distances(g, ["public"], "old-a").collect()} == {"a": 0, "b": 1}
    assert lookup.get_node(g, "old-a").first()["resolved_from"] == "old-a" and ids(scope.scoped_node(g, ["public"], "old-h")) == [] == ids(scope.scoped_edge(g, ["public"], "bh"))


def test_nodes_on_the_way_need_not_be_active(spark):
    g = graph(spark, [node("a"), node("b", vt=date(2020, 1, 1)), node("c")], [edge("ab", "a", "b"), edge("bc", "b", "c"), edge("ac", "a", "c", vt=date(2020, 1, 1))])
    assert {r["id"]: r["dist"] for r in traversal.scoped_distances(g, ["public"], "a", "2024-01-01").collect()} == {"a": 0, "b": 1, "c": 2}
    assert traversal.scoped_distances(g, ["public"], "b", "2024-01-01").count() == 0


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from tessera.operators import components

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {"spark.checkpoint.dir": None}

    with pytest.raises(RuntimeError):
        components.shared_dir(Session)
    Session.conf = {"spark.checkpoint.dir": "/shared"}
    assert components.shared_dir(Session) == "/shared"
    held = components.stored(spark.range(5), "x")
    assert held.count() == 5
    components.drop_stored(held)
    with pytest.raises(Exception):
        spark.read.parquet(held.inputFiles()[0])


def _links(spark, pairs):
    return spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "from_id string, to_id string")


def test_cycles_by_transitive_closure(spark):
    """Chains, rings, chains between rings, loops and bushes, against plain reachability."""
    rnd = random.Random(11)
    pairs, n = [], 0
    for _ in range(9):
        size = rnd.randint(2, 12)
        ring = list(range(n, n + size))
        pairs += list(zip(ring, ring[1:])) + ([(ring[-1], ring[0])] if rnd.random() < 0.5 else [])
        pairs += [(rnd.choice(ring), rnd.randint(0, n + size))] if rnd.random() < 0.7 else []
        pairs += [(ring[0], ring[0])] if rnd.random() < 0.3 else []
        n += size
    pairs += [(rnd.randint(0, n), rnd.randint(0, n)) for _ in range(10)]
    reach = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
    changed = True
    while changed:
        changed = False
        for a in reach:
            more = reach[a].union(*[reach.get(b, set()) for b in reach[a]])
            changed, reach[a] = changed or more != reach[a], more
    assert ids(traversal.on_cycle(_links(spark, pairs))) == sorted(str(a) for a in reach if a in reach[a])


def test_long_rings_and_chains_take_few_rounds(spark):
    n, log = 10_000, []
    ring = [(f"r{i}", f"r{(i + 1) % n}") for i in range(n)]
    chain = [(f"c{i}", f"c{i + 1}") for i in range(n)]
    assert traversal.on_cycle(_links(spark, ring + chain + [("c5", "r7")]), log).count() == n
    assert len(log) < 60, log


def _small_graph(spark):
    """Two nodes and the edge between them."""
    day, node = date(2024, 1, 1), {f.name: None for f in NODE_SCHEMA.fields}
    nodes = [tuple((node | {"id": i, "type": "team", "ns": ["x"], "props": {"name": f"team {i}"}, "src": ["a:1"], "pos": k}).values()) for k, i in enumerate(("a", "b"))]
    edge = {f.name: None for f in EDGE_SCHEMA.fields} | {"id": "e", "type": "knows", "ns": ["x"], "valid_from": day, "props": {"note": "team a a"}, "src": ["a:2"], "from_id": "a", "to_id": "b", "pos": 0}
    return Graph(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame([tuple(edge.values())], EDGE_SCHEMA))


def test_pages_gather_each_side_once(spark):
    """Lines and facts of a page come from one list, not from an exchange each."""
    found = pages.entity_pages(_small_graph(spark), Ontology())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2
    assert all("team a" in r.body and "team b" in r.body for r in found.collect())


def test_pages_join_titles_once_for_both_sides(spark):
    """Titles are joined to the edges before the lists are made: joins are left for the words and the lists of either side only."""
    found = pages.entity_pages(_small_graph(spark), Ontology())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 4


def test_plain_text_is_quoted_as_json(spark):
    texts = ["", "plain ~ text!", 'a "b"', "back\\slash", "tab\t", "line\n", "é ✓", "\x7f", "end\n", "[a]", None]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", pages.quoted(F.col("x")).alias("q")).collect()
    assert [r.q for r in rows] == [json.dumps(x, ensure_ascii=False) for x in texts]


def test_postings_pass_no_exchange(spark):
    g = _small_graph(spark)
    index = search.token_index(search.node_text(g.nodes).unionByName(search.node_text(g.nodes)))
    assert index._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    assert {(r.token, r.id, tuple(r.places)) for r in index.collect()} == {(t, i, p) for i, t, p in [("a", "team", (1, 2)), ("a", "a", (0, 3)), ("b", "team", (1, 2)), ("b", "b", (0, 3))]}
    assert [r.id for r in search.index_search(index, "team b", 5).collect()] == ["b"]


def test_postings_of_odd_texts(spark):
    texts = ["", None, "  ", "a b a, A", "Straße É é 1.5 x_y", "ord:1 ord:10 ord:1"]
    frame = spark.createDataFrame([("t", str(i), x) for i, x in enumerate(texts)], "type string, id string, body string")
    want = {}
    for i, x in enumerate(texts):
        for place, token in enumerate("".join(c if c.isalnum() else " " for c in (x or "").lower()).split()):
            want.setdefault((token, str(i)), []).append(place)
    assert {(r.token, r.id): r.places for r in search.token_index(frame).collect()} == want


def test_index_is_built_from_the_graph_as_written(spark, tmp_path):
    """Nodes are computed once: the names in the index are those that were written, also where they differ each time."""
    g = _small_graph(spark)
    random_name = F.udf(lambda x: uuid.uuid4().hex, "string").asNondeterministic()
    g = Graph(g.nodes.withColumn("props", F.create_map(F.lit("name"), random_name("id"))), g.edges)
    publication.publish_graph(g, str(tmp_path), "1", spark.range(1), index=True)
    out = publication.Published(spark, str(tmp_path))
    for r in out.graph().nodes.collect():
        assert [x.id for x in out.index().find(r.props["name"], 5).collect()] == [r.id]


def test_few_pieces_are_looked_for_whole(spark):
    rows = spark.createDataFrame([("mirage",), ("of IRAN",), (None,)], "x string")
    of = lambda pieces: [r[0] for r in rows.select(search.may_hold(F.col("x"), pieces)).collect()]
    assert of(["iran"]) == [False, True, None] and of(["iran", "rage"]) == [True, True, None] and of([])[:2] == [False, False]
    assert of(["iran", *(f"none{i}" for i in range(search.PIECES))])[1]


def test_evidence_reads_facts_that_were_computed_once(spark):
    g = _small_graph(spark)
    found = answers.evidence(g, spark.createDataFrame([("q", "team b")], "question string, word string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RDD" not in plan and "LocalRelation" not in plan and "Relation [" in plan
    assert [r.question for r in found.collect()] == ["q"] and "team a a" in found.first().found


def test_search_joins_labels_to_edges_that_may_hold_the_query(spark):
    g = _small_graph(spark)
    of = lambda *pieces: search.edges_that_may_hold(g.edges, g.nodes, list(pieces)).count()
    assert of("zzzz") == 0 and of("team") == 1 and of("knows") == 1 and of("zz", "b") == 1
    assert [r.id for r in search.search_edges(g, "b knows", 5).collect()] == [] and [r.id for r in search.search_edges(g, "Team A team B", 5).collect()] == ["e"]


def test_hops_join_edges_once(spark):
    g = _small_graph(spark)
    plan = traversal.typed_hops(g.edges, g.edges)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert {r.id: r.dist for r in traversal.distances(g.nodes, g.edges.unionByName(g.edges.withColumn("to_id", F.lit("gone"))), ["a"]).collect()} == {"a": 0, "b": 1}


def test_evidence_of_few_and_many_keywords_agree(spark, monkeypatch):
    from tessera.operators import answers

    words = spark.createDataFrame([("q", "Team B"), ("q", "kno"), ("r", "zz"), ("s", "")], "question string, word string")
    found = lambda: {r.question: r.found for r in answers.evidence(_small_graph(spark), words).collect()}
    some = found()
    monkeypatch.setattr(answers, "MANY", 0)
    assert set(some) == {"q"} and found() == some


def test_self_heal_exchanges_no_more_than_it_needs(spark):
    """Before, whole edges went through every exchange, and shuffle files of earlier jobs stayed until the driver's next collection."""
    from tessera.operators import components

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    seen, before = [], spark.conf.get(key)
    frame = spark.range(4)
    real = type(frame.write).parquet
    try:
        type(frame.write).parquet = lambda self, *a, **b: seen.append(spark.conf.get(key)) or real(self, *a, **b)
        components.stored(frame)
    finally:
        type(frame.write).parquet = real
    assert seen == ["true"] and spark.conf.get(key) == before
    g = graph(spark, [node(x) for x in "abc"], [
        edge("2", "a", "b"), edge("1", "a", "b"), edge("3", "a", "b", vf=date(2020, 1, 1)), edge("4", "b", "x"), edge("5", "y", "z"), edge("6", "b", "a"),
    ])
    fixed, report = health.self_heal(g)
    assert sorted((r["action"], r["id"]) for r in report.collect()) == [("circular_dependency", "a"), ("circular_dependency", "b"), ("deduped", "2"), ("orphan", "c"), ("removed", "4"), ("removed", "5")]
    assert sorted(r["id"] for r in fixed.edges.collect()) == ["1", "3", "6"]
    assert health._judged(g, g.nodes.select("id")).columns == ["id", "from_id", "to_id", "whole", "first"]


def test_facts_hash_is_the_same_in_turns(spark):
    """Also as it was when hashes travelled as digits."""
    import hashlib

    g = graph(spark, [node(f"n{i}") for i in range(40)], [edge(f"e{i}", f"n{i}", f"n{i + 1}") for i in range(39)])
    sha, parts = lambda s: hashlib.sha256(s.encode()).hexdigest(), {}
    for r in files.fact_lines(g).collect():
        parts.setdefault(sha(r["id"])[:2], []).append(sha(r["line"]))
    want = sha("".join(sorted(sha("".join(sorted(x))) for x in parts.values())))[:16]
    assert [files.facts_hash(g, turns).first()[0] for turns in (1, 3)] == [want, want]


def test_manifest_reads_the_graph_as_written(spark, tmp_path):
    """Before, the manifest computed the whole graph anew for each of its parts."""
    from tessera.plans import publication
    from tessera.plans.ontology import Ontology

    g, seen = graph(spark, [node("a"), node("b")], [edge("1", "a", "b")]), []
    found = lambda written: seen.append(written) or publication.manifest(written, Ontology(), turns=2)
    publication.publish_graph(g, f"file://{tmp_path}/pub", "1", found)
    assert all("/nodes/" in f for f in seen[0].nodes.inputFiles()) and all("/edges/" in f for f in seen[0].edges.inputFiles())
    own, want = publication.Published(spark, f"file://{tmp_path}/pub").table("manifest").first(), publication.manifest(g, Ontology()).first()
    assert own == want and own["edge_count"] == 1
