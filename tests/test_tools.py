"""Tools, publication, streams that go on, imports and answers: small and odd cases."""

import json
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import answers, evaluate, imports, pages, resolve, search, tools
from tessera.plans import publication
from tessera.plans.compile import email_rules
from tessera.plans.ontology import Ontology, OntologyStore, fingerprint
from tessera.sources import files, pointer, transcripts
from tessera.streaming import streams
from tessera.streaming.watch import Watch, watched
from tests.test_operators import edge, graph, ids, node


def test_as_of():
    assert tools.as_of_date("", "2024-05-01") == "2024-05-01" and tools.as_of_date(" ALL ", "2024-05-01") is None
    assert tools.as_of_date("2023-01-02T10:00:00Z", "2024-05-01") == "2023-01-02"
    with pytest.raises(ValueError):
        tools.as_of_date("soon", "2024-05-01")


def test_search_tool(spark):
    g = graph(
        spark,
        [node("a", props={"name": "Pay", "merged_ids": '["old-a"]'}), node("b", props={"name": "Pay too"}), node("h", ns=["secret"], props={"name": "Pay"}), node("z", props={"name": "Pay"}, vt=date(2020, 1, 1))],
        [edge("e1", "a", "b", props={"description": "pay flow"}), edge("e2", "b", "z", props={"note": "pay"}), edge("e3", "a", "h", props={"note": "pay"}), edge("e4", "b", "a", type_="relates_to", props={"note": "pay"}), edge("e5", "b", "b")],
    )
    found = tools.search_tool(g, ["public"], "pay", 5, center="old-a", today="2024-01-01")
    assert [(r.rank, r.id) for r in found.nodes.orderBy("rank").collect()] == [(0, "a"), (1, "b")]
    facts = {r.id: r for r in found.facts.collect()}
    assert set(facts) == {"e1", "e2", "e4", "e5"} and facts["e1"].description == "pay flow" and facts["e2"].description == ""
    assert [x.id for x in facts["e1"].neighbors] == ["e2", "e5"] and "neighbors" not in facts["e1"].neighbors[0]
    assert ids(tools.search_tool(g, ["public"], "pay", 5, kind="nodes", as_of="all", today="2024-01-01").nodes) == ["a", "b", "z"]
    assert tools.search_tool(g, ["public"], "nothing here", 5, today="2024-01-01").facts.count() == 0
    with pytest.raises(ValueError):
        tools.search_tool(g, ["public"], "pay", kind="all", today="2024-01-01")


def test_context_sections(spark):
    g = graph(spark, [node("a")], [])
    assert set(tools.context(g, ["public"], Ontology(), "2024-01-01")) == {"schema", "namespaces", "status"}
    assert [r.ns for r in tools.context(g, ["x", "public"], Ontology(), "2024-01-01", section="namespaces")["namespaces"].collect()] == ["public", "x"]
    status = {(r.section, r.item): r.n for r in tools.scoped_stats(graph(spark, [], []), ["public"], "2024-01-01").collect()}
    assert status["total", "nodes"] == 0 and status["freshness", "oldest"] is None
    with pytest.raises(ValueError):
        tools.context(g, ["public"], Ontology(), "2024-01-01", section="other")


def test_failed_publication_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "pub")
    g = graph(spark, [node("a")], [])
    publication.publish_graph(g, root, "1", publication.manifest(g, Ontology()))
    bad = spark.range(1).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        publication.publish(spark, root, "2", {"nodes": g.nodes, "pages": bad})
    assert publication.version_of(spark, root) == "1" and not (tmp_path / "pub" / "v=2").exists()
    with pytest.raises(ValueError):
        publication.publish(spark, root, "1", {})
    reader = publication.Published(spark, root)
    assert ids(reader.graph().nodes) == ["a"] and reader.graph() is reader.graph() and reader.reads == 1
    more = graph(spark, [node("a"), node("b")], [])
    publication.publish_graph(more, root, "2", publication.manifest(more, Ontology()), pages.entity_pages(more, Ontology()))
    assert ids(reader.graph().nodes) == ["a", "b"] and reader.reads == 2 and reader.table("pages").count() == 2
    assert [p.name for p in (tmp_path / "pub").iterdir() if "new" in p.name and not p.name.endswith(".crc")] == []
    with pytest.raises(FileNotFoundError):
        publication.Published(spark, str(tmp_path / "none")).graph()


def test_pointer(spark, tmp_path):
    path = f"file://{tmp_path}/P"
    assert pointer.read_small(spark, path) is None
    for text in ("one", "two"):
        pointer.replace_small(spark, path, text)
        assert pointer.read_small(spark, path) == text


def test_watch_reports_each_change_once(spark, tmp_path):
    raw, seen = tmp_path / "raw", []
    (raw / "x").mkdir(parents=True)
    (raw / "x" / "a.md").write_text("ann@mail1.example.com")
    (raw / "same.md").write_text("same")
    (tmp_path / "secret.md").write_text("outside")
    (raw / "link.md").symlink_to(tmp_path / "secret.md")
    take = lambda df: seen.extend((r.change, r.path.rsplit("/", 1)[1]) for r in df.orderBy("version", "path").collect())
    watch = lambda on=take: watched(spark, str(raw), str(tmp_path / "state"), on, "*.md")
    assert watch() == 2 and sorted(seen) == [("new", "a.md"), ("new", "same.md")] and watch() == 0
    (raw / "x" / "a.md").write_text("longer than before")
    (raw / "b.md").write_text("two")
    (raw / "c.txt").write_text("other")

    def broken(_):
        raise OSError("not now")

    with pytest.raises(Exception, match="not now"):
        watch(broken)
    seen.clear()
    (raw / "b.md").unlink()
    assert watch() == 3 and seen == [("new", "b.md"), ("changed", "a.md"), ("deleted", "b.md")] and watch() == 0


def test_watch_recovers_between_commit_and_hand_over(spark, tmp_path, monkeypatch):
    raw, seen = tmp_path / "raw", []
    raw.mkdir()
    (raw / "a.md").write_text("a")
    w = Watch(spark, str(tmp_path / "s"), {"texts": (str(raw), "*.md"), "journals": (str(tmp_path / "none"), "*")})
    moved = w._moved
    monkeypatch.setattr(w, "_moved", lambda v: moved(v) if v == 0 else (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        w.poll()
    again = Watch(spark, str(tmp_path / "s"), w.roots)
    assert again.poll() == 0
    again.deliver(lambda df: seen.extend(r.change for r in df.collect()))
    assert seen == ["new"]


def test_links_out_of_the_root(spark, tmp_path):
    root, other = tmp_path / "root", tmp_path / "other"
    (root / "in side").mkdir(parents=True)
    other.mkdir()
    (root / "in side" / "a b.md").write_text("in")
    (other / "secret.md").write_text("out")
    (root / "link.md").symlink_to(other / "secret.md")
    (root / "dir").symlink_to(other)
    (root / "own.md").symlink_to(root / "in side" / "a b.md")
    assert {r.text for r in files.read_documents(spark, str(root)).collect()} == {"in"}
    assert sorted(r.path for r in files.refused_links(spark, str(root)).collect()) == ["dir/secret.md", "link.md"]


def test_publish_refuses_names_that_exist(spark, tmp_path):
    root = str(tmp_path / "pub")
    for v in ("1", "2"):
        publication.publish(spark, root, v, {"t": spark.range(int(v))})
    bad = spark.range(1).select(F.raise_error(F.lit("broken")).alias("x"))
    for v, tables in (("1", {"t": bad}), ("1", {"t": spark.range(9)}), ("2", {})):
        with pytest.raises(ValueError, match="exists"):
            publication.publish(spark, root, v, tables)
    with pytest.raises(Exception, match="broken"):
        publication.publish(spark, root, "3", {"a": spark.range(1), "t": bad})
    assert sorted(p.name for p in (tmp_path / "pub").iterdir() if not p.name.startswith(".")) == ["CURRENT", "v=1", "v=2"]
    assert publication.version_of(spark, root) == "2" and spark.read.parquet(f"{root}/v=1/t").count() == 1


def test_quality_warnings(spark):
    from tessera.operators.stats import quality_warnings

    cases = [((0.0, 1.0, 0.0, 1.0, 0.5, 0), False), ((1.0, 0.99, 1.0, 1.0, 0.0, 0), True), ((1.0, 1.0, 1.0, 0.99, 0.0, 0), True), ((1.0, 1.0, 1.0, 1.0, 0.51, 0), True), ((1.0, 1.0, 1.0, 1.0, 0.0, 1), True)]
    names = ["node_label_coverage", "node_summary_coverage", "node_description_coverage", "edge_description_coverage", "generic_edge_ratio", "duplicate_label_count"]
    got = quality_warnings(spark.createDataFrame([c for c, _ in cases], names)).collect()
    assert {tuple(r)[:6]: r.warn for r in got} == dict(cases)


def test_queue_goes_on_after_a_restart(spark, tmp_path):
    from tessera.streaming.queue import drained_to

    feed, out, check = str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = "key string, event_id long, trigger string, at timestamp"

    def put(*rows):
        spark.createDataFrame([(k, i, t, datetime.fromtimestamp(s)) for k, i, t, s in rows], schema).coalesce(1).write.mode("append").parquet(feed)

    def drain():
        every, dead = drained_to(spark.readStream.schema(schema).parquet(feed), lambda key, event, trigger, n: key == "good" or (key == "late" and n >= 3), out, check)
        return sorted((r.key, r.event_id, r.attempt, r.outcome, r.s) for r in every.withColumn("s", F.unix_seconds("at")).collect()), sorted(r.key for r in dead.collect())

    put(("good", 1, "session_end", 1000), ("late", 2, "stop", 1000), ("bad", 3, "session_end", 1000), ("good", 4, "stop", 1100))
    first = [("bad", 3, n, "failed", s) for n, s in ((1, 1000), (2, 1002), (3, 1006), (4, 1014), (5, 1030), (6, 1062))] + [("good", 1, 1, "imported", 1000)]
    assert drain() == (first, [])
    assert drain() == (first, [])
    put(("late", 5, "stop", 1301), ("clock", 6, "session_end", 5000))
    every, dead = drain()
    # the first event of `late` was idle at 1300, just before a newer one took its place
    assert [x[1:] for x in every if x[0] == "late"] == [(2, 1, "failed", 1300), (5, 1, "failed", 1601), (5, 2, "failed", 1603), (5, 3, "imported", 1607)]
    assert [x[2:] for x in every if x[0] == "bad"][-2:] == [(9, "failed", 1510), (10, "dropped", 1766)] and dead == ["bad"]
    assert [x for x in every if x[0] == "good"][1:] == [("good", 4, 1, "imported", 1400)] and not [x for x in every if x[0] == "clock"]


def test_compile_in_steps_asks_once(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}.md", f"u{i % 3}@mail{i % 2}.example.com") for i in range(12)], "path string, text string")
    root = str(tmp_path / "out")
    versions = list(publication.compile_in_steps(docs, email_rules, root, steps=3))
    assert len(versions) == 3 and publication.version_of(spark, root) == versions[-1]
    reader = publication.Published(spark, root)
    assert len(ids(reader.graph().nodes)) == 5
    m = reader.table("manifest").first()
    assert m.chunk_count == 12 and m.run_id == versions[-1] and m.node_count == 5
    first = spark.read.parquet(f"{root}/v={versions[0]}/manifest").first()
    assert first.run_id == "streaming" and first.chunk_count < 12


def test_merge_stream_goes_on(spark, tmp_path):
    schema = "k string, n long"
    put = lambda rows, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / name))
    calls = []

    def merge(held, batch):
        calls.append(held.count())
        return held.unionByName(batch).groupBy("k").agg(F.sum("n").alias("n"))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        start = spark.createDataFrame([("a", 100), ("z", 7)], schema)
        out = streams.merge_stream(stream, start, merge, state_key=F.col("k"), entry_key=F.col("k"), root=str(tmp_path / "state"), buckets=8)
        return {r.k: r.n for r in out.collect()}

    put([("a", 1), ("b", 2)], "one")
    assert run() == {"a": 101, "b": 2, "z": 7}
    assert run() == {"a": 101, "b": 2, "z": 7} and len(calls) == 1  # nothing new: the state as it was
    put([("b", 5)], "two")
    assert run() == {"a": 101, "b": 7, "z": 7} and calls[1] < 3  # only b's bucket was read


def test_final_sessions_go_on(spark, tmp_path):
    def put(rows, name):
        spark.createDataFrame(rows, "user_id long, at string").select("user_id", F.to_timestamp("at").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        stream = spark.readStream.schema("user_id long, ts timestamp").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        return sorted((r.user_id, r.n) for r in streams.final_sessions(stream, str(tmp_path / "out"), str(tmp_path / "check"), late="10 minutes").collect())

    put([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 01:00:00")], "one")
    assert run() == [(1, 2)]
    put([(3, "2024-01-01 03:00:00")], "two")
    assert run() == [(1, 2), (2, 1)]


def test_imported_conversations(spark):
    talk = lambda i, *texts: json.dumps({"composerId": i, "createdAt": 5, "conversationMap": {str(k): {"type": str(1 + k % 2), "text": t, "createdAt": k} for k, t in enumerate(texts)}})
    rows = spark.createDataFrame([("composerData:a", talk("aaaaaaaaaa", "hi", "yo")), ("composerData:b", talk("bbbb", "boom", "x")), ("composerData:c", '{"composerId":"c"}'), ("x", talk("d", "q")), ("composerData:e", "no json"), ("composerData:n", None)], "key string, value string")
    none = spark.createDataFrame([], "session string, digest string")

    def provider(text):
        if "boom" in text:
            raise RuntimeError("no")
        return "S:" + text.splitlines()[-1]

    texts, manifest = imports.imported_conversations(rows, none, provider)
    got = {r.path: r.body for r in texts.collect()}
    assert set(got) == {"composer-session/aaaaaaaa-batch-01.md", "composer-session/bbbb-batch-01.md"}
    assert got["composer-session/aaaaaaaa-batch-01.md"] == "S:**Assistant:** yo" and "Call failed: no" in got["composer-session/bbbb-batch-01.md"]
    assert imports.changed_conversations(rows, manifest).count() == 0 and manifest.count() == 2
    other = spark.createDataFrame([(json.dumps(dict(reversed(json.loads(talk("bbbb", "boom", "x")).items()))),)], "value string")
    digest = {r.session: r.digest for r in manifest.collect()}
    assert other.select(transcripts.conversation_hash(F.col("value"))).first()[0] == digest["bbbb"]


def test_sessions_by_directory(spark):
    f = spark.createDataFrame([("old", 1), ("new", 2), ("late", 3)], "path string, mtime long")
    lines = spark.createDataFrame([("old", 0, '{"type":"session_meta","payload":{"cwd":"/w"}}'), ("new", 0, '{"cwd":""}'), ("new", 1, "no json"), ("new", 2, '{"data":{"cwd":"/w"}}'), ("late", 64, '{"cwd":"/w"}')], "path string, pos long, value string")
    pick = lambda recorded, cwd, **kw: [r.path for r in transcripts.session_of(f, recorded, cwd, **kw).collect()]
    assert pick(transcripts.first_record_cwd(lines), "/w", fallback=False) == ["old"] and pick(transcripts.first_record_cwd(lines), "/q", fallback=False) == []
    assert pick(transcripts.early_cwd(lines), "/w") == ["new"] and pick(transcripts.early_cwd(lines), "/q") == ["late"] and pick(transcripts.early_cwd(lines), None) == ["late"]


def test_ontology_store(spark, tmp_path):
    store, old, new = OntologyStore(spark, str(tmp_path / "ontologies")), {"version": 3, "node_types": {}}, {"version": 5, "node_types": {"a": {"label": "É"}}}
    assert store.definition() is None and store.back() is None
    first = store.use(old)
    assert store.outlook(new, []) == "own" and not store.offer(new, []) and store.definition() == old
    assert store.outlook(new, [first]) == "stock" and store.offer(new, [first]) and store.definition() == new and store.ontology().version == 5
    assert store.outlook(new, [first]) == "current" and not store.offer(new, [first], over_own=True)
    assert store.back() == first and store.definition() == old and store.offer(new, [], over_own=True) and store.ontology().is_valid_node_type("a")
    with pytest.raises(ValueError):
        store.use({"version": 9, "surprise": 1})
    assert store.definition() == new and fingerprint({"b": 1, "a": 2}) == fingerprint({"a": 2, "b": 1})


def test_keywords(spark):
    rows = [("What did Caroline paint for the school, and WHEN was It?",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "q string").select(search.keywords(F.col("q"))).collect()]
    assert got == [["Caroline", "WHEN", "It", "paint", "school,"], [], None]


def test_hits_are_those_of_a_scan(spark):
    rnd = random.Random(4)
    letters = lambda n: "".join(rnd.choice("abcé ") for _ in range(n))
    texts = [(rnd.choice("xy"), f"n{i:03d}", letters(rnd.randint(0, 40))) for i in range(150)] + [("x", "null", None)]
    words = [(f"q{i % 9}", letters(rnd.randint(1, 6)).strip().upper() or "a") for i in range(40)] + [("q0", ""), ("q1", None), ("q2", "none such")]
    want = set()
    for q, w in words:
        if w and w.strip():
            held = sorted((t, i) for t, i, b in texts if b is not None and w.lower() in b.lower())
            want |= {(q, i) for _, i in held[:5]}
    got = answers.hits(spark.createDataFrame(texts, "type string, id string, body string"), spark.createDataFrame(words, "question string, word string"))
    assert {tuple(r) for r in got.collect()} == want


def test_answers_by_category(spark):
    g = graph(spark, [node("a", props={"name": "Ann"}, src=("one.md:3",)), node("b", props={"name": "Rome"}), node("c", props={"name": "Opera"}), node("d", props={"name": "Drama"})], [edge("ab", "a", "b"), edge("bc", "b", "c"), edge("cd", "c", "d")])
    docs = spark.createDataFrame([("one.md", "violin"), ("two.md", "Ann plays tuba"), ("three.md", "else")], "path string, text string")
    q = spark.createDataFrame([("near", "Rome", "1", False), ("far", "Drama", "3", False), ("short", "Drama", "1", False), ("src", "violin tuba", "1", False), ("adv", "violin", "5", True), ("lost", "x", "1", False)], "question string, gold string, category string, adversarial boolean")
    words = spark.createDataFrame([(x, "Ann") for x in ("near", "far", "short", "src", "adv")] + [("lost", "zzz")], "question string, word string")
    got = {r.question: round(r.score, 4) for r in answers.answered(q, g, words, docs).collect()}
    # the edge of Ann and Rome is hit itself, so hops count from both; an edge's text tells of both its ends
    assert got == {"near": 1.0, "far": 1.0, "short": 0.0, "src": 1.0, "adv": 1.0, "lost": 0.0}


def test_evaluation_report(spark):
    part = spark.createDataFrame([("nodes", 1.0)], "what string, f1 double")
    assert json.loads(evaluate.evaluation(part, part).first().report) == {"extraction": [{"f1": 1.0, "what": "nodes"}], "structure": [{"f1": 1.0, "what": "nodes"}]}


def test_gold_and_bad_lines(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "g.facts.jsonl").write_text('{"kind":"node","id":"a","type":"t"}\n\n')
    (tmp_path / "notes.jsonl").write_text("no facts\n")
    assert ids(files.read_gold(spark, str(tmp_path))) == ["a"]
    lines = spark.createDataFrame([('{"entry_id":"1","fact":{"kind":"node","id":"a"}}',), ("{",), (" ",), (None,), ('{"entry_id":"2"}',)], "value string")
    assert ids(files.parsed_journal(lines)) == ["a"] and sorted(r.value for r in files.bad_journal_lines(lines).collect()) == ["{", '{"entry_id":"2"}']


def test_pending_entries_are_resolved_and_published(spark, tmp_path):
    from tessera.operators.journal import ENTRY

    g = graph(spark, [node("svc:a", props={"name": "A"}), node("svc:b", ns=["x"])], [edge("e", "svc:a", "svc:b")])
    entry = lambda k, conf, kind, id_, type_, a=None, b=None, status="pending": (k, "ag", None, "public", conf, f"t{k}", status, kind, id_, type_, a, b, ["public"], None, None, {"name": k}, [])
    rows = [entry("1", 0.9, "node", "svc:c", "service"), entry("2", 0.6, "edge", "", "depends_on", "svc:b", "svc:c"), entry("3", 0.1, "node", "svc:d", "service"), entry("4", 1.0, "edge", "", "same_as", "svc:a", "svc:b"), entry("5", 0.9, "node", "svc:e", "service", status="merged")]
    root = str(tmp_path / "pub")
    after = publication.resolve_pending(g, spark.createDataFrame(rows, ENTRY), root, "1")
    assert {r.entry_id: r.status for r in after.collect()} == {"1": "merged", "2": "merged", "3": "quarantined", "4": "merged", "5": "merged"}
    reader = publication.Published(spark, root)
    assert ids(reader.graph().nodes) == ["svc:b", "svc:c"] and ids(reader.scoped(["x*"]).nodes) == ["svc:b", "svc:c"]
    assert [(r.from_id, r.to_id) for r in reader.graph().edges.collect()] == [("svc:b", "svc:c")]
    assert {r.id: r.provenance and r.provenance.confidence for r in reader.graph().nodes.collect()} == {"svc:b": None, "svc:c": 0.9}
    m = reader.table("manifest").first()
    assert (m.merged_count, m.flagged_count, m.quarantined_count) == (3, 1, 1)


def test_imported_sessions(spark):
    rows = [("s/1", 0, "user", "hi", []), ("s/1", 1, "assistant", "yo", ["b", "a"]), ("t", 0, "user", "x" * 30, []), ("t", 1, "user", "y" * 30, []), ("t", 2, "user", "z" * 30, [])]
    messages = spark.createDataFrame(rows, "session string, pos int, role string, text string, tools array<string>")
    none = spark.createDataFrame([], "session string, digest string")
    texts, manifest = imports.imported_sessions(messages, none, lambda t: t.splitlines()[-1], namespace="n", max_chars=40, overlap=0, most_batches=2)
    assert {r.path: r.body for r in texts.collect()} == {"n/s-1-batch-01.md": "**Tools:** a, b", "n/t-batch-01.md": "**User:** " + "x" * 30, "n/t-batch-02.md": "**User:** " + "y" * 30}
    memory = spark.createDataFrame([("a.md", "h1", "A"), ("b.md", "h2", "B")], "path string, hash string, text string")
    held = spark.createDataFrame([("a.md", "h1"), ("b.md", "old")], "path string, hash string")
    out = imports.imported(memory, held, messages, manifest, lambda t: t, namespace="n")
    assert [(r.path, r.body) for r in out["documents"].collect()] == [("n-memory/b.md", "B")] and out["session_manifest"].count() == 2


def test_merged_paragraphs(spark):
    """Against the same by comparing all paragraphs of a group."""
    rnd = random.Random(4)
    words = ["pay", "Pay api", "the pay API of us", "x", "É", "one two three four", "one two three four five", "Two", "a" * 30]
    rows = [(g, o, "\n\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(1, 3)))) for g in (None, "a", "b", "c") for o in range(rnd.choice([1, 4, 12]))]
    want = {}
    for g in {r[0] for r in rows}:
        at = {}
        for _, o, t in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            for i, p in enumerate(t.split("\n\n")):
                at.setdefault(p.lower(), (o, i, p))
        stay = {f: v for f, v in at.items() if not any(f in w and f != w for w in at)}
        first = {f: v[:2] for f, v in stay.items()}
        for f, v in at.items():
            holders = [w for w in stay if f in w and f != w]
            if holders:
                heir = min(holders, key=lambda w: stay[w][:2])
                first[heir] = min(first[heir], v[:2])
        want[g] = "\n\n".join(stay[f][2] for f in sorted(stay, key=lambda f: (first[f], stay[f][:2])))
    frame = spark.createDataFrame(rows, "g string, place int, text string")
    assert {r.g: r.text for r in resolve.merged_paragraphs(frame, ["g"]).collect()} == want


def test_journal_of_many_writers(spark, tmp_path):
    """Eight threads append and one changes statuses and folds; nothing is lost, and readers see whole commits."""
    from concurrent.futures import ThreadPoolExecutor

    from tessera.operators.journal import ENTRY
    from tessera.sources.journal_log import JournalLog

    log, rounds, size = JournalLog(spark, str(tmp_path / "log")), 3, 5
    row = lambda w, r, i: (f"{w}-{r}-{i}", "ag", None, "public", 0.9, "t", "pending", "node", "a", "service", None, None, [], None, None, {}, [])
    status = lambda keys, s: spark.createDataFrame([(k, s) for k in keys], "key string, new_status string")

    def write(w):
        return [log.append(spark.createDataFrame([row(w, r, i) for i in range(size)], ENTRY).coalesce(1)) for r in range(rounds)]

    def judge():
        out = []
        for _ in range(4):
            seen = log.read().collect()
            assert len(seen) % size == 0
            done = [r.entry_id for r in seen if r.status == "pending"]
            if done:
                out.append(log.set_status(status(done, "merged")))
            log.compact()
        return out

    with ThreadPoolExecutor(9) as pool:
        judged = pool.submit(judge)
        numbers = [n for f in [pool.submit(write, w) for w in range(8)] for n in f.result()]
        numbers += judged.result()
    assert len(set(numbers)) == len(numbers)
    last = log.version()
    rows = log.read().collect()
    assert sorted(r.entry_id for r in rows) == sorted(f"{w}-{r}-{i}" for w in range(8) for r in range(rounds) for i in range(size))
    merged = {r.entry_id for r in rows if r.status == "merged"}
    log.compact()
    log.set_status(status([r.entry_id for r in rows], "quarantined"))
    now = {r.entry_id: r.status for r in log.read().collect()}
    assert {k for k, s in now.items() if s == "merged"} == merged and set(now.values()) <= {"merged", "quarantined"}
    assert log.read(last).count() == len(rows) and log.read(0).count() == 0


def test_written_index_equals_the_scan(spark, tmp_path):
    """Nodes and facts, after a build, an update, a merge and through a publication; only the buckets of a query's tokens are read."""
    from tessera.operators.text_index import SearchIndex

    g = graph(spark, [node(f"svc:{i}", props={"name": f"Pay API {i % 3}", "note": "É x-ray"}, ns=["a" if i % 2 else "b"]) for i in range(30)], [edge(f"e{i}", f"svc:{i}", f"svc:{i + 1}", props={"note": f"calls {i % 4}"}) for i in range(29)])
    index = SearchIndex(spark, str(tmp_path / "index"), buckets=16)
    queries = ["pay-api 1", "calls 3", "É ray", "ray-x", "-", ""]

    def same(g):
        for kind, texts in (("nodes", search.node_text(g.nodes)), ("facts", search.edge_text(g.edges, g.nodes))):
            for q in queries[:4]:
                want = [(r.type, r.id, r.place) for r in search.search(texts, q, 7, "terms").collect()]
                assert [(r.type, r.id, r.place) for r in index.find(q, 7, kind).orderBy("place").collect()] == want, (kind, q)

    index.build(g)
    assert [index.find(q, 5).count() for q in queries[4:]] == [0, 0]
    same(g)
    read = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in index.find("calls 3", 5, "facts").inputFiles()}
    assert 1 <= len(read) <= 2
    now = graph(spark, [*[node(f"svc:{i}", props={"name": "Renamed" if i == 5 else f"Pay API {i % 3}", "note": "É x-ray"}, ns=["a" if i % 2 else "b"]) for i in range(30) if i != 9], node("svc:new", props={"name": "pay none such"})], [edge(f"e{i}", f"svc:{i}", f"svc:{i + 1}", props={"note": f"calls {i % 4}"}) for i in range(29) if i not in (8, 9, 20)])
    ids_of = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    index.update(now, ids_of("svc:5", "svc:9", "svc:new"), ids_of("e8", "e9", "e20"))
    queries[0] = "renamed"
    assert index.find("renamed", 9, "facts").count() == 2 and len(index.segments()) == 2
    same(now)
    index.merge()
    assert len(index.segments()) == 1
    same(now)
    root = str(tmp_path / "pub")
    publication.publish_graph(now, root, "1", publication.manifest(now, Ontology()), index=True)
    reader = publication.Published(spark, root)
    for kind in ("nodes", "facts"):
        want = search.scoped_search(now, ["a", "b", "public"], "pay", 5, kind=kind, center="svc:3", mode="terms").select("id").collect()
        assert want and search.scoped_search(reader.graph(), ["a", "b", "public"], "pay", 5, kind=kind, center="svc:3", index=reader.index()).select("id").collect() == want
