"""Layouts that let reads skip what they don't need: SQLite conditions, adjacency by buckets, facts by validity."""

import random
import sqlite3
from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.operators import adjacency, lookup, traversal
from tessera.operators.adjacency import Adjacency
from tessera.plans import publication
from tessera.plans.graph import Graph
from tessera.plans.ontology import Ontology
from tessera.sources import transcripts
from tests.test_operators import edge, graph, ids, node


@pytest.fixture()
def store(tmp_path):
    con = sqlite3.connect(tmp_path / "x.db")
    con.execute("CREATE TABLE kv (key TEXT COLLATE NOCASE, n INTEGER, loose)")
    rows = [(f"composerData:{i}", i, i) for i in range(30)] + [("composerDatb", 1, 1), ("COMPOSERDATA:x", 2, 2), ("composerData", 3, 3), ("other'; DROP TABLE kv; --", 4, 4), (None, None, None)]
    con.executemany("INSERT INTO kv VALUES (?, ?, ?)", rows)
    con.execute("CREATE INDEX by_key ON kv (key COLLATE BINARY)")
    con.commit()
    con.close()
    return str(tmp_path / "x.db")


def test_conditions_reach_sqlite(spark, store):
    spark.dataSource.register(transcripts.SQLiteSource)
    plain = spark.read.format("sqlite").schema("key string, n long").option("path", store).option("table", "kv").load().collect()
    df = transcripts.read_sqlite(spark, store, "kv", "key string, n long")
    cases = [
        (F.col("key").startswith("composerData:"), lambda r: (r.key or "").startswith("composerData:")),
        (F.col("key") == "other'; DROP TABLE kv; --", lambda r: r.key == "other'; DROP TABLE kv; --"),
        (F.col("key").isin("composerData", "composerDatb", "no"), lambda r: r.key in ("composerData", "composerDatb")),
        ((F.col("n") >= 5) & (F.col("n") < 8), lambda r: r.n is not None and 5 <= r.n < 8),
        (F.col("key") > "composerData:5", lambda r: r.key is not None and r.key > "composerData:5"),
        (F.col("n").isNull(), lambda r: r.n is None),
        (F.col("key").startswith("") & (F.col("n") == 2), lambda r: r.key is not None and r.n == 2),
    ]
    for condition, keep in cases:
        assert sorted(map(str, df.where(condition).collect())) == sorted(str(r) for r in plain if keep(r)), condition


def test_what_is_handed_on(store):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith
    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType().add("key", StringType()).add("n", LongType()).add("loose", LongType())
    reader = transcripts.SQLiteSource({"path": store, "table": "kv", "push": "true"}).reader(schema)
    asked = [StringStartsWith(("key",), "composerData:"), GreaterThan(("n",), 3), EqualTo(("loose",), 4), EqualTo(("n",), "4"), In(("n",), (4, 5, 6))]
    assert list(reader.pushFilters(asked)) == asked
    assert reader.conditions == ["key COLLATE BINARY >= ?", "key COLLATE BINARY < ?", "n > ?", "n IN (?, ?, ?)"]
    assert reader.values == ["composerData:", "composerData;", 3, 4, 5, 6]
    read = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted(r[1] for r in read) == [4, 5, 6]
    con = sqlite3.connect(store)
    plan = con.execute("EXPLAIN QUERY PLAN SELECT key FROM kv WHERE key COLLATE BINARY >= ? AND key COLLATE BINARY < ?", ("composerData:", "composerData;")).fetchall()
    assert "by_key" in plan[0][-1]


def test_end_of_a_prefix():
    assert transcripts.after_prefix("ab") == "ac" and transcripts.after_prefix("a" + chr(0xD7FF)) == "a" + chr(0xE000)
    assert transcripts.after_prefix("a\U0010ffff") == "b" and transcripts.after_prefix("\U0010ffff") is None


def test_session_choice_through_the_source(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "s.db")
    con.execute("CREATE TABLE session (id TEXT, project_id TEXT, time_updated INTEGER)")
    con.executemany("INSERT INTO session VALUES (?, ?, ?)", [(f"s{i}", "p" if i % 2 else "q", i) for i in range(20)])
    con.commit()
    con.close()
    df = transcripts.read_sqlite(spark, str(tmp_path / "s.db"), "session", "id string, project_id string, time_updated long")
    projects = spark.createDataFrame([("p", "/w")], "id string, worktree string")
    assert transcripts.current_session(df, projects, "/w").first()["id"] == "s19"
    assert [r.id for r in df.where("id = 's7'").collect()] == ["s7"]


def _random_graph(spark, seed, n=40, m=70):
    """Nodes of two namespaces and some dates, edges of two types, loops and missing ends among them."""
    rnd = random.Random(seed)
    names = [f"n{i}" for i in range(n)]
    ns = {x: rnd.choice([["a"], ["b"], ["a", "b"]]) for x in names}
    day = lambda: rnd.choice([None, date(2020, 1, 1 + rnd.randrange(20))])
    nodes = [node(x, ns=ns[x], vf=day(), props={"merged_ids": f'["old-{x}", "shared"]'} if i % 7 == 0 else {}, pos=i) for i, x in enumerate(names)]
    edges = [edge(f"e{i}", rnd.choice(names), rnd.choice([*names, "missing"]), rnd.choice(["depends_on", "owns"]), ns=rnd.choice([["a"], ["b"]]), vf=day(), pos=i) for i in range(m)]
    return nodes, edges


def _same(spark, layout: Adjacency, g: Graph, start: str):
    pairs = lambda df: sorted((r["id"], r["dist"]) for r in df.collect())
    own = lookup.canonical(g, start)
    assert layout.canonical(start) == own and layout.canonical("old-n0") == lookup.canonical(g, "old-n0")
    assert ids(layout.get_node(start)) == ids(lookup.get_node(g, start))
    assert ids(layout.out_edges(own, "owns")) == ids(lookup.out_edges(g, own, "owns")) and ids(layout.in_edges(own)) == ids(lookup.in_edges(g, own))
    assert pairs(layout.distances([own])) == pairs(traversal.distances(g.nodes, g.edges, [own]))
    for got, want in ((layout.neighbors(start, "owns", 2), traversal.neighbors(g, start, "owns", 2)), (layout.scoped_neighbors(["a"], start, depth=2), traversal.scoped_neighbors(g, ["a"], start, depth=2)), (layout.scoped_neighbors(["a"], start, depth=2, strict=True), traversal.scoped_neighbors(g, ["a"], start, depth=2, strict=True))):
        assert [ids(x) for x in got] == [ids(x) for x in want]
    assert pairs(layout.scoped_distances(["a"], start, "2020-01-10")) == pairs(traversal.scoped_distances(g, ["a"], start, "2020-01-10"))


@pytest.mark.parametrize("listed", [1000, 2])
def test_adjacency_equals_traversal(spark, tmp_path, monkeypatch, listed):
    """Before and after an update, with frontiers in filters and in joins, from a node, an alias, a shared alias and an id that isn't there."""
    monkeypatch.setattr(adjacency, "LISTED", listed)
    nodes, edges = _random_graph(spark, 5)
    g = graph(spark, nodes, edges)
    layout = Adjacency(spark, str(tmp_path / "adj"), buckets=4)
    assert not layout.written()
    layout.build(g)
    for start in ("old-n7",) if listed > 2 else ("shared",):
        _same(spark, layout, g, start)
    changed = [node("n0", ns=["a"], props={"merged_ids": '["old-n35"]'}, pos=99), node("new", ns=["a"], pos=100)]
    come, gone = [edge("e3", edges[3][8], edges[3][9], "owns", ns=["a"], pos=3), edge("x", "new", "n0", ns=["a"], pos=101)], edges[10:15]
    now = graph(spark, [x for x in nodes if x[0] != "n0"] + changed, [x for i, x in enumerate(edges) if i != 3 and x not in gone] + come)
    part = graph(spark, changed, come)
    Adjacency(spark, str(tmp_path / "adj"), buckets=4).update(part.nodes, part.edges, graph(spark, changed, gone).edges)
    again = Adjacency(spark, str(tmp_path / "adj"), buckets=4)
    assert ids(again.tables.read("out")) == ids(now.edges) == ids(again.tables.read("into")) and ids(again.tables.read("nodes")) == ids(now.nodes)
    for start in ("old-n35",) if listed > 2 else ("nobody",):
        _same(spark, again, now, start)


def test_a_hop_reads_its_buckets_only(spark, tmp_path):
    n = 400
    g = graph(spark, [node(f"n{i}") for i in range(n)], [edge(f"e{i}", f"n{i}", f"n{i + 1}") for i in range(n - 1)])
    root = str(tmp_path / "pub")
    publication.publish_graph(g, root, "1", publication.manifest(g, Ontology()), adjacency=True)
    layout = publication.Published(spark, root).adjacency()
    one, whole = layout.out_edges("n7"), layout.tables.read("out")
    assert ids(one) == ["e7"] and {f.rsplit("bucket=", 1)[1].split("/")[0] for f in one.inputFiles()} == {str(b) for b in layout.tables.numbers(spark.createDataFrame([("n7",)], "id string"))}
    assert len(one.inputFiles()) * 8 < len(whole.inputFiles())
    assert "PushedFilters: [IsNotNull(from_id), EqualTo(from_id,n7)]" in one._jdf.queryExecution().toString()
    assert {r["id"]: r["dist"] for r in layout.distances(["n7"], 2).collect()} == {"n5": 2, "n6": 1, "n7": 0, "n8": 1, "n9": 2}


def test_facts_by_validity(spark, tmp_path):
    """Snapshots and changes equal those of a scan for spans of all kinds, and read few files; also before 1970 and at the ends of the calendar."""
    rnd = random.Random(7)
    day = lambda: date(1960 + rnd.randrange(40), 1 + rnd.randrange(12), 1 + rnd.randrange(28))
    spans = [(day() if rnd.random() < 0.9 else None, day() if rnd.random() < 0.9 else None) for _ in range(150)]
    starts = [day() for _ in range(150)]
    spans += [(a, date.fromordinal(a.toordinal() + rnd.choice([0, 1, 2, 31, 32, 33, 64, 65, 400]))) for a in starts]
    spans += [(date(1, 1, 1), date(9999, 12, 31)), (date(1970, 1, 1), date(1970, 2, 2)), (None, None)]
    edges = [edge(f"e{i}", "a", "b", vf=a, vt=b) for i, (a, b) in enumerate(spans)]
    g = graph(spark, [node("a"), node("b", vf=date(1975, 5, 5))], edges)
    root = str(tmp_path / "pub")
    publication.publish_graph(g, root, "1", publication.manifest(g, Ontology()), by_validity=True)
    reader = publication.Published(spark, root)
    assert reader.graph().edges.columns == g.edges.columns and ids(reader.graph().edges) == ids(g.edges)
    for at in ("1969-12-31", "1975-05-05", str(starts[0]), str(spans[3][1] or "1980-02-29"), "9999-12-31"):
        got, want = reader.snapshot(at), lookup.snapshot(g, at)
        assert ids(got.nodes) == ids(want.nodes) and ids(got.edges) == ids(want.edges), at
    for since, until in (("1968-02-01", "1972-02-01"), (str(starts[1]), str(date.fromordinal(starts[1].toordinal() + 1))), ("1980-01-01", "1980-01-01")):
        got, want = ([sorted((r["id"], r["change"]) for r in x.collect())] for x in (reader.changes(since, until), lookup.changes(g, since, until)))
        assert got == want
    plan = reader.snapshot("1975-05-05").edges._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "block" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    narrow = reader.snapshot("1975-05-05").edges
    read = narrow.select(F.input_file_name()).distinct().count()
    assert 0 < read * 2 < len(reader.placed.edges.inputFiles())


def test_session_folders(spark):
    rows = [("/h/p/a/summary.json", 1), ("/h/p/a/chat_history.jsonl", 9), ("/h/p/b/chat_history.jsonl", 5), ("/h/p/c/summary.json", 99), ("/h/p/x/deep/chat_history.jsonl", 99), ("/h/q/e/chat_history.jsonl", 99)]
    files = spark.createDataFrame(rows, "path string, mtime long")
    found = transcripts.session_folders(files, "/h/", "p")
    assert sorted(map(tuple, found.collect())) == [("/h/p/a", 1), ("/h/p/b", 5)] and transcripts.newest(found).first()["path"] == "/h/p/b"
    assert transcripts.newest(found.limit(0)).first()["path"] is None
    assert transcripts.project_slug("/home/my_user/app") == "-home-my-user-app" and transcripts.url_name("/w x") == "%2Fw%20x"
    plain = spark.createDataFrame([("/h/p/t.jsonl", 1), ("/h/p/t.prompts.jsonl", 2), ("/h/p/prompts.jsonl", 3), ("/h/p/d/u.jsonl", 4), ("/h/p/n.txt", 5)], "path string, mtime long")
    assert sorted(r.mtime for r in transcripts.main_transcripts(plain).collect()) == [1, 3, 4]
    assert sorted(r.mtime for r in transcripts.project_transcripts(plain, "/h", "p").collect()) == [1, 2, 3]
