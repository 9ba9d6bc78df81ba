"""The incremental graph against one resolution of everything."""

import random

import pytest

from tessera.operators.journal import ENTRY
from tessera.plans import publication
from tessera.plans.incremental import IncrementalGraph
from tests.test_operators import edge, graph, node


def entry(n, kind, id_, type_, a=None, b=None, confidence=0.9, props=None, status="pending"):
    return (f"{n:04d}", "ag", None, "public", confidence, f"t{n}", status, kind, id_, type_, a, b, ["public"], None, None, props or {"name": f"n{n}"}, [f"j:{n}"])


def plain(g):
    nodes = sorted((r.id, r.type, tuple(r.ns), tuple(r.src), tuple(sorted(r.props.items()))) for r in g.nodes.collect())
    edges = sorted((r.id, r.type, r.from_id, r.to_id, tuple(r.src), tuple(sorted(r.props.items()))) for r in g.edges.collect())
    return nodes, edges


def journal(rnd, n):
    ids = [f"svc:{x}" for x in ("a", "b", "C_d", "c-d", "E", "e", "f g", "h")] + ["prs:x", "prs:y"]
    kind = lambda i: "person" if i.startswith("prs") else "service"
    rows = []
    for k in range(n):
        i, j = rnd.choice(ids), rnd.choice(ids)
        what = rnd.random()
        if what < 0.45:
            props = {"name": f"n{k}"} | ({"description": rnd.choice(["one part", "one part more", "other"])} if rnd.random() < 0.4 else {}) | ({"merged_ids": f'["{j}"]'} if rnd.random() < 0.1 and kind(i) == kind(j) else {})
            rows.append(entry(k, "node", i, kind(i), confidence=rnd.choice([0.3, 0.6, 0.9]), props=props))
        elif what < 0.6:
            rows.append(entry(k, "edge", "", "same_as", i, j, confidence=rnd.choice([0.4, 1.0])))
        else:
            rows.append(entry(k, "edge", "", rnd.choice(["depends_on", "relates_to", "owns"]), i, j))
    return rows + [entry(n, "node", "zz", "no such type"), entry(n + 1, "node", None, "service"), entry(n + 2, "edge", "", "depends_on", "svc:a", "svc:nowhere"), entry(n + 3, "node", "svc:done", "service", status="merged")]


@pytest.mark.parametrize("seed", [1])
def test_batches_in_any_order_equal_one_resolution(spark, tmp_path, seed):
    rnd = random.Random(seed)
    start = graph(spark, [node("svc:a", props={"name": "A"}), node("svc:C_d", ns=["x"]), node("svc:far"), node("svc:off")], [edge("e1", "svc:a", "svc:far"), edge("e2", "svc:far", "svc:off", props={"note": "stays"})])
    rows = journal(rnd, 40)
    publication.resolve_pending(start, spark.createDataFrame(rows, ENTRY), str(tmp_path / "one"), "1")
    want = plain(publication.Published(spark, str(tmp_path / "one")).graph())
    rnd.shuffle(rows)  # late entries and edges before their ends, too
    root = str(tmp_path / "state")
    IncrementalGraph(spark, root, buckets=8).load(start)
    for n in range(3):
        state = IncrementalGraph(spark, root, buckets=8)  # as after a restart
        assert state.apply(n + 1, spark.createDataFrame(rows[n::3], ENTRY)) and not state.apply(n + 1, spark.createDataFrame(rows[n::3], ENTRY))
    assert plain(IncrementalGraph(spark, root, buckets=8).graph()) == want


def test_only_touched_groups_are_folded(spark, tmp_path):
    start = graph(spark, [node(f"svc:{i}") for i in range(200)], [edge(f"e{i}", f"svc:{i}", f"svc:{i + 1}") for i in range(199)])
    state = IncrementalGraph(spark, str(tmp_path / "s"), buckets=16)
    state.load(start)
    assert state.report == {"groups": 200, "ids": 200, "edges": 199}
    before = {t: dict(x) for t, x in state.tables.index.items()}
    state.apply(1, spark.createDataFrame([entry(1, "edge", "", "same_as", "svc:7", "svc:150"), entry(2, "node", "svc:New", "service")], ENTRY))
    assert state.report["groups"] == 2 and state.report["ids"] == 4 and state.report["edges"] == 5
    rewritten = {t: sum(before.get(t, {}).get(b) != v for b, v in x.items()) for t, x in state.tables.index.items()}
    assert rewritten["nodes"] <= 4 and rewritten["roots"] <= 4 and rewritten["base_nodes"] == 0
    got = state.graph()
    assert got.nodes.count() == 200 and {r.id for r in got.nodes.collect()} >= {"svc:new"} and got.edges.count() == 199


def test_failed_batch_comes_again(spark, tmp_path, monkeypatch):
    root, feed = str(tmp_path / "s"), tmp_path / "feed"
    stream = lambda: spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).json(str(feed))
    put = lambda name, rows: spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").json(str(feed))
    put("1", [entry(1, "node", "svc:a", "service"), entry(2, "edge", "", "depends_on", "svc:a", "svc:b")])
    state = IncrementalGraph(spark, root, buckets=4)
    monkeypatch.setattr(state.tables, "commit", lambda *a: (_ for _ in ()).throw(OSError("no disk")))
    with pytest.raises(Exception, match="no disk"):
        state.follow(stream())
    again = IncrementalGraph(spark, root, buckets=4)
    assert again.graph().nodes.count() == 0
    again.follow(stream())
    put("2", [entry(3, "node", "svc:b", "service")])
    last = IncrementalGraph(spark, root, buckets=4)
    last.follow(stream())
    last.follow(stream())
    nodes, edges = plain(last.graph())
    assert [x[0] for x in nodes] == ["svc:a", "svc:b"] and [x[:4] for x in edges] == [("e_depends_on_0001", "depends_on", "svc:a", "svc:b")]
