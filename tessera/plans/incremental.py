"""A resolved graph that takes journals batch by batch and folds only the groups that they touch.

All facts and entries are kept, by id, so what is folded again is folded from everything that was ever said of it; so the order in which
batches come does not matter, and late entries fall into their place. Ids that may mean one entity (normalised alike, same_as, merged_ids) form groups,
kept as a table of roots. A batch's links are joined to the roots of their ends, and components are computed on this
contracted graph alone, whose size is the batch's. The groups that new facts or links touch are judged, merged and resolved anew, with the
edges at their members; ends outside come with the canonical ids and types that the roots table has. All else stays as it is written.

Numbers of edges count all edges in order, so they are given when the graph is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import normal_id
from tessera.operators.components import connected_components, drop_stored, stored
from tessera.operators.journal import ENTRY, LOW, decided, merge_edges, merge_nodes
from tessera.operators.resolve import alias_map, checked_edges, collapsed_nodes, folded_edges, numbered_edges
from tessera.plans.graph import EDGE_SCHEMA, NODE_SCHEMA, Graph, prop
from tessera.plans.ontology import Ontology
from tessera.sources.buckets import BUCKETS, BucketTables
from tessera.streaming.streams import run_available

_KEYS = {"base_nodes": "id", "base_edges": "from_id", "node_entries": "id", "edge_entries": "from_id", "incoming": "to_id", "roots": "id", "members": "root", "nodes": "root", "edges": "from_root"}


def _schemas() -> dict[str, T.StructType]:
    of = T.StructType.fromDDL
    node, edge = T.StructType([f for f in NODE_SCHEMA if f.name != "pos"]), T.StructType([f for f in EDGE_SCHEMA if f.name != "pos"])
    return {
        "base_nodes": node, "base_edges": edge, "node_entries": of(ENTRY), "edge_entries": of(ENTRY), "incoming": of("to_id string, from_id string"),
        "roots": of("id string, root string, canonical string, canonical_type string"), "members": of("root string, id string"),
        "nodes": T.StructType([*node, T.StructField("root", T.StringType())]),
        "edges": T.StructType([*[f for f in edge if f.name != "id"], *of("from_root string, to_root string, _f string, _t string")]),
    }


class IncrementalGraph:
    """The state in a folder; a new object for the same folder goes on from its last whole batch."""

    def __init__(self, spark: SparkSession, root: str, ontology: Ontology | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.ontology, self.size = spark, root.rstrip("/"), ontology or Ontology(), buckets
        self.tables = BucketTables(spark, f"{self.root}/state", _KEYS, _schemas(), buckets)

    @property
    def report(self) -> dict | None:
        """What the last batch did: groups and ids folded again, edges judged again."""
        return self.tables.said

    def load(self, g: Graph) -> None:
        """The graph to begin with; once."""
        if self.tables.batch < 0:
            none = self.spark.createDataFrame([], ENTRY)
            self._apply(0, none, g.nodes, g.edges)

    def apply(self, number: int, entries: DataFrame) -> bool:
        """Takes pending entries as batch `number` (from 1); whether it did: a batch that is done is not done again."""
        if number <= self.tables.batch:
            return False
        schemas = _schemas()
        self._apply(number, entries.where("status = 'pending'"), self.spark.createDataFrame([], schemas["base_nodes"]), self.spark.createDataFrame([], schemas["base_edges"]))
        return True

    def follow(self, entries: DataFrame) -> None:
        """Takes what a stream of entries has now; the next call goes on from here, also if this one fails."""

        def each(batch: DataFrame, n: int) -> None:
            kept = stored(batch, "entries")
            self.apply(n + 1, kept)
            drop_stored(kept)

        run_available(entries, each, checkpoint=f"{self.root}/checkpoint")

    def graph(self) -> Graph:
        """The resolved graph."""
        edges = numbered_edges(self.tables.read("edges").drop("from_root", "to_root"))
        return Graph(self.tables.read("nodes").drop("root"), edges)

    def decisions(self) -> DataFrame:
        """All kept entries with their verdicts, as the whole graph has them now; over everything, for reports."""
        read = self.tables.read
        return decided(read("node_entries").unionByName(read("edge_entries")), read("base_nodes"), self.ontology)

    # ------------------------------------------------------------

    def _links(self, entries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """(a, b): pairs of one group that new facts make; (a, a) for an id that they only touch."""
        facts = nodes.select("id", "props").unionByName(entries.where("kind = 'node'").select("id", "props"))
        ends = edges.select("type", "from_id", "to_id").unionByName(entries.where("kind = 'edge'").select("type", "from_id", "to_id"))
        pair = lambda df, a, b: df.select(F.col(a).alias("a"), b.alias("b"))
        merged = facts.select("id", F.explode(F.from_json(prop("merged_ids"), "array<string>")).alias("other")).where("other is not null")
        links = pair(facts, "id", normal_id(F.col("id"), compose=True)).unionByName(pair(merged, "id", F.col("other")))
        same = pair(ends.where("type = 'same_as'"), "from_id", F.col("to_id"))
        return links.unionByName(same).unionByName(pair(ends.where("type <> 'same_as'"), "from_id", F.col("from_id"))).distinct()

    def _members(self, links: DataFrame) -> DataFrame:
        """(id, old, root) of every id in a touched group: the root that it had and the one that it gets."""
        ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
        rooted = ends.join(self.tables.rows("roots", ends).select("id", "root"), "id", "left").select("id", F.coalesce("root", "id").alias("old"))
        rooted = stored(rooted, "rooted")
        end = lambda c: rooted.select(F.col("id").alias(c), F.col("old").alias(f"_{c}"))
        contracted = links.join(end("a"), "a").join(end("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        merged = connected_components(contracted).withColumnRenamed("node", "old")
        olds = rooted.select("old").distinct()
        held = self.tables.rows("members", olds).select("id", F.col("root").alias("old"))
        every = held.unionByName(rooted.select("id", "old")).distinct()
        return stored(every.join(merged, "old", "left").select("id", "old", F.coalesce("root", "old").alias("root")), "members")

    def _apply(self, number: int, entries: DataFrame, base_nodes: DataFrame, base_edges: DataFrame) -> None:
        t = self.tables
        edge = F.col("from_id").isNotNull() & F.col("to_id").isNotNull()
        whole = F.col("id").isNotNull() & F.col("type").isNotNull() & ((F.col("kind") == "node") | ((F.col("kind") == "edge") & edge))
        entries = entries.where(whole & (F.col("confidence") >= LOW))  # others are quarantined whatever comes
        new_ends = entries.where("kind = 'edge'").select("to_id", "from_id").unionByName(base_edges.select("to_id", "from_id")).distinct()
        for name, rows in (("base_nodes", base_nodes), ("base_edges", base_edges), ("node_entries", entries.where("kind = 'node'")), ("edge_entries", entries.where("kind = 'edge'")), ("incoming", new_ends)):
            t.append(name, rows, number)
        links = stored(self._links(entries, base_nodes, base_edges), "links")
        members = self._members(links)
        ids = members.select("id")

        sources = stored(t.rows("incoming", ids).select("from_id").unionByName(ids.select(F.col("id").alias("from_id"))).distinct(), "sources")
        inside = lambda df: df.join(ids.select(F.col("id").alias("from_id"), F.lit(True).alias("_a")), "from_id", "left").join(ids.select(F.col("id").alias("to_id"), F.lit(True).alias("_b")), "to_id", "left").where("_a or _b").drop("_a", "_b")
        said, held = inside(t.rows("edge_entries", sources)), inside(t.rows("base_edges", sources))
        ends = lambda df: df.select(F.col("from_id").alias("id")).unionByName(df.select(F.col("to_id").alias("id")))
        around = stored(ends(said).unionByName(ends(held)).distinct().join(ids, "id", "left_anti"), "around")
        near = ids.unionByName(around)
        own = lambda df: df.join(ids, "id", "left_semi")

        columns = [f.name for f in _schemas()["edge_entries"]]
        base = t.rows("base_nodes", near)
        judged = decided(t.rows("node_entries", near).select(*columns).unionByName(said.select(*columns)), base, self.ontology)
        passed = stored(judged.where("verdict <> 'quarantined'"), "passed")
        nodes = stored(merge_nodes(own(base), own(passed.where("kind = 'node'"))).where(F.col("type").isin(*self.ontology.node_types)).drop("facts"), "nodes")
        edges = stored(merge_edges(held, passed).drop("facts"), "edges")

        aliases = stored(alias_map(nodes, edges), "aliases")
        folded = stored(collapsed_nodes(nodes, aliases), "folded")
        outside = stored(t.rows("roots", around), "outside")
        known = folded.select("id", "type").unionByName(outside.where("canonical_type is not null").select(F.col("canonical").alias("id"), F.col("canonical_type").alias("type")).distinct())
        renamed = aliases.unionByName(outside.where("canonical <> id").select(F.col("id").alias("alias"), "canonical"))
        whole_edges = folded_edges(checked_edges(edges, known, renamed, self.ontology).where("reason is null"))

        types = folded.select(F.col("id").alias("canonical"), F.col("type").alias("canonical_type"))
        roots = members.select("id", "root").join(aliases.withColumnRenamed("alias", "id"), "id", "left").withColumn("canonical", F.coalesce("canonical", "id")).join(types, "canonical", "left")
        at = members.select("id", "root").unionByName(outside.select(F.col("canonical").alias("id"), "root")).distinct()
        root_of = lambda c, name: at.select(F.col("id").alias(c), F.col("root").alias(name))
        placed = stored(whole_edges.join(root_of("from_id", "from_root"), "from_id").join(root_of("to_id", "to_root"), "to_id"), "placed")

        touched = members.select(F.col("old").alias("root")).unionByName(members.select("root")).distinct()
        self._edges(number, touched, sources, placed)
        t.replace("nodes", touched, folded.join(members.select("id", "root"), "id"), number)
        t.replace("members", touched, members.select("root", "id"), number)
        t.replace("roots", ids, roots, number)
        groups = members.agg(F.count_distinct("root").alias("groups"), F.count("*").alias("ids")).first()
        t.commit(number, {"groups": groups["groups"], "ids": groups["ids"], "edges": edges.count()})
        drop_stored(links, members, sources, around, passed, nodes, edges, aliases, folded, outside, placed)

    def _edges(self, number: int, touched: DataFrame, sources: DataFrame, placed: DataFrame) -> None:
        """Edges at touched groups go, those that were folded again come; only buckets of groups that such an edge begins in are written."""
        t = self.tables
        begins = t.rows("roots", sources).select("root").unionByName(touched).unionByName(placed.select(F.col("from_root").alias("root"))).distinct()
        numbers = t.numbers(begins)
        gone = lambda c: touched.select(F.col("root").alias(c))
        kept = t.read("edges", numbers).join(gone("from_root"), "from_root", "left_anti").join(gone("to_root"), "to_root", "left_anti")
        names = _schemas()["edges"].names
        t.write("edges", kept.select(*names).unionByName(placed.select(*names)), numbers, number)
