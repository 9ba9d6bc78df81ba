"""A written layout of a graph for traversal: edges twice, in buckets of either end, nodes in buckets of their id, aliases in buckets of the alias.

A hop reads the buckets of its frontier alone and, where that is small, only the row groups that may hold it; nothing of the size of the
graph is read or written. Results are those of the functions of the same names in traversal and lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.operators.components import drop_stored, stored
from tessera.operators.lookup import active
from tessera.operators.scope import visible
from tessera.operators.traversal import CAP, grown
from tessera.plans.graph import EDGE_SCHEMA, NODE_SCHEMA, Graph, shaped
from tessera.sources.buckets import BUCKETS, BucketTables

LISTED = 1000  # so many ids are listed in a filter, which reaches the files; more are joined
KEYS = {"nodes": "id", "out": "from_id", "into": "to_id", "aliases": "alias"}
SCHEMAS = {"nodes": NODE_SCHEMA, "out": EDGE_SCHEMA, "into": EDGE_SCHEMA, "aliases": StructType([StructField("alias", StringType()), StructField("id", StringType()), StructField("pos", LongType())])}


def _aliases(nodes: DataFrame) -> DataFrame:
    merged = F.from_json(F.try_element_at("props", F.lit("merged_ids")), "array<string>")
    return nodes.select(F.explode(merged).alias("alias"), "id", "pos").distinct()


class Adjacency:
    """The layout below a folder; build() writes it, update() rewrites the buckets that a change touches."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.tables = spark, BucketTables(spark, root, KEYS, SCHEMAS, buckets)

    def written(self) -> bool:
        return self.tables.batch >= 0

    def build(self, g: Graph) -> None:
        number, nodes, edges = self.tables.batch + 1, shaped(g.nodes, NODE_SCHEMA), shaped(g.edges, EDGE_SCHEMA)
        for table, rows in {"nodes": nodes, "out": edges, "into": edges, "aliases": _aliases(nodes)}.items():
            self.tables.write(table, rows, list(range(self.tables.buckets)), number)
        self.tables.commit(number)

    def update(self, nodes: DataFrame, edges: DataFrame, gone: DataFrame | None = None) -> None:
        """Takes nodes and edges that are new or changed, and takes away the edges in gone (rows as they were). A changed edge must keep its ends, else
        its old row goes into gone."""
        number, nodes, edges = self.tables.batch + 1, shaped(nodes, NODE_SCHEMA), shaped(edges, EDGE_SCHEMA)
        before, ids = self._at("nodes", nodes), nodes.select("id").distinct()
        named = stored(_aliases(before).unionByName(_aliases(nodes)).select("alias").distinct(), "named")
        other = self.tables.rows("aliases", named).join(ids, "id", "left_anti")
        self.tables.replace("aliases", named, other.unionByName(_aliases(nodes)), number)
        self.tables.replace("nodes", ids, nodes, number)
        gone = edges.limit(0) if gone is None else shaped(gone, EDGE_SCHEMA)
        for table in ("out", "into"):
            ends = stored(gone.unionByName(edges).select(KEYS[table]).distinct(), "ends")
            left = self.tables.rows(table, ends).join(gone.unionByName(edges).select("id"), "id", "left_anti")
            self.tables.replace(table, ends, left.unionByName(edges.select(*left.columns)), number)
            drop_stored(ends)
        drop_stored(named)
        self.tables.commit(number)

    def _at(self, table: str, ids: DataFrame) -> DataFrame:
        """The rows of a table whose key is among ids (a column id)."""
        some = [r["id"] for r in ids.select("id").distinct().limit(LISTED + 1).collect()]
        if len(some) > LISTED:
            return self.tables.rows(table, ids.select("id"))
        listed = self.spark.createDataFrame([(x,) for x in some], "id string")
        return self.tables.read(table, self.tables.numbers(listed)).where(F.col(KEYS[table]).isin(some))

    def _ids(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in ids], "id string")

    def canonical(self, id_: str) -> str:
        """The id of the node that an id or alias means; of nodes that share an alias the last by pos."""
        found = self._at("aliases", self._ids(id_)).agg(F.max_by("id", "pos").alias("id")).first()
        return found["id"] or id_

    def get_node(self, id_: str) -> DataFrame:
        own = self.canonical(id_)
        return self._at("nodes", self._ids(own)).withColumn("resolved_from", F.lit(id_ if own != id_ else None).cast("string"))

    def out_edges(self, id_: str, edge_type: str | None = None) -> DataFrame:
        return self._at("out", self._ids(id_)).where(_typed(edge_type))

    def in_edges(self, id_: str, edge_type: str | None = None) -> DataFrame:
        return self._at("into", self._ids(id_)).where(_typed(edge_type))

    def distances(self, starts: list[str] | DataFrame, cap: int = CAP, nodes_if: Column | None = None, edges_if: Column | None = None, start_if: Column | None = None) -> DataFrame:
        """(id, dist): hops from the nearest start, at most cap, over undirected edges of edges_if between nodes of nodes_if; starts need start_if, too."""
        every = F.lit(True)
        nodes_if, edges_if, start_if = (every if c is None else c for c in (nodes_if, edges_if, start_if))
        asked = self._ids(*starts) if isinstance(starts, list) else starts.select("id")
        first = stored(self._at("nodes", asked).where(nodes_if & start_if).select("id").distinct().withColumn("dist", F.lit(0)), "level")

        def hop(level: DataFrame) -> DataFrame:
            ends = lambda table, end: self._at(table, level).where(edges_if).select(F.col(end).alias("id"))
            return ends("out", "to_id").unionByName(ends("into", "from_id"))

        met: list[DataFrame] = []

        def kept(new: DataFrame) -> DataFrame:
            met.append(stored(new, "met"))
            return self._at("nodes", met[-1]).where(nodes_if).select("id")

        out = grown(first, hop, cap, kept)
        drop_stored(*met)
        return out

    def neighbors(self, id_: str, edge_type: str | None = None, depth: int = 1) -> tuple[DataFrame, DataFrame]:
        """Nodes (with dist) within depth hops of an id or alias, and the edges met on the way. depth is held within 1 and 5."""
        return self._around(self.canonical(id_), depth, None, _typed(edge_type))

    def _around(self, id_: str, depth: int, nodes_if: Column | None, edges_if: Column) -> tuple[DataFrame, DataFrame]:
        depth = max(1, min(5, depth))
        dist = self.distances([id_], depth, nodes_if, edges_if)
        near = dist.where(F.col("dist") < depth).select("id")
        outward = self._at("out", near).where(edges_if)
        inward = self._at("into", near).where(edges_if).join(near.withColumnRenamed("id", "from_id"), "from_id", "left_anti").select(*outward.columns)
        return self._at("nodes", dist).join(dist, "id"), outward.unionByName(inward)

    def scoped_neighbors(self, scope: list[str], id_: str, edge_type: str | None = None, depth: int = 1, strict: bool = False) -> tuple[DataFrame, DataFrame]:
        """Neighbours that are visible; nothing around a hidden node. The walk passes through hidden nodes unless strict; an edge needs both ends kept."""
        seen, own = visible(scope), self.canonical(id_)
        shown = not self._at("nodes", self._ids(own)).where(seen).isEmpty()
        typed = _typed(edge_type)
        nodes, edges = self._around(own if shown else "", depth, seen if strict else None, (typed & seen) if strict else typed)
        nodes = nodes.where(seen)
        ids = nodes.select("id")
        kept = edges.where(seen).join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
        return nodes, kept

    def scoped_distances(self, scope: list[str], center: str, as_of: str | None = None, cap: int = CAP) -> DataFrame:
        """Hops from a node (id or alias) over visible nodes and visible edges, active ones only if as_of is given; the centre must be active itself."""
        seen, live = visible(scope), F.lit(True) if as_of is None else active(as_of)
        return self.distances([self.canonical(center)], cap, seen, seen & live, live)


def _typed(edge_type: str | None) -> Column:
    return F.lit(True) if edge_type is None else F.col("type") == edge_type
