"""A temporal, namespace-scoped property graph: two DataFrames of facts and an alias map.

Nodes and edges are immutable rows with half-open validity [valid_from, valid_to); null is unbounded.
`pos` stands in for file order wherever an order must be total. Operators are functions of a Graph that
return DataFrames (or another Graph); nothing is computed until the caller asks.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROVENANCE = T.StructType([
    T.StructField("agent", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("proposed_at", T.StringType()), T.StructField("device", T.StringType()),
])
_FACT = [
    T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("ns", T.ArrayType(T.StringType())),
    T.StructField("valid_from", T.DateType()), T.StructField("valid_to", T.DateType()),
    T.StructField("props", T.MapType(T.StringType(), T.StringType())), T.StructField("src", T.ArrayType(T.StringType())), T.StructField("provenance", PROVENANCE),
]
NODE_SCHEMA = T.StructType([*_FACT, T.StructField("pos", T.LongType())])
EDGE_SCHEMA = T.StructType([*_FACT, T.StructField("from_id", T.StringType()), T.StructField("to_id", T.StringType()), T.StructField("pos", T.LongType())])


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> Graph:
        """A graph with ids made unique: of rows with one id, the last (by pos) counts."""
        return cls(last_of(nodes), last_of(edges))

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    def aliases(self) -> DataFrame:
        """(alias, id): merged ids that nodes carry as a JSON list in props.merged_ids."""
        text = F.try_element_at("props", F.lit("merged_ids"))
        return self.nodes.where(text.isNotNull()).select(F.explode(F.from_json(text, "array<string>")).alias("alias"), "id", "pos").groupBy("alias").agg(F.max_by("id", "pos").alias("id"))


def last_of(facts: DataFrame) -> DataFrame:
    """Of rows with one id the one with the greatest pos."""
    w = Window.partitionBy("id").orderBy(F.desc("pos"))
    return facts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def positioned(facts: DataFrame) -> DataFrame:
    """facts with a pos where the source has no order of its own: a hash of (type, id), so copies of an id tie.

    Files are ordered by type and id; operators that need that order sort by these columns."""
    return facts.withColumn("pos", F.xxhash64("type", "id"))


def shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with a fact's columns, nulls for those that it lacks."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def prop(name: str) -> Column:
    """A property's value, null if absent."""
    return F.try_element_at("props", F.lit(name))


def text_or_null(c: Column) -> Column:
    """c if it is more than white space."""
    return F.when(F.trim(c) != "", c)
