"""Row-level visibility: namespaces, wildcards, and the scoped graph that every scoped read starts from."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.lookup import canonical, changes, closed, get_edge, get_node, history_of, snapshot
from tessera.plans.graph import Graph

PUBLIC = "public"


def namespaces(g: Graph) -> DataFrame:
    """(ns): every namespace in the graph."""
    return g.nodes.select(F.explode("ns").alias("ns")).union(g.edges.select(F.explode("ns"))).distinct()


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression over the whole name: * ? and [..]; case counts."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            body = glob[i:j].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = j + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def expand_namespaces(g: Graph, allowed: list[str]) -> DataFrame:
    """(ns): allowed names, with those that hold * replaced by the graph's namespaces that they match."""
    spark = g.nodes.sparkSession
    literal = spark.createDataFrame([(x,) for x in allowed if "*" not in x], "ns string")
    globs = [glob_pattern(x) for x in allowed if "*" in x]
    if not globs:
        return literal.distinct()
    match: Column = F.lit(False)
    for p in globs:
        match = match | F.col("ns").rlike(p)
    return literal.union(namespaces(g).where(match)).distinct()


def effective(g: Graph, allowed: list[str]) -> list[str]:
    """The scope as a sorted list: expanded names and the public one. Its size is the number of namespaces, not of facts."""
    return sorted({r["ns"] for r in expand_namespaces(g, allowed).collect()} | {PUBLIC})


def visible(scope: list[str]) -> Column:
    return F.arrays_overlap("ns", F.array(*[F.lit(x) for x in scope]))


def scoped(g: Graph, scope: list[str]) -> Graph:
    """Nodes with a namespace in scope; edges with one too, whose both ends are visible."""
    return closed(Graph(g.nodes.where(visible(scope)), g.edges.where(visible(scope))))


def scoped_snapshot(g: Graph, scope: list[str], at: str) -> Graph:
    """The visible graph at a date: edges also need both ends active."""
    return closed(snapshot(Graph(g.nodes.where(visible(scope)), g.edges.where(visible(scope))), at))


def scoped_history(g: Graph, scope: list[str], id_: str) -> DataFrame:
    """Nothing if the node is hidden, for then its edges are hidden too; an alias counts as its node."""
    return history_of(scoped(g, scope), canonical(g, id_))


def scoped_node(g: Graph, scope: list[str], id_: str) -> DataFrame:
    """The visible node with an id or alias."""
    return get_node(g, id_).where(visible(scope))


def scoped_edge(g: Graph, scope: list[str], id_: str) -> DataFrame:
    """The edge with an id if it and both its ends are visible."""
    return closed(Graph(g.nodes.where(visible(scope)), get_edge(g, id_).where(visible(scope)))).edges


def scoped_changes(g: Graph, scope: list[str], since: str, until: str) -> DataFrame:
    """Changes of visible edges; their ends must be visible, not active."""
    return changes(scoped(g, scope), since, until)
