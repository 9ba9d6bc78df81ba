"""Queries over layouts that are written from the sample graph, and the SQL of the same questions without them. Importing it registers them."""

from __future__ import annotations

import uuid

from tessera.operators.adjacency import Adjacency
from tessera.operators.components import own_dir
from tessera.plans.graph import EDGE_SCHEMA, NODE_SCHEMA, Graph, shaped
from tessera.plans.queries import AT, SCOPE, SINCE, SQL, UNTIL, _both, _with_aliases, facts, query
from tessera.sources import validity
from tessera.sources.graph_view import sample_graph


def _folder(spark, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _adjacency(spark, d) -> Adjacency:
    layout = Adjacency(spark, _folder(spark, "adjacency"))
    layout.build(_with_aliases(sample_graph(spark, d)))
    return layout


@query("adjacency_neighbors", SQL["neighbors_d2"])
def adjacency_neighbors(spark, d):
    return _both(*_adjacency(spark, d).neighbors("cust:42", depth=2))


@query("adjacency_scoped_neighbors", SQL["scoped_neighbors_by_alias"])
def adjacency_scoped_neighbors(spark, d):
    return _both(*_adjacency(spark, d).scoped_neighbors(SCOPE, "old-part:100", depth=2), dist=False)


@query("adjacency_scoped_distances", SQL["scoped_distances_by_alias"])
def adjacency_scoped_distances(spark, d):
    return _adjacency(spark, d).scoped_distances(SCOPE, "old-part:100", AT)


def _by_validity(spark, rows, schema):
    path = _folder(spark, "validity")
    validity.write(shaped(rows, schema), path)
    return validity.read(spark, path, schema)


@query("validity_snapshot", SQL["snapshot_at"])
def validity_snapshot(spark, d):
    g = sample_graph(spark, d)
    return facts(Graph(validity.snapshot(_by_validity(spark, g.nodes, NODE_SCHEMA), AT), validity.snapshot(_by_validity(spark, g.edges, EDGE_SCHEMA), AT)))


@query("validity_changes", SQL["changes_began_ended"])
def validity_changes(spark, d):
    return validity.changes(_by_validity(spark, sample_graph(spark, d).edges, EDGE_SCHEMA), SINCE, UNTIL).select("change", "id", "type")
