"""Bounded traversal: neighbours, hop distances, typed hops, cycles, hubs.

Distances grow level by level over links that are computed and written once; each level is a written table
of what is new, small ones being broadcast by their known size, and the result is the levels together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import drop_stored, stored
from tessera.operators.lookup import active_at, canonical
from tessera.operators.scope import scoped, visible
from tessera.plans.graph import Graph
from tessera.plans.ontology import GENERIC, IDENTITY, SEMANTIC

CAP = 4
FEW = 50_000


def few(written: DataFrame, most: int = FEW) -> DataFrame:
    """A written table, to broadcast if its known size is within a bound."""
    return F.broadcast(written) if written.limit(most + 1).count() <= most else written


def links_of(edges: DataFrame) -> DataFrame:
    """(a, b): both directions of every edge, from one pass over the edges."""
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    return edges.select(F.inline(F.array(way("from_id", "to_id"), way("to_id", "from_id"))))


def distances(nodes: DataFrame, edges: DataFrame, starts: list[str] | DataFrame, cap: int = CAP) -> DataFrame:
    """(id, dist): hops from the nearest start, at most cap, over undirected edges between nodes.

    starts: ids, or a DataFrame with a column id."""
    spark = nodes.sparkSession
    first = spark.createDataFrame([(x,) for x in starts], "id string") if isinstance(starts, list) else starts.select("id")
    ids = nodes.select("id")
    levels = [stored(first.distinct().join(ids, "id", "left_semi").withColumn("dist", F.lit(0)), "level")]
    # one hop reads them once
    links = edges.select("from_id", "to_id")
    links = stored(links, "links", "zstd") if cap > 1 else links

    def hop(level: DataFrame) -> DataFrame:
        near = few(level.select("id"))
        side = lambda own, other: links.join(near.withColumnRenamed("id", own), own, "left_semi").select(F.col(other).alias("id"))
        return side("from_id", "to_id").unionByName(side("to_id", "from_id"))

    # only what is reached is looked up among the nodes
    out = grown(levels[0], hop, cap, lambda new: new.join(ids, "id", "left_semi"))
    if cap > 1:
        drop_stored(links)
    return out


def grown(first: DataFrame, hop: Callable[[DataFrame], DataFrame], cap: int, kept: Callable[[DataFrame], DataFrame] = lambda new: new) -> DataFrame:
    """(id, dist): what hop (of a level, to ids, over undirected links) reaches from the written table `first` in at most cap steps; kept says which new ids count."""
    levels = [first]
    for d in range(1, cap + 1):
        new = hop(levels[-1]).distinct()
        # what is two levels back can't come again: a link goes both ways
        for level in levels[-2:]:
            new = new.join(level.select("id"), "id", "left_anti")
        levels.append(stored(kept(new).withColumn("dist", F.lit(d)), "level"))
        if levels[-1].isEmpty():
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def neighbors(g: Graph, id_: str, edge_type: str | None = None, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes (with dist) within depth hops of the node with an id or alias, itself included, and the edges met on the way:
    those with an end at less than depth hops. depth is held within 1 and 5."""
    return _around(g, canonical(g, id_), edge_type, depth)


def _around(g: Graph, id_: str, edge_type: str | None, depth: int) -> tuple[DataFrame, DataFrame]:
    depth = max(1, min(5, depth))
    edges = g.edges if edge_type is None else g.edges.where(F.col("type") == edge_type)
    dist = distances(g.nodes, edges, [id_], depth)
    near = dist.where(F.col("dist") < depth).select("id")
    outward = edges.join(near.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    inward = edges.join(near.withColumnRenamed("id", "to_id"), "to_id", "left_semi").join(near.withColumnRenamed("id", "from_id"), "from_id", "left_anti")
    return g.nodes.join(dist, "id"), outward.unionByName(inward)


def scoped_neighbors(g: Graph, scope: list[str], id_: str, edge_type: str | None = None, depth: int = 1, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Neighbours that are visible; nothing around a node that is hidden itself. The walk passes through hidden nodes unless
    strict; an edge needs both ends kept."""
    own = canonical(g, id_)
    start = g.nodes.where((F.col("id") == own) & visible(scope))
    nodes, edges = _around(scoped(g, scope) if strict else g, own if not start.isEmpty() else "", edge_type, depth)
    nodes = nodes.where(visible(scope))
    ids = nodes.select("id")
    kept = edges.where(visible(scope)).join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return nodes, kept


def scoped_distances(g: Graph, scope: list[str], center: str, as_of: str | None = None, cap: int = CAP) -> DataFrame:
    """Hops from a node (id or alias) over visible nodes and edges only, and only active edges if as_of is given; the centre
    must be visible and active itself, nodes on the way only visible."""
    seen = scoped(g, scope)
    start = active_at(seen.nodes, as_of).where(F.col("id") == canonical(g, center))
    return distances(seen.nodes, active_at(seen.edges, as_of), start, cap)


def type_weight(edge_type: Column) -> Column:
    """What an edge type says: generic 0.15, identity 0.2, semantic 1.0, any other 0.5."""
    return F.when(edge_type.isin(*GENERIC), 0.15).when(edge_type.isin(*IDENTITY), 0.2).when(edge_type.isin(*SEMANTIC), 1.0).otherwise(0.5)


def typed_hops(seeds: DataFrame, edges: DataFrame, limit: int = CAP) -> DataFrame:
    """seeds may be marked for broadcast. (seed, hop, hop_type, rank): for each seed edge the first `limit` semantic edges that share an end with it, by weight then id."""
    ends = lambda df, name, *more: df.select(F.col("id").alias(name), F.explode(F.array("from_id", "to_id")).alias("end"), *more)
    semantic = edges.where(type_weight(F.col("type")) == 1.0)
    pairs = ends(seeds, "seed").join(ends(semantic, "hop", F.col("type").alias("hop_type")), "end").where("seed <> hop").select("seed", "hop", "hop_type").distinct()
    w = Window.partitionBy("seed").orderBy("hop")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("seed", "hop", "hop_type", "rank")


def touching(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The edges that share an end with some of a few seed edges, which are broadcast."""
    near = lambda c: F.broadcast(seeds.select(F.explode(F.array("from_id", "to_id")).alias(c)).distinct().withColumn(f"_{c}", F.lit(True)))
    return edges.join(near("from_id"), "from_id", "left").join(near("to_id"), "to_id", "left").where("_from_id OR _to_id").select(*edges.columns)


def scoped_typed_hops(g: Graph, scope: list[str], seeds: DataFrame, as_of: str | None = None, limit: int = CAP) -> DataFrame:
    return typed_hops(seeds, active_at(scoped(g, scope).edges, as_of), limit)


def degrees(g: Graph) -> DataFrame:
    """(id, degree) of every node that has an edge."""
    return links_of(g.edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))


def hubs(g: Graph, limit: int = 10) -> DataFrame:
    """The nodes with most edges: ties by lower-cased label, then id."""
    label = F.coalesce(F.try_element_at("props", F.lit("name")), F.try_element_at("props", F.lit("title")), F.col("id"))
    return degrees(g).join(g.nodes, "id").select("id", label.alias("label"), "degree").orderBy(F.desc("degree"), F.lower("label"), "id").limit(limit)


def _raked(left: DataFrame) -> DataFrame:
    """left without the links of nodes that have no way in or no way out; one layer of them."""
    kept = left.join(left.select(F.col("to_id").alias("from_id")).distinct(), "from_id", "left_semi").join(left.select(F.col("from_id").alias("to_id")).distinct(), "to_id", "left_semi")
    return stored(kept.select("from_id", "to_id"), "links")


def _compressed(left: DataFrame, log: list[str]) -> tuple[DataFrame, DataFrame] | None:
    """Nodes with one way in and one way out, as paths (id, u, w) between other nodes and as rings (id, c) without any; None if there are none.

    Pointers to both sides double until they leave such nodes; those that have not after as many rounds as their number has digits go round
    a ring, and have seen all of it."""
    out = left.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n_out"), F.min("to_id").alias("w")).where("n_out = 1")
    come = left.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n_in"), F.min("from_id").alias("u")).where("n_in = 1")
    chain = stored(out.join(come, "id").select("id", "u", "w", F.col("id").alias("c")), "chain")
    n, covered = chain.count(), 1
    if n == 0:
        return None
    mark = lambda c: chain.select(F.col("id").alias(c), F.lit(True).alias(f"on_{c}"))
    going = lambda df: df.where("on_u OR on_w")
    state = chain.join(mark("u"), "u", "left").join(mark("w"), "w", "left").fillna(False, ["on_u", "on_w"])
    state = stored(state.select("id", "u", "w", "c", "on_u", "on_w"), "paths")
    while covered <= 2 * n and not going(state).isEmpty():
        far = lambda c, *also: state.select(F.col("id").alias(c), F.col(c).alias(f"{c}2"), F.col(f"on_{c}").alias(f"on_{c}2"), *also)  # noqa: B023, E731
        moved = going(state).join(far("u", F.col("c").alias("c2")), "u", "left").join(far("w"), "w", "left")
        step = lambda c: (F.when(F.col(f"on_{c}"), F.col(f"{c}2")).otherwise(F.col(c)).alias(c), (F.col(f"on_{c}") & F.coalesce(F.col(f"on_{c}2"), F.lit(False))).alias(f"on_{c}"))
        (u, on_u), (w, on_w) = step("u"), step("w")
        old, state = state, stored(state.where("NOT on_u AND NOT on_w").unionByName(moved.select("id", u, w, F.least("c", F.when(F.col("on_u"), F.col("c2"))).alias("c"), on_u, on_w)), "paths")
        drop_stored(old)
        covered *= 2
        log.append("double")
    drop_stored(chain)
    return state.where("NOT on_u AND NOT on_w").select("id", "u", "w"), state.where("on_u").select("id", "c")


def _coloured(left: DataFrame, log: list[str]) -> tuple[DataFrame, DataFrame]:
    """Some strongly connected components (id, c) of a core, and the links that remain. Every node takes the greatest id that reaches it as its
    colour; the nodes of a colour that reach its id are one component."""
    colours = stored(left.select(F.col("from_id").alias("id"), F.col("from_id").alias("c")).distinct(), "colours")
    moved = colours
    while not moved.isEmpty():
        come = left.join(moved.withColumnRenamed("id", "from_id"), "from_id").groupBy(F.col("to_id").alias("id")).agg(F.max("c").alias("new"))
        now = stored(colours.join(come, "id", "left").select("id", F.greatest("c", "new").alias("c"), F.coalesce(F.col("new") > F.col("c"), F.lit(False)).alias("moved")), "colours")
        drop_stored(colours)
        colours, moved = now.select("id", "c"), now.where("moved").select("id", "c")
        log.append("colour")
    one = left.join(colours.select(F.col("id").alias("from_id"), "c"), "from_id").join(colours.select(F.col("id").alias("to_id"), F.col("c").alias("to_c")), "to_id").where("c = to_c")
    one = stored(one.select("from_id", "to_id", "c"), "coloured")
    reach = stored(colours.where("id = c").select("id"), "reach")
    new = reach
    while not new.isEmpty():
        old_new, old = new, reach
        new = stored(one.join(new.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct().join(reach, "id", "left_anti"), "new")
        reach = stored(reach.unionByName(new), "reach")
        drop_stored(old, *([old_new] if old_new is not old else []))
        log.append("reach")
    ends = lambda df, how: df.join(reach.withColumnRenamed("id", "from_id"), "from_id", how).join(reach.withColumnRenamed("id", "to_id"), "to_id", how)
    # a component of one node has no link left; loops were taken before
    found = stored(ends(one, "left_semi").select(F.col("from_id").alias("id"), "c").distinct(), "cyclic")
    return found, stored(ends(one, "left_anti").select("from_id", "to_id"), "links")


def on_cycle(edges: DataFrame, log: list[str] | None = None) -> DataFrame:
    """(id): nodes that reach themselves along directed edges. A loop counts. log takes the name of each round.

    Nodes without a way in or out are raked off, layer by layer; where that is slow, paths of nodes with one way in and one way out become
    single links by doubling pointers, so chains, rings and trees of any length take rounds by the logarithm of it. The core that neither changes
    is cut into strongly connected components by colouring, whose rounds go with the longest path that a colour takes there. Backwards, a path's nodes
    belong to the component that both its ends are in. Tables have a row for each node or link, never for pairs."""
    log = [] if log is None else log
    every = edges.where("from_id is not null and to_id is not null").select("from_id", "to_id").distinct()
    left = stored(every.where("from_id <> to_id"), "links")
    loops = stored(every.where("from_id = to_id").select(F.col("from_id").alias("id")), "loops")
    parts, paths = loops.select("id", F.col("id").alias("c")).limit(0), []
    count = left.count()
    while count:
        old, left = left, _raked(left)
        drop_stored(old)
        before, count = count, left.count()
        log.append("rake")
        if count == 0 or count <= 0.9 * before:
            continue
        squeezed = _compressed(left, log)
        if squeezed is None and count < before:
            continue
        if squeezed is None:
            found, rest = _coloured(left, log)
            parts = parts.unionByName(found)
        else:
            path, ring = squeezed
            paths.append(path)
            parts = parts.unionByName(ring)
            loops = loops.unionByName(path.where("u = w").select(F.col("u").alias("id")))
            gone = path.select("id").unionByName(ring.select("id"))
            kept = left.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
            rest = stored(kept.select("from_id", "to_id").unionByName(path.where("u <> w").select(F.col("u").alias("from_id"), F.col("w").alias("to_id"))).distinct(), "links")
        drop_stored(left)
        left = rest
        count = left.count()
    loops = loops.distinct()
    alone = loops.join(parts, "id", "left_anti")
    for path in paths:
        alone = alone.join(path, "id", "left_anti")
    parts = parts.unionByName(alone.select("id", F.col("id").alias("c")))
    for path in reversed(paths):
        known = stored(parts, "parts")
        of = lambda c: known.select(F.col("id").alias(c), F.col("c").alias(f"c_{c}"))  # noqa: B023, E731
        both = path.join(of("u"), "u", "left").join(of("w"), "w", "left").join(loops.withColumn("loop", F.lit(True)), "id", "left")
        c = F.coalesce(F.when(F.col("c_u") == F.col("c_w"), F.col("c_u")), F.when(F.col("loop"), F.col("id")))
        parts = known.unionByName(both.select("id", c.alias("c")).where("c is not null"))
        log.append("back")
    return parts.select("id").distinct()
