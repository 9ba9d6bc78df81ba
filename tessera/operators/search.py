"""Text search over nodes and edges, ranking, and the scoped search that combines them.

Facts are searched in file order (type, then id). Two modes: `scan` looks for the whole query as one
substring; `terms` wants every term of the query, each as a run of adjacent tokens.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import stored
from tessera.operators.lookup import active_at, closed
from tessera.operators.scope import scoped, visible
from tessera.operators.traversal import CAP, few, scoped_distances, touching, type_weight, typed_hops
from tessera.plans.graph import Graph, prop, text_or_null

if TYPE_CHECKING:
    from tessera.operators.adjacency import Adjacency
    from tessera.operators.text_index import SearchIndex

OVER_FETCH = 8
#: Pieces up to which texts are searched for each of them whole; of more, for runs of letters that cover them.
PIECES = 32
#: Ids of nodes whose label matches, up to which they are broadcast.
MATCHED = 1_000_000


def _others() -> Column:
    """Property values but for the name, by key."""
    kept = F.array_sort(F.map_entries(F.map_filter("props", lambda k, _: k != "name")))
    return F.array_join(F.transform(kept, lambda e: e["value"]), " ")


def node_text(nodes: DataFrame) -> DataFrame:
    """nodes with body: id, type, name and the other property values."""
    return nodes.withColumn("body", F.concat_ws(" ", "id", "type", F.coalesce(prop("name"), F.lit("")), _others()))


def labels(nodes: DataFrame) -> DataFrame:
    """(id, label): name, else title, if more than white space."""
    return nodes.select("id", F.coalesce(text_or_null(prop("name")), text_or_null(prop("title"))).alias("label")).where("label is not null")


def edge_text(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with body: id, type, ends, the ends' labels and the property values."""
    named = labels(nodes)
    a, b = named.select(F.col("id").alias("from_id"), F.col("label").alias("from_label")), named.select(F.col("id").alias("to_id"), F.col("label").alias("to_label"))
    # made before the joins, so that they needn't carry the properties for it
    values = F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: e["value"]), " ").alias("_values")
    body = F.concat_ws(" ", "id", "type", "from_id", "to_id", F.coalesce("from_label", F.lit("")), F.coalesce("to_label", F.lit("")), "_values")
    return edges.select("*", values).join(a, "from_id", "left").join(b, "to_id", "left").withColumn("body", body).select(*edges.columns, "body")


def _cover(pieces: list[str], n: int = 3) -> list[str]:
    """Few runs of n characters of which each piece has one; shorter pieces are whole."""
    out, left = [p for p in pieces if len(p) < n], {p for p in pieces if len(p) >= n}
    while left:
        grams = [p[i : i + n] for p in sorted(left) for i in range(len(p) - n + 1)]
        best = max(sorted(set(grams)), key=lambda x: sum(x in p for p in left))
        out, left = [*out, best], {p for p in left if best not in p}
    return out


def may_hold(text: Column, pieces: list[str]) -> Column:
    """False only where the text, lower-cased, has none of the pieces."""
    looked_for = sorted(set(pieces)) if len(pieces) <= PIECES else _cover(pieces)

    def hit(t: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in looked_for], F.lit(False))

    # as a lambda's argument the text is made and lower-cased once, not for each piece
    return F.exists(F.array(F.lower(text)), hit)


def edges_that_may_hold(edges: DataFrame, nodes: DataFrame, pieces: list[str]) -> DataFrame:
    """The edges whose text may hold one of the pieces (lower-cased, without white space, so each lies within one part of the text): their own
    part does, or the label of an end. So the labels of ends are joined to these edges alone."""
    values = F.array_join(F.transform(F.map_entries("props"), lambda e: e["value"]), " ")
    own = F.coalesce(may_hold(F.concat_ws(" ", "id", "type", "from_id", "to_id", values), pieces), F.lit(False))
    named = few(stored(labels(nodes).where(may_hold(F.col("label"), pieces)).select("id"), "named", "zstd"), MATCHED)
    end = lambda c: named.select(F.col("id").alias(c), F.lit(True).alias(f"_{c}"))
    return edges.withColumn("_own", own).join(end("from_id"), "from_id", "left").join(end("to_id"), "to_id", "left").where("_own OR _from_id OR _to_id").select(*edges.columns)


def search_edges(g: Graph, query: str, limit: int, mode: str = "scan") -> DataFrame:
    """search() over the texts of a graph's edges."""
    pieces = query.lower().split() if mode == "scan" else []
    edges = edges_that_may_hold(g.edges, g.nodes, [max(pieces, key=len)]) if pieces else g.edges
    return search(edge_text(edges, g.nodes), query, limit, mode)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, each with a space before and after, as one text."""
    low = F.lower(c)
    # in ASCII the class is a plain one, which is told faster
    kept = F.when(F.octet_length(low) == F.char_length(low), F.regexp_replace(low, "[^a-z0-9]+", " ")).otherwise(F.regexp_replace(low, r"[^\p{L}\p{N}\p{Co}]+", " "))
    return F.concat(F.lit(" "), F.trim(kept), F.lit(" "))


def matches(body: Column, query: str, mode: str = "scan") -> Column:
    if mode == "scan":
        return F.contains(F.lower(body), F.lit(query.lower()))
    hit: Column = F.lit(bool(query.split()))
    for term in query.split():
        hit = hit & F.contains(tokens(body), tokens(F.lit(term)))
    return hit


def search(texts: DataFrame, query: str, limit: int, mode: str = "scan") -> DataFrame:
    """The first `limit` texts (a frame with body) that match, in file order; place counts from 0."""
    found = texts.where(matches(F.col("body"), query, mode)).orderBy("type", "id").limit(limit)
    return found.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("type", "id")) - 1)


def fact_score(place: Column, edge_type: Column, dist: Column) -> Column:
    """1 / (10 + place), times 0.5 + what the type says, times 0.5 + nearness (0.45 where the distance is unknown)."""
    near = F.coalesce(1.0 / (1.0 + dist), F.lit(0.45))
    return 1.0 / (10.0 + place) * (0.5 + type_weight(edge_type)) * (0.5 + near)


def edge_distance(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """edges with dist: that of their nearer end, null if neither is known."""
    a, b = dist.select(F.col("id").alias("from_id"), F.col("dist").alias("_a")), dist.select(F.col("id").alias("to_id"), F.col("dist").alias("_b"))
    return edges.join(a, "from_id", "left").join(b, "to_id", "left").withColumn("dist", F.least("_a", "_b")).drop("_a", "_b")


def rank_facts(found: DataFrame, dist: DataFrame | None, limit: int) -> DataFrame:
    """The best `limit` of found edges (a frame with place): by score, then place."""
    near = found.withColumn("dist", F.lit(None).cast("int")) if dist is None else edge_distance(found, dist)
    return near.withColumn("score", fact_score(F.col("place"), F.col("type"), F.col("dist"))).orderBy(F.desc("score"), "place").limit(limit)


def rank_nodes(found: DataFrame, dist: DataFrame | None, limit: int) -> DataFrame:
    """The first `limit` of found nodes (a frame with place): by distance, unknown last, then place."""
    near = found.withColumn("dist", F.lit(None).cast("int")) if dist is None else found.join(dist, "id", "left")
    return near.orderBy(F.coalesce("dist", F.lit(99)), "place").limit(limit)


def scoped_search(g: Graph, scope: list[str], query: str, limit: int, *, kind: str = "nodes", center: str | None = None, as_of: str | None = None, mode: str = "scan", index: SearchIndex | None = None, layout: Adjacency | None = None) -> DataFrame:
    """Search, then visibility, activity, rank and limit, in this order: OVER_FETCH * limit candidates are drawn before
    the filters, so fewer than `limit` may be left. kind: nodes or facts. An index of g takes the place of reading all texts; it wants every term
    of the query, as mode `terms` does. A layout of g for traversal serves the distances."""
    seen = scoped(g, scope)
    dist = None
    if center is not None:
        dist = scoped_distances(g, scope, center, as_of) if layout is None else layout.scoped_distances(scope, center, as_of)
    if index is not None:
        places = F.broadcast(index.find(query, OVER_FETCH * limit, kind).select("id", "place"))  # OVER_FETCH * limit rows
        facts, rank = (seen.nodes, rank_nodes) if kind == "nodes" else (seen.edges, rank_facts)
        return rank(active_at(facts.join(places, "id"), as_of), dist, limit)
    if kind == "nodes":
        found = search(node_text(g.nodes), query, OVER_FETCH * limit, mode).where(visible(scope))
        return rank_nodes(active_at(found, as_of), dist, limit)
    # OVER_FETCH * limit rows, whose ends are then looked up
    found = stored(search_edges(g, query, OVER_FETCH * limit, mode), "found")
    found = closed(Graph(g.nodes.where(visible(scope)), F.broadcast(found.where(visible(scope))))).edges
    return rank_facts(active_at(found, as_of), dist, limit)


def search_packed(g: Graph, scope: list[str], query: str, limit: int, *, center: str | None = None, as_of: str | None = None, hops: int = CAP) -> DataFrame:
    """Facts found, each with its typed hops: hops array<struct<rank, hop, hop_type>>, in order."""
    facts = stored(scoped_search(g, scope, query, limit, kind="facts", center=center, as_of=as_of), "facts")
    near = scoped(g.with_edges(touching(g.edges, facts)), scope).edges
    packed = typed_hops(F.broadcast(facts), active_at(near, as_of), hops).groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("rank", "hop", "hop_type"))).alias("hops"))
    return facts.join(packed, facts["id"] == packed["seed"], "left").drop("seed")


def raw_text_search(docs: DataFrame, keywords: list[str], limit: int = 3, key: str = "path") -> DataFrame:
    """The first texts, by key, that hold any of the keywords."""
    hit: Column = F.lit(False)
    for w in keywords:
        hit = hit | F.contains(F.lower("text"), F.lit(w.lower()))
    return docs.where(hit).orderBy(key).limit(limit)


def source_texts(facts: DataFrame, docs: DataFrame, limit: int = 5) -> DataFrame:
    """The texts of the first `limit` distinct files, by path, that facts name as path:line."""
    paths = facts.select(F.explode("src").alias("src")).select(F.regexp_extract("src", r"^(.*?)(?::\d+)?$", 1).alias("path")).where("path <> ''").distinct().orderBy("path").limit(limit)
    return docs.join(F.broadcast(paths), "path", "left_semi")


#: Words with a capital that are no names.
NO_NAMES = (
    "What When Where Who Why How Did Do Does Was Were Is Are The A An I My Me Would Could Will Have Has Had They Them Their Her His Its This That These Those Which"
).split()
#: Words that say nothing of what is asked for.
NO_CONTENT = (
    "what when where who why how did do does was were is are the a an to of in on at for from about after before during and or not no yes can could would will have has had been being that this "
    "these those it they them their her his its ago long much many old new first last"
).split()


def keywords(question: Column, most: int = 8, content: int = 3) -> Column:
    """What to search for: words that begin with a capital, then the first `content` others, lower-cased, of three letters or more."""
    words = F.filter(F.split(F.translate(question, "?.!", ""), r"(?U)\s+"), lambda w: w != "")
    capital = lambda w: w.rlike(r"^\p{Lu}")
    names = F.filter(words, lambda w: capital(w) & ~w.isin(*NO_NAMES))
    rest = F.transform(F.filter(words, lambda w: ~capital(w) & ~F.lower(w).isin(*NO_CONTENT) & (F.length(w) > 2)), F.lower)
    return F.slice(F.concat(names, F.slice(rest, 1, content)), 1, most)


def token_index(texts: DataFrame) -> DataFrame:
    """(token, type, id, places): an inverted index of texts (a frame with body), made within each row; write it sorted by token for lookups
    that skip files. Texts of one id give postings each; a search takes them as one."""
    def parts(each: Column) -> Column:
        # each: (token, place), sorted; a run of one token is one posting
        starts = F.filter(F.sequence(F.lit(1), F.size(each)), lambda i: (i == 1) | (F.get(each, i - 1)["token"] != F.get(each, i - 2)["token"]))
        return F.struct(each["token"].alias("t"), each["place"].alias("p"), starts.alias("starts"))

    words = F.split(F.trim(tokens(F.col("body"))), " ")
    # the lambdas' arguments and inline() keep the optimizer from making an array again wherever it is used
    each = F.transform(F.array(words), lambda w: F.sort_array(F.arrays_zip(w.alias("token"), F.sequence(F.lit(0), F.size(w) - 1).alias("place"))))
    said = texts.select("type", "id", F.inline(F.transform(each, parts)))
    said = said.select("*", F.posexplode("starts").alias("k", "a"))
    until = F.coalesce(F.get("starts", F.col("k") + 1), F.size("t") + 1)
    return said.select(F.get("t", F.col("a") - 1).alias("token"), "type", "id", F.slice("p", F.col("a"), until - F.col("a")).alias("places")).where("token <> ''")


def _query_terms(query: str) -> list[list[str]]:
    """The tokens of each term."""
    terms = ["".join(c if c.isalnum() else " " for c in term.lower()).split() for term in query.split()]
    return [t for t in terms if t]


def query_tokens(query: str) -> list[str]:
    return sorted({t for term in _query_terms(query) for t in term})


def index_search(index: DataFrame, query: str, limit: int) -> DataFrame:
    """(type, id): the first `limit` texts, in file order, that have every term of the query; a term of several tokens must stand as a run.

    Only the postings of the query's tokens are read."""
    terms = _query_terms(query)
    wanted = query_tokens(query)
    if not wanted:
        return index.select("type", "id").limit(0)
    said = index.where(F.col("token").isin(wanted)).groupBy("type", "id", "token").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    at = said.groupBy("type", "id").agg(F.map_from_entries(F.collect_list(F.struct("token", "places"))).alias("p"))
    def run_of(others: Column, k: int):
        return lambda i: F.array_contains(others, i + k)

    hit: Column = F.lit(True)
    for term in terms:
        starts = F.try_element_at("p", F.lit(term[0]))
        for k, t in enumerate(term[1:], 1):
            others = F.coalesce(F.try_element_at("p", F.lit(t)), F.array().cast("array<int>"))
            starts = F.filter(starts, run_of(others, k))
        hit = hit & F.coalesce(F.size(starts) > 0, F.lit(False))
    return at.where(hit).select("type", "id").orderBy("type", "id").limit(limit)
