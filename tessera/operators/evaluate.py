"""Scores: precision and recall over keys, coreference, retrieval checks, question answering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import token_recall
from tessera.plans.graph import Graph, prop


def precision_recall_f1(gold: DataFrame, got: DataFrame) -> DataFrame:
    """One row: gold, got, hit, precision, recall, f1 over distinct rows; both empty counts as 1."""
    cols = gold.columns
    both = gold.distinct().withColumn("_g", F.lit(1)).join(got.distinct().withColumn("_h", F.lit(1)), cols, "full")
    row = both.agg(F.count("_g").alias("gold"), F.count("_h").alias("got"), F.count_if(F.col("_g").isNotNull() & F.col("_h").isNotNull()).alias("hit"))
    none = (F.col("gold") == 0) & (F.col("got") == 0)
    per = lambda n: F.when(none, 1.0).when(F.col(n) == 0, 0.0).otherwise(F.col("hit") / F.col(n))
    scored = row.withColumns({"precision": per("got"), "recall": per("gold")})
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def node_keys(nodes: DataFrame) -> DataFrame:
    """(type, name): name, else id."""
    return nodes.select("type", F.coalesce(prop("name"), F.col("id")).alias("name"))


def edge_keys(g: Graph) -> DataFrame:
    """(type, from_name, to_name)."""
    name = lambda c: g.nodes.select(F.col("id").alias(f"{c}_id"), F.coalesce(prop("name"), F.col("id")).alias(f"{c}_name"))
    return g.edges.join(name("from"), "from_id", "left").join(name("to"), "to_id", "left").select("type", F.coalesce("from_name", "from_id").alias("from_name"), F.coalesce("to_name", "to_id").alias("to_name"))


def extraction_report(gold: Graph, got: Graph) -> DataFrame:
    """(kind, gold, got, hit, precision, recall, f1) for nodes and edges."""
    nodes = precision_recall_f1(node_keys(gold.nodes), node_keys(got.nodes)).withColumn("kind", F.lit("node"))
    return nodes.unionByName(precision_recall_f1(edge_keys(gold), edge_keys(got)).withColumn("kind", F.lit("edge")))


def pairs(members: DataFrame) -> DataFrame:
    """(a, b): pairs of names in one cluster (columns cluster and name); pairwise scores are over exactly these."""
    m = members.select("cluster", "name").distinct()
    return m.withColumnRenamed("name", "a").join(m.withColumnRenamed("name", "b"), "cluster").where("a < b").select("a", "b").distinct()


def pair_counts(gold: DataFrame, got: DataFrame) -> DataFrame:
    """One row: the pairs of gold, of got, and of both, for clusterings of disjoint clusters, by counting and without making a pair."""
    n2 = lambda c: F.coalesce(F.sum(F.col(c) * (F.col(c) - 1) / 2), F.lit(0)).cast("long")
    size = lambda df, *k: df.groupBy(*k).agg(F.count_distinct("name").alias("n"))
    met = gold.select("name", F.col("cluster").alias("g")).distinct().join(got.select("name", F.col("cluster").alias("h")).distinct(), "name")
    row = size(gold, "cluster").agg(n2("n").alias("gold")).crossJoin(F.broadcast(size(got, "cluster").agg(n2("n").alias("got"))))
    return row.crossJoin(F.broadcast(size(met, "g", "h").agg(n2("n").alias("hit"))))  # one row each


def coreference_f1(gold: DataFrame, got: DataFrame) -> DataFrame:
    """One row: pairwise precision, recall and f1 of disjoint clusters (columns cluster and name)."""
    row = pair_counts(gold, got)
    none = (F.col("gold") == 0) & (F.col("got") == 0)
    per = lambda n: F.when(none, 1.0).when(F.col(n) == 0, 0.0).otherwise(F.col("hit") / F.col(n))
    scored = row.withColumns({"precision": per("got"), "recall": per("gold")})
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def qa_scores(questions: DataFrame) -> DataFrame:
    """questions (found, gold, adversarial) with score: recall of gold in found, or what is missing of it if adversarial."""
    recall = token_recall(F.col("found"), F.col("gold"))
    return questions.withColumn("score", F.when(F.col("adversarial"), 1.0 - recall).otherwise(recall))


def qa_report(scored: DataFrame) -> DataFrame:
    """(category, n, mean): by category, and overall where it is null."""
    return scored.rollup("category").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))


def superset(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """(key, expected, missing, passed): whether a question's results (column id) hold all that is expected."""
    hit = got.select(key, "id").distinct().withColumn("hit", F.lit(1))
    per = expected.select(key, "id").distinct().join(hit, [key, "id"], "left").groupBy(key)
    return per.agg(F.count("*").alias("expected"), F.count_if(F.col("hit").isNull()).alias("missing")).withColumn("passed", F.col("missing") == 0)


def edge_types_at(questions: DataFrame, edges: DataFrame) -> DataFrame:
    """questions (question, time as date, present array<string>, absent array<string>) with passed: whether edges of all present
    types, and none of the absent ones, are active at the time. A null list asks for nothing."""
    live = (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("time"))) & (F.col("valid_to").isNull() | (F.col("time") < F.col("valid_to")))
    # the times asked for are few; edges are counted by type and time before anything else
    times = F.broadcast(questions.select("time").distinct())
    types = edges.select("type", "valid_from", "valid_to").join(times, live).groupBy("time").agg(F.collect_set("type").alias("types"))
    none = F.array().cast("array<string>")
    held = F.coalesce("types", none)
    ok = (F.size(F.array_except(F.coalesce("present", none), held)) == 0) & (F.size(F.array_intersect(F.coalesce("absent", none), held)) == 0)
    return questions.join(types, "time", "left").withColumn("passed", ok).drop("types")


def evaluation(extraction: DataFrame, structure: DataFrame) -> DataFrame:
    """One row of JSON (report): the construction report, its parts with sorted keys."""
    part = lambda df, name: df.agg(F.array_sort(F.collect_list(F.to_json(F.struct(*sorted(df.columns))))).alias(name))
    both = part(extraction, "extraction").crossJoin(F.broadcast(part(structure, "structure")))
    listed = lambda c: F.concat(F.lit(f'"{c}":['), F.array_join(c, ","), F.lit("]"))
    return both.select(F.concat(F.lit("{"), listed("extraction"), F.lit(","), listed("structure"), F.lit("}")).alias("report"))
