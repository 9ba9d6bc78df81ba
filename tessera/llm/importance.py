"""Importance resampling: the documents whose features look most like those of a target corpus.

Features are runs of 1 to `n` words, counted in `buckets` buckets by crc32. Identical texts are grouped by their whole text first:
features and weight are computed once for each distinct text, its counts are multiplied by its copies, and weights are joined
back to the documents before the noise of each document's own id is added. Counts have one row for each bucket, so the gains are an array
of fixed size that becomes part of the plan. The draw numbers the eligible documents by score
in ranges that are sorted apart; no task sorts all.

Null and empty texts have no words, no features and weight 0. Documents with fewer than `least_words` words are scored but never drawn. Ties in
score go to the smaller id. A row without id takes the noise of an empty id and comes last among ties. Repeated rows get one result and one
rank each. An empty table gives an empty result; an empty target gives every bucket the gain of no target features; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import alnum_words, stored
from tessera.operators.resolve import dense_numbers

BUCKETS, RUN, SEED, LEAST_WORDS, PERCENT = 10000, 1, "2024", 20, 10


def _runs(words: Column, n: int) -> Column:
    """All runs of n words, joined by spaces."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def _features(words: Column, run: int) -> Column:
    """All runs of 1 to `run` words."""
    return F.concat(words, *[_runs(words, n) for n in range(2, run + 1)])


def bucketed(docs: DataFrame, run: int, buckets: int) -> DataFrame:
    """One row for each distinct text: its digest, copies, n_words and the bucket of every feature."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    found = texts.select("copies", F.unhex(F.sha2("text", 256)).alias("digest"), alnum_words(F.col("text")).alias("words"))
    of = lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int")
    return found.select("digest", "copies", F.size("words").alias("n_words"), F.transform(_features(F.col("words"), run), of).alias("buckets"))


def _counts(texts: DataFrame, name: str) -> DataFrame:
    """(bucket, name): how often a bucket's features occur, copies included; a row for each bucket that occurs."""
    return texts.select("copies", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("copies").alias(name))


def gains(texts: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of every bucket; as many as there are buckets, whatever the corpus."""
    both = texts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(_counts(texts, "s"), "bucket", "left").join(_counts(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    totals = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    gain = F.floor(1000 * F.log((t + 1) * (F.col("all_s") + buckets) / ((s + 1) * (F.col("all_t") + buckets))))
    return [r["gain"] for r in both.crossJoin(F.broadcast(totals)).select("bucket", gain.alias("gain")).sort("bucket").collect()]


def weighted(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    texts = stored(bucketed(docs, run, buckets), "texts")
    of = gains(texts, bucketed(target, run, buckets), buckets)
    table = F.split(F.lit(",".join(map(str, of))), ",").cast("array<bigint>")  # folded into one literal
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))
    n = F.size("buckets").cast("long")
    weight = F.when(n > 0, F.floor(total / n)).otherwise(F.lit(0)).cast("long")
    weights = texts.select("digest", F.col("n_words").cast("long").alias("n_words"), n.alias("n_features"), weight.alias("weight"))
    ids = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    return ids.join(weights, "digest").drop("digest")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, *, run: int = RUN, buckets: int = BUCKETS, seed: str = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs (doc_id, text); rank is null for what is not drawn."""
    scored = weighted(docs, target, run, buckets).withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long"))
    scored = stored(scored, "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    ranked = dense_numbers(able, [F.desc("score"), F.asc_nulls_last("doc_id")], "n")
    columns = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("n") <= drawn, F.col("n")).cast("long").alias("rank")
    return ranked.select(*columns, rank).unionByName(scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
