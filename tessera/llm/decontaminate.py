"""Benchmark decontamination: a prefix-filtered set join on windows of benchmark words.

An item's words are cut into windows (13 consecutive words; a shorter item is one window). All words of
a window must stand in a text, in order, so the window's rarest word alone is a necessary prefix: words
are ordered by the number of texts that hold them, and only places of such rarest words are candidates.
Position and length bounds drop candidates whose window would begin before the text or end after it; the
words around the place then verify the window exactly. Nothing but these few words is ever shuffled.

Null and empty texts have no words, hit nothing and are not contaminated; items without words give no
window. Repeated rows get one result each; items that agree all count; extra columns are ignored; empty
tables give empty results, or no hits. Rarity ties go to the word that sorts first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import alnum_words, stored
from tessera.llm.positional import contexts, small, word_counts

WINDOW = 13


def windows(benchmark: DataFrame, *, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(item_id, window): every window of every item."""
    words = benchmark.select(F.col(item).alias("item_id"), alnum_words(F.col(text)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("window")).distinct()


def necessary(cut: DataFrame, docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    """cut with each window's rarest word (token) and its place in it (offset), and the number of rows."""
    vocabulary = cut.select(F.explode("window").alias("word")).distinct()
    words = vocabulary.count()
    counts = small(word_counts(docs, text, vocabulary, words), words)
    placed = cut.select("item_id", "window", F.posexplode("window").alias("offset", "word")).join(counts, "word", "left")
    rarest = F.min_by(F.struct("word", "offset"), F.struct(F.coalesce("docs", F.lit(0)), "word", "offset"))
    out = stored(placed.groupBy("item_id", "window").agg(rarest.alias("r")).select("item_id", "window", F.col("r.word").alias("token"), F.col("r.offset").alias("offset")), "windows")
    return out, out.count()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, share: int = 20) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs.

    n_hit: words inside an occurrence of a window; contaminated: n_hit > 0 and share * n_hit >= n_words."""
    cut, rows = necessary(windows(benchmark, item=item, text=item_text, size=size), docs, text)
    base = stored(contexts(docs, cut.select("token").distinct(), size - 1, key=key, text=text), "contexts")
    start = F.col("pos") - F.col("offset")
    length = F.size("window")
    inside = (start >= 0) & (start + length <= F.col("n_words"))
    # spans by start: what each adds beyond the end so far
    new = lambda a, s: F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["length"]).alias("end"), (a["hit"] + new(a, s)).alias("hit"))
    covered = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")), step)["hit"]
    hits = (
        base.select("doc_id", "text_hash", "n_words", F.inline("found"))
        .withColumnRenamed("word", "token")
        .join(small(cut, rows), "token")
        .where(inside)
        .where(F.slice("near", start - F.col("first") + 1, length) == F.col("window"))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct(start.alias("start"), length.alias("length"))).alias("spans"), F.collect_set("item_id").alias("items"))
        .select(
            F.col("doc_id").alias("hit_id"),
            F.col("text_hash").alias("hit_hash"),
            covered.alias("n_hit"),
            F.transform("items", lambda x: x.cast("string")).alias("items"),
        )
    )
    plain = base.where("part = 0").select("doc_id", "text_hash", "n_words")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return plain.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left").select(
        "doc_id",
        "text_hash",
        F.col("n_words").cast("long").alias("n_words"),
        hit.alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join(F.array_sort("items"), ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"),
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated."""
    found = decontaminate(docs, benchmark, key=key, text=text, item=item, item_text=item_text, size=size, share=share)
    bad = found.where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs[text]) == bad["bad_hash"]), "left_anti")
