"""Rare words and where they stand: candidates for phrases and windows, found inside each row.

A row's words stay one array. Positions that hold one of the looked-for words are picked from it, each
with the words around it, so that whatever is joined later carries a few dozen words, never a text.
A row carries PLACES_A_ROW places at most; texts with more of them give more rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import alnum_words

#: Words that may be part of the plan. More of them are joined with the words of the texts instead.
TOKENS_A_SCAN = 20_000
PLACES_A_ROW = 1_000
#: Rows of at most some hundred bytes that may be broadcast; beyond it a shuffle join does the same.
BROADCAST_ROWS = 50_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if its counted rows are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def word_counts(docs: DataFrame, text: str, vocabulary: DataFrame, rows: int) -> DataFrame:
    """(word, docs): in how many rows of docs each word of the vocabulary occurs, over all rows."""
    words = docs.select(F.explode(F.array_distinct(alnum_words(F.col(text)))).alias("word"))
    return words.join(small(vocabulary.select("word").distinct(), rows), "word").groupBy("word").agg(F.count("*").alias("docs"))


def contexts(docs: DataFrame, tokens: DataFrame, reach: int, *, key: str, text: str) -> DataFrame:
    """doc_id, text_hash, n_words, part and found: for every place of one of the tokens (column token, distinct) its word, position
    (from 0) and the words from `reach` before it to `reach` after it (`first` is the position of the first of them).

    doc_id and text_hash together name a row; rows that agree in both have the same words. Every row of docs has one row
    of part 0 here, and more parts only for more than PLACES_A_ROW places."""
    split = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), alnum_words(F.col(text)).alias("words"))
    n, none = F.size("words"), F.array().cast("array<int>")
    if tokens.limit(TOKENS_A_SCAN + 1).count() <= TOKENS_A_SCAN:
        looked = sorted(r["token"] for r in tokens.select("token").collect())
        wanted = lambda i: F.get(F.col("words"), i).isin(looked) if looked else F.lit(False)
    else:
        # each text's own looked-for words, by a join of its distinct words with the tokens; rare words, so no key is hot
        distinct = split.select("doc_id", "text_hash", F.explode(F.array_distinct("words")).alias("token")).join(tokens.select("token"), "token")
        own = distinct.groupBy("doc_id", "text_hash").agg(F.collect_set("token").alias("looked")).withColumnsRenamed({"doc_id": "own_id", "text_hash": "own_hash"})
        split = split.join(own, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")), "left")
        wanted = lambda i: F.coalesce(F.array_contains("looked", F.get(F.col("words"), i)), F.lit(False))

    def around(i):
        first = F.greatest(i - reach, F.lit(0))
        return F.struct(F.get(F.col("words"), i).alias("word"), i.alias("pos"), first.alias("first"), F.slice("words", first + 1, i + reach - first + 1).alias("near"))

    placed = split.withColumn("places", F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), wanted)).otherwise(none))
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("places") - 1) / PLACES_A_ROW).cast("int")))
    cut = placed.select("doc_id", "text_hash", "words", "places", F.explode(parts).alias("part"))
    here = F.slice("places", F.col("part") * PLACES_A_ROW + 1, PLACES_A_ROW)
    return cut.select("doc_id", "text_hash", n.alias("n_words"), "part", F.transform(here, around).alias("found"))
