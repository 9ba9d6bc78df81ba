"""Line dedup: lines that many documents share go from all of them.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys are compared by 128 bits of
hash. Documents are cut into rows of (document, place, line, hash); distinct (hash, document) pairs are counted by hash,
in two steps, so that a line of a third of all documents is spread by document first and then combined on the map side;
lines whose hash is frequent are dropped in a join (a broadcast only if the written table of frequent hashes is small enough for
Spark's own threshold, else a shuffle that AQE splits where it is skewed), and what stays is put together by place.

A null or empty text is one empty line; a text of line breaks is empty lines; empty keys never go. A document that loses all its lines has empty text.
Documents are counted by id: rows of one id are one document, and so are all rows without id. Repeated rows get one result
each. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, stored

DOCUMENTS, CODE_POINTS = 10, 1
#: ASCII white space at the ends of a line.
_ENDS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def line_key(line: Column) -> Column:
    return ascii_lower(F.regexp_replace(line, _ENDS, ""))


def _lines(docs: DataFrame, *kept: str) -> DataFrame:
    """One row for each line: doc_id, h1, h2 (null for keys too short to count) and of text_hash, place, line those in kept."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), *([F.xxhash64(text).alias("text_hash")] if kept else []))
    cut = rows.select("doc_id", *(["text_hash"] if kept else []), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    keyed = cut.withColumn("key", line_key(F.col("line")))
    counts = F.length("key") >= F.lit(CODE_POINTS)
    hashes = [F.when(counts, F.xxhash64("key")).alias("h1"), F.when(counts, F.xxhash64(F.lit(1), F.reverse("key"))).alias("h2")]
    return keyed.select("doc_id", *kept, *hashes)


def frequent_lines(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(h1, h2) of the keys found in at least that many documents."""
    pairs = _lines(docs).where("h1 is not null").groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    return pairs.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= documents).select("h1", "h2")


def line_dedup(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """doc_id, text (what stays), n_lines and n_dropped of every row of docs (doc_id, text)."""
    frequent = stored(frequent_lines(docs, documents), "frequent").withColumn("gone", F.lit(True))
    marked = _lines(docs, "text_hash", "place", "line").join(frequent, ["h1", "h2"], "left")
    # rows of one id and text are one group; its lines are a set of (place, line), so copies add nothing
    whole = marked.groupBy("doc_id", "text_hash").agg(
        F.sum(F.when(F.col("place") == 0, 1)).alias("copies"), F.max("place").alias("last"),
        F.collect_set(F.when(F.col("gone").isNull(), F.struct("place", "line"))).alias("stay"),
    )
    text = F.array_join(F.transform(F.array_sort("stay"), lambda x: x["line"]), "\n")
    n_lines = F.col("last").cast("long") + 1
    out = whole.select("doc_id", "copies", text.alias("text"), n_lines.alias("n_lines"), (n_lines - F.size("stay")).cast("long").alias("n_dropped"))
    return out.select(F.explode(F.array_repeat(F.struct("doc_id", "text", "n_lines", "n_dropped"), F.col("copies").cast("int"))).alias("r")).select("r.*")
