"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Fingerprints that differ in `distance` (2) bits or fewer differ in as many bytes at most, so they share
six of their eight positional bytes at least. One positional byte alone has N / 256 postings, so the
index holds the guaranteed matches in combination: the bytes form four pairs, two differing bytes leave
two pairs whole, and each fingerprint is posted under its six pairs of pairs (four positional bytes each).
Within a posting list the shared positional bytes of each pair are tallied, pairs with the guaranteed
minimum are retained, and their bits verify them.

Exact copies share one fingerprint and are one entry. Posting lists of over LIST fingerprints are not
paired: two fingerprints are within two bits just if they share a value within one bit of both, so each
member is listed under its 33 values (the other four bytes, and those with one bit turned) and linked to
the smallest member there. That gives the same components, at 33 rows a member, whatever the list's size.

Fingerprints are made in the JVM: a text's shingles become rows, and one sum carries two bits' counts, in the
halves of a 64-bit integer, so a text leaves its scan as 32 sums whatever its length.

Null and empty texts have fingerprint zero, linked like any other. Repeated rows get one result each; a
component whose ids are all null has a null id; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, stored, white_words
from tessera.operators.components import connected_components, drop_stored

SHINGLE, DISTANCE, LIST = 3, 2, 32


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """XXH64 (seed 42, which is what xxhash64() has) of each run of `shingle` words; fewer words are one run, none gives null."""
    words = white_words(ascii_lower(text))

    def run(w: Column, i: Column) -> Column:
        return F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(shingle)]))

    # a one-element transform names the words, so that they are cut once
    last = lambda w: F.greatest(F.size(w) - shingle, F.lit(0))
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), last(w)), lambda i: run(w, i)))), F.lit(0))


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row of docs: bit i of the signed 64-bit fp is set if it is set in over half of the shingles' hashes."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), shingle_hashes(F.col(text), shingle).alias("hashes"))
    halves = F.lit(1 << 32 | 1)
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(halves)).alias(f"s{i}") for i in range(32)]
    counted = rows.select("row", "doc_id", F.explode_outer("hashes").alias("h")).groupBy("row", "doc_id").agg(F.count("h").alias("n"), *sums)
    bit = lambda count, k: F.when(2 * count > F.col("n"), F.lit(_turned(1 << k))).otherwise(F.lit(0).cast("long"))
    fp = F.lit(0).cast("long")
    for i in range(32):
        fp = fp.bitwiseOR(bit(F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF)), i)).bitwiseOR(bit(F.shiftrightunsigned(f"s{i}", 32), i + 32))
    return counted.select("doc_id", fp.alias("fp"))


def _turned(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose components are those of all pairs within DISTANCE."""
    pairs = list(combinations(range(4), 2))
    masks = [_turned(sum(0xFFFF << 16 * i for i in p)) for p in pairs]
    posted = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("combo", "bytes"))
    lists = posted.groupBy("combo", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    posted = stored(posted.join(lists, ["combo", "bytes"]), "postings")
    # Short lists: tally each pair's shared positional bytes.
    short = posted.where(F.col("n") <= LIST).groupBy("combo", "bytes").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    paired = short.select("fps", F.explode("fps").alias("a")).select("a", F.explode(F.filter("fps", lambda x: x > F.col("a"))).alias("b"))
    other = F.col("a").bitwiseXOR(F.col("b"))
    tally = sum((F.when(F.shiftrightunsigned(other, 8 * i).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))
    near = paired.where(tally >= 8 - DISTANCE).where(F.bit_count(other) <= DISTANCE).select("a", "b")
    # Long lists: values within one bit of the bytes that the list doesn't fix.
    free = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_turned(1 << b)) for b in range(64) if not (m >> b) & 1]) for m in masks])
    long = posted.where(F.col("n") > LIST).select("fp", "combo", "bytes", F.explode(F.get(free, F.col("combo"))).alias("bit"))
    long = long.select("fp", "combo", F.col("fp").bitwiseXOR(F.col("bit")).alias("value"))
    least = long.groupBy("combo", "value").agg(F.min("fp").alias("b"), F.count("*").alias("members")).where("members > 1")
    star = long.join(least, ["combo", "value"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    found = stored(near.unionByName(star).distinct(), "near")
    drop_stored(posted)
    return found


def simhash(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable by links) of every row of docs."""
    rows = stored(fingerprints(docs, key=key, text=text, shingle=shingle), "fingerprints")
    reps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    found = links(reps)
    roots = connected_components(found).withColumnRenamed("node", "fp")
    drop_stored(found)
    rooted = stored(reps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, all columns, whose id is the smallest of its component."""
    found = simhash(docs, key=key, text=text, shingle=shingle)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs[key].eqNullSafe(kept["kept_id"]), "left_semi")
