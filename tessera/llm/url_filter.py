"""URL rules: a blocked Bloom filter of the listed keys, then an exact hash join.

Every listed rule is a canonical key, host then path prefix ("example.org/es/"). A URL can only fit a
rule whose host is its own host or a parent of it, and whose path is a prefix of its path with a length
that some rule has. Each such candidate key is tested in a blocked Bloom filter: one 64-bit block per
key, picked by the key's hash, with BITS bits of that block set. The filter has `blocks` rows at most
whatever the number of rules, so it is broadcast; what passes goes to an exact join with the rules,
which removes the false positives. The longest rule (in characters) wins.

Nulls, empty and malformed URLs have empty host and path, fit no rule and get the default verdict.
Repeated rows each get their own result; an empty table gives an empty result; extra columns of pages
are carried only if asked for. Repeated rules count once, the blocking one first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 6


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; without :// or for null empty."""
    from tessera.llm.common import ascii_lower

    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    """BITS bits of a 64-bit block, each from six other bits of a second hash."""
    second = F.xxhash64(key, F.lit("mask"))
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        bit = F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def bloom(rules: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): the filter, at most `blocks` rows of 16 bytes."""
    return rules.groupBy(_block(F.col("rule"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("rule"))).alias("bits"))


def url_filter(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", blocks: int = 1 << 14, default: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict of every row of pages.

    rules: rule string (host, then path from its first /), verdict string. blocks: rows of the filter; it
    bounds what is broadcast (16 bytes each). default: the verdict where no rule fits."""
    listed = rules.select("rule", "verdict").where("rule is not null").groupBy("rule").agg(F.max("verdict").alias("rule_verdict"))
    rows = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # The lengths that rules' paths have are few even for long lists; a long tail would only add candidates.
    lengths = listed.select(F.length(F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)).alias("n")).agg(F.array_sort(F.collect_set("n")).alias("lengths"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    tried = (
        rows.where("host <> ''").select("host", "path").distinct()
        .crossJoin(F.broadcast(lengths))
        .withColumn("prefixes", F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n)))
        .select("host", "path", F.explode(suffixes).alias("suffix"), "prefixes")
        .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
        .select("host", "path", F.concat("suffix", "prefix").alias("rule"))
    )
    passed = (
        tried.withColumns({"block": _block(F.col("rule"), blocks), "mask": _mask(F.col("rule"))})
        .join(F.broadcast(bloom(listed, blocks)), "block")
        .where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        .select("host", "path", "rule")
    )
    longest = F.struct(F.length("rule"), "rule")
    fits = passed.join(listed, "rule").groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), longest).alias("best"))
    shown = ["page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")]
    # rows without a host fit nothing; there may be many, so they stay out of the join
    hosted = rows.where("host <> ''").join(fits, ["host", "path"], "left").select(*shown)
    return hosted.unionByName(rows.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
