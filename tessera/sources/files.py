"""Files in and out: facts as JSON lines, Markdown trees cut into chunks, journals."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import sorted_map
from tessera.operators.components import stored_in_turns, together
from tessera.plans.graph import PROVENANCE, Graph

LINES = 60
#: A fact as it is written: properties are JSON values, so they are read as text and kept as JSON literals.
FACT = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("ns", T.ArrayType(T.StringType())),
    T.StructField("valid_from", T.DateType()), T.StructField("valid_to", T.DateType()), T.StructField("props", T.MapType(T.StringType(), T.StringType())),
    T.StructField("src", T.ArrayType(T.StringType())), T.StructField("provenance", PROVENANCE), T.StructField("from", T.StringType()), T.StructField("to", T.StringType()),
])


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts of JSON lines; blank lines are skipped, a line that is no fact fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    facts = lines.select(F.from_json("value", FACT, {"mode": "FAILFAST", "dateFormat": "yyyy-MM-dd"}).alias("f"), F.monotonically_increasing_id().alias("pos"))
    return facts.select("f.*", "pos")


def read_graph(spark: SparkSession, path: str) -> Graph:
    """The graph of a facts file: of facts with one id, the last counts."""
    facts = read_facts(spark, path)
    nodes = facts.where("kind = 'node'").drop("kind", "from", "to")
    edges = facts.where("kind = 'edge'").withColumnsRenamed({"from": "from_id", "to": "to_id"}).drop("kind")
    return Graph.of(nodes, edges)


def fact_lines(g: Graph) -> DataFrame:
    """(kind, type, id, line): facts as JSON with sorted keys and nulls kept."""
    p = lambda df: F.col("provenance") if "provenance" in df.columns else F.lit(None).cast(PROVENANCE).alias("provenance")
    node = g.nodes.select(F.lit("node").alias("kind"), "id", "type", "ns", "valid_from", "valid_to", sorted_map(F.col("props")).alias("props"), "src", p(g.nodes))
    edge = g.edges.select(F.lit("edge").alias("kind"), "id", "type", "ns", "valid_from", "valid_to", sorted_map(F.col("props")).alias("props"), "src", p(g.edges), F.col("from_id").alias("from"), F.col("to_id").alias("to"))
    options = {"ignoreNullFields": "false"}
    line = lambda df: df.select("kind", "type", "id", F.to_json(F.struct(*sorted(df.columns)), options).alias("line"))
    return line(node).unionByName(line(edge))


def write_facts(g: Graph, path: str, files: int | None = None) -> None:
    """JSON lines in the order kind, type, id, over range-sorted files (one file if files is 1)."""
    lines = fact_lines(g)
    order = ["kind", "type", "id"]
    dealt = lines.repartitionByRange(files, *order) if files else lines.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def facts_hash(g: Graph, turns: int = 1) -> DataFrame:
    """(facts_hash): over the sorted hashes of all lines, so that no task needs all lines. turns: over 1, a written graph is read so often, and
    only the hashes of one turn are exchanged at a time; the result is the same."""
    # hashes travel as bytes, half the length; their order is that of their digits
    joined = lambda: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("h")), lambda h: F.lower(F.hex(h))), ""), 256)
    part = F.substring(F.sha2("id", 256), 1, 2)
    by_part = lambda lines: lines.select(F.unhex(F.sha2("line", 256)).alias("h"), "part").groupBy("part").agg(F.unhex(joined()).alias("h"))
    lines = fact_lines(g).withColumn("part", part)
    parts = by_part(lines) if turns == 1 else together(stored_in_turns(lines, "part", by_part, "hashes", turns))
    return parts.agg(F.substring(joined(), 1, 16).alias("facts_hash"))


def inside_root(root: str, path: Column) -> Column:
    """Whether a file's path, with links resolved, lies below root. Only local file systems have links; elsewhere every file does."""
    if "://" in root and not root.startswith("file:"):
        return F.lit(True)
    import os
    from urllib.parse import unquote

    local = lambda p: unquote(p.removeprefix("file:")) if p.startswith("file:") else p
    real = os.path.realpath(re.sub("^/+", "/", local(root)))

    @F.pandas_udf(T.BooleanType())
    def check(paths: pd.Series) -> pd.Series:
        found = {p: os.path.realpath(re.sub("^/+", "/", local(p))) for p in paths.unique()}
        return paths.map(lambda p: found[p] == real or found[p].startswith(real.rstrip("/") + "/"))

    return check(path)


def _texts(spark: SparkSession, root: str, glob: str) -> DataFrame:
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).format("text").load(root)
    full = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/")
    return files.select(F.regexp_replace(full, "^.*?" + _quoted(root.rstrip("/")) + "/", "").alias("path"), F.col("value").alias("text"), inside_root(root, F.col("_metadata.file_path")).alias("inside"))


def read_documents(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """(path, text): text files under root, path relative to it. Links that lead out of root are not followed."""
    return _texts(spark, root, glob).where("inside").drop("inside")


def refused_links(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """(path): what read_documents() leaves out, for counts and logs."""
    return _texts(spark, root, glob).where("not inside").select("path")


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def namespace_of(path: Column) -> Column:
    """The first directory of a path, else public."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.get(parts, F.lit(0))).otherwise("public")


def chunks(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(path, start_line, end_line, text, namespace, src, hash): windows of lines, counted from 1; blank windows go.

    docs: path, text. A line end at the end of a text begins no further line. Chunks come from one row, without a shuffle."""
    each = docs.select("path", F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"), "\n").alias("ls"))
    each = each.withColumn("ls", F.when(F.element_at("ls", -1) == "", F.slice("ls", 1, F.size("ls") - 1)).otherwise(F.col("ls"))).where(F.size("ls") > 0)
    window = lambda i: F.struct((i + 1).alias("start_line"), F.least(i + lines, F.size("ls")).alias("end_line"), F.array_join(F.slice("ls", i + 1, lines), "\n").alias("text"))
    cut = each.select("path", F.inline(F.transform(F.sequence(F.lit(0), F.size("ls") - 1, F.lit(lines)), window)))
    src = F.concat("path", F.lit(":"), F.col("start_line").cast("string"))
    return cut.where(F.col("text").rlike(r"(?U)\S")).withColumns({"namespace": namespace_of(F.col("path")), "src": src, "hash": F.sha2(F.concat("path", F.lit("\n"), "text"), 256)})


def run_id(cut: DataFrame, version: int) -> DataFrame:
    """(run_id): over the ontology's version and the hashes of all chunks in order of path and line; by path first, so no row holds all."""
    per = cut.groupBy("path").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "hash"))), lambda x: x["hash"]), ""), 256).alias("h"))
    part = per.groupBy(F.substring("h", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return part.agg(F.substring(F.sha2(F.concat(F.lit(str(version)), F.array_join(F.array_sort(F.collect_list("h")), "")), 256), 1, 16).alias("run_id"))


def chunk_facts(cut: DataFrame, facts: DataFrame) -> DataFrame:
    """(chunk, facts): the first 16 digits of each chunk's hash, and the ids of the facts that name it as source, joined."""
    named = facts.select("id", F.explode("src").alias("src"))
    return cut.select(F.substring("hash", 1, 16).alias("chunk"), "src").join(named, "src").groupBy("chunk").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("facts"))


def uncached(cut: DataFrame, cache: DataFrame, keys: tuple[str, ...] = ("hash",)) -> DataFrame:
    """Chunks that the extraction cache does not have."""
    return cut.join(cache.select(*keys).distinct(), list(keys), "left_anti")


JOURNAL = T.StructType([
    T.StructField("fact", T.StringType()), T.StructField("agent", T.StringType()), T.StructField("device", T.StringType()), T.StructField("entry_id", T.StringType()), T.StructField("ns", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("proposed_at", T.StringType()), T.StructField("status", T.StringType()), T.StructField("_bad", T.StringType()),
])


def parsed_journal(lines: DataFrame) -> DataFrame:
    """Journal lines (column value) as entries for the journal operators; lines that are no entry are dropped."""
    raw = lines.select(F.from_json("value", JOURNAL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e")).select("e.*").where("_bad is null and fact is not null")
    fact = F.from_json("fact", FACT, {"dateFormat": "yyyy-MM-dd"})
    return raw.withColumn("f", fact).select("entry_id", "agent", "device", "ns", "confidence", "proposed_at", "status", "f.kind", "f.id", "f.type", F.col("f.from").alias("from_id"), F.col("f.to").alias("to_id"), F.col("f.ns").alias("fact_ns"), "f.valid_from", "f.valid_to", "f.props", "f.src")


def bad_journal_lines(lines: DataFrame) -> DataFrame:
    """The lines (column value) that parsed_journal() drops, but for blank ones: for counts and logs."""
    entry = F.from_json("value", JOURNAL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.where(F.trim("value") != "").select("value", entry.alias("e")).where("e._bad is not null or e.fact is null").select("value")


def read_gold(spark: SparkSession, root: str) -> DataFrame:
    """The facts of every *.facts.jsonl below root, for evaluation."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.facts.jsonl").text(root).where(F.trim("value") != "")
    return lines.select(F.from_json("value", FACT, {"mode": "FAILFAST", "dateFormat": "yyyy-MM-dd"}).alias("f")).select("f.*")


def read_journals(spark: SparkSession, root: str) -> DataFrame:
    return parsed_journal(spark.read.option("recursiveFileLookup", True).text(root))


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files (path, hash) that are new or differ from what the manifest has."""
    return now.join(before.select("path", "hash"), ["path", "hash"], "left_anti")


def dump_batches(batches: DataFrame, root: str, namespace: str) -> None:
    """Rendered batches (session, batch, body) as text under root/namespace, one folder a session; sessions that are given are replaced whole, others stay."""
    spark = batches.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        ordered = batches.repartition("session").sortWithinPartitions("session", "batch")
        ordered.select("session", "body").write.mode("overwrite").partitionBy("session").option("lineSep", "\n").text(f"{root.rstrip('/')}/{namespace}")
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def within(path: str, roots: list[str]) -> bool:
    """Whether a path, with links and dots resolved, lies under one of the roots."""
    import os

    real = os.path.realpath(path)
    return any(real == r or real.startswith(r.rstrip("/") + "/") for r in map(os.path.realpath, roots))
