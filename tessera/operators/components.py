"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or else the context's checkpoint folder. Where neither is set, a temporary folder
    serves a local master; on a cluster, whose machines share no such folder, that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext.getCheckpointDir()


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; dropped_all() empties it."""
    return f"{shared_dir(spark).rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written within removes its shuffle files as soon as it is done, so that later jobs don't find the disk full of them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, name: str = "table", codec: str = "snappy") -> DataFrame:
    """df written as Parquet into the shared folder and read again: it is computed once, and survives lost executors.

    Operators drop the tables that nothing reads any more; those that a returned DataFrame reads stay until dropped_all()."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_in_turns(df: DataFrame, by: str, made: Callable[[DataFrame], DataFrame], name: str, turns: int = 4) -> list[DataFrame]:
    """made(the rows of df of one turn), written turn after turn, so that only a part of df is exchanged at a time. Rows of one value of `by` are in one turn."""
    return [stored(made(df.where(F.pmod(F.xxhash64(by), F.lit(turns)) == turn)), name, "zstd") for turn in range(turns)]


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _deleted(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(*tables: DataFrame) -> None:
    """Deletes the files of tables that stored() wrote, once nothing reads them any more."""
    for df in tables:
        own = own_dir(df.sparkSession).split("/")[-1]
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if folder.split("/")[-2] == own:
                _deleted(df.sparkSession, folder)


def dropped_all(spark: SparkSession) -> None:
    """Deletes everything that this application has stored; for the end of a job, when all results are written."""
    _deleted(spark, own_dir(spark))


def _round(links: DataFrame) -> DataFrame:
    """A large star, then a small star. Every link (a, b) has a > b."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.withColumnRenamed("m", "b")).distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node of its component.

    links: columns a and b of one sortable type; nulls and loops are left out. Each round is a written
    table, so lineage stays short and a lost executor repeats one round at most; the driver only sees
    counts and sums of hashes. A component's links meet at its root only in joins, which AQE can split."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = stored(links, "links"), None
    for _ in range(most_rounds):
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if now == before or not now[0]:
            break
        before, old = now, links
        links = stored(_round(links), "links")
        drop_stored(old)
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    # the table of links stays: the result reads it
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
