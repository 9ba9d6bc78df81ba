"""Files that are new, changed or deleted, as a stream of typed changes.

A poll lists the watched folders (paths, sizes, times and, if asked, hashes of the content) with Spark's own file source, so on any file system that
Spark reads and by its tasks, compares the listing with the last one in a join, and keeps the differences as one change set. A change set counts once the
pointer names its listing; until then a poll that fails leaves nothing that is read. A stream follows the sets: its checkpoint
knows what was delivered, so each change is handed out once, and a call that fails gets its changes again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import inside_root
from tessera.sources.pointer import file_system, read_small, replace_small
from tessera.streaming.streams import run_available

CHANGE = "kind string, path string, change string, size long, modified timestamp, version long"
_FILE = "kind string, path string, size long, modified timestamp, digest string"


class Watch:
    """roots: a kind (texts, ontology, journals, ...) to (folder, glob of names). content: files of one size and time are compared by hash, too."""

    def __init__(self, spark: SparkSession, state: str, roots: dict[str, tuple[str, str]], content: bool = False):
        self.spark, self.state, self.roots, self.content = spark, state.rstrip("/"), roots, content

    def _listing(self) -> DataFrame:
        found = self.spark.createDataFrame([], _FILE)
        for kind, (folder, glob) in self.roots.items():
            path, fs = file_system(self.spark, folder)
            if not fs.exists(path):
                continue
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
            digest = F.sha2("content", 256) if self.content else F.lit(None).cast("string")
            files = files.where(inside_root(folder, F.col("path")))
            found = found.unionByName(files.select(F.lit(kind).alias("kind"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), digest.alias("digest")))
        return found

    def _last(self) -> int:
        return int(read_small(self.spark, f"{self.state}/LISTING") or 0)

    def _moved(self, version: int) -> None:
        """The change set of a listing that counts goes where the stream looks; also after a failure in between."""
        ready, fs = file_system(self.spark, f"{self.state}/ready/{version}")
        sets = file_system(self.spark, f"{self.state}/changes")[0]
        fs.mkdirs(sets)
        if fs.exists(ready):
            fs.rename(ready, file_system(self.spark, f"{self.state}/changes/{version}")[0])

    def poll(self) -> int:
        """Takes a new listing; returns how many files are new, changed or deleted since the last."""
        last = self._last()
        self._moved(last)
        now, ready = f"{self.state}/listing/{last + 1}", f"{self.state}/ready/{last + 1}"
        self._listing().write.mode("overwrite").parquet(now)
        read = lambda v: self.spark.read.schema(_FILE).parquet(f"{self.state}/listing/{v}") if v else self.spark.createDataFrame([], _FILE)
        new, old = read(last + 1).withColumn("n", F.lit(1)), read(last).select("kind", "path", *[F.col(c).alias(f"old_{c}") for c in ("size", "modified", "digest")], F.lit(1).alias("o"))
        differs = ~(F.col("size").eqNullSafe(F.col("old_size")) & F.col("modified").eqNullSafe(F.col("old_modified")) & (F.col("digest").eqNullSafe(F.col("old_digest")) | F.col("old_digest").isNull()))
        change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted").when(differs, "changed")
        found = new.join(old, ["kind", "path"], "full").withColumn("change", change).where("change is not null")
        found.select("kind", "path", "change", "size", "modified", F.lit(last + 1).cast("long").alias("version")).write.mode("overwrite").parquet(ready)
        n = self.spark.read.schema(CHANGE).parquet(ready).count()
        drop = lambda name: file_system(self.spark, f"{self.state}/{name}")[1].delete(file_system(self.spark, f"{self.state}/{name}")[0], True)
        if n == 0:
            drop(f"ready/{last + 1}")
            return 0
        replace_small(self.spark, f"{self.state}/LISTING", str(last + 1))
        self._moved(last + 1)
        drop(f"listing/{last}")
        return n

    def changes(self) -> DataFrame:
        """The change sets as a stream; version tells their order."""
        self._moved(self._last())
        return self.spark.readStream.schema(CHANGE).option("recursiveFileLookup", True).parquet(f"{self.state}/changes")

    def deliver(self, on_change: Callable[[DataFrame], None]) -> None:
        """Calls on_change(changes) with all that was not delivered yet."""
        run_available(self.changes(), lambda df, _: on_change(df), checkpoint=f"{self.state}/checkpoint")


def watched(spark: SparkSession, raw: str, state: str, on_change: Callable[[DataFrame], None], glob: str = "*") -> int:
    """Calls on_change(changes) with the files under raw that are new, changed or deleted since the last call with this state; returns their number."""
    watch, seen = Watch(spark, state, {"raw": (raw, glob)}), [0]
    watch.poll()

    def each(batch: DataFrame) -> None:
        n = batch.count()
        if n:
            on_change(batch)
            seen[0] += n

    watch.deliver(each)
    return seen[0]
