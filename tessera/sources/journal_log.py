"""A journal that many writers share: a log of numbered commits over files that never change.

A writer writes its rows into a folder of its own, then claims the next number in the log; if another was faster it claims the one after. A number is
claimed by giving a finished file its name where no file has it, so readers see whole commits only. Status changes are commits
too: an entry that is pending takes the first status that a later commit has for its key. Compaction folds all commits up to
a number into one folder and is itself a commit; entries keep the number that they came with, so what is committed meanwhile still applies.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.journal import ENTRY, entry_key
from tessera.sources.pointer import file_system

_STATUS = "key string, new_status string"


class JournalLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _name(self, number: int) -> str:
        return f"{self.root}/_log/{number:012d}.json"

    def _claimed(self, number: int, text: str) -> bool:
        """Whether the commit file of a number is ours: it gets its name only if none has it."""
        (target, fs), (new, _) = file_system(self.spark, self._name(number)), file_system(self.spark, f"{self.root}/_log/.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":  # a link is made in one step, unlike this file system's rename
                local = lambda p: unquote(urlparse(fs.makeQualified(p).toString()).path)
                try:
                    os.link(local(new), local(target))
                except FileExistsError:
                    return False
                return True
            jvm = self.spark.sparkContext._jvm
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            if fs.exists(target):
                return False
            try:
                context.rename(new, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            except Exception:
                if fs.exists(target):
                    return False
                raise
            return True
        finally:
            fs.delete(new, False)

    def _commit(self, said: dict) -> int:
        number = self.version() + 1
        while not self._claimed(number, json.dumps(said)):
            number += 1
        return number

    def version(self) -> int:
        """The number of the last commit; 0 before the first. Numbers have no gaps."""
        path, fs = file_system(self.spark, f"{self.root}/_log")
        fs.mkdirs(path)
        names = (s.getPath().getName() for s in fs.listStatus(path))
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def append(self, entries: DataFrame) -> int:
        """Adds entries (ENTRY); returns the commit's number."""
        folder = f"entries/{uuid.uuid4().hex}"
        entries.select(*self.spark.createDataFrame([], ENTRY).columns).write.parquet(f"{self.root}/{folder}")
        return self._commit({"what": "entries", "folder": folder})

    def set_status(self, statuses: DataFrame) -> int:
        """Gives pending entries of a key (key, new_status) a status; others, and entries that come later, stay as they are."""
        folder = f"statuses/{uuid.uuid4().hex}"
        statuses.select("key", "new_status").write.parquet(f"{self.root}/{folder}")
        return self._commit({"what": "statuses", "folder": folder})

    def compact(self) -> int | None:
        """Folds all commits so far into one folder."""
        upto = self.version()
        if upto == 0:
            return None
        folder = f"folded/{uuid.uuid4().hex}"
        self._entries(upto).write.parquet(f"{self.root}/{folder}")
        return self._commit({"what": "folded", "folder": folder, "upto": upto})

    def _log(self, version: int) -> list[tuple[int, dict]]:
        """The commits that count: the greatest folding and what came after what it holds."""
        texts = self.spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(f"{self.root}/_log").select("value", F.regexp_extract("_metadata.file_path", r"(\d+)\.json$", 1).cast("long").alias("n"))
        every = [(r["n"], json.loads(r["value"])) for r in texts.where(F.col("n") <= version).collect()]
        folded = max(((c["upto"], n) for n, c in every if c["what"] == "folded"), default=(0, 0))
        return sorted([(n, c) for n, c in every if n == folded[1] or (n > folded[0] and c["what"] != "folded")], key=lambda x: x[0])

    def _entries(self, version: int) -> DataFrame:
        """Entries with the number of their commit, statuses applied."""
        schema = f"{ENTRY}, commit long"
        found, statuses = self.spark.createDataFrame([], schema), self.spark.createDataFrame([], f"{_STATUS}, at long")
        for n, c in self._log(version) if version else []:
            path = f"{self.root}/{c['folder']}"
            if c["what"] == "folded":
                found = found.unionByName(self.spark.read.schema(schema).parquet(path))
            elif c["what"] == "entries":
                found = found.unionByName(self.spark.read.schema(ENTRY).parquet(path).withColumn("commit", F.lit(n).cast("long")))
            else:
                statuses = statuses.unionByName(self.spark.read.schema(_STATUS).parquet(path).withColumn("at", F.lit(n).cast("long")))
        # one entry for each commit that a key came with, then the first status after it
        keyed = found.withColumn("key", entry_key())
        pending = keyed.where("status = 'pending' AND key IS NOT NULL").select("key", "commit").distinct()
        first = pending.join(statuses, "key").where("at > commit").groupBy("key", "commit").agg(F.min_by("new_status", F.struct("at", "new_status")).alias("taken"))
        joined = keyed.join(first, ["key", "commit"], "left")
        return joined.withColumn("status", F.when(F.col("status") == "pending", F.coalesce("taken", "status")).otherwise(F.col("status"))).select(*found.columns)

    def read(self, version: int | None = None) -> DataFrame:
        """The entries as of a commit, or now."""
        return self._entries(self.version() if version is None else version).drop("commit")
