"""Tables in buckets of a key, of which an update rewrites only those that it touches, and an index that makes one update of several tables one step."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.sources.pointer import read_small, replace_small

BUCKETS, FILES = 64, 4


class BucketTables:
    """Tables below a folder. keys: each table's key column; schemas: its columns.

    An update has a number. It writes new versions of buckets into folders of that number, which nothing reads until commit()
    replaces the index; run again, it overwrites its own folders only. A bucket's rows are written by up to FILES tasks, so a hot key's
    rows don't pass through one, and sorted by their key, so a filter on keys skips row groups."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str], schemas: dict[str, StructType], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.schemas, self.buckets = spark, root.rstrip("/"), keys, schemas, buckets
        held = json.loads(read_small(spark, f"{self.root}/INDEX") or "null") or {"batch": -1, "tables": {}, "said": None}
        self.batch, self.said = held["batch"], held["said"]
        self.index = {t: {int(b): v for b, v in x.items()} for t, x in held["tables"].items()}
        self.next = {t: dict(x) for t, x in self.index.items()}

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def numbers(self, keys: DataFrame) -> list[int]:
        """The buckets of keys (one column); at most as many as there are."""
        return sorted(r[0] for r in keys.select(self._bucket(F.col(keys.columns[0]))).distinct().collect())

    def read(self, table: str, numbers: list[int] | None = None) -> DataFrame:
        """The rows of some buckets, or all, with this update's own writes."""
        held = self.next.get(table, {})
        paths = [f"{self.root}/{table}/v={v}/bucket={b}" for b, v in sorted(held.items()) if numbers is None or b in numbers]
        return self.spark.read.schema(self.schemas[table]).parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[table])

    def rows(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows whose key is among keys (one column), from their buckets."""
        k = self.keys[table]
        return self.read(table, self.numbers(keys)).join(keys.select(F.col(keys.columns[0]).alias(k)).distinct(), k, "left_semi")

    def write(self, table: str, rows: DataFrame, touched: list[int], number: int) -> None:
        """The new content of the touched buckets."""
        path = f"{self.root}/{table}/v={number}"
        shaped = rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[table].fields])
        placed = shaped.withColumn("bucket", self._bucket(F.col(self.keys[table])))
        spread = F.pmod(F.xxhash64(*[c for c, t in shaped.dtypes if not t.startswith("map")]), F.lit(FILES))
        placed.repartition("bucket", spread).sortWithinPartitions("bucket", self.keys[table]).write.mode("overwrite").partitionBy("bucket").parquet(path)
        schema = StructType([*self.schemas[table].fields, StructField("bucket", IntegerType())])
        full = {r[0] for r in self.spark.read.schema(schema).parquet(path).select("bucket").distinct().collect()}
        held = self.next.setdefault(table, {})
        for b in touched:
            held.pop(b, None)
        held.update(dict.fromkeys(full, number))

    def append(self, table: str, rows: DataFrame, number: int) -> None:
        touched = self.numbers(rows.select(self.keys[table]))
        if touched:
            self.write(table, self.read(table, touched).unionByName(rows.select(*self.schemas[table].names)), touched, number)

    def replace(self, table: str, gone: DataFrame, rows: DataFrame, number: int) -> None:
        """Rows of the keys in gone (one column) go, rows come."""
        k = self.keys[table]
        gone = gone.select(F.col(gone.columns[0]).cast("string").alias(k)).distinct()
        touched = self.numbers(gone.unionByName(rows.select(F.col(k).cast("string").alias(k))))
        if touched:
            self.write(table, self.read(table, touched).join(gone, k, "left_anti").unionByName(rows.select(*self.schemas[table].names)), touched, number)

    def commit(self, number: int, said: dict | None = None) -> None:
        replace_small(self.spark, f"{self.root}/INDEX", json.dumps({"batch": number, "tables": self.next, "said": said}))
        self.batch, self.said, self.index = number, said, {t: dict(x) for t, x in self.next.items()}
