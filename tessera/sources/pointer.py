"""Small files that are replaced in one step: pointers and indexes in a folder of any Hadoop file system."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """(path, its file system) of the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_small(spark: SparkSession, path: str, text: str) -> None:
    """A new file is renamed onto the old one, which no reader sees missing or half written."""
    jvm = spark.sparkContext._jvm
    new, fs = file_system(spark, f"{path}.{uuid.uuid4().hex}.new")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, file_system(spark, path)[0], rename)
    except Exception:
        fs.delete(new, False)
        raise


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    found, fs = file_system(spark, path)
    return spark.read.option("wholetext", True).text(found.toString()).first()["value"].strip() if fs.exists(found) else None
