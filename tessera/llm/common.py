"""Small helpers shared by the corpus operators: text columns, shared-folder tables, row identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.components import drop_stored, shared_dir, stored  # noqa: F401

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words made of digits, ASCII letters and every character beyond ASCII.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The ASCII white space that separates words.
WHITE = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """text with A-Z lower-cased and every other character kept; null becomes empty.

    lower() is far cheaper than translate(), and equal to it unless a capital beyond ASCII occurs."""
    text = F.coalesce(text, F.lit(""))
    other_capital = text.rlike(r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^A-Z]]")
    return F.when(other_capital, F.translate(text, A_TO_Z, A_TO_Z.lower())).otherwise(F.lower(text))


def alnum_words(text: Column) -> Column:
    """Lower-cased words of digits, ASCII letters and characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text), NOT_ALNUM), "")


def white_words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0: such rows never serve for learning. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
