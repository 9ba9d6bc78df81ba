"""Scalar functions over text columns: ids, slugs, labels, tokens, canonical JSON."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Caseless form; it differs from lower() for characters such as the sharp s."""
    return s.map(lambda x: None if x is None else x.casefold())


def composed(c: Column) -> Column:
    """c in NFC; text that is plain ASCII never leaves the JVM's fast path (its value is the same)."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), nfc(c)).otherwise(c)


def normal_id(c: Column, compose: bool = False) -> Column:
    """Lower case, with runs of hyphens, underscores and white space as one hyphen; compose: in NFC first."""
    return F.regexp_replace(F.lower(composed(c) if compose else c), r"(?U)[-_\s]+", "-")


def slug(c: Column) -> Column:
    return F.translate(c, ":/", "--")


def safe_key(c: Column, default: str = "session") -> Column:
    """A name for files: other characters than letters, digits, dot, hyphen and underscore become one hyphen."""
    kept = F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "-")
    kept = F.regexp_replace(kept, r"^-+|-+$", "")
    return F.when(kept == "", default).otherwise(F.coalesce(kept, F.lit(default)))


def humanised(c: Column) -> Column:
    """snake_case as words with capitals."""
    return F.initcap(F.translate(c, "_-", "  "))


def plural(c: Column) -> Column:
    return F.when(c.endswith("s"), c).otherwise(F.concat(c, F.lit("s")))


def prose(c: Column) -> Column:
    """White space normalised within paragraphs, paragraphs kept and separated by one empty line."""
    parts = F.transform(F.split(F.regexp_replace(c, r"\r\n?", "\n"), r"\n[ \t]*\n+"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")


def clipped(c: Column, n: int, ending: str = "…") -> Column:
    """c, cut to n characters with an ending where longer."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, n - len(ending))), F.lit(ending)))


def first_text(*cs: Column) -> Column:
    """The first that is more than white space."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cs])


#: Words that don't count when answers are compared.
STOP_TOKENS = ("a", "an", "the", "is", "are", "was", "were", "to", "of", "in", "on", "at")


def answer_tokens(c: Column) -> Column:
    """Lower-cased words without punctuation and stop words."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]+", " ")), r"(?U)\s+"), lambda w: (w != "") & ~w.isin(*STOP_TOKENS))


def overlap(a: Column, b: Column) -> Column:
    """How many tokens two arrays share, as multisets."""
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(count(a, w), count(b, w)))


def token_f1(answer: Column, gold: Column) -> Column:
    """F1 of shared tokens; both empty 1, one empty 0."""
    a, g = answer_tokens(answer), answer_tokens(gold)
    shared = overlap(a, g)
    return F.when((F.size(a) == 0) & (F.size(g) == 0), 1.0).when(shared == 0, 0.0).otherwise(2.0 * shared / (F.size(a) + F.size(g)))


def token_recall(found: Column, gold: Column) -> Column:
    """Share of gold's tokens, as a multiset, that found has; an empty gold counts as found."""
    g = answer_tokens(gold)
    return F.when(F.size(g) == 0, 1.0).otherwise(overlap(g, answer_tokens(found)) / F.size(g))


def canonical_json(*columns: str) -> Column:
    """A row as JSON: sorted keys, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def sorted_map(m: Column) -> Column:
    """A map with its keys in order, so equal maps serialise alike."""
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def validity(valid_from: Column, valid_to: Column) -> Column:
    """Validity as text."""
    f, t = F.date_format(valid_from, "yyyy-MM-dd"), F.date_format(valid_to, "yyyy-MM-dd")
    return (
        F.when(valid_from.isNull() & valid_to.isNull(), "always")
        .when(valid_to.isNull(), F.concat(f, F.lit(" → present")))
        .when(valid_from.isNull(), F.concat(F.lit("until "), t))
        .otherwise(F.concat(f, F.lit(" → "), t))
    )


def iso_date(c: Column) -> Column:
    """The date that an ISO date or timestamp starts with; the time zone does not shift it. Null if there is none."""
    return F.try_to_date(F.substring(F.trim(c), 1, 10), "yyyy-MM-dd")
