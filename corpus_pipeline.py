"""The corpus pipeline: documents through five operators, each stage on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of documents.
Stages take whatever rows there are: null and empty texts, null and repeated ids, ties and empty tables have the results that their
operators state, and columns beside doc_id and text pass through all but the last stage unread, whatever their names.

SQL can express neither the learnt classifier, nor 64-bit fingerprints, nor the tokenizer, so ORACLE_SQL is
None; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table
from tessera.llm.decontaminate import uncontaminated
from tessera.llm.quality_classifier import accepted
from tessera.llm.sentencepiece import encode
from tessera.llm.simhash import representatives
from tessera.llm.suffix_dedup import deduplicated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Empty texts get a score like any other; without labels of both kinds all stay."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays; empty texts are one group. Rows that share the
    smallest id all stay; a group without any id keeps its rows."""
    return representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has go from the text; n_chars follows. A null text stays null; a null id counts as
    larger than any other, and rows of one id take nothing from each other."""
    return deduplicated(docs).withColumn("n_chars", F.length("text").cast("long"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go; those without words stay, and all do if the benchmark has none."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip of every row; null and empty texts have no tokens."""
    return encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("SentencePiece encoding", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each stage's result is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i}")
    return docs
