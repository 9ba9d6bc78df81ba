"""Every query of the library's own operators against its SQL."""

import pytest

from tessera.plans import data_queries, layout_queries, stream_queries, tool_queries  # noqa: F401
from tessera.plans.queries import QUERIES, SQL
from tests.oracle import TABLES, agree


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, name):
    agree(spark, sf, QUERIES[name], SQL[name])


def test_redact_compares_texts_with_secrets_of_their_own(spark, sf, tmp_path):
    texts = ["my api_key=abc, then more", "user https://joe:pw@host/x?a=1&token=t2#z", "Bearer a.b-c and a key", "plain text", "sk-0123456789abcdef here", "no secret: a token"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for name in set(TABLES) - {"documents"}:
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    agree(spark, str(tmp_path), QUERIES["redact"], SQL["redact"])
    assert QUERIES["redact"](spark, str(tmp_path)).where("sha IS NULL").isEmpty()


def test_without_sql(spark, sf):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, sf).count() > 0, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
