"""Every registered query against its DuckDB SQL."""

import duckdb
import pytest

from tamis.plans import catalog
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_oracle(spark, con, name):
    compare(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], SF)


def test_text_words_of_odd_documents(spark, tmp_path):
    texts = [None, "", "  ", "\n\t\r\f", "\x0b", "\x0bx y", "\x85a b", "\xa0a b", "a\xa0b c", "a\u3000b c", "\u2028z w", "a\x1cb", "\x00a b", "\ufeffa b", " \n lead x", "\r\nx y", "x\r", "\fq", "two words", "two words"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    odd = duckdb.connect()
    odd.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    compare(spark, odd, catalog.text_words, catalog.oracle_sql()["text_words"], str(tmp_path))


def test_without_oracle(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
