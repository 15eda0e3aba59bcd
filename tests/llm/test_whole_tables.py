"""Whole answers of text operators against SQL and plain Python."""

import duckdb
import pytest
from plain import quality_by_hand

tokenizers = pytest.importorskip("public_tokenizers")

from pagequarry.llm.queries import QUERIES  # noqa: E402
from pagequarry.llm.sql import ORACLES  # noqa: E402


def test_quality_by_hand(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in QUERIES["op1_quality_rules"](spark, sf_dir).collect())
    assert got == sorted((r.doc_id, *quality_by_hand(r.text)) for r in texts)


def test_chat_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = db.sql(ORACLES["op9_chat_formatting"])
    got = QUERIES["op9_chat_formatting"](spark, sf_dir)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("name", ["op1_quality_rules", "op11_secret_scans", "op12_lexical_search"])
def test_sql_twins(spark, sf_dir, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    want = db.sql(ORACLES[name])
    got = QUERIES[name](spark, sf_dir)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
