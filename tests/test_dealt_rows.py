"""Pages made from a table in one row group are work for all cores, and are moved as markup only."""

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import origins
from pagequarry.operators.parse import parse_pages
from pagequarry.plans.queries import QUERIES
from pagequarry.schema import PAGES
from pagequarry.sources import rendered

KEYS = 400


@pytest.fixture(scope="module")
def one_split(spark, tmp_path_factory):
    """Tables of one row group each."""
    path = str(tmp_path_factory.mktemp("one-split"))
    key = F.col("id")
    text = F.concat(F.lit("name "), key)
    tables = {
        "customer": [key.alias("c_custkey"), text.alias("c_name")],
        "part": [key.alias("p_partkey"), text.alias("p_name"), text.alias("p_brand"), text.alias("p_type"), (key % 50).cast("int").alias("p_size")],
        "orders": [
            key.alias("o_orderkey"), F.lit("O").alias("o_orderstatus"), F.lit("2-HIGH").alias("o_orderpriority"),
            F.timestamp_seconds(key * 86400).alias("o_orderdate"),
        ],
    }
    for name, columns in tables.items():
        # a repeated and a missing key
        rows = spark.range(KEYS).union(spark.createDataFrame([(7,), (None,)], "id long")).select(columns)
        rows.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("pages_of", ["detail_pages", "table_pages", "catalogue_pages", "block_pages", "film_block_pages"])
def test_rendering_uses_all_cores(spark, one_split, pages_of):
    pages = getattr(rendered, pages_of)(spark, one_split, dealt=True)
    in_part = [r["count"] for r in pages.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(in_part) == KEYS + 2
    assert len(in_part) >= spark.sparkContext.defaultParallelism
    assert max(in_part) <= 2 * (KEYS + 2) / len(in_part)


@pytest.mark.parametrize("name", ["detail_like_pages", "next_pages", "classify_as_coded", "table_rows_per_page", "page_stats"])
def test_queries_use_all_cores(spark, one_split, name):
    spark.createDataFrame([], PAGES).write.mode("overwrite").parquet(f"{one_split}/pages.parquet")
    assert QUERIES[name](spark, one_split).select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism


def test_elements_are_counted_once_for_the_rules(spark, one_split):
    spark.createDataFrame([], PAGES).write.mode("overwrite").parquet(f"{one_split}/pages.parquet")
    rules = QUERIES["page_rules"](spark, one_split)
    assert "Filter" not in rules._jdf.queryExecution().optimizedPlan().toString()
    assert rules.count() == 4 * (KEYS + 2)


def test_texts_are_matched_on_all_cores(spark, one_split):
    matched = QUERIES["matched_labels"](spark, one_split)
    in_part = [r["count"] for r in matched.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(in_part) == 10 * (KEYS + 2) and len(in_part) >= spark.sparkContext.defaultParallelism


def test_values_are_read_again_without_gathering_pages(spark, one_split):
    shown = rendered.table_pages(spark, one_split).where("page_id <> 7")
    rows = origins.field_origins(parse_pages(shown, keep_html=True), origins.table_origins("nodes"))
    for stored in (shown, parse_pages(shown)):
        again = origins.values_at(rows, stored)
        plan = again._jdf.queryExecution().toString()
        assert "Broadcast" not in plan
        got = again.where("page_id is not null").select("value", "again").collect()
        assert got and all(r.value == r.again for r in got)


def test_values_of_pages_that_are_gone(spark, one_split):
    shown = rendered.detail_pages(spark, one_split).where("page_id < 4")
    rows = origins.field_origins(parse_pages(shown, keep_html=True), origins.main_origins("nodes"))
    left = shown.where("page_id > 0").withColumn("html", F.when(F.col("page_id") > 1, F.col("html")))
    got = {(r.page_id, r.again is None) for r in origins.values_at(rows, left).collect()}
    assert got == {(0, True), (1, True), (2, False), (3, False)}
