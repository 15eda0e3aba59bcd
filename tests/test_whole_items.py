"""Item queries over whole tables."""

from pyspark.sql import functions as F

from pagequarry.operators import curate
from pagequarry.plans.queries import QUERIES
from pagequarry.sources import rendered


def test_upsert_has_every_key(spark, sf_dir):
    items = rendered.sourced_items(spark, sf_dir).withColumn("title_key", curate.title_key(F.col("title")))
    named = items.where("title_key <> '' and year is not null")
    want = {tuple(r) for r in named.select("title_key", "year").distinct().collect()}
    rows = QUERIES["upserted_all_items"](spark, sf_dir).collect()
    assert len(rows) == len(want) and {(r.title_key, r.year) for r in rows} == want
