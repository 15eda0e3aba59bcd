"""Stored pages: scans, lookup by key, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.schema import PAGES


def read_table(spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None) -> DataFrame:
    """A table as it is stored: splits follow ``spark.sql.files.maxPartitionBytes`` and the row groups.

    ``partitions`` shuffles the rows into so many parts, for small files of one row group.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.repartition(partitions) if partitions else rows


def read_pages(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """``page_id, url, html`` from Parquet, without a shuffle unless ``partitions`` is given."""
    rows = spark.read.schema(PAGES).parquet(path)
    return rows.repartition(partitions) if partitions else rows


def read_html_dir(spark: SparkSession, path: str) -> DataFrame:
    """Pages stored one per file as ``<key>.html``: ``key, html``."""
    files = spark.read.text(path, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return files.select(F.regexp_replace(name, r"\.html$", "").alias("key"), F.col("value").alias("html"))


def page_key(url: Column) -> Column:
    """Name under which a page is stored."""
    return F.md5(url)


def seeds(spark: SparkSession, urls: list[str]) -> DataFrame:
    """The URLs a run starts from."""
    return spark.createDataFrame([(u,) for u in urls], "url string")


def stored_pages(requests: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Requests answered from the snapshot (``key`` plus page columns)."""
    keyed = requests.select(F.col("url").alias("request_url"), page_key(F.col("url")).alias("key"))
    return keyed.join(snapshot, "key")


def missing_pages(requests: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Requests with no stored page, each once."""
    keyed = requests.select("url").distinct().withColumn("key", page_key(F.col("url")))
    return keyed.join(snapshot.select("key"), "key", "left_anti").select("url", "key")
