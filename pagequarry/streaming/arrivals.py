"""Pages processed as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagequarry.operators.classify import with_class
from pagequarry.operators.parse import parse_pages
from pagequarry.plans.jobs import process_pages
from pagequarry.schema import PAGES


def arriving_pages(spark: SparkSession, path: str, files_per_trigger: int | None = None, max_file_age: str = "36500d") -> DataFrame:
    """Stream of the Parquet page files appearing under ``path``, with the time each was read as ``arrived``.

    The time is that of reading and not of the file, so a file that appears with an old modification time is not
    late. For the same reason no file is passed over for its age beside the newest one unless ``max_file_age``
    says so (Spark's own default is a week); the driver remembers the names of the files younger than that.
    """
    reader = spark.readStream.schema(PAGES).option("maxFileAge", max_file_age)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("arrived", F.current_timestamp())


def each_url_once(rows: DataFrame, time_col: str = "arrived", delay: str = "1 day") -> DataFrame:
    """Drop rows whose URL came before, within ``delay`` of event time, which bounds the state.

    A ``time_col`` of the caller's own may go back: rows older than the watermark are dropped, seen or not.
    Apply it to what was taken from the pages, not to the pages: the shuffle to the state then carries no markup.
    """
    return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["url"])


def processed_once(pages: DataFrame, delay: str = "1 day", **options) -> DataFrame:
    """``process_pages`` over arriving pages, the result of each URL once within ``delay``."""
    return each_url_once(process_pages(pages, keep=("arrived",), **options), delay=delay)


def running_counts(pages: DataFrame, **class_options) -> DataFrame:
    """Pages so far by type."""
    return with_class(parse_pages(pages), **class_options).groupBy("page_type").agg(F.count("*").alias("n"))


def process_stream(
    pages: DataFrame,
    out: str,
    checkpoint: str,
    job: Callable[[DataFrame], DataFrame] = process_pages,
    available_now: bool = True,
) -> StreamingQuery:
    """Run ``job`` on every batch and write its rows below ``out``.

    Each batch owns a folder and overwrites it when repeated after a failure, so
    a page's result is there exactly once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def store_stream(rows: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append rows to Parquet below ``out``, each exactly once."""
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
