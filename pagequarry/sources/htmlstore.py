"""A folder of stored pages, one ``<key>.html`` each, as a data source: ``format("html_store")``.

A filter on ``key`` reaches the source, which then opens the named files and does not list the folder, so that a
lookup costs the pages it asks for and not the pages that are stored. Paths are any that Arrow's file systems know.
An empty file is a page with empty markup (``pages.read_html_dir`` passes it over).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)

from pagequarry.sources.pages import page_key

FORMAT = "html_store"
SCHEMA = "key string, html string"
ENDING = ".html"
FILES_PER_TASK = 1000
# a batch is handed on when it holds so many bytes of markup
BATCH_BYTES = 16 << 20
ARROW = pa.schema([("key", pa.string()), ("html", pa.string())])


@dataclass
class Files(InputPartition):
    keys: list[str]
    # whether the folder listed them; one that was only asked for may not be there
    listed: bool


def located(path: str) -> str:
    """The path as a URI that Arrow takes; Hadoop writes local ones with a single slash."""
    local = re.sub(r"^file:/+", "/", path)
    return f"file://{local}" if local.startswith("/") else path


def is_key(key: str | None) -> bool:
    return bool(key) and "/" not in key and key[0] not in "._"


class StoreReader(DataSourceReader):
    def __init__(self, path: str, files_per_task: int):
        self.path, self.files_per_task = path, files_per_task
        self.asked: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            if isinstance(one, EqualTo) and one.attribute == ("key",):
                keys = {one.value}
            elif isinstance(one, In) and one.attribute == ("key",):
                keys = set(one.value)
            else:
                yield one
                continue
            self.asked = keys if self.asked is None else self.asked & keys

    def partitions(self) -> list[Files]:
        if self.asked is not None:
            keys = sorted(k for k in self.asked if is_key(k))
        else:
            system, root = fs.FileSystem.from_uri(self.path)
            found = system.get_file_info(fs.FileSelector(root))
            names = [f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(ENDING)]
            keys = sorted(k for k in (n[: -len(ENDING)] for n in names) if is_key(k))
        step = self.files_per_task
        return [Files(keys[i : i + step], self.asked is None) for i in range(0, len(keys), step)] or [Files([], True)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(self.path)
        keys, texts, size = [], [], 0
        for key in partition.keys:
            try:
                with system.open_input_stream(f"{root}/{key}{ENDING}") as file:
                    data = file.read()
            except FileNotFoundError:
                if partition.listed:
                    raise
                continue
            keys.append(key)
            texts.append(data.decode("utf-8", "replace"))
            size += len(data)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(texts, pa.string())], schema=ARROW)
                keys, texts, size = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(texts, pa.string())], schema=ARROW)


class StoreWriter(DataSourceArrowWriter):
    """Pages become visible one by one, each whole; a repeated task writes the same files again."""

    def __init__(self, path: str, at: tuple[int, int]):
        self.path, self.at = path, at

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        for batch in iterator:
            for key, html in zip(*(batch.column(i).to_pylist() for i in self.at), strict=True):
                if html is None or key is None:
                    continue
                if not is_key(key):
                    raise ValueError(f"not a name for a page: {key!r}")
                half = f"{root}/_{uuid.uuid4().hex}"
                with system.open_output_stream(half) as file:
                    file.write(html.encode())
                system.move(half, f"{root}/{key}{ENDING}")
        return WriterCommitMessage()


class HtmlStore(DataSource):
    """``key, html``. Options: ``path``, and ``files_per_task`` for reading."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StoreReader:
        return StoreReader(located(self.options["path"]), int(self.options.get("files_per_task", FILES_PER_TASK)))

    def writer(self, schema, overwrite: bool) -> StoreWriter:
        if overwrite:
            raise ValueError("a store of pages is added to; take a new folder for a new one")
        return StoreWriter(located(self.options["path"]), (schema.names.index("key"), schema.names.index("html")))


def register_store(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HtmlStore)


def write_store(pages: DataFrame, path: str) -> None:
    """Adds the pages (``url, html``) to the store at ``path``.

    A page that is there is replaced; rows without a URL or markup are left out. Of several rows with one URL the one of
    the greatest markup is kept, whatever the order of the rows.
    """
    register_store(pages.sparkSession)
    rows = pages.where("url is not null").groupBy(page_key(F.col("url")).alias("key")).agg(F.max("html").alias("html"))
    rows.write.format(FORMAT).mode("append").save(path)


def read_store(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """``key, html`` of the store, of all pages or of the ``keys`` that are there."""
    register_store(spark)
    rows = spark.read.format(FORMAT).load(path)
    return rows if keys is None else rows.where(F.col("key").isin(keys))


def opened_pages(requests: DataFrame, path: str, files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """``url, key, html`` of the requested URLs that are stored, each once: a task opens the files of its own requests.

    For requests that are a table of any size, but few against the store; ``pages.stored_pages`` scans the store instead.
    """
    wanted = requests.where("url is not null").select("url").distinct().withColumn("key", page_key(F.col("url")))
    location = located(path)

    def open_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = StoreReader(location, files_per_task)
        for batch in batches:
            urls = dict(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True))
            for found in reader.read(Files(sorted(urls), False)):
                url = pa.array([urls[k] for k in found.column(0).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([url, found.column(0), found.column(1)], names=["url", "key", "html"])

    return wanted.mapInArrow(open_files, f"url string, {SCHEMA}")
