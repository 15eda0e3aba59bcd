"""Arrivals in files for all cores, and the rows of a key taken one by one."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from pagequarry.plans import queries
from pagequarry.schema import PAGES
from pagequarry.streaming import seen


def test_arrivals_are_some_files_each(spark, tmp_path):
    rows = [(i, f"https://example.com/{i}", "<p>x</p>") for i in range(120)] + [(None, None, None)]
    spark.createDataFrame(rows, PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    path = queries._arrivals(spark, str(tmp_path))
    came = spark.read.schema(PAGES).parquet(path).select("page_id", F.col("_metadata.file_name").alias("f")).collect()
    files = {}
    for r in came:
        files.setdefault(r.page_id, []).append(r.f)
    assert set(files) == {*range(120), None} and files[None] and len(came) == 161
    assert all(len(f) == len(set(f)) == (2 if i is not None and i % 3 == 0 else 1) for i, f in files.items())
    assert len({r.f for r in came}) > 4


class Record:
    def __init__(self, value=None):
        self.value = value

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def given(repeats, record, texts):
    keys = seen.SeenKeys(None, repeats)
    keys.record = record
    return [(r.row, r.n_before) for r in keys.handleInputRows(("k",), iter([Row(key="k", row=t) for t in texts]), None)]


def test_the_least_row_of_a_batch_is_the_first():
    record = Record()
    assert given(False, record, ["c", "a", "b"]) == [("a", 0)]
    assert given(False, record, ["0"]) == [] and record.value[1] == 4
    assert given(True, record, ["y", "x"]) == [("x", 4), ("y", 5)] and record.value[1] == 6


def test_repeats_are_put_in_order_some_at_a_time(monkeypatch):
    monkeypatch.setattr(seen, "AT_ONCE", 2)
    assert given(True, Record(), ["d", "c", "b", "a", "e"]) == [("c", 0), ("d", 1), ("a", 2), ("b", 3), ("e", 4)]
