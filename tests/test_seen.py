"""Keys of a stream seen once, over batches, restarts and long pauses."""

import os
import time

import pytest

from pagequarry.streaming import seen
from pagequarry.streaming.arrivals import store_stream

pytest.importorskip("google.protobuf")
SCHEMA = "page_id long, url string, arrived timestamp, fields map<string, string>"


class Stream:
    def __init__(self, spark, folder, transform):
        self.spark, self.folder, self.transform, self.files = spark, folder, transform, 0

    def run(self, rows, days_ago=0):
        """One more file, then the stream from its checkpoint until all is read."""
        path = self.folder / "in"
        old = set(path.glob("*.parquet"))
        self.spark.createDataFrame(rows, "page_id long, url string").selectExpr(
            "page_id", "url", f"current_timestamp() - interval {days_ago} days as arrived", "map('id', cast(page_id as string)) as fields"
        ).coalesce(1).write.mode("append").parquet(str(path))
        for f in set(path.glob("*.parquet")) - old:
            os.utime(f, (time.time(),) * 2)
        source = self.spark.readStream.schema(SCHEMA).parquet(str(path))
        query = store_stream(self.transform(source), str(self.folder / "out"), str(self.folder / "state"))
        query.awaitTermination()
        return query

    def rows(self):
        return self.spark.read.parquet(str(self.folder / "out")).collect()


@pytest.fixture(autouse=True)
def provider(spark):
    before = spark.conf.get(seen.PROVIDER)
    yield
    spark.conf.set(seen.PROVIDER, before)


def test_a_key_counts_once_over_restarts_and_long_pauses(spark, tmp_path):
    stream = Stream(spark, tmp_path, seen.first_of_each_key)
    stream.run([(1, "a"), (2, "b"), (3, "b"), (4, None)], days_ago=400)
    stream.run([(5, "a"), (6, "c")], days_ago=40)
    query = stream.run([(7, "b"), (8, "c"), (9, "d"), (10, None)], days_ago=800)
    assert sorted((r.page_id, r.url, r.fields["id"]) for r in stream.rows()) == [(1, "a", "1"), (2, "b", "2"), (4, None, "4"), (6, "c", "6"), (9, "d", "9")]
    assert seen.keys_held(query) == 5


def test_repeats_carry_their_history(spark, tmp_path):
    stream = Stream(spark, tmp_path, seen.with_repeats)
    stream.run([(1, "a"), (2, "a")])
    stream.run([(3, "a"), (4, "b")])
    got = {r.page_id: (r.n_before, r.first_seen) for r in stream.rows()}
    assert {k: n for k, (n, _) in got.items()} == {1: 0, 2: 1, 3: 2, 4: 0}
    assert got[1][1] == got[2][1] == got[3][1] <= got[4][1]


def test_records_expire_when_asked(spark, tmp_path):
    """A running stream; its own clock lets the record go."""
    source = tmp_path / "in"
    rows = spark.createDataFrame([(1, "a")], "page_id long, url string").selectExpr("page_id", "url", "current_timestamp() as arrived", "map('k', 'v') as fields")
    rows.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).parquet(str(source))
    once = seen.first_of_each_key(stream, forget_after_seconds=1)
    query = store_stream(once, str(tmp_path / "out"), str(tmp_path / "state"), available_now=False)

    def arrived(n):
        for _ in range(120):
            time.sleep(0.5)
            found = [r.page_id for r in spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect()] if (tmp_path / "out").exists() else []
            if len(found) >= n:
                return sorted(found)
        return found

    try:
        assert arrived(1) == [1]
        time.sleep(2)
        rows.withColumn("page_id", rows["page_id"] + 1).coalesce(1).write.mode("append").parquet(str(source))
        assert arrived(2) == [1, 2]
    finally:
        query.stop()
