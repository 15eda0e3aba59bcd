"""Ranked title search against a full scan of the records."""

import collections
import math
import re

import pytest

from pagequarry.operators.titleindex import TitleIndex, bucket_of
from pagequarry.session import new_dir
from pagequarry.sources import rendered

ITEMS = "item_id long, title string"
QUERIES = "query_id long, query string"


def words(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def by_hand(items, queries, top):
    held = [(i, words(t)) for i, t in items if i is not None and words(t)]
    n_docs, total = len(held), sum(len(w) for _, w in held)
    df = collections.Counter(w for _, ws in held for w in set(ws))
    want = []
    for q, text in set(queries):
        scores = []
        for i, ws in held:
            m = 25 + (75 * len(ws) * n_docs) // total
            tf = collections.Counter(ws)
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in words(text) if w in tf
            )
            if s > 0:
                scores.append((-s, i))
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:top])]
    return sorted(want)


def found(index, spark, queries, top):
    return sorted(map(tuple, index.search(spark.createDataFrame(queries, QUERIES), top).collect()))


@pytest.mark.parametrize("top", [1, 10])
def test_all_titles_as_queries(spark, sf_dir, top):
    items = rendered.sourced_items(spark, sf_dir).select("item_id", "title")
    index = TitleIndex(spark, new_dir(spark, "titles"))
    index.add(items.where("item_id % 3 = 0"))
    index.add(items.where("item_id % 3 <> 0"))
    rows = [tuple(r) for r in items.collect()]
    queries = [(i, t) for i, t in rows if i % 4 == 0]
    assert found(index, spark, queries, top) == by_hand(rows, queries, top)


def test_ties_nulls_repeats_and_clashing_columns(spark):
    rows = [(5, "Red River"), (1, "red river"), (2, "River, red red"), (3, None), (4, "..."), (6, "Blue"), (6, "Blue"), (None, "red"), (7, "été 川")]
    queries = [(1, "RED"), (2, "river red"), (2, "river red"), (3, None), (4, "nothing"), (5, "川 blue blue"), (6, "")]
    index = TitleIndex(spark, new_dir(spark, "titles"), keep=3)
    index.add(spark.createDataFrame(rows, ITEMS).selectExpr("*", "1 as bucket", "'x' as token", "2 as n", "'k' as title_key"))
    assert found(index, spark, queries, 3) == by_hand(rows, queries, 3)
    with pytest.raises(ValueError):
        index.search(spark.createDataFrame(queries, QUERIES), 4)


def test_empty_index_and_no_queries(spark):
    index = TitleIndex(spark, new_dir(spark, "titles"))
    assert found(index, spark, [(1, "a")], 10) == []
    index.add(spark.createDataFrame([], ITEMS))
    index.add(spark.createDataFrame([(1, "a b")], ITEMS))
    assert index.search(spark.createDataFrame([], QUERIES)).collect() == []


def test_a_search_reads_its_own_folders_only(spark):
    """The plan scans postings and titles of the index, no records, and asks the folders of the query's tokens."""
    index = TitleIndex(spark, new_dir(spark, "titles"))
    index.add(spark.createDataFrame([(i, f"word{i} film") for i in range(500)], ITEMS))
    hits = index.search(spark.createDataFrame([(1, "word7")], QUERIES))
    assert [tuple(r)[:3] for r in hits.collect()] == [(1, 1, 7)]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    folder = index.spark.createDataFrame([("word7",)], "token string").select(bucket_of("token")).first().bucket
    assert re.search(rf"PartitionFilters: \[[^]]*bucket#\d+ (IN \({folder}\)|= {folder})", plan)


def test_added_runs_leave_older_files_alone(spark):
    import glob
    import os

    path = new_dir(spark, "titles")
    index = TitleIndex(spark, path)
    index.add(spark.createDataFrame([(1, "a b"), (2, "c")], ITEMS))
    local = path.removeprefix("file:")
    files = {f: os.path.getmtime(f) for f in glob.glob(f"{local}/*/*/*.parquet")}
    index.add(spark.createDataFrame([(3, "a")], ITEMS))
    assert files and all(os.path.getmtime(f) == t for f, t in files.items())
    assert {r.item_id for r in index.search(spark.createDataFrame([(1, "a")], QUERIES)).collect()} == {1, 3}
