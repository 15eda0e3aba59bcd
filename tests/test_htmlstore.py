"""A folder of stored pages: round trip, lookups that open only what they ask for, odd names."""

import hashlib
import os

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from pagequarry.sources import htmlstore
from pagequarry.sources.pages import read_html_dir

md5 = lambda url: hashlib.md5(url.encode()).hexdigest()


def store(spark, tmp_path, n=50):
    path = str(tmp_path / "store")
    rows = [(f"https://a.test/{i}", f"<p>page {i} Ω</p>") for i in range(n)]
    rows += [("https://a.test/0", "<a>"), ("https://a.test/null", None), (None, "<p>"), ("https://a.test/empty", "")]
    htmlstore.write_store(spark.createDataFrame(rows, "url string, html string"), path)
    return path


def test_paths():
    assert htmlstore.located("/a/b") == htmlstore.located("file:/a/b") == htmlstore.located("file:///a/b") == "file:///a/b"
    assert htmlstore.located("s3://bucket/a") == "s3://bucket/a"


def test_round_trip(spark, tmp_path):
    path = store(spark, tmp_path)
    got = {r.key: r.html for r in htmlstore.read_store(spark, path).collect()}
    assert len(got) == 51 and got[md5("https://a.test/7")] == "<p>page 7 Ω</p>" and got[md5("https://a.test/empty")] == ""
    assert got[md5("https://a.test/0")] == "<p>page 0 Ω</p>"
    assert {k: v for k, v in got.items() if v} == {r.key: r.html for r in read_html_dir(spark, path).collect()}
    # pages are added and replaced; nothing half written is left
    htmlstore.write_store(spark.createDataFrame([("https://a.test/7", "new"), ("https://b.test/", "b")], "url string, html string"), path)
    again = {r.key: r.html for r in htmlstore.read_store(spark, path).collect()}
    assert again == got | {md5("https://a.test/7"): "new", md5("https://b.test/"): "b"}
    assert all(n.endswith(".html") for n in os.listdir(path))
    small = spark.read.format("html_store").option("files_per_task", 10).load(path)
    assert small.rdd.getNumPartitions() == 6 and small.count() == 52


def test_lookup_opens_what_it_asks_for(spark, tmp_path):
    path = store(spark, tmp_path)
    keys = [md5(f"https://a.test/{i}") for i in range(45, 55)]
    # a scan of the folder would fail on this one
    os.symlink(str(tmp_path / "nowhere"), f"{path}/{md5('broken')}.html")
    found = htmlstore.read_store(spark, path, keys)
    assert sorted(r.html for r in found.collect()) == [f"<p>page {i} Ω</p>" for i in range(45, 50)]
    reader = htmlstore.StoreReader(f"file://{path}", 4)
    rest = list(reader.pushFilters([In(("key",), tuple(keys)), GreaterThan(("html",), "x"), EqualTo(("html",), "y")]))
    assert len(rest) == 2 and [len(p.keys) for p in reader.partitions()] == [4, 4, 2]
    assert list(reader.pushFilters([EqualTo(("key",), keys[3])])) == []
    assert [p.keys for p in reader.partitions()] == [[keys[3]]]
    list(reader.pushFilters([EqualTo(("key",), "other")]))
    assert [p.keys for p in reader.partitions()] == [[]]
    both = htmlstore.read_store(spark, path, keys).where("html like '%46%'")
    assert [r.key for r in both.collect()] == [keys[1]]
    assert htmlstore.read_store(spark, path, ["../x", "", "_x"]).collect() == []


def test_requests_of_any_number(spark, tmp_path):
    path = store(spark, tmp_path)
    requests = spark.createDataFrame([(f"https://a.test/{i}",) for i in (3, 3, 4, 99)] + [(None,)], "url string")
    got = sorted((r.url, r.key, r.html) for r in htmlstore.opened_pages(requests, path).collect())
    assert got == [(u, md5(u), f"<p>page {i} Ω</p>") for i, u in ((3, "https://a.test/3"), (4, "https://a.test/4"))]
    assert htmlstore.opened_pages(requests.limit(0), path).collect() == []


def test_refusals(spark, tmp_path):
    htmlstore.register_store(spark)
    rows = spark.createDataFrame([("a/b", "x")], "key string, html string")
    with pytest.raises(Exception, match="not a name"):
        rows.write.format("html_store").mode("append").save(str(tmp_path / "s"))
    with pytest.raises(Exception, match="added to"):
        rows.write.format("html_store").mode("overwrite").save(str(tmp_path / "s"))
