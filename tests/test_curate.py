"""Curating: small tables with known answers."""

from pyspark.sql import functions as F

from pagequarry.operators import curate

SCHEMA = "item_id long, title string, year string, director string, genre string, source_url string, trust long"


def items(spark):
    rows = [
        (1, "Low Tide!", "1951", None, "noir", "u1", 3), (2, "low  tide", "1951", "A. Wren", None, "u2", 9),
        (3, "LOW TIDE", "1951", "B. Low", "drama", None, 9), (4, "Low Tide", "1952", None, None, "u4", 1),
        (5, None, "1951", "X", None, "u5", 1), (6, "Kelp", None, None, None, "u6", 1), (7, " - ", "1960", None, None, None, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_merge_by_trust(spark):
    got = {(r["title_key"], r["year"]): r for r in curate.merge_items(items(spark)).collect()}
    assert set(got) == {("low tide", "1951"), ("low tide", "1952")}
    best = got["low tide", "1951"]
    assert (best["title"], best["director"], best["genre"], best["n_sources"]) == ("low  tide", "A. Wren", "drama", 3)


def test_upsert_keeps_values_and_dates(spark):
    old = items(spark).where("item_id = 3").withColumns({"first_seen": F.lit("a"), "last_seen": F.lit("b")})
    row = curate.upsert_items(old, items(spark).where("item_id in (1, 4)"), "c").where("year = '1951'").first()
    assert (row["title"], row["director"], row["genre"], row["first_seen"], row["last_seen"]) == ("Low Tide!", "B. Low", "noir", "a", "c")


def test_flags_and_kpis(spark):
    flags = {r["item_id"]: (r["title_only"], r["enrichment_needed"]) for r in curate.with_enrichment(items(spark)).collect()}
    assert flags[2] == (False, False) and flags[6] == (True, True) and flags[5] == (False, True)
    one = curate.kpis(items(spark)).first()
    assert one["n_items"] == 7 and abs(one["title_only_ratio"] - 1 / 7) < 1e-12
    assert curate.likely_items(items(spark)).count() == 6
    report = {r["field"]: r["n_missing"] for r in curate.quality_report(items(spark)).collect()}
    assert report == {"title": 1, "year": 1, "director": 4, "genre": 5}


def test_retries_and_caps(spark):
    errors = spark.createDataFrame([("a",), ("a",), ("b",)], "url string")
    assert [tuple(r) for r in curate.retry_queue(errors, 2).collect()] == [("b", 1)]
    pages = spark.createDataFrame([(3, "http://A.test:80/x"), (1, "https://a.test/y"), (2, "http://b.test/")], "page_id long, url string")
    assert sorted(r["page_id"] for r in curate.at_most_per_domain(pages, 1).collect()) == [1, 2]


def test_scrub(spark):
    texts = {
        "write to a.b+c@mail.test.org now": "write to [email] now",
        "call +49 (30) 123-4567 or 0301234567.": "call [phone] or [phone].",
        "born 1951, item 12, v1.2.3, 10 000": "born 1951, item 12, v1.2.3, 10 000",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(curate.scrubbed(F.col("t"))).collect()] == list(texts.values())


def test_drift(spark, parsed):
    was = curate.shape_hash(parsed([("u", "<p>a<b>x</b>"), ("v", "<p>"), ("w", "<i>")]))
    now = curate.shape_hash(parsed([("u", "<p>other<b></b>"), ("v", "<p><p>"), ("x", "<i>")]))
    assert {r["url"]: r["status"] for r in curate.drift(was, now).collect()} == {"u": "same", "v": "changed", "w": "gone", "x": "new"}


def test_export(spark, tmp_path):
    curate.export_items(items(spark), str(tmp_path / "out"), "trust > 3")
    assert sorted(r["item_id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == [2, 3]
    assert [r["item_id"] for r in curate.search_titles(items(spark), "TIDE low").orderBy("item_id").collect()] == [1, 2, 3, 4]


def test_history_of_values(spark):
    rows = [
        (1, "a", "1", None, "g", "t1"), (1, "a", "1", None, "g", "t2"), (1, "a", "1", "d", "h", "t3"), (1, "a", "1", None, "g", "t4"),
        (2, None, None, None, None, "t1"), (2, None, None, None, None, "t3"), (3, "b", "2", "d", "g", "t2"), (3, "b", "2", "d", "g", "t2"),
    ]
    runs = spark.createDataFrame(rows, "item_id long, title string, year string, director string, genre string, seen string")
    got = {(r.item_id, r.valid_from): (r.genre, r.valid_to, r.changed) for r in curate.item_history(runs).collect()}
    assert got == {
        (1, "t1"): ("g", "t3", ""), (1, "t3"): ("h", "t4", "director,genre"), (1, "t4"): ("g", None, "director,genre"),
        (2, "t1"): (None, None, ""), (3, "t2"): ("g", None, ""),
    }
    assert curate.item_history(runs.limit(0)).collect() == []
