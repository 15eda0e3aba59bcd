"""Ranges, coverage, merged records and retries: small tables with known answers."""

from datetime import datetime, timedelta

from pagequarry.operators import health

ITEMS = "item_id long, title string, year string, director string, genre string, source_url string, trust long"


def test_ranges_and_alarms(spark):
    rows = [
        (1, "a", "1799", None, "g", None, 1), (2, " ", "1800", None, "g", None, 1), (3, "b", "soon", None, None, None, 1), (4, "c", "2030", "d", "g", None, 1),
        (5, "c", "2031", "", "g", None, 1), (6, "c", None, "d", "g", None, 1), (7, "c", " 1951 ", "d", "g", None, 1),
        (8, "c", "99999999999999999999", "d", "g", None, 1),
    ]
    report = health.value_report(spark.createDataFrame(rows, ITEMS), 2025)
    got = {r.field: tuple(r)[1:] for r in report.collect()}
    assert got["year"] == (8, 1, 0.125, 1799, 2031, 2, 2)
    assert got["title"] == (8, 1, 0.125, None, None, None, None) and got["director"][1] == 4
    found = {(r.field, r.reason): r.share for r in health.alarms(report, {"director": 0.4, "title": 0.125}, most_bad=0.5).collect()}
    assert found == {("director", "missing"): 0.5, ("year", "bad"): 4 / 7}
    assert health.alarms(report, {}, most_bad=0.9).collect() == []
    empty = {r.field: tuple(r)[1:] for r in health.value_report(spark.createDataFrame([], ITEMS), 2025).collect()}
    assert empty["year"] == (0, 0, None, None, None, 0, 0)
    assert health.alarms(health.value_report(spark.createDataFrame([], ITEMS), 2025), {"year": 0.0}).collect() == []


def test_coverage_and_merging(spark):
    schema = "page_id long, field string, value string, source_url string"
    rows = [(1, "title", "a", "u"), (1, "title", "b", " "), (2, "title", "a", None), (2, "year", "1", "u"), (3, "year", None, None)]
    got = {r.field: (r.n_values, r.n_sourced, r.n_pages, r.coverage) for r in health.field_coverage(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"title": (3, 1, 2, 1 / 3), "year": (1, 1, 1, 1.0)}
    items = [
        (1, "Low Tide", "1951", None, "noir", "u1", 1), (2, "low tide!", "1951", "A", None, "u2", 9), (3, "Low tide", "1951", None, None, "u2", 0),
        (4, "Kelp", "1951", None, None, None, 1), (5, None, "1951", "x", None, "u5", 1),
    ]
    row = health.merge_kpis(spark.createDataFrame(items, ITEMS)).first()
    assert tuple(row) == (2, 0.5, 1.0, 4.0, 1)
    assert tuple(health.merge_kpis(spark.createDataFrame([], ITEMS)).first()) == (0, None, None, None, 0)


def test_retries(spark):
    start = datetime(2024, 1, 1)
    at = lambda minutes: start + timedelta(minutes=minutes)
    log = [
        ("a", at(0), "old"), ("a", at(10), None), ("a", at(20), "x"), ("a", at(20), "y"), ("a", at(20), "y"), ("a", at(50), "z"),
        ("b", at(0), "x"), ("b", at(5), None), ("c", at(0), "x"), ("c", at(0), None), ("d", at(7), "only"), (None, at(1), "x"), ("e", None, "x"),
        *[("f", at(i), "x") for i in range(30)],
    ]
    fetches = spark.createDataFrame(log, "url string, at timestamp, error string")
    queue = health.retry_table(fetches, max_attempts=31)
    got = {r.url: (r.attempts, r.first_failed, r.last_failed, r.last_error, r.next_at) for r in queue.collect()}
    assert got == {
        "a": (3, at(20), at(50), "z", at(50 + 120)), "d": (1, at(7), at(7), "only", at(37)), "f": (30, at(0), at(29), "x", at(29 + 7 * 24 * 60)),
    }
    assert sorted(r.url for r in health.due(queue, "2024-01-01 00:37:00").collect()) == ["d"]
    assert {r.url: r.next_at is None for r in health.retry_table(fetches, max_attempts=3).collect()} == {"a": True, "d": False, "f": True}
    kpis = health.retry_kpis(fetches.where("url in ('a', 'b', 'c', 'd')")).first()
    # a: 10 and 30 minutes, b: 5; c went well at its only time
    assert (kpis.n_failed, kpis.recovered_share, kpis.avg_delay_minutes) == (3, 2 / 3, 15.0)
    assert health.retry_table(fetches.limit(0)).collect() == [] and tuple(health.retry_kpis(fetches.limit(0)).first()) == (0, None, None)
