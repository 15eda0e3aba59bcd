"""Provenance with selectors, KPIs with depth: small tables with known answers."""

from pagequarry.operators import curate, fields


def test_selector_of_each_value(parsed):
    pages = parsed(
        [
            '<h1 class="title">second</h1><span class="my-year">1951</span>',
            '<h1 class="entry-title">first</h1><h1 class="title">second</h1>',
            '<h1 class="entry-title"> </h1><div class="movie-title"><b>whole of the third</b></div>',
        ],
        keep_html=True,
    )
    rows = curate.provenance(pages, fields.main_fields("nodes"), fields.main_selectors("nodes")).collect()
    got = sorted((r.page_id, r.field, r.value, r.selector) for r in rows)
    assert got == [(0, "title", "second", 1), (0, "year", "1951", 1), (1, "title", "first", 0), (2, "title", "whole of the third", 2)]
    assert {r.selector for r in curate.provenance(pages, fields.main_fields("nodes")).collect()} == {None}


def test_median_depth(spark):
    items = spark.createDataFrame([("a", "u"), (None, None)], "title string, source_url string")
    items = items.selectExpr("title", "source_url", "cast(null as string) year", "cast(null as string) director", "cast(null as string) genre")
    schema = "url string, depth int, page_type string"
    crawled = spark.createDataFrame([("a", 0, "catalogue"), ("b", 1, "unknown"), ("b", 1, "unknown"), ("c", 4, "detail"), ("d", 9, None)], schema)
    row = curate.kpis(items, crawled=crawled).first()
    assert (row.n_items, row.title_only_ratio, row.median_depth) == (2, 0.5, 1.0)
    assert curate.kpis(items, crawled=crawled.limit(0)).first().median_depth is None
    assert "median_depth" not in curate.kpis(items).columns
