"""Extraction by SQL functions: equal to the jobs, without a shuffle."""

import re

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import tables
from pagequarry.operators.parse import parse_pages
from pagequarry.plans import jobs, sqlfunctions
from pagequarry.sources import rendered
from test_origins import PAGES

LATERAL = """select p.page_id, t.* from {pages} p, lateral page_parts(p.html, p.url) parts
    lateral view outer inline(parts.tables) t where t.row_id is not null"""


@pytest.fixture
def functions(spark):
    return sqlfunctions.register_functions(spark)


def plan_of(df):
    """The operators of a plan, without what they compute."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [re.sub(r"^[\s:+*()\d-]*", "", line).split(" ")[0] for line in lines]


def test_table_rows(spark, sf_dir, functions):
    pages = rendered.table_pages(spark, sf_dir)
    got = spark.sql(LATERAL, pages=pages)
    plan = plan_of(got)
    assert plan.count("ArrowEvalPython") == 1
    assert not [name for name in plan if "Exchange" in name or "Join" in name or "Aggregate" in name]
    want = parse_pages(pages).select("page_id", F.inline(F.expr(tables.table_items("nodes"))))
    assert got.schema.names == want.schema.names
    rows = lambda df: sorted((r[0], r[1], r[2], sorted(r[3].items())) for r in df.collect())
    assert rows(got) == rows(want) and got.count() > 100


def test_every_part_equals_the_job(spark, functions):
    links = '<a href="/movie/1">a</a><a href="javascript:x">b</a><a class="next" href="/p/2">next</a>'
    rows = [(i, f"https://example.com/{i}", p) for i, p in enumerate([*PAGES, links])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = spark.sql("select p.page_id, parts.* from {pages} p, lateral page_parts(p.html, p.url) parts order by page_id", pages=pages)
    whole = plan_of(spark.sql("select parts.* from {p} p, lateral page_parts(html, url) parts", p=pages))
    assert whole.count("ArrowEvalPython") == 1 and not [name for name in whole if "Exchange" in name or "Join" in name]
    want = jobs.extract_all(pages).orderBy("page_id").collect()
    for g, w in zip(got.collect(), want, strict=True):
        for name in ("links", "main_fields", "paragraph_fields", "fields"):
            assert g[name] == w[name], (g.page_id, name)
        assert g.tables == w["items"]
    alone = spark.sql("select page_id, page_links(html, url) links, page_tables(html) rows, page_next_page(html, url) next from {pages}", pages=pages)
    assert {r.page_id: (r.links, r.rows) for r in alone.collect()} == {w.page_id: (w.links, w["items"]) for w in want}


def test_scalar_functions_can_be_filtered_on(spark, functions):
    pages = spark.createDataFrame([(1, PAGES[0]), (2, None), (3, "")], "page_id long, html string")
    got = spark.sql("select page_id from {pages} where page_main_fields(html)['year'] = '1951'", pages=pages).collect()
    assert [r.page_id for r in got] == [1]
    assert spark.sql("select size(page_nodes(html)) n from {pages} where page_id > 1", pages=pages).collect() == [(0,), (0,)]
    assert set(functions) >= {"page_nodes", "page_tables", "page_links", "page_parts"}
    # again, for another kind of content
    sqlfunctions.register_functions(spark, "games")
