"""Paths of values: known pages, equality with the extractors, reading again."""

from pyspark.sql import functions as F

from pagequarry.operators import fields, origins, tables

PAGES = [
    '<h1 class="entry-title"> </h1>x<h1 class="title">a<b>whole</b></h1><span class="my-year">Year: 1951</span>',
    '<div><div class="movie-title"><i></i><b>in the third</b></div><iframe></iframe><iframe src="http://x.test/v"></iframe></div>',
    '<div class="entry-content">lead<!-- c --><p>Director: A. Wren</p><p><b>Genre</b>: <i>noir</i></p><p>Director: second</p><img src="/p.jpg"></div>',
    "<table><tr><th>Title</th><th>Year</th><th>Title</th></tr><tr><td>one <b>two</b></td><td>1951</td><td>last</td></tr>"
    "<tr><td></td><td>1960</td></tr></table><table><tr><td>x</td></tr></table>",
    "", "no markup", "<p>&amp;", None, "<div>" * 90 + '<h1 class="title">deep</h1>' + "<table><tr><th>Title</th></tr><tr><td>low</td></tr></table>",
]


def all_rows(pages, **options):
    return origins.field_origins(
        pages, origins.main_origins("nodes", **options), origins.paragraph_origins("nodes"), origins.table_origins("nodes")
    )


def test_known_paths(parsed):
    got = {(r.page_id, r.extractor, r.field, r.row_id): (r.value, r.reading, r.path) for r in all_rows(parsed(PAGES, True)).collect()}
    assert got[0, "main", "title", None] == ("a", "text", "/*[2]/text()[1]")
    assert got[0, "main", "year", None] == ("1951", "text", "/*[3]/text()[1]")
    assert got[1, "main", "title", None] == ("in the third", "whole", "/*[1]/*[1]")
    assert got[1, "main", "streaming_link", None] == ("//x.test/v", "attribute", "/*[1]/*[3]/@src")
    assert got[2, "paragraph", "director", None] == ("A. Wren", "text", "/*[1]/*[1]/text()[1]")
    assert got[2, "paragraph", "genre", None][1:] == ("whole", "/*[1]/*[2]")
    assert got[2, "main", "poster_url", None][2] == "/*[1]/*[4]/@src"
    cells = sorted((f, v) for (p, e, f, _), v in got.items() if p == 3)
    assert cells == [
        ("title", ("last", "cell", "/*[1]/*[2]/*[3]")), ("year", ("1951", "cell", "/*[1]/*[2]/*[2]")), ("year", ("1960", "cell", "/*[1]/*[3]/*[2]")),
    ]
    assert got[8, "main", "title", None][2] == "/*[1]" * 91 + "/text()[1]"
    assert {k[0] for k in got} == {0, 1, 2, 3, 8}


def test_values_are_those_of_the_extractors(parsed):
    pages = parsed(PAGES, True)
    for clean in (True, False):
        mains = pages.select("page_id", F.explode(F.expr(fields.main_fields("nodes", clean_urls=clean))))
        paragraphs = pages.select("page_id", F.explode(F.expr(fields.paragraph_fields("nodes"))))
        cells = pages.select("page_id", F.inline(F.expr(tables.table_items("nodes")))).select("page_id", "row_id", F.explode("values"))
        want = [("main", *r[:1], None, *r[1:]) for r in mains.collect()] + [("paragraph", *r[:1], None, *r[1:]) for r in paragraphs.collect()]
        want += [("table", *r) for r in cells.collect()]
        rows = all_rows(pages, clean_urls=clean)
        got = [(r.extractor, r.page_id, r.row_id, r.field, r.value) for r in rows.collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
        numbers = pages.select("page_id", F.explode(F.expr(fields.main_selectors("nodes")))).collect()
        main = {(r.page_id, r.field): r.selector for r in rows.where("extractor = 'main'").collect()}
        assert main == {(r[0], r[1]): r[2] for r in numbers if (r[0], r[1]) in main}
        again = origins.values_at(rows, pages, clean_urls=clean).collect()
        assert len(again) == len(got) and all(r.again == r.value for r in again)


def test_changed_pages_are_noticed(parsed):
    rows = all_rows(parsed(PAGES, True))
    other = parsed([p and p.replace("1951", "1952").replace("<i></i>", "<i>not </i>") for p in PAGES[:4]])
    moved = {(r.page_id, r.field, r.again) for r in origins.values_at(rows, other).collect() if r.again != r.value and r.again is not None}
    assert moved == {(0, "year", "1952"), (1, "title", "not in the third"), (3, "year", "1952")}
    assert {r.again for r in origins.values_at(rows.where("page_id = 8"), other).collect()} == {None}
    assert origins.values_at(rows.limit(0), other).collect() == []
