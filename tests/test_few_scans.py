"""Extraction looks at few nodes of a page, with the results of looking at all."""

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import dom
from pagequarry.functions.dom import Selector, own_texts, select_value, touched
from pagequarry.functions.sql import let
from pagequarry.operators import fields, links, origins, tables

DETAIL = (
    '<h1 class="entry-title"> </h1><h1 class="title">a<b>whole</b></h1><i class="ytps">1951</i><p>out</p>'
    '<div class="entry-content">lead<p>Director: A</p><p><b>Genre</b>: x</p><p>Director: A</p><p>Director: B</p><img src="/p.jpg"></div>'
)
CELLS = (
    "<table><tr><th>Title</th><th>Year</th><th>Title</th><th>Genre</th></tr><tr><td>one <b>two</b></td><td> 1951\n</td><td>last</td><td><br></td></tr>"
    "<tr><td></td><td><i>1960</i></td></tr><tr><td>plain</td><td>1970</td></tr></table>"
)
SELECTORS = [s for chain in fields.FIELD_SELECTORS.values() for s in chain]


def test_selectors_touch_few_nodes(parsed):
    rows = parsed([DETAIL, CELLS, "", None]).select("page_id", F.expr(touched("nodes", SELECTORS)).alias("t"), "nodes").orderBy("page_id").collect()
    assert [[n.tag for n in r.t] for r in rows] == [["h1", "h1", "i", "div", "img"], [], [], []]


def test_matches_among_few_are_those_among_all(parsed):
    chains = [*fields.FIELD_SELECTORS.values(), [Selector(None, class_like="a"), Selector("b", inside=Selector("h1", inside=Selector()), take="deep")], []]
    pages = parsed([DETAIL, CELLS, DETAIL.replace("h1", "h2"), "<div class='entry-content'><img src='a'></div>", "", None])
    for chain in chains:
        few = let(touched("nodes", chain), lambda among: select_value("nodes", chain, among))
        got = pages.select(F.expr(few).alias("few"), F.expr(select_value("nodes", chain)).alias("all")).collect()
        assert all(r.few == r["all"] for r in got)


def test_own_texts_lie_within_their_parents(parsed):
    pages = parsed(["x<p>a<b>c</b>d</p>y<p>e<p>", "<ul><li>a<ul><li>b</li>c</ul>d</li></ul>z", "none", ""])
    of = lambda tag: own_texts("nodes", dom.elements("nodes", tag))
    got = pages.orderBy("page_id").select(F.expr(of("p")).alias("p"), F.expr(of("li")).alias("li")).collect()
    assert [r.p for r in got] == [["a", "d", "e"], [], [], []]
    assert [r.li for r in got] == [[], ["a", "b", "d"], [], []]
    assert "slice(" in of("p")


def test_cells_and_rows(parsed):
    got = parsed([CELLS]).select(F.expr(tables.table_items("nodes")).alias("i")).first().i
    assert [r["values"] for r in got] == [{"title": "last", "year": "1951"}, {"year": "1960"}, {"title": "plain", "year": "1970"}]


def test_the_page_url_is_taken_apart_only_for_a_link(parsed, monkeypatch):
    monkeypatch.setattr(links, "url_parts", lambda u: f"if(raise_error('taken apart') is null, {dom_parts(u)}, NULL)")
    pages = parsed(["<p>no link</p>", "<a>none</a>"])
    assert [r.l for r in pages.select(F.expr(links.link_array("nodes", "url")).alias("l")).collect()] == [[], []]
    with pytest.raises(Exception, match="taken apart"):
        parsed(['<a href="/x">l</a>']).select(F.expr(links.link_array("nodes", "url")).alias("l")).collect()


dom_parts = links.url_parts


def test_paths_go_up_once_for_each_parent(parsed, monkeypatch):
    walks = []
    monkeypatch.setattr(origins, "element_path", lambda nodes, n: walks.append(n) or f"if({n} is null, '', concat('@', {n}.id))")
    rows = origins.field_origins(parsed([CELLS], True), origins.table_origins("nodes")).collect()
    assert len(walks) == 1 and len(rows) == 5
    assert len({r.path.split("/")[0] for r in rows}) == 3 and all(r.path.startswith(f"@{r.row_id}/*[") for r in rows)


@pytest.mark.parametrize("depth", [1, 7, 8, 9, 63, 64, 65, 90])
def test_paths_of_any_depth(parsed, depth):
    page = "t<i></i>" + "<div>" * depth + '<h1 class="title">deep</h1>'
    row = origins.field_origins(parsed([page], True), origins.main_origins("nodes")).first()
    assert row.path == "/*[2]" + "/*[1]" * depth + "/text()[1]"


def test_steps_are_looked_up(parsed):
    """Elements of a path are found by their place; only a text is searched for among its siblings."""
    pages = parsed(["a<p>b<i>c</i>d</p><p><i>e</i><i>f</i>g</p>", None])
    paths = {"/*[2]/*[2]": 9, "/*[2]/text()[1]": 11, "/*[1]/text()[2]": 5, "/text()[1]": 0, "/*[3]": None, "/*[1]/*[9]/*[1]": None, "/*[0]": None, "/*[1]/text()[3]": None}
    for path, want in paths.items():
        followed = let(origins._places("nodes"), lambda places: f"{origins._followed('nodes', places, repr(path))}.id")
        got = [r.n for r in pages.orderBy("page_id").select(F.expr(followed).alias("n")).collect()]
        assert got == [want, None], path


def test_equal_paragraph_texts_are_matched_once(parsed):
    page = parsed([DETAIL], True)
    rows = origins.field_origins(page, origins.paragraph_origins("nodes")).collect()
    assert {(r.field, r.value, r.reading) for r in rows} == {("director", "A", "text"), ("genre", "x", "whole")}
    assert "array_position(" in origins.paragraph_origins("nodes")
