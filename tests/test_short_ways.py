"""Ordinary attributes, links and paragraphs take a short way, with the results of the long one."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagequarry.functions import urls
from pagequarry.functions.dom import has_class
from pagequarry.functions.labels import _Label, match_field
from pagequarry.functions.sql import struct
from pagequarry.operators import fields, parse

CARD = '<div class="card">\n<a href="/x?a=1&amp;b=2">One</a><img SRC="/i.jpg" ></div><p class="">t</p>'


def taken_apart(u: str) -> str:
    return struct(**{part: "cast(raise_error('taken apart') as string)" for part in ("scheme", "host", "path", "query")})


def test_a_lone_attribute_needs_no_search(monkeypatch):
    whole = parse._parse_array(pa.array([CARD]))
    found = [n["attrs"] for n in whole[0][0].as_py() if n["attrs"]]
    assert found == [[("class", "card")], [("href", "/x?a=1&b=2")], [("src", "/i.jpg")], [("class", "")]]
    monkeypatch.setattr(parse, "_attributes", None)
    nodes, errors = parse._parse_array(pa.array([CARD]))
    assert errors.to_pylist() == [None] and nodes.equals(whole[0])


@pytest.mark.parametrize("source", [' a="1"', ' A = "1"', ' a="1" b="2"', ' a="1" A="2"', ' a="&lt;" ', " a='1'", ' a="', ' ="1"', ' a"="1"', '/ a="1"', ' a="1"/', ' "a="1"'])
def test_lone_attributes_are_read_as_all_are(source):
    page = pa.array([f"<b{source}>t</b><i>u</i>"])
    with pytest.MonkeyPatch.context() as patch:
        nodes, _ = parse._parse_array(page)
        patch.setattr(parse, "ONE_ATTRIBUTE", parse.re.compile(r"(?!)"))
        assert nodes.equals(parse._parse_array(page)[0])


@pytest.mark.parametrize("threshold", [0, 1, 2, 55, 70, 99, 100, 101, 130])
def test_lengths_near_a_label(threshold):
    for size in range(1, 30):
        label = _Label("f", 0, threshold, "x" * size, "x" * size, False)
        for n in range(1, 200):
            near = 100 * abs(n - size) <= (101 - threshold) * max(n, size)
            assert (label.shortest <= n <= label.longest) == near


def test_words_in_another_order(spark):
    rows = spark.createDataFrame([("year release",), ("release year",), ("Release Yaer",), ("by directed",), ("zzz",)], "t string")
    got = [tuple(r) for r in rows.selectExpr(f"inline(array({match_field('t')}))").collect()]
    assert got == [("year", 95), ("year", 100), ("year", 83), ("director", 95), (None, 0)]


def test_equal_paragraph_texts_are_matched_once(parsed):
    page = '<div class="entry-content"><p>Director: A</p><p><b>Genre: </b>x</p><p>Director: A</p><p>Director: B</p></div>'
    rows = parsed([page]).select(F.expr(fields.paragraph_fields("nodes")).alias("f"))
    assert rows.first().f == {"director": "A", "genre": "x"}
    assert "array_distinct(" in fields.paragraph_fields("nodes")


def test_a_path_from_the_root_is_not_taken_apart(spark, monkeypatch):
    raws = ["/list/3", "/", "/a/../b", "/a/./", "/..", " /x y\n", "/a//b"]
    rows = spark.createDataFrame([(r,) for r in raws], "raw string")
    base = struct(scheme="'https'", host="'h.example.com'", path="'/p/q'", query="''")
    want = [r.u for r in rows.selectExpr(f"{urls.resolve(repr('https://h.example.com/p/q'), 'raw')} as u").collect()]
    assert want == [f"https://h.example.com{p}" for p in ("/list/3", "/", "/b", "/a/", "/", "/x y", "/a//b")]
    monkeypatch.setattr(urls, "url_parts", taken_apart)
    assert [r.u for r in rows.selectExpr(f"{urls.resolve(repr('https://h.example.com/p/q'), 'raw', base)} as u").collect()] == want


def test_an_ordinary_page_is_not_taken_apart(spark, monkeypatch):
    plain = ["https://h.example.com/list/3", "http://h/a?q=1#f", " https://h/../x "]
    other = {
        "https://h/": urls.BASE_OR_FRAGMENT, "https://h/;p": urls.BASE_OR_FRAGMENT, "https://h/\n?q": urls.BASE_OR_FRAGMENT, "https://h": urls.BASE_OR_FRAGMENT,
        "https://h/none": urls.EMPTY, "https:///x": urls.MALFORMED, "HTTPS://h/x": None, "https://h//x": None, "ftp://h/x": urls.MALFORMED,
    }
    got = spark.createDataFrame([(u,) for u in [*plain, *other]], "u string").selectExpr("u", f"{urls.reject_reason('u')} as r").collect()
    assert {r.u: r.r for r in got} == {**dict.fromkeys(plain), **other}
    monkeypatch.setattr(urls, "url_parts", taken_apart)
    rows = spark.createDataFrame([(u,) for u in plain], "u string")
    assert [r.r for r in rows.selectExpr(f"{urls.reject_reason('u')} as r").collect()] == [None] * 3


def test_classes_are_whole_words(spark):
    rnd = random.Random(2)
    classes = [None, "", "card", "movie-card", "card movie-card", "\tcard\n", "cards x", *(" ".join(rnd.choices(["card", "cards", "a"], k=3)) for _ in range(20))]
    rows = spark.createDataFrame([(c,) for c in classes], "c string").selectExpr("c", "named_struct('attrs', map('class', c)) as n")
    assert all(r.ok == ("card" in (r.c or "").split()) for r in rows.selectExpr("c", f"{has_class('n', 'card')} as ok").collect())
    assert has_class("n", "card").index("contains") < has_class("n", "card").index("split")
