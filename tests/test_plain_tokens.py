"""Ordinary markup is read a whole element at a time, and gives the nodes that reading it token by token gives."""

import random
import re

import pyarrow as pa

from pagequarry.operators import parse

LISTING = (
    '<html><body><iframe src="/player"></iframe><p>Note 1</p><p>Note &amp; 2</p><table><tbody><tr><td>Row 1</td></tr></tbody></table>'
    '<div class="card"><a href="/list/4">1</a><img src=/c/1.jpg></div><ul><li>One<li><b>Two</b> 2</ul><a class="next">Next</a></body></html>'
)
PIECES = [
    "<p>", "<p class='a>b'>one</p>", "<P>two</p>", "</p>", "<li>x", "<td>", "</td>", "<b>", "</b>", "<i></i>", "<br>", "<br/>t</br>", "<p/>u</p>",
    "<a href=/x/>v</a>", '<a href="/x"/>', "<a b='", '<a "c>', "<div a=1 A=2>", "</div >", "</", "<", "a < b &lt; c", "<!-- <p>d</p> -->", "<!-->",
    "<script>if (a<b) {}</script>", "<style>p&amp;</STYLE>", "<a b='" + "z" * 2000 + "'>w</a>", "<a " + "k='1' " * 30 + ">y</a>", "</3>", "<p", "'", '"',
]


def test_ordinary_markup_needs_no_step_by_step_reading(monkeypatch):
    monkeypatch.setattr(parse, "TOKEN", None)
    nodes, errors = parse._parse_array(pa.array([LISTING]))
    assert errors.to_pylist() == [None]
    first = [(n["tag"], n["text"]) for n in nodes[0].as_py()][3:9]
    assert first == [("p", None), ("#text", "Note 1"), ("p", None), ("#text", "Note & 2"), ("table", None), ("tbody", None)]


def test_both_ways_give_the_same_nodes(monkeypatch):
    rnd = random.Random(5)
    pages = pa.array([LISTING, "", None] + ["".join(rnd.choices(PIECES, k=rnd.randint(1, 25))) for _ in range(3000)])
    nodes, errors = parse._parse_array(pages)
    monkeypatch.setattr(parse, "PLAIN", re.compile(r"(?!)"))
    step_by_step, same_errors = parse._parse_array(pages)
    assert nodes.equals(step_by_step) and errors.equals(same_errors)
