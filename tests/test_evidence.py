"""Blocks by their signs of title, year and director."""

from pyspark.sql import functions as F

from pagequarry.functions.dom import elements
from pagequarry.functions.sql import each
from pagequarry.operators import candidates
from pagequarry.plans.jobs import process_pages
from pagequarry.schema import PAGES

LINKED = '<a href="/x"><img src="/x.jpg"></a>'
WORDS = "some plain words that make the block long enough "


def counts(parsed, blocks, content_type="movies"):
    pages = parsed([f"<main>{b}</main>" for b in blocks])
    of = each(elements("nodes", "div"), lambda b: candidates.block_evidence("nodes", b, content_type))
    return [r.e for r in pages.select("page_id", F.expr(of).alias("e")).orderBy("page_id").collect()]


def test_signs(parsed):
    blocks = {
        "<div><h3>Low Tide</h3></div>": [1], "<div><h3> </h3><img></div>": [0], "<div><h2><i>Low</i></h2> 1951</div>": [2],
        "<div>21000, 19512</div>": [0], "<div>x1951x</div>": [1], "<div>1799</div>": [0], "<div>1800</div>": [1],
        "<div>Director: A</div>": [1], "<div>the director of</div>": [0], "<div>DIRECTED BY - A</div>": [1],
        "<div><b>Director</b>: A<span>19</span><span>51</span></div>": [1], "<div>ဒါရိုက်တာ: A</div>": [1],
        "<div></div>": [0], "<p>none</p>": [], "<div><h1>a</h1><div>1951</div> director: b</div>": [3, 1],
        "<div><script>1951 director:</script></div>": [0],
    }
    assert dict(zip(blocks, counts(parsed, list(blocks)))) == blocks
    assert counts(parsed, ["<div>Developer: A</div>", "<div>Director: A</div>"], "games") == [[1], [0]]


def test_filter_before_ranking(spark, parsed):
    long = f"<div>{LINKED}{WORDS * 4}</div>"
    short = f"<div>{LINKED}<h2>Low Tide</h2>{WORDS}1951</div>"
    pages = parsed([long + short, long, short * 7], keep_html=True)
    found = candidates.candidate_blocks(pages, min_evidence=2).orderBy("page_id", "rank").collect()
    assert [(r.page_id, r["rank"]) for r in found] == [(0, 1), *[(2, i) for i in range(1, 6)]]
    assert all(r.snippet == short for r in found)
    assert candidates.candidate_blocks(pages).where("page_id < 2").count() == 3
    # a page without such a block stays unknown
    raw = spark.createDataFrame([(0, "u", f'<iframe src="/a"></iframe>{long}'), (1, "v", f'<iframe src="/a"></iframe>{long}{short}')], PAGES)
    types = lambda n: {r.page_id: r.page_type for r in process_pages(raw, min_evidence=n).collect()}
    assert types(0) == {0: "detail", 1: "detail"} and types(2) == {0: "unknown", 1: "detail"}
