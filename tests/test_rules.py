"""URL, text, label and page-rule logic against known cases and plain Python."""

import random
from itertools import product
from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from pagequarry.functions.labels import _labels, _patterns, match_field
from pagequarry.functions.text import clean_text, strip
from pagequarry.functions.urls import reject_reason, resolve
from pagequarry.operators.classify import (
    CATALOGUE_RULES, STATS, THRESHOLDS, Rule, catalogue_score, detail_like, page_stats, page_type, rule_results, with_class,
)
from pagequarry.operators.parse import node_rows

NBSP = " "


def column(spark, values, schema, expression):
    """``expression`` over one row per value, in order."""
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r["out"] for r in df.select("i", F.expr(expression).alias("out")).orderBy("i").collect()]


REJECTED = {
    None: "Non-string input",
    " \t": "Empty or None",
    "NONE": "Empty or None",
    "void(0)": "Empty or None",
    "http://shop.test/item/none": "Empty or None",
    "#": "Fragment-only link or base URL",
    "#part-3": "Fragment-only link or base URL",
    "http://shop.test": "Fragment-only link or base URL",
    "https://shop.test/": "Fragment-only link or base URL",
    "http://shop.test/?sort=up": "Fragment-only link or base URL",
    "mailto:desk@shop.test": "Non-crawlable scheme",
    "Tel:0049": "Non-crawlable scheme",
    "JAVASCRIPT:open()": "Non-crawlable scheme",
    "sftp://shop.test/a": "Unsupported or malformed URL format",
    "data:image/gif;base64,R0": "Unsupported or malformed URL format",
    "https:": "Unsupported or malformed URL format",
    "?": "Unsupported or malformed URL format",
    "//shop.test": "Unsupported or malformed URL format",
    "item7.htm": "Unsupported or malformed URL format",
}
VALID = ["https://shop.test/item/7", "HtTpS://shop.test/b", "/item", "./near", "../far", "//cdn.shop.test/a.js", "http://shop.test/find?w=x"]


def test_reject_reasons(spark):
    assert column(spark, [(u,) for u in REJECTED], "u string", reject_reason("u")) == list(REJECTED.values())
    assert column(spark, [(u,) for u in VALID], "u string", reject_reason("u")) == [None] * len(VALID)


def test_resolve_equals_urllib(spark):
    bases = [
        "http://shop.test", "http://shop.test/", "http://shop.test/list", "https://shop.test/list/of/",
        "http://e.org/a/b/c/?x=1&y=2#frag", "https://m.shop.test/de/25#top", "https://e.com/a/b.html?page=2",
    ]
    refs = [
        "http://else.test/w", "http://else.test/w#s", "\t http://else.test/v ", "/root/leaf", "./leaf", "../leaf", "../../x",
        "../../../../x", "x/./y/../z", ".", "..", "./", "../", "a//b", "/a//b", "/a/../b/", "", " ", "#", "#sec", "?q=1", "?q=1#f",
        "//other.org/p", "//other.org", "mailto:a@b.c", "mailto:a@b.c#f", "Tel:1", "JavaScript:a#b", "gopher:/x", "ftp://e.com/x",
        "HTTP://Else.test/X", "HTTP://Else.test/X#y", "None", "a b/c", "ünï/ç", "x?y=/../z", "x;p?q",
    ]
    cases = list(product(bases, refs))
    got = column(spark, cases, "base string, raw string", resolve("base", "raw"))
    expected = [urldefrag(urljoin(base, raw.strip()))[0] for base, raw in cases]
    assert {c: g for c, g, e in zip(cases, got, expected) if g != e} == {}


CLEAN = {
    "Length: 88 min": "88 min",
    "Shelf - Upper left": "Upper left",
    "Shelf – Upper – left": "Upper – left",
    "no mark at all": "no mark at all",
    "\n Length :  88  ": "88",
    f"Length:{NBSP}{NBSP}88": "88",
    f"Shelf{NBSP}–{NBSP}B": "B",
    "": "",
    None: "",
    "a: b: c": "b: c",
    "12-34-56": "34-56",
    "Ends:": "",
    ":starts": "starts",
    "\t tab \n": "tab",
}


def test_clean_text(spark):
    assert column(spark, [(t,) for t in CLEAN], "t string", clean_text("t")) == list(CLEAN.values())


def test_strip_equals_python(spark):
    texts = [" a ", "\t\n a b \r\n", f"{NBSP}x{NBSP}", "　y ", "", "  ", "\x85z\x85", "​w"]
    assert column(spark, [(t,) for t in texts], "t string", strip("t")) == [t.strip() for t in texts]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def plain_match(text, labels):
    """Every label scored in full, best score first, earlier field on a tie."""
    normal = " ".join("".join(c if c.isalnum() or c > "࿿" else " " for c in text.lower()).split())
    tokens = " ".join(sorted(normal.split()))
    best = (None, 0)
    for label in labels:
        longest = max(len(normal), len(label.normal))
        ratio = [100 * (1 - levenshtein(a, b) / longest) for a, b in ((normal, label.normal), (tokens, label.tokens))]
        inside = (90 if len(normal) <= 8 * len(label.normal) else 60) if label.needle in f" {normal} " else 0
        value = int(max(ratio[0], 0.95 * ratio[1], inside) + 0.5)
        if value >= label.threshold and value > best[1]:
            best = (label.field, value)
    return best


@pytest.mark.parametrize("content_type", ["movies", "games"])
def test_match_equals_full_scan(spark, content_type):
    rng = random.Random(7)
    labels = _labels(_patterns(content_type))
    texts = []
    for label in labels:
        word = list(label.normal)
        texts += [label.normal, label.normal.upper() + ": value", "some words before " + label.normal, " ".join(reversed(label.normal.split()))]
        for _ in range(4):
            edited = word[:]
            for _ in range(rng.randint(1, 3)):
                spot = rng.randrange(len(edited))
                edited[spot : spot + 1] = rng.choice([[], ["x"], [edited[spot], "e"]]) or []
                edited = edited or ["q"]
            texts.append("".join(edited))
    texts += ["".join(rng.choices("abcdeirty ", k=rng.randint(1, 60))) for _ in range(60)] + ["-", "title of the director"]
    got = column(spark, [(t,) for t in texts], "t string", match_field("t", content_type))
    differing = {t: ((g["field"], g["score"]), plain_match(t, labels)) for t, g in zip(texts, got) if (g["field"], g["score"]) != plain_match(t, labels)}
    assert differing == {}


STAT_PAGES = [
    ("<a name=x><img><img alt='>'><iframe>w</iframe><p><p><table><tbody><tr><tr></tbody></table>", (1, 2, 1, 2, 1, 2)),
    ("<main> only text </main>", (0, 0, 0, 0, 0, 0)),
    ("", (0, 0, 0, 0, 0, 0)),
    # what follows a broken end tag up to the next bracket is part of it
    ("<a href=/1>open<p>one</p <table><tr><td>in</td></tr></table><img>", (1, 1, 0, 1, 0, 0)),
    ("<table><tr><td>1<tr><td>2</table><table><tbody><tr><td>3</table>", (0, 0, 0, 0, 2, 1)),
    ("<!-- <a> --><script>'<a><p>'</script><style><p></style><p>x<p>y", (0, 0, 0, 2, 0, 0)),
    ("<p>a</p><img title='no end></p></main>", (0, 1, 0, 1, 0, 0)),
    ("text <b>bold < 3 > 2</b> <p>cut <a hre", (0, 0, 0, 1, 0, 0)),
]


def test_page_stats(parsed):
    rows = page_stats(parsed([h for h, _ in STAT_PAGES])).orderBy("page_id").collect()
    assert [tuple(r[s] for s in STATS) for r in rows] == [e for _, e in STAT_PAGES]


def test_tree_recovery(parsed):
    html = "<ul><li>a<li>b <b>c</ul>d<table><tr><td>1<td>2<tr><td>3</table><p>e<div>f</p></div></span>g<br/>&amp;&lt;"
    rows = {r["id"]: r for r in node_rows(parsed([html])).collect()}

    def path(r):
        return (path(rows[r["parent"]]) if r["parent"] >= 0 else "") + "/" + r["tag"]

    got = [(path(r).removesuffix("/#text"), r["text"]) for r in rows.values() if r["text"] is not None]
    assert got == [
        ("/ul/li", "a"), ("/ul/li", "b "), ("/ul/li/b", "c"), ("", "d"), ("/table/tr/td", "1"), ("/table/tr/td", "2"),
        ("/table/tr/td", "3"), ("/p", "e"), ("/div", "f"), ("", "g"), ("", "&<"),
    ]
    for r in rows.values():
        below = [n["id"] for n in rows.values() if path_has(rows, n, r["id"])]
        assert below == list(range(r["id"] + 1, r["last"] + 1))


def path_has(rows, node, ancestor):
    while node["parent"] >= 0:
        if node["parent"] == ancestor:
            return True
        node = rows[node["parent"]]
    return False


def stat_rows(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{s} long" for s in STATS))
    return df, {s: F.col(s) for s in STATS}


def test_rule_boundaries(spark):
    rows = [
        (51, 0, 0, 0, 0, 0), (50, 0, 0, 0, 0, 0), (51, 0, 1, 0, 0, 0), (31, 5, 0, 0, 0, 0), (31, 6, 0, 0, 0, 0), (30, 0, 0, 0, 0, 0),
        (0, 5, 0, 51, 0, 0), (0, 6, 0, 51, 0, 0), (0, 0, 0, 50, 0, 0), (0, 0, 0, 0, 1, 3), (0, 0, 0, 0, 1, 2), (0, 0, 0, 0, 0, 9),
        (29, 0, 1, 51, 1, 3), (None, 0, 0, 51, 0, 0),
    ]
    df, stats = stat_rows(spark, rows)
    found = df.select("i", rule_results(stats).alias("r"), detail_like(stats).alias("d")).orderBy("i").collect()
    passed = [[x["name"][:4] for x in r["r"] if x["passed"]] for r in found]
    assert passed == [
        ["link", "fall"], ["fall"], ["fall"], ["fall"], [], [], ["text"], [], [], ["tabl"], [], [], ["text", "tabl"], ["text"]
    ]
    assert all(len(r["r"]) == len(CATALOGUE_RULES) for r in found)
    assert [r["d"] for r in found][:3] == [True, True, True] and found[12]["d"] is False


def test_scores_and_types(spark):
    def rule(passed):
        return lambda s, t: F.lit(passed)

    def broken(s, t):
        raise ValueError("rule error")

    df, stats = stat_rows(spark, [(0, 0, 1, 0, 0, 0)])
    cases = [
        ([Rule("a", rule(True), 1), Rule("b", rule(True), 2), Rule("c", rule(True), 3)], (6, 100.0, True)),
        ([Rule("a", rule(True), 1), Rule("b", rule(False), 2), Rule("c", rule(True), 3)], (4, 400 / 6, True)),
        ([Rule("a", rule(True), 3), Rule("b", rule(False), 3)], (3, 50.0, False)),
        ([Rule("a", rule(False), 1), Rule("b", broken, 2)], (0, 0.0, False)),
        ([Rule("a", lambda s, t: s["links"] > t["missing"], 1), Rule("b", rule(None), 1)], (0, 0.0, False)),
    ]
    for rules, expected in cases:
        results = rule_results(stats, rules)
        methods = ("sum", "weighted_average", "strict_majority")
        row = df.select(*[catalogue_score(results, m).alias(m) for m in methods], catalogue_score(results, "other").alias("o")).first()
        assert (row["sum"], pytest.approx(row["weighted_average"]), row["strict_majority"]) == expected and row["o"] == expected[0]
    kinds = df.select(page_type(stats, F.lit(4)).alias("a"), page_type(stats, F.lit(3)).alias("b"), page_type(stats, F.lit(9), mode="intended").alias("c")).first()
    assert tuple(kinds) == ("catalogue", "unknown", "detail")
    with pytest.raises(ValueError):
        page_type(stats, F.lit(1), mode="other")


def test_rule_from_pandas_udf(parsed):
    import pandas as pd

    @F.pandas_udf("boolean")
    def few(links: pd.Series) -> pd.Series:
        return links < 2

    rows = with_class(parsed(["<a>1</a>", "<a>1</a><a>2</a>"]), [Rule("few", lambda s, t: few(s["links"]), 7)], THRESHOLDS)
    assert [r["score"] for r in rows.orderBy("page_id").collect()] == [7, 0]


@pytest.mark.parametrize("piece", ["<a ", "<font>", "<i>x</b>", "<a '>", "<a \"' >", "</u>", "<p><b>", "<", "&lt;<b x='"])
def test_parser_is_linear(piece):
    import time

    from pagequarry.operators.parse import _add_page, _Columns

    start = time.perf_counter()
    _add_page(piece * (1_000_000 // len(piece)), _Columns())
    assert time.perf_counter() - start < 5
