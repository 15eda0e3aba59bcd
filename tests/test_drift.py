"""Degree of drift against a plain comparison of all subtrees."""

import collections

import pytest

from pagequarry.operators import drift

PAGES = {
    "a": "<html><body><div class=x><p>one</p><p>two</p></div><ul><li><a href=/1>1</a></li><li><a href=/2>2</a></li></ul></body></html>",
    "b": "<html><body><div class=y><p>one</p><p>two</p></div><ul><li><a href=/1>1</a></li></ul></body></html>",
    "c": "<html><body><ul><li><a href=/1>1</a></li><li><a href=/2>2</a></li></ul><div class=x><p>else</p><p></p></div></body></html>",
    "text": "only text",
    "deep": "<div>" * 3000 + "x",
    "wide": "<p>x</p>" * 5000,
}


def subtrees(nodes):
    """Every element subtree written out, children in order."""
    below = collections.defaultdict(list)
    out = []
    for n in reversed(nodes):
        if n.tag == "#text":
            continue
        text = f"({n.tag}|{(n.attrs or {}).get('class') or ''}{''.join(reversed(below[n.id]))})"
        below[n.parent].append(text)
        out.append(text)
    return collections.Counter(out)


@pytest.fixture(scope="module")
def rows(spark):
    from pagequarry.operators.parse import parse_pages
    from pagequarry.schema import PAGES as SCHEMA

    table = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(PAGES.items()) if k != "deep"], SCHEMA)
    return {r.url: r.nodes for r in parse_pages(table).collect()}


def prints(parsed, *pages):
    return drift.fingerprints(parsed([("u", PAGES[p]) for p in pages]))


@pytest.mark.parametrize("was", ["a", "b", "c", "text", "wide"])
@pytest.mark.parametrize("now", ["a", "b", "c", "text", "wide"])
def test_degree_of_all_subtrees(parsed, rows, was, now):
    got = drift.drift_degree(prints(parsed, was), prints(parsed, now)).collect()[0]
    a, b = subtrees(rows[was]), subtrees(rows[now])
    shared, held = sum((a & b).values()), sum(a.values()) + sum(b.values())
    assert (got.n_was, got.n_is) == (sum(a.values()), sum(b.values()))
    assert got.n_lost == got.n_was - shared and got.n_added == got.n_is - shared
    assert got.degree == pytest.approx((held - 2 * shared) / held if held else 0)
    assert got.status == ("same" if a == b else "changed") and got.significant == (got.degree > 0.2)


def test_texts_do_not_count_and_small_changes_stay_small(parsed):
    one = [("u", "<div>" + "<p class=a>x</p>" * 60 + "</div>")]
    other = [("u", "<div>" + "<p class=a>y</p>" * 60 + "</div>")]
    more = [("u", "<div>" + "<p class=a>x</p>" * 61 + "</div>")]
    degree = lambda a, b: drift.drift_degree(drift.fingerprints(parsed(a)), drift.fingerprints(parsed(b))).collect()[0]
    assert degree(one, other).status == "same"
    small = degree(one, more)
    assert small.status == "changed" and small.degree < 0.05 and not small.significant


def test_new_gone_repeated_and_unreadable_pages(parsed):
    was = drift.fingerprints(parsed([("gone", PAGES["a"]), ("kept", PAGES["a"]), ("kept", PAGES["a"]), ("bad", None), (None, PAGES["a"])]))
    now = drift.fingerprints(parsed([("new", PAGES["b"]), ("kept", PAGES["a"])]))
    got = {r.url: (r.status, r.degree) for r in drift.drift_degree(was, now).collect()}
    assert got == {"gone": ("gone", 1.0), "new": ("new", 1.0), "kept": ("same", 0.0)}
    assert drift.drift_degree(was.limit(0), now.limit(0)).collect() == []


def test_deep_pages_take_one_pass():
    n = 200_000
    assert len(drift.subtree_hashes(["div"] * n, [None] * n, list(range(-1, n - 1)))) == n
