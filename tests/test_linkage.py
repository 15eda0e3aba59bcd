"""Fuzzy merge against all pairs, planted spellings, hot blocks."""

import itertools

import pytest

from pagequarry.operators import linkage
from pagequarry.sources import rendered

SCHEMA = "item_id long, title string, year string, director string, genre string, trust long"


def pairs_of(key):
    return {f"_{w}_"[i : i + 2] for w in key.split() for i in range(len(w) + 1)}


def by_hand(nodes):
    """Links of ``(node, key, year, director)`` rows from all pairs."""
    out = set()
    for (a, s, y, d), (b, t, z, e) in itertools.combinations(sorted(nodes), 2):
        if abs(y - z) > 1:
            continue
        p, q = pairs_of(s), pairs_of(t)
        points = 10 * (100 * len(p & q) // len(p | q)) - 310 * (y != z)
        points += 0 if d is None or e is None else 50 if d == e else -200
        if points >= 700:
            out.add((a, b, points))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("tile", [128, 3])
def test_links_equal_all_pairs(spark, sf_dir, tile):
    both = rendered.sourced_items(spark, sf_dir).unionByName(rendered.misspelt_items(spark, sf_dir))
    nodes = linkage.title_nodes(both).cache()
    want = by_hand([(r.node, r.title_key, r.year, r.b_director and r.b_director.value) for r in nodes.collect()])
    got = [tuple(r) for r in linkage.links(linkage.blocks(nodes), tile).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_misspelt_titles_are_found(spark, sf_dir):
    """At least nine in ten of the second source's records meet the part that they misspell."""
    sourced, wrong = rendered.sourced_items(spark, sf_dir), rendered.misspelt_items(spark, sf_dir)
    nodes = linkage.title_nodes(sourced.unionByName(wrong)).cache()
    keys = {(r.title_key, r.year): r.node for r in nodes.collect()}
    groups = {r.node: r.cluster for r in linkage.clusters(linkage.links(linkage.blocks(nodes))).collect()}
    film = lambda r: groups.get(n := keys[(" ".join(r.title.lower().replace(",", " ").split()), int(r.year))], n)
    of = {r.item_id: film(r) for r in sourced.where("title is not null and year is not null").collect()}
    planted = [r for r in wrong.collect() if r.item_id - 1_000_000_000 in of]
    assert planted and sum(film(r) == of[r.item_id - 1_000_000_000] for r in planted) >= 0.9 * len(planted)


def test_conflicts_go_by_trust_and_missing_values_lose(spark):
    rows = [
        (3, "The Long River", "1999", "A. Bee", None, 5),
        (1, "the long  river!", "1999", None, "drama", 1),
        (2, "The Long Rivr", "1999", "A. Bee", "comedy", 9),
        (4, "The Long River", "1985", "A. Bee", "war", 9),
        (5, None, "1999", "x", "x", 1),
        (6, "River", None, "x", "x", 1),
        (7, "River", "soon", "x", "x", 1),
        (8, "...", "1999", "x", "x", 1),
    ]
    got = {tuple(r) for r in linkage.linked_items(frame(spark, rows)).collect()}
    assert got == {(1, "The Long Rivr", "1999", "A. Bee", "comedy", 3, 2), (4, "The Long River", "1985", "A. Bee", "war", 1, 1)}


def test_chains_are_one_film_and_remakes_are_not(spark):
    rows = [(i, "abcdefghijklmnopqrst"[: 20 - i], "2001", None, None, 1) for i in range(10)]
    rows += [(100 + i, "another film", str(1950 + 2 * i), "d", None, 1) for i in range(5)]
    got = {r.item_id: r.n_titles for r in linkage.linked_items(frame(spark, rows)).collect()}
    assert got == {0: 10, **{100 + i: 1 for i in range(5)}}


def test_next_year_needs_the_same_director(spark):
    rows = [(1, "some film", "2000", "d", None, 1), (2, "some film", "2001", "d", None, 1), (3, "some film", "2002", None, None, 1)]
    assert {r.item_id for r in linkage.linked_items(frame(spark, rows)).collect()} == {1, 3}


def test_empty_repeated_and_extra_columns(spark):
    items = frame(spark, [(1, "a film", "2000", "d", "g", None)] * 3).selectExpr("*", "1 as node", "'x' as pairs", "2 as cluster")
    assert linkage.linked_items(items.limit(0)).collect() == []
    assert [tuple(r) for r in linkage.linked_items(items).collect()] == [(1, "a film", "2000", "d", "g", 3, 1)]


def test_one_title_of_very_many_sources_is_one_node(spark):
    items = spark.range(20_000).selectExpr("id as item_id", "'same title' as title", "'2000' as year", "'d' as director", "'g' as genre", "id % 3 as trust")
    assert linkage.title_nodes(items).count() == 1
    assert [tuple(r) for r in linkage.linked_items(items).collect()] == [(0, "same title", "2000", "d", "g", 20_000, 1)]
