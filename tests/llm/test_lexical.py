"""Ranked lexical search against plain Python."""

import collections
import math
import re

import pytest

from pagequarry.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [w.translate(FOLD) for w in TERM.findall(text or "")]


def by_hand(docs, items, top=10):
    held = [(d, collections.Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(w for _, c in held for w in c)
    want = []
    for item, text in set(items):
        scores = []
        for doc, c in held:
            m = 25 + (75 * sum(c.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m))
                for w in terms(text)
                if w in c
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        want += [(item, n + 1, None if none else d, -s) for n, (s, none, d) in enumerate(sorted(scores)[:top])]
    return sorted(want, key=str)


def found(spark, docs, items, **options):
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, lexical.ranked_documents(left.repartition(3), right, **options).collect()), key=str)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = sorted(map(tuple, lexical.ranked_documents(docs, items).collect()), key=str)
    plain = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got == by_hand(plain, [tuple(r) for r in items.select("item_id", "text").collect()])


ODD = [
    (1, "Alpha beta, GAMMA-delta 12"), (2, "alpha alpha Älpha älpha"), (3, None), (4, ""), (5, " .,;\x00\x1f "), (6, "beta beta beta"),
    (7, "alpha beta"), (8, "alpha beta"), (8, "alpha beta"), (None, "alpha beta"), (9, "日本 alpha beta"), (10, "x " * 50_000 + "beta"),
]


@pytest.mark.parametrize("top", [1, 3, 10])
def test_ties_nulls_repeated_rows_and_long_texts(spark, top):
    items = [(1, "alpha BETA alpha"), (2, None), (3, "..."), (4, "nothing here"), (5, "x 日本 Älpha"), (1, "alpha BETA alpha"), (1, "delta")]
    want = by_hand(ODD, [(i, t) for i, t in items], top)
    assert found(spark, ODD, items, top=top) == want
    assert found(spark, ODD, items, top=top, at_once=1) == want


def test_empty_tables_and_clashing_columns(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, ODD, []) == []
    docs = spark.createDataFrame([(1, "a b", 2, "c", 3)], "doc_id long, text string, n long, query string, score long")
    items = spark.createDataFrame([(1, "a", 5, 6)], "item_id long, text string, rank int, doc_id long")
    # a term of the only document has weight floor(1000 ln(4 / 3))
    assert [tuple(r)[:3] for r in lexical.ranked_documents(docs, items).collect()] == [(1, 1, 1)]


def test_blocks_are_skipped_and_none_is_missed(spark, monkeypatch):
    """Many blocks a list, high thresholds: most blocks are ruled out by their summaries, and the answer is whole."""
    import numpy as np

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[: 20 + 40 * (i % 2)], 12))) for i in range(600)]
    number = {w.encode(): i for i, w in enumerate(words)}
    df = collections.Counter(w for _, t in rows for w in set(t.split()))
    weights = np.array([lexical.weight(600, df[w]) for w in words])
    texts = [" ".join(rng.choice(words, 6)).encode() for _ in range(5)]
    queries = lexical.Queries(texts, number, weights)
    vectors = []
    for _, t in rows:
        c = collections.Counter(number[w.encode()] for w in t.split())
        cols = np.array(sorted(c))
        vectors.append((cols, lexical.values(np.array([c[k] for k in cols.tolist()]), 12, 600, 7200)))
    shard = lexical.Shard([i for i, _ in rows], vectors, 60)
    looked = []
    inner = lexical.Shard.visit

    def visit(self, column, live, queries, best, bar, scored, top):
        inner(self, column, live, queries, best, bar, scored, top)
        looked.append(int(scored.sum()))

    monkeypatch.setattr(lexical.Shard, "visit", visit)
    got = shard.search(queries, np.zeros(5, np.int64), 3)
    for q, own in enumerate(got):
        dense = np.zeros(60, np.int64)
        dense[queries.columns[q]] = queries.weights[q]
        scores = shard.cells @ dense
        order = sorted(range(600), key=lambda i: (-scores[i], i))[:3]
        assert [(int(scores[i]), i) for i in order] == sorted(own, key=lambda x: (-x[0], x[1]))[:3]
    asked = sum(int((shard.cells[:, queries.columns[q]].max(axis=1) > 0).sum()) for q in range(5))
    assert looked[-1] < 0.6 * asked


def test_summaries_bound_every_document_of_their_block():
    import numpy as np

    rng = np.random.default_rng(5)
    cells = rng.integers(0, 1000, (300, 20)) * (rng.random((300, 20)) < 0.4)
    shard = lexical.Shard(list(range(300)), [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in cells], 20)
    for column in range(20):
        rows, starts = shard.blocks(column)
        assert sorted(rows.tolist()) == np.flatnonzero(cells[:, column]).tolist()
        assert np.diff(np.append(starts, len(rows))).max() <= lexical.BLOCK
