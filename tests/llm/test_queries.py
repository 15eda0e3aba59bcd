"""Registered queries of the text operators against plain Python over the whole tables."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest

tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from pagequarry.llm.queries import QUERIES  # noqa: E402
from pagequarry.llm.sql import ORACLES  # noqa: E402


def run(spark, sf_dir, number):
    return next(f for n, f in QUERIES.items() if n.startswith(f"op{number}_"))(spark, sf_dir).collect()


@pytest.fixture
def texts(spark, sf_dir):
    return sorted((r.doc_id, r.text or "", r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())


def test_url_filters_sql(spark, sf_dir):
    duckdb.sql(f"create or replace temp view pages as select * from '{sf_dir}/pages.parquet'")
    want = sorted(map(repr, duckdb.sql(ORACLES["op7_url_filters"]).fetchall()))
    assert sorted(repr(tuple(r)) for r in run(spark, sf_dir, 7)) == want


def test_language_held_out(spark, sf_dir, texts):
    truth = {d: lang for d, _, lang in texts}
    held = [r for r in run(spark, sf_dir, 2) if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_packing(spark, sf_dir, texts):
    from by_hand import pieces_by_hand

    rows = run(spark, sf_dir, 3)
    pieces_by_hand([(d, t) for d, t, _ in texts], rows)
    used = collections.Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and sum(n < 2048 for n in used.values()) <= 1


def test_top_products(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    ids = np.array([i for i, _ in rows])
    ints = np.floor(64 * np.array([v for _, v in rows], float)).astype(np.int64)
    scores = ints @ ints.T
    want = []
    for row in np.flatnonzero(ids % 20 == 0):
        order = [j for j in np.lexsort((ids, -scores[row])) if ids[j] != ids[row]][:20]
        want += [(int(ids[row]), n + 1, int(ids[j]), int(scores[row, j])) for n, j in enumerate(order)]
    assert sorted(tuple(r) for r in run(spark, sf_dir, 4)) == sorted(want)


def test_removed_words(spark, sf_dir, texts):
    got = {r.doc_id: r for r in run(spark, sf_dir, 8)}
    seen = set()
    for doc, text, _ in texts:
        words = text.encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        assert (got[doc].n_words, got[doc].n_removed) == (len(words), sum(gone))
        assert got[doc].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_jaccard_components(spark, sf_dir, texts):
    from by_hand import components_by_hand

    want = components_by_hand([(d, t) for d, t, _ in texts], 4, 85)
    assert sorted(tuple(r) for r in run(spark, sf_dir, 10)) == sorted(want)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 3
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in pieces} == kept
