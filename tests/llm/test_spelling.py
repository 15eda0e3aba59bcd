"""Spelling variants against plain Python."""

import collections
import re
import zlib

import numpy as np
import pytest

from pagequarry.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def counts_by_hand(rows):
    c = collections.Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(counts):
    words = sorted(counts)
    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(around[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(around[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


def found(docs, **options):
    return sorted(map(tuple, spelling.spelling_variants(docs, **options).collect()), key=str)


def test_counts_of_a_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    assert got == counts_by_hand([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(docs) == by_hand(counts_by_hand([tuple(r) for r in docs.select("doc_id", "text").collect()]))


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(11)
    base = ["straße", "straßen", "naïveté", "aaaaaa", "aaaaaaa", "ababab", "bababa", "prefix" * 3, "z" * 3000]
    words = list(base)
    for _ in range(400):
        w = list(base[rng.integers(len(base) - 1)])
        at, letter = int(rng.integers(len(w))), "abcdefé"[rng.integers(7)]
        words.append("".join([*w[:at], letter, *w[at + int(rng.integers(2)) :]]))
    words += ["z" * 2999 + "y", "z" * 2999, "×÷×÷×÷", "×÷×÷×"]
    rows = [(i, " ".join(words[i % len(words) :][:40] * 5) + "\n" + "STRASSE Straße, ſtraße ") for i in range(60)]
    return [*rows, (61, None), (62, ""), (None, "naïveté naïvete " * 7), (63, rows[0][1]), (63, rows[0][1])]


@pytest.mark.parametrize("group, cells", [(256, 1 << 20), (4, 1 << 20), (256, 1 << 12)])
def test_windows_and_tiles_of_any_size(spark, odd, group, cells):
    docs = spark.createDataFrame(odd, "doc_id long, text string").repartition(3)
    assert found(docs, group=group, cells=cells) == by_hand(counts_by_hand(odd))


def test_every_pair_is_found_once(spark):
    """All short words over two letters, with groups cut to the last window."""
    import itertools

    counts = {"".join(w): 5 + i for n in (6, 7) for i, w in enumerate(itertools.product("ab", repeat=n))}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: r.n_near for r in spelling.near_words(words, group=2).collect()}
    assert got == {w: sum(near(w, v) for v in counts) for w in counts}


def test_long_chains_of_forms(spark):
    rows = [(f"w{i}", f"w{i + 1}" if i < 40 else None) for i in range(41)]
    words = spark.createDataFrame(rows, "word string, form string")
    assert {r.root for r in spelling.with_roots(words).collect()} == {"w40"}


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "letter lettre letter " * 30, "x", 2)], "doc_id long, text string, word string, n long")
    assert spelling.spelling_variants(docs.limit(0)).collect() == []
    assert {r.word for r in spelling.spelling_variants(docs).collect()} == {"letter", "lettre"}


def test_hot_half_is_parted(spark):
    """A start that thousands of words share: tiles stay small, as the window is halved until few words share the rest."""
    rng = np.random.default_rng(2)
    words = {"common" + "".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3000)}
    counts = {w: 5 for w in words}
    got = spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), group=64)
    masks = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masks[w[:i] + "*" + w[i + 1 :]].add(w)
    want = collections.Counter()
    for same in masks.values():
        for w in same:
            want[w] += len(same) - 1
    assert {r.word: r.n_near for r in got.collect()} == {w: n for w, n in want.items() if n}
