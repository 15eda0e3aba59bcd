"""Every stage of the pipeline against plain Python, row by row, over whole tables."""

import random

import pytest
from by_hand import components_by_hand
from plain import quality_by_hand

tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from pagequarry.llm import langid  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)


def clear(docs):
    made = langid.learn(docs.where(~langid.held_out(docs["doc_id"])))
    by_lang = langid.compressors(made.dictionaries, made.level)
    return [tuple(r) for r in docs.collect() if not langid.classify(r.text, by_lang, made.margin)[2]]


def good(rows):
    return [r for r in rows if quality_by_hand(r[1])[-1]]


def first_of_each(rows):
    """The row with the smallest id of each group; texts without words are groups of their own."""
    group = {doc: component for doc, _, component in components_by_hand([(r[0], r[1]) for r in rows], 5, 80)}
    return [r for r in rows if group[r[0]] == r[0]]


def without_repeats(rows, length=20):
    seen, out = set(), []
    for doc, text, *rest in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        if any(gone):
            text = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
            rest[-1] = len(text)
            if not text:
                continue
        out.append((doc, text, *rest))
    return out


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = clear(docs)
    plain = {"quality": good, "near_copies": first_of_each, "repeats": without_repeats}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = plain[name](rows) if name in plain else rows
        got = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(got.collect(), got.schema)
        assert sorted(map(tuple, docs.collect())) == sorted(rows), name
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    want = {r[0]: len(tool.encode(r[1], add_special_tokens=False).ids) + 1 for r in rows}
    held = {}
    for r in STAGES["packing"](spark, docs, sf_dir).collect():
        held[r.doc_id] = held.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == want[r.doc_id]
    assert held == want


def test_whole_run_over_odd_rows(spark, tmp_path):
    """NULLs, empty texts and repeated rows as a whole run; the pieces are those of the rows that the stages keep."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    parts = ["ing", "the", "ou", "er", "sta", "wor", "ble", "re", "an", "ti", "lo", "ve"]

    def text(seed):
        rng = random.Random(seed)
        return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(60)) + "."

    rows = [(i, text(i), "en", "s", 1) for i in range(40)] + [(3, text(3), "en", "s", 1)] * 2
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (None, text(77), "en", "s", 1), (102, "12 34 !!", "de", "s", 8)]
    for name, chosen in (("odd", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(chosen, schema).write.parquet(f"{folder}/documents.parquet")
        pieces = corpus_pipeline.run(spark, folder).collect()
        kept = {r.doc_id for r in pieces}
        assert kept == ({None, *range(40)} if chosen else set())
        starts = [r.start for r in pieces if r.doc_id == 3]
        assert len(starts) == len(set(starts))
