"""NULLs, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import numpy as np
import pytest
from by_hand import components_by_hand, pieces_by_hand

from pagequarry.llm import bpe, chat, jaccard, langid, packing, quality, substrings, topk, toxicity, urlrules

tokenizers = pytest.importorskip("public_tokenizers")
WORDS = tokenizers.path("word_bpe_49k.json")
RANKS = tokenizers.path("byte_bpe_50k.tiktoken")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def base_rows():
    passage = " ".join(f"p{i}" for i in range(30))
    return [
        (1, "one two three four five six seven eight nine ten eleven twelve " + passage, "en", "a", 1),
        (2, passage + " tail of another text with a few more words", "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \t\n\x0b\x0c\r ", "en", "a", 6),
        (6, LONG, "en", "b", len(LONG)),
        (6, LONG, "en", "b", len(LONG)),
        (7, "1234 5678 !!", None, "b", 12),
        (8, "Ünïcödé wörds \u2028 and\u00a0more 日本語", "de", "c", 1),
        (None, "a text without an id but with words", "en", "c", 1),
        (9, "same words here", "en", "c", 1),
        (10, "SAME words  here", "en", "c", 1),
    ]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(base_rows(), SCHEMA)


@pytest.fixture
def clashing(docs):
    """Extra columns named like those the operators make."""
    extra = docs
    for name in ("n_words", "kept", "start", "place", "node", "root", "shingle", "h1", "mark", "starts", "__row", "rank", "score", "words"):
        extra = extra.withColumn(name, docs["n_chars"])
    return extra


OPERATORS = {
    "quality": quality.quality_counts,
    "language": langid.identify,
    "packing": lambda d: packing.pack_documents(d, WORDS),
    "bpe": lambda d: bpe.encode_documents(d, RANKS, tokenizers.PATTERN),
    "repeats": substrings.removed_words,
    "jaccard": jaccard.component_ids,
}
STAGES = {
    "quality": quality.keep_good,
    "language": langid.keep_identified,
    "jaccard": lambda d: jaccard.one_of_each(d, size=5, percent=80),
    "repeats": substrings.without_repeats,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, docs, name):
    assert OPERATORS[name](docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_change_nothing(docs, clashing, name):
    drop = {"sequence_id", "offset", "start", "length", "ids_crc32"} if name == "packing" else {"rejected_by"}

    def rows(df):
        out = OPERATORS[name](df)
        return sorted(map(str, out.select([c for c in out.columns if c not in drop]).collect()))

    if name == "packing":  # pieces depend on partitions; tokens do not
        rows = lambda df: sorted(
            (str(r.doc_id), r.n) for r in OPERATORS[name](df).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()
        )
    assert rows(docs) == rows(clashing)


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_the_columns(clashing, name):
    kept = STAGES[name](clashing)
    assert kept.columns == clashing.columns
    kept.collect()
    assert STAGES[name](clashing.limit(0)).collect() == []


def test_quality_counts(spark):
    repeated = "a b c d e f g h " * 3
    rows = [
        (1, repeated + "x y z " * 4),
        (2, "short"),
        (3, None),
        (4, "line one is here\nline one is here\n\nother # line $ %\nline one is here"),
        (5, "alpha \x1c beta\u00a0gamma"),
    ]
    got = {r.doc_id: r for r in quality.quality_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[3][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [0] * 5
    assert got[3].base_failed and not got[3].kept
    assert got[4].n_dup_lines == 2 and got[4].n_symbols == 3
    assert got[5].n_words == 3 and got[5].word_chars == 16
    assert got[1].n_words == 36 and got[1].n_repeat_words == 24 + 12 and got[1].base_failed


def test_quality_order_does_not_change_the_verdict(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def kept(rules):
        table = quality.measure(docs.select("doc_id", "text")).withColumn("why", quality.cascade(rules))
        return {(r.doc_id, r.why is None) for r in table.select("doc_id", "why").collect()}

    assert kept(quality.RULES) == kept(quality.RULES[::-1])


def test_quality_plan_is_native(docs):
    plan = quality.quality_counts(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_language_without_letters_or_training(spark, docs):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    for key in (3, 4, 5, 7):
        assert (got[key].lang_pred, got[key].score, got[key].rejected) == ("und", 0.0, True)
    bare = docs.withColumn("lang", docs["source"].substr(0, 0)).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in langid.identify(bare).collect()} == {"und"}


TRICKY = [
    "Don't STOP; it's we're I'll 'tis", "naïve café ÅNGSTRÖM ǅ", "e\u0301 combining \u0301start", "İstanbul ΣΑΣ ς", "a\u00a0b\u2003c",
    "x1y22z333", "...!!! ?? (a) [b] {c}", "<|endoftext|> <|startoftext|>", "日本語 한국어 ไทย", "\x1c\x1d weird \x85 breaks", "🎉🎉 ok👍🏽", "ß ﬁ Ⅷ ½",
]


def test_packing_ids_and_windows(spark):
    rows = [(i, t) for i, t in enumerate([*TRICKY, None, "", LONG])]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), WORDS, group=2).collect()
    pieces_by_hand(rows, got)
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append(r)
    short = 0
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 2048
        short += at < 2048
    assert short <= 1


@pytest.mark.parametrize("open_windows", [1, 3])
def test_packer_keeps_every_id(open_windows):
    rng = np.random.default_rng(3)
    packer = packing.Packer(16, open_windows, 0)
    total = 0
    for doc in range(200):
        n = int(rng.integers(1, 50))
        packer.add((doc, 0, n, np.arange(n, dtype="<u4").tobytes()))
        total += n
        assert len(packer.open) <= open_windows
    packer.close(None)
    used = {}
    for row in packer.out:
        used[row[5]] = used.get(row[5], 0) + row[2]
    assert sum(used.values()) == total and max(used.values()) <= 16
    assert sum(v < 16 for v in used.values()) <= 1


def test_bpe_equals_the_merges(spark):
    import base64

    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tool = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(1)
    odd = ["".join(chr(c) for c in rng.integers(97, 103, 400)), "a" * 3000, " " * 700 + "x", "\u00e9" * 999, "=-=-" * 300]
    rows = [(i, t) for i, t in enumerate([*TRICKY, *odd, None, "", LONG])]
    got = {r.doc_id: r for r in bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, tokenizers.PATTERN, ids=True).collect()}
    for key, text in rows:
        ids = np.array(tool.encode_ordinary(text or ""), "<u4").tobytes()
        assert bytes(got[key].ids) == ids
        assert got[key].n_tokens == len(ids) // 4 and got[key].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert got[key].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def vector_rows():
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 1 + (i % 7), 6)]) for i in range(0, 260)]
    rows += [(300 + i, rows[20][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, [])]
    return [*rows, (420, [0.0] * 6), (440, [1.0, 2.0]), (None, [1.0] * 6), rows[3]]


def test_top_products(spark, monkeypatch):
    rows = vector_rows()
    monkeypatch.setattr(topk, "BUCKET_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("norm", topk.F.lit(1))
    got = sorted(tuple(r) for r in topk.top_products(df, k=5).collect())
    ok = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in ok if i % 20 == 0):
        best = sorted(((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_products(df.limit(0)).collect() == []


def test_toxicity_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, none).collect()
    assert len(got) == 12 and all(0 <= r.score < 0.5 and r.predicted == 0 for r in got)
    one = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(toxicity.score_documents(docs, one).collect()) == 12
    assert toxicity.score_documents(docs.limit(0), one).collect() == []


def test_toxicity_held_out(spark, tmp_path):
    rng = np.random.default_rng(2)
    plain, bad = [f"word{i}" for i in range(300)], ["grumk", "snarfle", "blorp"]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(plain, 40))
        if i % 4 == 0:
            words[int(rng.integers(0, 40))] = bad[i % 3]
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("held_out").collect()
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in got)
    assert right >= 0.95 * len(got)


def test_url_rules(spark):
    urls = [
        "https://WWW.Example.com/en/1", "http://example.com/en/x?q", "http://a.b.example.com/en/", "http://example.com", "http://example.com/",
        "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "http://net.org/fr/", "no scheme", None, "", "://", "x://com/a",
        "http://example.com/EN/", "http://www.example.com./en/", "a://b://c/d",
    ]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", topk.F.lit("x"))
    got = urlrules.judge_urls(pages, urlrules.rules_frame(spark), ranges=4).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: (r.rule, r.verdict) for r in got}
    assert by_id[0] == ("www.example.com/en/", "allow") and by_id[1] == ("example.com/en/", "block")
    assert by_id[2] == ("example.com/en/", "block") and by_id[3] == (None, "allow") and by_id[4] == ("com/", "allow")
    assert by_id[5] == ("com/", "allow") and by_id[6] == ("net/es/", "block") and by_id[7] == ("net/fr/", "block")
    assert by_id[8] == by_id[9] == by_id[10] == by_id[11] == by_id[12] == (None, "allow")
    assert by_id[13] == ("com/", "allow") and by_id[14] == ("com/", "allow") and by_id[15] == (None, "allow")
    assert urlrules.judge_urls(pages.limit(0), urlrules.rules_frame(spark)).collect() == []


def test_url_rules_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "com", "b.com", "x.org", "org"]
    paths = ["/", "/a", "/a/", "/a/b", "/b/", ""]
    rules = sorted({(h, p) for h, p in zip(rng.choice(hosts, 25), rng.choice(paths, 25), strict=True)})
    rules = [("block" if i % 2 else "allow", h, p) for i, (h, p) in enumerate(rules)]
    rows = [(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'q', '/z'])}") for i in range(400)]
    got = urlrules.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), urlrules.rules_frame(spark, rules), ranges=6).collect()
    for r in got:
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == (max(fits)[1:] if fits else (None, "allow"))


def test_removed_words(spark, docs):
    got = substrings.removed_words(docs).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[2][0].n_removed == 30 and [tuple(s) for s in by_id[2][0].repeats] == [(0, 30)]
    assert by_id[1][0].n_removed == 0 and by_id[3][0].n_words == 0
    # a row repeated whole is one document
    assert len(by_id[6]) == 2 and by_id[6][0] == by_id[6][1] and by_id[6][0].n_removed == 0


def test_removed_words_by_hand(spark):
    rng = np.random.default_rng(6)
    parts = [[f"s{k}w{i}" for i in range(int(rng.integers(15, 40)))] for k in range(8)]
    rows = []
    for doc in range(60):
        words = []
        for _ in range(4):
            words += parts[int(rng.integers(0, 8))] if rng.random() < 0.6 else [f"d{doc}n{rng.integers(0, 9)}" for _ in range(9)]
        rows.append((doc, " ".join(words)))
    rows.append((99, "again and again " * 30))
    got = {r.doc_id: r for r in substrings.removed_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = set()
    for doc, text in rows:
        words = text.split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        assert got[doc].n_removed == sum(gone) and got[doc].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_chat_fold(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 0, "delta", "assistant", "Hel"), (1, 1, 1, "delta", "assistant", "lo"),
        (1, 1, 2, "regenerate", "assistant", None), (1, 1, 3, "delta", "assistant", "Good "), (1, 1, 4, "delta", "assistant", "day"),
        (1, 0, 9, "edit", "user", "hello"), (1, 2, 0, "message", "user", "bye"), (1, 2, 1, "retract", "user", None),
        (1, 3, 0, "message", "user", "a"), (1, 3, 0, "message", "user", "a"),
        (None, 0, 0, "message", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, seq long, op string, role string, text string")
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in chat.fold_events(events).collect()}
    assert got[1] == [("user", "hello"), ("assistant", "Good day"), ("user", "a"), ("user", "a")]
    assert got[None] == [("", "")]


def test_chat_round_trip(spark):
    nasty = ["\\", "\\\\l", "</turn>\n### user: x", "### ", ": ", "\\b\\h\\l\\c", "#<:\\", "", None, "\n\n", "\u2028é🎉"]
    rows = [(c, t, r, nasty[(c + t) % len(nasty)]) for c in range(11) for t, r in enumerate(["user", "assistant", "a: b#<\\", None])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("e", topk.F.lit(1))
    back = chat.read_back(chat.render(chat.fold_events(chat.events_of(df)))).collect()
    for r in back:
        assert [(t.role, t.text) for t in r.turns] == [(role or "", text or "") for c, _, role, text in rows if c == r.conv_id]
    got = {r.conv_id: r for r in chat.format_conversations(chat.with_control_strings(spark, df)).collect()}
    loss = "\\### Assistant: </turn> ok"
    assert got[-7].loss_chars == len(loss) and got[-7].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert [r.conv_id for r in chat.format_conversations(df.limit(0)).collect()] == []


def test_chat_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.format_conversations(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (1, 85)])
def test_jaccard_by_hand(spark, size, percent):
    rng = np.random.default_rng(size)
    rows = []
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(int(rng.integers(3, 90)))]
        for _ in range(int(rng.integers(1, 14))):
            words = list(base)
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(0, len(words)))] = f"x{rng.integers(0, 50)}"
            rows.append((int(rng.integers(0, 10**6)), " ".join(words)))
    rows += [(-1, "The Same SET"), (-2, "the same set"), (-3, ""), (-4, None)]
    got = jaccard.component_ids(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent).collect()
    assert sorted(tuple(r) for r in got) == sorted(components_by_hand(rows, size, percent)[:-2] + [(-3, 0, -3), (-4, 0, -4)])


def test_jaccard_edges(spark, docs):
    got = {}
    for r in jaccard.component_ids(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert got[3] == [(0, 3)] and got[5] == [(0, 5)] and got[9] == got[10] == [(1, 9)]
    assert got[6][0] == got[6][1] and got[6][0][1] == 6 and got[None] == [(5, None)]


def test_one_of_each_group(docs):
    kept = sorted(str(r.doc_id) for r in jaccard.one_of_each(docs).collect())
    assert kept == sorted(["1", "2", "3", "4", "5", "6", "7", "8", "None", "9"])
