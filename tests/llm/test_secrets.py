"""Secret scans against plain Python, and the ledger over several runs."""

import hashlib
import re

import pytest

from pagequarry.llm import secrets
from pagequarry.session import new_dir

KINDS = [
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", lambda m: True),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", lambda m: True),
    ("login", r"://[^/:@ \t\n\r]+:[^/:@ \t\n\r]+@", lambda m: True),
]
KEY, DIGITS = "AKIA" + "ABCDEFGH12345678", "0123456789abcdef01234567"
ODD = [
    "", None, "no secrets here", f"é日本 password = 'hunter22' and {KEY}", f"token: token=abcdef {KEY[:-1]} {DIGITS}",
    f"API_KEY='x' apikey=\"{DIGITS}\" PassWd:abc secret =  'a.b=c-d'", "toKen=abcdefgh ſecret=abcdefgh",
    f"{DIGITS[:-1]} {DIGITS}{DIGITS}g{DIGITS}", "-----BEGIN RSA PRIVATE KEY-----\nx", "see https://bob:pw@example.com/ and https://a/b:c@d",
    "gh" + "p_" + "a" * 36, "token=token:abcdef", f"token=\"{DIGITS}\" " * 3000, "x" * 200_000 + f" {KEY}",
]


def by_hand(text):
    spans = []
    for place, (kind, pattern, keeps) in enumerate(KINDS):
        spans += [(m.start(), place, kind, m.end()) for m in re.finditer(pattern, text or "") if keeps(m)]
    spans.sort()
    name = lambda chosen: ",".join(f"{k}:{a}:{b}" for a, p, k, b in spans if p < chosen)
    counts = [sum(s[1] == i for s in spans) for i in range(3)]
    return (*counts, hashlib.sha256(name(3).encode()).hexdigest(), name(9))


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, *ODD])], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in secrets.document_secrets(docs.repartition(3)).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate([*ODD, *ODD])}


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in secrets.document_secrets(docs).collect()}
    assert got == {r.doc_id: by_hand(r.text) for r in docs.select("doc_id", "text").collect()}


def test_empty_table_clashing_columns_and_repeated_rows(spark):
    schema = "doc_id long, text string, blob string, spans_of string, kind string, `__blob` int"
    rows = [(1, ODD[3], "b", "s", "k", 1), (1, ODD[3], "b", "s", "k", 1), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    assert secrets.document_secrets(docs.limit(0)).collect() == []
    want = [(d, *by_hand(t)) for d, t, *_ in rows]
    assert sorted(map(tuple, secrets.document_secrets(docs).collect()), key=str) == sorted(want, key=str)
    ledger = secrets.Ledger(spark, new_dir(spark, "ledger"))
    out = secrets.scan(docs, ledger)
    assert out.columns == [*docs.columns, "spans"] and out.count() == 3


def versions(spark, rows):
    return spark.createDataFrame(rows, "path string, version int, text string")


def test_only_unseen_pairs_are_scanned(spark):
    ledger = secrets.Ledger(spark, new_dir(spark, "ledger"))
    done = lambda: sorted((bytes(r.blob).hex()[:6], tuple(sorted(r.rules))) for r in ledger.read().collect())
    first, second = f"a {KEY}", "token=abcdefgh"
    secrets.scan(versions(spark, [("x", 1, first), ("y", 1, first), ("x", 2, second)]), ledger, secrets.BASE).count()
    before = done()
    assert len(before) == 2 and all(len(rules) == 3 for _, rules in before)
    # nothing new: nothing is scanned, and the findings still reach a new path
    out = secrets.scan(versions(spark, [("z", 1, first)]), ledger, secrets.BASE).collect()
    assert done() == before and [(s.kind, s.start, s.end) for s in out[0].spans] == [("access", 2, 22)]
    # a new version of one rule is run alone, over the old blob; the other rules only over the new one
    newer = [secrets.BASE[0], secrets.Rule("access", 2, "AKIA[A-Z0-9]{4}"), secrets.BASE[2]]
    out = secrets.scan(versions(spark, [("z", 1, first), ("z", 2, "third")]), ledger, newer).collect()
    assert sorted(len(rules) for _, rules in done()) == [1, 3, 3, 3]
    assert {(r.version, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in out} == {(1, (("access", 2, 10),)), (2, ())}


def test_two_runs_over_one_blob_count_once(spark):
    """Two runs that did not see each other leave two rows of a blob."""
    ledger = secrets.Ledger(spark, new_dir(spark, "ledger"))
    docs = versions(spark, [("x", 1, f"a {KEY}")])
    ledger.update(docs, secrets.BASE)
    ledger.read().write.mode("append").parquet(new_dir(spark, "copy"))
    again = secrets.Ledger(spark, new_dir(spark, "ledger"))
    again.update(docs, secrets.BASE)
    again.read().write.mode("append").parquet(ledger.path)
    assert len(secrets.scan(docs, ledger, secrets.BASE).collect()[0].spans) == 1


def test_no_python_in_the_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ledger = secrets.Ledger(spark, new_dir(spark, "ledger"))
    for df in (ledger.unseen(docs, secrets.RULES), secrets.scan(docs, ledger)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.name)
def test_rules_take_linear_time(spark, rule):
    """Texts made of the starts of matches."""
    import time

    bait = {"assign": "token ", "access": "AKI", "hex": "0123456789abcdef012345 ", "pem": "-----BEGIN ", "github": "ghp_", "login": "://a"}
    docs = spark.createDataFrame([(1, bait[rule.kind] * (400_000 // len(bait[rule.kind])))], "doc_id long, text string")
    start = time.perf_counter()
    secrets.scan(docs, secrets.Ledger(spark, new_dir(spark, "ledger")), [rule]).collect()
    assert time.perf_counter() - start < 60
