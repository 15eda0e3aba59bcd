"""Nested blocks: known cases, round trips, a YAML library where there is one."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagequarry.sources import blocks

CASES = {
    "a: 1\nb:\n  c: [x, 'y z', {d: 2.5}]\n": {"a": 1, "b": {"c": ["x", "y z", {"d": 2.5}]}},
    "a:\n- 1\n- b: 2\n  c: 3\n-\n  - 4\nd: ~": {"a": [1, {"b": 2, "c": 3}, [4]], "d": None},
    "a: |\n  x\n   y\n\nb: >-\n  p\n  q\n\n  r\n": {"a": "x\n y\n", "b": "p q\nr"},
    "a: 'it''s' # note\nb: \"\\u00e9\\n\"\nc: x#y": {"a": "it's", "b": "é\n", "c": "x#y"},
    "a: yes\nb: No\nc: 0x1F\nd: 012\ne: 1_000\nf: 1e5\ng: 2020-01-01": {
        "a": True, "b": False, "c": 31, "d": 10, "e": 1000, "f": "1e5", "g": "2020-01-01",
    },
    "a: x\n  y\n\n  z": {"a": "x y\nz"},
    "a:\n    b:\n        c: 1\n    d: 2": {"a": {"b": {"c": 1}, "d": 2}},
    "---\na: 1\n...\nanything": {"a": 1},
}
MALFORMED = [
    "", "- a\n- b", "text", "a: b: c", "a: [1", "a: 'x", "a:\n  b: 1\n c: 2", "a: 1\n  b: 2", "a: *x", "\ta: 1", "a: b\n- c", "a: !t x",
    "a: {b: 1} x", "a: [,]", 'a: "\\q"', "a: @x", 'a: "\\ud800"', "[" * 500, "a: " + "[" * 500, "\n".join(" " * i + "a:" for i in range(500)),
]


def read(text):
    found = blocks.read_block(text)
    return None if found is None else json.loads(found)


@pytest.mark.parametrize("text", CASES)
def test_known_blocks(text):
    assert read(text) == CASES[text]


@pytest.mark.parametrize("text", MALFORMED)
def test_malformed_blocks_are_missing(text):
    assert read(text) is None


SCALARS = [
    None, True, False, 0, -5, 12345678901234567890, 1.5, -2.25e-10, 1e30, "", "x", "yes", "1", "1.5", "~", "a: b", "a #b", "- x", "  pad ",
    "line\nbreak", "tab\tx", "qu\"o'te", "[x]", "{", "é日本", "#x", "x:", "null", "\u2028", "\x07", "back\\slash", "a,b", "?", "\u00a0", "🙂",
]


def value(rng, depth):
    kind = rng.random()
    if depth < 4 and kind < 0.25:
        return {rng.choice(["a", "b c", "1", "true", "k:z", "é", "a#b", " p"]) + str(rng.randint(0, 3)): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    if depth < 4 and kind < 0.5:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice(SCALARS)


def test_written_blocks_read_again():
    rng = random.Random(1)
    for _ in range(3000):
        v = {"r": value(rng, 0), "s": value(rng, 0)}
        assert read(blocks.write_block(json.dumps(v))) == v


def test_agrees_with_a_library():
    yaml = pytest.importorskip("yaml")
    rng = random.Random(2)
    for _ in range(1500):
        v = {"r": value(rng, 0), "s": value(rng, 0)}
        if "\u2028" in str(v) or "\\u2028" in str(v):
            continue
        assert yaml.safe_load(blocks.write_block(json.dumps(v))) == v
        assert read(yaml.dump(v, allow_unicode=True, sort_keys=False, default_flow_style=rng.random() < 0.2 or None)) in (v, None)
        assert read(yaml.dump(v, allow_unicode=True, sort_keys=False, default_flow_style=False)) == v


def test_reading_takes_linear_time():
    import time

    for text in ("a: '" + "''" * 200_000 + "'", "\n".join(f"k{i}: {i}" for i in range(60_000)), "a:\n" + "- - x\n" * 60_000, "a: |\n" + "  x\n\n" * 60_000, "a" * 300_000 + ": 1"):
        start = time.perf_counter()
        assert read(text) is not None
        assert time.perf_counter() - start < 10


def test_columns(spark):
    bodies = [
        "x\n```yaml\na:\n  b: [1, two]\n```\ny\n```yaml\nc: 1\n```", None, "", "no block", "```yaml\n- a\n```", "```yaml\n  a: 1\n b: 2\n```",
    ]
    docs = spark.createDataFrame(list(enumerate(bodies)), "number int, body string").withColumn("block", blocks.nested_block(F.col("body")))
    assert [r.j for r in docs.orderBy("number").select(F.to_json("block").alias("j")).collect()] == ['{"a":{"b":[1,"two"]}}', None, None, None, None, None]
    leaves = blocks.block_leaves(docs, "block", "number").collect()
    assert [tuple(r) for r in leaves] == [(0, "$.a.b[0]", "1", "int"), (0, "$.a.b[1]", "two", "str")]
    again = docs.select("number", blocks.nested_body(F.col("block"), F.lit("t")).alias("body")).orderBy("number").collect()
    assert again[1].body == "t" and again[0].body == "t\n```yaml\na:\n  b:\n    - 1\n    - two\n```\n"
    assert blocks.block_leaves(docs.limit(0), "block", "number").collect() == []
