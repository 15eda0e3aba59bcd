"""Quality rules as a short-circuit cascade, in built-in functions only.

Counts every rule may use are computed once per text. The rules form one ``CASE WHEN``: a text leaves at
the first rule that rejects it, and later rules are not evaluated. Before that, each rule is run over a
bounded sample of rows to measure its cost and how much it rejects; rules then stand in the order of
rejections per cost. The order decides the time only: a text is kept when no rule rejects it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SAMPLE_ROWS = 1000


@dataclass(frozen=True)
class Rule:
    """``rejects``: SQL over ``__text``, ``__words``, ``__lines`` and the counts of ``measure``."""

    name: str
    rejects: str


RULES = [
    Rule("symbols", "n_symbols > 0.25 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 0.4 * size(__lines)"),
    Rule("shouting", "length(__text) - length(regexp_replace(__text, '[A-ZÀ-ÖØ-Þ]+', '')) > 0.5 * word_chars"),
    Rule("exclamations", "length(__text) - length(replace(__text, '!', '')) > 0.3 * n_words"),
    Rule("digits", "length(__text) - length(regexp_replace(__text, '[0-9]+', '')) > 0.4 * word_chars"),
    Rule("few_kinds", "n_words >= 50 and size(array_distinct(__words)) < 0.1 * least(n_words, 1000)"),
]

BREAKS = " \\t\\n\\u000b\\u000c\\r"  # the characters of SPACES in an SQL literal


def words_of(text: str) -> str:
    trimmed = f"trim(BOTH '{BREAKS}' FROM {text})"
    return f"if({trimmed} = '', cast(array() as array<string>), split({trimmed}, '{SPACES}'))"


def window_at(i: str) -> str:
    """SQL list of the words of the window that starts at ``i`` (from 0); element reads take constant time."""
    return ", ".join(f"__words[{i} + {k}]" for k in range(WINDOW))


def neighbours(array: str, key: str) -> str:
    """SQL: the ``i``-th entry (from 1) of a sorted array has an equal neighbour."""
    return (
        f"(i > 1 and {array}[i - 2].{key} = {array}[i - 1].{key})"
        f" or (i < size({array}) and {array}[i].{key} = {array}[i - 1].{key})"
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the work columns ``__…``.

    Repeated windows are found by a hash of their words and then compared as words, so a clash of hashes
    cannot count. Only texts with equal hashes take the second step.
    """
    empty = "cast(array() as array<int>)"
    hashed = f"transform(sequence(0, size(__words) - {WINDOW}), i -> xxhash64({window_at('i')}))"
    order = "sort_array(transform(__hashes, (h, i) -> struct(h as h, i as i)))"
    suspects = f"transform(filter(sequence(1, size(__o)), i -> {neighbours('__o', 'h')}), i -> __o[i - 1].i)"
    spelled = f"sort_array(transform(__p, i -> struct(concat_ws(' ', {window_at('i')}) as s, i as i)))"
    again = f"sort_array(transform(filter(sequence(1, size(__q)), i -> {neighbours('__q', 's')}), i -> __q[i - 1].i))"
    steps = [
        ("__text", f"coalesce({text}, '')"),
        ("__words", words_of("__text")),
        ("__lines", f"filter(split(__text, '\\n'), l -> trim(BOTH '{BREAKS}' FROM l) != '')"),
        ("n_words", "cast(size(__words) as long)"),
        ("word_chars", "cast(length(concat_ws('', __words)) as long)"),
        ("n_symbols", f"cast(length(__text) - length(regexp_replace(__text, '[{SYMBOLS}]', '')) as long)"),
        ("n_dup_lines", "cast(size(__lines) - size(array_distinct(__lines)) as long)"),
        ("__hashes", f"if(size(__words) > {WINDOW}, {hashed}, cast(array() as array<bigint>))"),
        (
            "__o",
            "if(size(array_distinct(__hashes)) = size(__hashes), "
            f"cast(array() as array<struct<h: bigint, i: int>>), {order})",
        ),
        ("__p", f"if(size(__o) = 0, {empty}, {suspects})"),
        ("__q", f"if(size(__p) = 0, cast(array() as array<struct<s: string, i: int>>), {spelled})"),
        ("__r", f"if(size(__q) = 0, {empty}, {again})"),
        (
            "n_repeat_words",
            "if(size(__r) = 0, 0L, aggregate(zip_with(__r, slice(__r, 2, size(__r)), "
            f"(a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), 0L, (s, x) -> s + x))",
        ),
    ]
    for name, sql in steps:
        docs = docs.withColumn(name, F.expr(sql))
    return docs


def rule_order(docs: DataFrame, rules: list[Rule], *, sample_rows: int = SAMPLE_ROWS, text: str = "text") -> list[Rule]:
    """The rules by rejections per second on about ``sample_rows`` rows drawn from all, best first."""
    texts = docs.select(F.col(text).alias("text"))
    drawn = texts.sample(min(1.0, sample_rows / max(1, texts.count())), seed=5)
    sample = measure(drawn).persist()
    try:
        total = sample.count()
        if not total:
            return list(rules)
        gains = []
        for rule in rules:
            probe = sample.agg(F.count_if(F.expr(rule.rejects)).alias("n"), F.sum("n_words"))
            seconds = []
            for _ in range(2):
                start = time.perf_counter()
                rejected = probe.first().n
                seconds.append(time.perf_counter() - start)
            gains.append((rejected / total + 1e-6) / max(min(seconds), 1e-4))
    finally:
        sample.unpersist()
    return [rule for _, _, rule in sorted(zip([-g for g in gains], range(len(rules)), rules, strict=True), key=lambda x: x[:2])]


def base_failed() -> Column:
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, or NULL; later rules are not evaluated."""
    chain = F.when(base_failed(), F.lit("base"))
    for rule in rules:
        chain = chain.when(F.expr(rule.rejects), F.lit(rule.name))
    return chain


def judge(docs: DataFrame, rules: list[Rule] | None = None, *, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the five counts, ``base_failed``, ``kept`` and ``rejected_by`` added.

    A NULL text has no words and fails the base rules, like an empty one. Repeated rows are judged each
    for itself; an empty table gives no rows. ``docs`` must not have columns of the added names. Which of
    several rejecting rules is named depends on the measured order; whether a text is kept does not.
    """
    ordered = rule_order(docs, RULES if rules is None else rules, sample_rows=sample_rows, text=text)
    out = measure(docs, text).withColumn("rejected_by", cascade(ordered))
    # the partition number, always true here, keeps the optimizer from writing all counts out inside a filter on kept
    kept = F.col("rejected_by").isNull() & (F.spark_partition_id() >= 0)
    out = out.withColumn("base_failed", base_failed()).withColumn("kept", kept)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def quality_counts(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``doc_id``, the counts and the verdict of every document; other columns of ``docs`` are ignored."""
    return judge(docs.select("doc_id", "text"), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"
    )


def keep_good(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns whatever their names."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    return judge(packed, rules).where("kept").select("row.*")
