"""Fuzzy matching of a text to a catalogue field by its labels.

The labels are a short fixed list, so they ride along as one constant array
and each text is scored where it is: no join, no row blow-up, no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pagequarry.functions.sql import each, keep, let, lit, struct
from pagequarry.labels import DEFAULT_THRESHOLD, field_mapping

# field -> (labels, threshold)
Patterns = dict[str, tuple[list[str], int]]

# Scripts written without blanks between words; a label in them is looked for
# as a plain run of characters.
UNSPACED_SCRIPTS = ("MYANMAR", "CJK", "HIRAGANA", "KATAKANA")
TOKEN_ORDER_WEIGHT = 0.95
# A label inside a text says little when the text is many times as long: it is prose.
CONTAINED_SCORE = 90.0
PROSE_SCORE, PROSE_RATIO = 60.0, 8


def normalise(x: str) -> str:
    """Lower case, anything but letters, marks and digits as one blank."""
    return rf"trim(regexp_replace(lower({x}), r'[^\p{{L}}\p{{M}}\p{{N}}]+', ' '))"


def sort_tokens(normal: str) -> str:
    return f"array_join(array_sort(split({normal}, ' ')), ' ')"


def label_dim(spark: SparkSession, content_type: str = "movies") -> DataFrame:
    """The label table: one row per field and label, in declared order."""
    rows = [
        (content_type, field, fi, label, li, m.get("type"), m.get("format"), bool(m.get("required")), m.get("confidence_threshold", DEFAULT_THRESHOLD))
        for fi, (field, m) in enumerate(field_mapping(content_type).items())
        for li, label in enumerate(m["labels"])
    ]
    return spark.createDataFrame(
        rows,
        "content_type string, field string, field_order int, label string, label_order int, "
        "type string, format string, required boolean, threshold int",
    )


def _patterns(content_type: str) -> Patterns:
    mapping = field_mapping(content_type).items()
    return {f: (m["labels"], m.get("confidence_threshold", DEFAULT_THRESHOLD)) for f, m in mapping}


@dataclass(frozen=True)
class _Label:
    field: str
    field_order: int
    threshold: int
    normal: str
    tokens: str
    unspaced: bool

    @property
    def shortest(self) -> int:
        """Least length of a text near the label: ``100 * (label - len) <= (101 - threshold) * label`` solved for len."""
        return max(0, -((1 - self.threshold) * len(self.normal) // 100))

    @property
    def longest(self) -> int:
        """Greatest length of a text near the label: ``100 * (len - label) <= (101 - threshold) * len`` solved for len; with
        a threshold of 1 or less any length is near."""
        return 2**31 - 1 if self.threshold <= 1 else 100 * len(self.normal) // (self.threshold - 1)

    @property
    def needle(self) -> str:
        """What a text with a blank at both ends must contain to contain the label."""
        return self.normal if self.unspaced else f" {self.normal} "


def _labels(patterns: Patterns) -> list[_Label]:
    """The few labels, normalised once by the rule of ``normalise``."""
    rows = []
    for order, (field, (labels, threshold)) in enumerate(patterns.items()):
        for label in labels:
            chars = [c if unicodedata.category(c)[0] in "LMN" else " " for c in label.lower()]
            tokens = "".join(chars).split()
            unspaced = any(unicodedata.name(c, "").startswith(UNSPACED_SCRIPTS) for c in label)
            rows.append(_Label(field, order, threshold, " ".join(tokens), " ".join(sorted(tokens)), unspaced))
    return rows


def _score(t: str, e: str) -> str:
    """0-100 likeness of a text to a label that it may be like (see ``_may_be_like``).

    Where neither the text nor the label has its words in another order than the sorted one, the second edit distance would
    be the first again, at a lower weight.
    """
    longest = f"greatest({t}.len, {e}.len)"

    def ratio(a: str, b: str) -> str:
        return f"100d * (1d - levenshtein({a}, {b}) / {longest})"

    whole = ratio(f"{t}.normal", f"{e}.normal")
    reordered = f"if({t}.normal = {t}.tokens and {e}.normal = {e}.tokens, 0d, {TOKEN_ORDER_WEIGHT}d * ({ratio(f'{t}.tokens', f'{e}.tokens')}))"
    edit = f"greatest({whole}, {reordered})"
    inside = f"if({t}.len <= {PROSE_RATIO} * {e}.len, {CONTAINED_SCORE}d, {PROSE_SCORE}d)"
    contained = f"if(contains({t}.padded, {e}.needle), {inside}, 0d)"
    return f"cast(round(greatest(if({_is_near(t, e)}, {edit}, 0d), {contained})) as int)"


def _is_near(t: str, e: str) -> str:
    """Whether a text is neither too short nor too long to reach the label's threshold by edit distance, which is never
    below the difference in length."""
    return f"{t}.len between {e}.shortest and {e}.longest"


def _may_be_like(t: str, e: str) -> str:
    """Whether a label need be scored at all: any other has score 0."""
    return f"({_is_near(t, e)} or contains({t}.padded, {e}.needle))"


def match_patterns(text: str, patterns: Patterns) -> str:
    """``struct(field, score)``; field NULL and score 0 when no field reaches its threshold.

    The best score wins, and the earlier field on a tie.  A text that is a label
    is looked up; one that is too long to be like any label and contains none
    is done after one regular expression; only the others are scored.
    """
    labels = _labels(patterns)
    exact: dict[str, str] = {}
    for label in labels:
        exact.setdefault(label.normal, label.field)
    array = ", ".join(
        struct(
            field=lit(x.field),
            field_order=lit(x.field_order),
            threshold=lit(x.threshold),
            normal=lit(x.normal),
            tokens=lit(x.tokens),
            len=lit(len(x.normal)),
            shortest=lit(x.shortest),
            longest=lit(x.longest),
            needle=lit(x.needle),
        )
        for x in labels
    )
    # a longer text scores only by containing a label
    longest_near = max(x.longest for x in labels)
    contained = "|".join(re.escape(x.needle).replace("\\ ", " ") for x in labels)

    def best(t: str) -> str:
        scored = each(
            keep(f"array({array})", lambda e: _may_be_like(t, e)),
            lambda e: struct(score=_score(t, e), rank=f"-{e}.field_order", field=f"{e}.field", threshold=f"{e}.threshold"),
        )
        hit = f"array_max({keep(scored, lambda s: f'{s}.score >= {s}.threshold')})"
        return let(hit, lambda h: struct(field=f"{h}.field", score=f"coalesce({h}.score, 0)"))

    nothing = struct(field="cast(NULL as string)", score="0")

    def found(n: str) -> str:
        known = f"map({', '.join(f'{lit(k)}, {lit(v)}' for k, v in exact.items())})[{n}]"
        parts = struct(normal=n, tokens=sort_tokens(n), len=f"length({n})", padded=f"concat(' ', {n}, ' ')")
        return (
            f"case when {n} = '' then {nothing} "
            f"when {known} is not null then {struct(field=known, score='100')} "
            f"when length({n}) > {longest_near} and not concat(' ', {n}, ' ') rlike {lit(contained)} then {nothing} "
            f"else {let(parts, best)} end"
        )

    return let(normalise(f"coalesce({text}, '')"), found)


def match_field(text: str, content_type: str = "movies") -> str:
    """``match_patterns`` with the labels of a content type."""
    return match_patterns(text, _patterns(content_type))
