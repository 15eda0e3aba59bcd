"""Main text of a page or block: the run of nodes with the most text for its markup.

Every node gets points in document order: a word of text one, a word inside a link minus one, an element that
parts blocks minus ``TAG``. The main text is the run of nodes with the largest sum, found in one pass over the node
array inside the row. Menus and link lists are full of elements and links, so runs of prose win over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.dom import elements, is_below, is_text
from pagequarry.functions.sql import each, keep, let, lits, some
from pagequarry.functions.text import strip

#: Points that a block element costs, and the least sum of a main text.
TAG = 3
LEAST = 10
#: Elements that stand inside a line of text and cost nothing.
INLINE_TAGS = ["a", "abbr", "b", "br", "cite", "code", "em", "i", "img", "q", "small", "span", "strong", "sub", "sup", "u", "wbr"]
#: What is below these is never main text.
SKIPPED_TAGS = ["script", "style", "template", "noscript", "head", "nav", "footer", "aside", "form", "button", "select"]
WORD = r"[^ \t\n\x0B\f\r]+"


def points(n: str, link: str, skip: str) -> str:
    """Points of a node; ``link`` and ``skip`` are the last ids of the link and the skipped element around it."""
    words = f"size(regexp_extract_all({n}.text, r'{WORD}', 0))"
    return (
        f"case when {n}.id <= {skip} then 0 when {is_text(n)} then if({n}.id <= {link}, -1, 1) * {words} "
        f"when {n}.tag in ({lits(INLINE_TAGS)}) then 0 else -{TAG} end"
    )


def main_span(nodes: str) -> str:
    """``struct<best, first, last>``: points and first and last node of the best run, the first of equal ones.

    ``best`` is 0 when no run has points; NULL nodes give NULL.
    """
    start = "named_struct('link', -1, 'skip', -1, 'run', 0, 'since', 0, 'best', 0, 'first', -1, 'last', -1)"

    def step(a: str, n: str) -> str:
        link = f"if({n}.tag = 'a', greatest({a}.link, {n}.last), {a}.link)"
        skip = f"if({n}.tag in ({lits(SKIPPED_TAGS)}), greatest({a}.skip, {n}.last), {a}.skip)"
        run = f"greatest({a}.run, 0) + {points(n, f'{a}.link', f'{a}.skip')}"
        since = f"if({a}.run <= 0, {n}.id, {a}.since)"

        def best(s: str) -> str:
            better = f"{s}.run > {a}.best"
            return (
                f"named_struct('link', {link}, 'skip', {skip}, 'run', {s}.run, 'since', {s}.since, 'best', greatest({s}.run, {a}.best), "
                f"'first', if({better}, {s}.since, {a}.first), 'last', if({better}, {n}.id, {a}.last))"
            )

        return let(f"named_struct('run', {run}, 'since', {since})", best)

    return f"aggregate({nodes}, {start}, (a, n) -> {step('a', 'n')}, a -> named_struct('best', a.best, 'first', a.first, 'last', a.last))"


def main_text(nodes: str, least: int = LEAST) -> str:
    """The stripped texts of the best run, joined by blanks, links inside it included; NULL under ``least`` points."""

    def texts(s: str) -> str:
        run = f"slice({nodes}, {s}.first + 1, {s}.last - {s}.first + 1)"
        skipped = elements(run, *SKIPPED_TAGS)
        shown = let(skipped, lambda h: keep(run, lambda n: f"{is_text(n)} and not {some(h, lambda e: is_below(n, e))}"))
        kept = keep(each(shown, lambda n: strip(f"{n}.text")), lambda t: f"{t} <> ''")
        return f"if({s}.best >= {least}, array_join({kept}, ' '), NULL)"

    return let(main_span(nodes), texts)


def main_texts(parsed: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, points, main_text`` of every parsed page; a page that could not be read has neither."""
    spans = parsed.select("page_id", F.expr(f"{main_span('nodes')}.best").cast("long").alias("points"), F.expr(main_text("nodes", least)).alias("main_text"))
    return spans


def best_block_by_text(blocks: str) -> str:
    """Index of the node array whose main text has most points, the first one on ties; NULL for none."""
    scored = f"transform({blocks}, (b, i) -> named_struct('points', coalesce({main_span('b')}.best, 0), 'place', -i))"
    return f"-array_max({scored}).place"
