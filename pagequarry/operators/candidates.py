"""Candidate blocks of pages that are neither catalogue nor detail."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.dom import elements, is_below, is_text, subtree
from pagequarry.functions.sql import each, each_indexed, keep, let, lit, some, struct
from pagequarry.functions.text import LABEL_SEPARATORS, is_blacklisted, strip
from pagequarry.labels import labels_for

# Fixed values.
BLOCK_TAGS = ["div", "section", "article"]
MIN_BLOCK_TEXT = 30
SNIPPET_CHARS = 1500
MAX_CANDIDATES = 5
# signs of a title and of a year
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
YEAR = r"(^|[^0-9])(1[89][0-9]{2}|20[0-9]{2})([^0-9]|$)"
# text of these is not page text
HIDDEN_TAGS = ["script", "style", "template"]
# nor is text below these part of a block's own matter
SIDE_TAGS = ["script", "style", "nav", "footer"]


def visible_text(part: str, sep: str, skip_tags: list[str]) -> str:
    """Stripped, non-blank texts of a run of nodes, those under ``skip_tags`` left out."""

    def join(skipped: str) -> str:
        kept = keep(part, lambda n: f"{is_text(n)} and not {some(skipped, lambda s: is_below(n, s))}")
        return f"array_join({keep(each(kept, lambda n: strip(f'{n}.text')), lambda t: f'{t} <> {chr(39) * 2}')}, '{sep}')"

    return let(elements(part, *skip_tags), join)


def block_features(nodes: str) -> str:
    """``array<struct<id, src_start, src_end, text>>`` of the blocks with an image and a link below them."""

    def has(part: str, tag: str) -> str:
        return some(part, lambda n: f"{n}.tag = '{tag}'")

    def features(b: str) -> str:
        def of(part: str) -> str:
            found = struct(
                id=f"{b}.id",
                src_start=f"{b}.src_start",
                src_end=f"{b}.src_end",
                text=f"lower({visible_text(part, '', HIDDEN_TAGS)})",
            )
            return f"if({has(part, 'img')} and {has(part, 'a')}, {found}, NULL)"

        return let(subtree(nodes, b), of)

    return keep(each(elements(nodes, *BLOCK_TAGS), features), lambda f: f"{f} is not null")


def block_evidence(nodes: str, b: str, content_type: str = "movies") -> str:
    """How many of title, year and director a block shows signs of, 0 to 3.

    A heading with a text, a number that may be a year, and a label of the director (of games, the developer) followed
    by a separator.
    """
    named = labels_for("director", content_type) or labels_for("developer", content_type)
    labels = "|".join(re.escape(label.lower()) for label in named)

    def titled(part: str, headings: str) -> str:
        return some(part, lambda n: f"{is_text(n)} and {strip(f'{n}.text')} <> '' and {some(headings, lambda h: is_below(n, h))}")

    def of(part: str) -> str:
        title = let(elements(part, *HEADING_TAGS), lambda headings: titled(part, headings))
        # texts of neighbouring elements are kept apart, as numbers and labels would run together
        text = f"lower({visible_text(part, ' ', HIDDEN_TAGS)})"
        return let(text, lambda t: f"int({title}) + int({t} rlike {lit(YEAR)}) + int({t} rlike {lit(f'({labels}) *{LABEL_SEPARATORS}')})")

    return let(subtree(nodes, b), of)


def ranked_blocks(nodes: str, max_candidates: int = MAX_CANDIDATES, min_evidence: int = 0, content_type: str = "movies") -> str:
    """The longest blocks that pass both filters, longest first, document order on ties.

    With ``min_evidence``, only blocks with so many of title, year and director are ranked at all.
    """

    def is_good(f: str) -> str:
        good = f"length({f}.text) > {MIN_BLOCK_TEXT} and not {is_blacklisted(f'{f}.text')}"
        if not min_evidence:
            return good
        return f"{good} and {let(f'get({nodes}, {f}.id)', lambda b: block_evidence(nodes, b, content_type))} >= {min_evidence}"

    good = keep(block_features(nodes), is_good)
    ranked = each(
        good,
        lambda f: struct(
            rank=f"-length({f}.text)", id=f"{f}.id", src_start=f"{f}.src_start", src_end=f"{f}.src_end"
        ),
    )
    return f"slice(array_sort({ranked}), 1, {max_candidates})"


def _snippet(html: str, b: str) -> str:
    return f"substring({html}, {b}.src_start + 1, least({b}.src_end - {b}.src_start, {SNIPPET_CHARS}))"


def candidate_blocks(
    parsed: DataFrame, max_candidates: int = MAX_CANDIDATES, min_evidence: int = 0, content_type: str = "movies"
) -> DataFrame:
    """``page_id, rank, text_length, snippet``; ``parsed`` must keep its ``html``."""
    found = each_indexed(
        ranked_blocks("nodes", max_candidates, min_evidence, content_type),
        lambda b, i: struct(rank=f"{i} + 1", text_length=f"-{b}.rank", snippet=_snippet("html", b)),
    )
    return parsed.select("page_id", F.inline(F.expr(found)))


def block_score(nodes: str) -> str:
    """Length of a block's own text."""
    return f"coalesce(length({visible_text(nodes, ' ', SIDE_TAGS)}), 0)"


def best_block(blocks: str) -> str:
    """Index of the node array with the highest score, the first one on ties; NULL for none."""
    scored = each_indexed(blocks, lambda nodes, i: struct(score=block_score(nodes), rank=f"-{i}"))
    return f"-array_max({scored}).rank"


def block_nodes(nodes: str, b: str) -> str:
    """The nodes of block ``b`` that begin in its first 1500 characters of source, numbered as a page of their own.

    They are a slice of the page's nodes, so no markup is read again. What goes on beyond the cut ends there; a text
    keeps as many characters as its source has before it.
    """

    def renumbered(part: str, n: str, end: str) -> str:
        is_root = f"{n}.id = {b}.id"
        return struct(
            id=f"{n}.id - {b}.id",
            parent=f"if({is_root}, -1, {n}.parent - {b}.id)",
            last=f"least({n}.last - {b}.id, size({part}) - 1)",
            sib=f"if({is_root}, 0, {n}.sib)",
            tag=f"{n}.tag",
            attrs=f"{n}.attrs",
            text=f"if({n}.src_end > {end}, left({n}.text, {end} - {n}.src_start), {n}.text)",
            src_start=f"{n}.src_start - {b}.src_start",
            src_end=f"least({n}.src_end, {end}) - {b}.src_start",
        )

    def cut(end: str) -> str:
        part = keep(f"slice({nodes}, {b}.id + 1, {b}.last - {b}.id + 1)", lambda n: f"{n}.src_start < {end}")
        return let(part, lambda kept: each(kept, lambda n: renumbered(kept, n, end)))

    return let(f"least({b}.src_end, {b}.src_start + {SNIPPET_CHARS})", cut)


def picked_block(nodes: str, max_candidates: int = MAX_CANDIDATES, min_evidence: int = 0, content_type: str = "movies") -> str:
    """The best of the ranked blocks, as its index ``block_no`` and its ``nodes``; NULL without one."""

    def pick(blocks: str) -> str:
        return let(best_block(blocks), lambda i: f"if({i} is null, NULL, {struct(block_no=i, nodes=f'get({blocks}, {i})')})")

    ranked = ranked_blocks(nodes, max_candidates, min_evidence, content_type)
    return let(each(ranked, lambda r: let(f"get({nodes}, {r}.id)", lambda b: block_nodes(nodes, b))), pick)


def pick_block(parsed: DataFrame, max_candidates: int = MAX_CANDIDATES, min_evidence: int = 0, content_type: str = "movies") -> DataFrame:
    """The best block of each page: its index as ``block_no``, its nodes as ``nodes``; both NULL without one."""
    found = parsed.withColumn("block", F.expr(picked_block("nodes", max_candidates, min_evidence, content_type)))
    return found.withColumns({"block_no": F.col("block.block_no"), "nodes": F.col("block.nodes")}).drop("block")
