"""Parse pages once, in parallel, into a node array per page.

The node array is in document order, so an element's descendants are the
contiguous slice ``nodes[id + 1 .. last]``.  Every later operator works on that
slice with built-in array functions inside the row: no join, no shuffle, and a
hot site costs no more than its share of pages.

Python runs only here.  It turns markup into a tree (open-element stack, void
elements, implied ends); nothing else is decided in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.schema import NODES, TEXT_TAG

# Error of a page without markup.
NO_MARKUP = "no markup"

# Markup bytes handed to Arrow per output batch; keeps the Python worker's
# memory flat however large the incoming batch is.
CHUNK_CHARS = 4_000_000

# Fixed values of the HTML standard.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING_TAGS = frozenset("b big em font i small strong tt u".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote center dd details div dl dt fieldset figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
# open tag -> start tags that end it
ENDED_BY = {
    "p": BLOCK_TAGS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option", "optgroup"]),
    "td": frozenset("td th tr tbody thead tfoot".split()),
    "th": frozenset("td th tr tbody thead tfoot".split()),
    "tr": frozenset("tr tbody thead tfoot".split()),
    "thead": frozenset("tbody tfoot".split()),
    "tbody": frozenset("tbody tfoot".split()),
    "tfoot": frozenset(["tbody"]),
    "head": frozenset(["body"]),
}
# an end tag never closes an open element of a higher level than its own
LEVELS = {"div": 1, "td": 2, "th": 2, "tr": 3, "thead": 4, "tbody": 4, "tfoot": 4, "table": 5, "head": 6, "body": 6, "html": 7}


# One token without quotes in it: comment, declaration, end tag (1), or the name of a start tag (2).
TOKEN = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))
          |[!?][^>]*>
          |/([a-zA-Z][^\s/>]*)[^>]*>
          |/[^a-zA-Z][^>]*>
          |([a-zA-Z][^\s/>]*))""",
    re.S | re.X,
)
# The common token at a place, in one match: text (1), then a start tag (2) with its attributes (3), if it holds nothing but
# text that text (4) and its end, or an end tag (5). Nothing is given back and the quoted stretches are bounded, so a stray
# quote or a cut-off tag costs no search of the page; what does not match goes by ``TOKEN``.
PLAIN = re.compile(
    r"""([^<]*+)<
        (?:([a-zA-Z][^\s/>]*+)
           ((?:[^>"']{0,500}+(?:"[^"]{0,1000}+"|'[^']{0,1000}+')){0,16}+[^>"']{0,500}+)>
           (?:([^<]*+)</\2>)?+
          |/([a-zA-Z][^\s/>]*+)[^>]*+>)""",
    re.X,
)
QUOTE_OR_END = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
# all of a start tag with one attribute in double quotes, which ``ATTRIBUTE`` reads the same
ONE_ATTRIBUTE = re.compile(r"""\s+([^\s"'>/=][^\s"'>/=]*+)="([^"]*+)"\s*+""")
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")
# markup cut off in the middle of a tag
CUT_OFF = re.compile(r"<[a-zA-Z/!?]")
RAW_TEXT_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in ("script", "style")}


class _Columns:
    """Flat node columns of many pages; ``offsets`` marks where each page starts."""

    def __init__(self) -> None:
        self.offsets = [0]
        self.parent, self.last, self.sib = [], [], []
        self.tag, self.text = [], []
        self.attr_offsets, self.attr_keys, self.attr_values = [0], [], []
        self.src_start, self.src_end = [], []

    def forget_from(self, keep: int) -> None:
        """Drop the nodes of a page that failed half way."""
        for column in (self.parent, self.last, self.sib, self.tag, self.text, self.src_start, self.src_end):
            del column[keep:]
        del self.attr_offsets[keep + 1 :]
        del self.attr_keys[self.attr_offsets[-1] :]
        del self.attr_values[self.attr_offsets[-1] :]

    def to_arrow(self) -> pa.Array:
        starts = np.asarray(self.offsets, dtype=np.int32)
        ids = np.arange(len(self.tag), dtype=np.int32) - np.repeat(starts[:-1], np.diff(starts))
        attrs = pa.MapArray.from_arrays(
            pa.array(self.attr_offsets, pa.int32()), pa.array(self.attr_keys, pa.string()), pa.array(self.attr_values, pa.string())
        )
        columns = [
            pa.array(ids, pa.int32()),
            *(pa.array(c, pa.int32()) for c in (self.parent, self.last, self.sib)),
            pa.array(self.tag, pa.string()),
            attrs,
            pa.array(self.text, pa.string()),
            *(pa.array(c, pa.int32()) for c in (self.src_start, self.src_end)),
        ]
        return pa.ListArray.from_arrays(
            pa.array(starts, pa.int32()), pa.StructArray.from_arrays(columns, names=NODES.elementType.names)
        )


def _attributes(source: str) -> dict[str, str]:
    """Attributes of a start tag; the first of a name counts."""
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        value = double or single or bare
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


class _TagEnds:
    """Finds where start tags of a page end, in time linear in the page.

    A tag ends at the first ``>`` outside quotes; with a stray quote, at the first ``>`` at all. A search that
    runs into a stray quote is remembered by the quotes it passed, and the absence of a later quote by its
    kind, so no stretch of markup is searched twice in vain.
    """

    def __init__(self, html: str) -> None:
        self.html = html
        self.last = html.rfind(">")
        self.vain: set[int] = set()
        self.gone: set[str] = set()

    def end_of(self, pos: int) -> int:
        """Place behind the ``>`` of a tag whose attributes start at ``pos``; -1 when the markup breaks off."""
        html = self.html
        if pos > self.last:
            return -1
        passed = []
        at = pos
        while True:
            mark = QUOTE_OR_END.search(html, at)
            if mark is None:
                break
            place, kind = mark.start(), mark.group()
            if kind == ">":
                return place + 1
            passed.append(place)
            close = -1 if place in self.vain or kind in self.gone else html.find(kind, place + 1)
            if close < 0:
                if place not in self.vain:
                    self.gone.add(kind)
                break
            at = close + 1
        self.vain.update(passed)
        return html.find(">", pos) + 1 or -1


class _Open:
    """Open elements below a root, with what the rules ask of them at hand."""

    def __init__(self) -> None:
        self.stack: list[list] = [[-1, "", 0, 0]]  # node, tag, element children so far, depth of the last non-formatting one
        self.depths: dict[str, list[int]] = {}
        self.levels: list[list[int]] = [[] for _ in range(8)]

    def push(self, node: int, tag: str) -> None:
        depth = len(self.stack)
        self.stack.append([node, tag, 0, self.stack[-1][3] if tag in FORMATTING_TAGS else depth])
        self.depths.setdefault(tag, []).append(depth)
        if tag in LEVELS:
            self.levels[LEVELS[tag]].append(depth)

    def pop(self) -> list:
        entry = self.stack.pop()
        self.depths[entry[1]].pop()
        if entry[1] in LEVELS:
            self.levels[LEVELS[entry[1]]].pop()
        return entry

    def match(self, tag: str) -> int:
        """Depth that an end tag closes, 0 for none: nothing beyond an element of a higher level."""
        own = self.depths.get(tag)
        if not own:
            return 0
        barrier = max((d[-1] for d in self.levels[LEVELS.get(tag, 0) + 1 :] if d), default=0)
        return own[-1] if own[-1] >= barrier else 0


def _add_page(html: str, out: _Columns) -> None:
    """Append the nodes of one page, in document order."""
    base = len(out.tag)
    opened = _Open()
    stack = opened.stack
    ends = _TagEnds(html)

    def append(tag: str, text: str | None, start: int, end: int) -> int:
        node = len(out.tag) - base
        parent = stack[-1]
        out.parent.append(parent[0])
        out.last.append(node)
        out.tag.append(tag)
        out.text.append(text)
        out.src_start.append(start)
        out.src_end.append(end)
        if text is None:
            out.sib.append(parent[2])
            parent[2] += 1
        else:
            out.sib.append(None)
            out.attr_offsets.append(len(out.attr_keys))
        return node

    def close(depth: int, at: int) -> None:
        """Close the open elements from ``depth`` on."""
        newest = len(out.tag) - base - 1
        while len(stack) > depth:
            node = opened.pop()[0]
            out.last[base + node] = newest
            out.src_end[base + node] = at

    def end_implied(tag: str, at: int) -> None:
        """Close what a start tag ends: ``<li>`` an open ``li``, and so on."""
        while tag in ENDED_BY.get(stack[stack[-1][3]][1], ()):
            close(stack[-1][3], at)

    def end_tag(tag: str, start: int, end: int) -> None:
        depth = opened.match(tag)
        if depth:
            close(depth + 1, start)
            close(depth, end)

    parents, lasts, sibs, tags, texts = out.parent, out.last, out.sib, out.tag, out.text
    starts, src_ends, attr_offsets, keys, values = out.src_start, out.src_end, out.attr_offsets, out.attr_keys, out.attr_values

    def plain_tokens(pos: int) -> int:
        """Append all tokens from ``pos`` on that ``PLAIN`` takes whole; the place behind them.

        The same rules as in the loop below; an element of nothing but text is not opened for it.
        """
        count = len(tags) - base
        while (found := PLAIN.match(html, pos)) is not None:
            before, name, source, inner, ended = found.groups()
            top = stack[-1]
            start = pos
            if before:
                start += len(before)
                parents.append(top[0])
                lasts.append(count)
                sibs.append(None)
                tags.append(TEXT_TAG)
                texts.append(unescape(before) if "&" in before else before)
                starts.append(pos)
                src_ends.append(start)
                attr_offsets.append(len(keys))
                count += 1
            pos = found.end()
            if name is None:
                ended = ended.lower()
                if top[1] == ended:
                    opened.pop()
                    lasts[base + top[0]] = count - 1
                    src_ends[base + top[0]] = pos
                else:
                    end_tag(ended, start, pos)
                continue
            tag = name.lower()
            if tag in ENDED_BY.get(stack[top[3]][1], ()):
                end_implied(tag, start)
                top = stack[-1]
            after = start + len(name) + len(source) + 2
            parents.append(top[0])
            lasts.append(count)
            sibs.append(top[2])
            top[2] += 1
            tags.append(tag)
            texts.append(None)
            starts.append(start)
            src_ends.append(after)
            self_closed = False
            if source:
                alone = ONE_ATTRIBUTE.fullmatch(source)
                if alone is not None:
                    key, value = alone.groups()
                    keys.append(key.lower())
                    values.append(unescape(value) if "&" in value else value)
                else:
                    for key, value in _attributes(source).items():
                        keys.append(key)
                        values.append(value)
                    self_closed = source.rstrip().endswith("/") and SELF_CLOSED.search(source) is not None
            attr_offsets.append(len(keys))
            count += 1
            if self_closed or tag in VOID_TAGS:
                pos = after
            elif tag in RAW_TEXT_END:
                opened.push(count - 1, tag)
                return raw_text(tag, after)
            elif inner is None:
                opened.push(count - 1, tag)
            else:
                src_ends[-1] = pos
                if inner:
                    lasts[-1] = count
                    parents.append(count - 1)
                    lasts.append(count)
                    sibs.append(None)
                    tags.append(TEXT_TAG)
                    texts.append(unescape(inner) if "&" in inner else inner)
                    starts.append(after)
                    src_ends.append(after + len(inner))
                    attr_offsets.append(len(keys))
                    count += 1
        return pos

    def raw_text(tag: str, pos: int) -> int:
        """Append the text of a script or style that was opened; the place behind it."""
        stop = RAW_TEXT_END[tag].search(html, pos)
        raw_end = stop.start() if stop else size
        if raw_end > pos:
            append(TEXT_TAG, html[pos:raw_end], pos, raw_end)
        return raw_end

    pos, size = 0, len(html)
    while pos < size:
        # a quote once found stray sways how later tags end, which only ``ends`` knows
        plain_end = pos if ends.vain else plain_tokens(pos)
        if plain_end > pos:
            pos = plain_end
            continue
        token = TOKEN.search(html, pos) if pos <= ends.last else None
        start = token.start() if token else size
        after = token.end() if token else size
        if token and token.group(2):
            after = ends.end_of(after)
            if after < 0:
                token = None
        if token is None:
            cut = CUT_OFF.search(html, pos)
            start = cut.start() if cut else size
        if start > pos:
            text = html[pos:start]
            append(TEXT_TAG, unescape(text) if "&" in text else text, pos, start)
        if token is None:
            break
        pos = after
        ended, tag = token.groups()
        if ended is not None:
            end_tag(ended.lower(), start, pos)
        elif tag is not None:
            source = html[token.end() : after - 1]
            tag = tag.lower()
            end_implied(tag, start)
            node = append(tag, None, start, pos)
            if source:
                for name, value in _attributes(source).items():
                    out.attr_keys.append(name)
                    out.attr_values.append(value)
            out.attr_offsets.append(len(out.attr_keys))
            if tag in VOID_TAGS or (source and SELF_CLOSED.search(source)):
                continue
            opened.push(node, tag)
            if tag in RAW_TEXT_END:
                pos = raw_text(tag, pos)
    close(1, size)


def _parse_array(html: pa.Array) -> tuple[pa.Array, pa.Array]:
    """One node list and one error (NULL when fine) per markup string."""
    out, errors = _Columns(), []
    for value in html.to_pylist():
        start = len(out.tag)
        try:
            if value is not None:
                _add_page(value, out)
            errors.append(NO_MARKUP if value is None else None)
        except Exception as exc:  # a bad page is reported, the job goes on
            out.forget_from(start)
            errors.append(f"{type(exc).__name__}: {exc}")
        out.offsets.append(len(out.tag))
    return out.to_arrow(), pa.array(errors, pa.string())


def nodes_of(html: pa.Array) -> pa.Array:
    """One node list for each markup string; an empty one for NULL and for a page that cannot be parsed."""
    return _parse_array(html)[0]


def _chunks(batch: pa.RecordBatch, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    start = chars = 0
    for row, size in enumerate(sizes):
        if row > start and chars + size > CHUNK_CHARS:
            yield batch.slice(start, row - start)
            start, chars = row, 0
        chars += size
    if start < batch.num_rows:
        yield batch.slice(start)


def parse_pages(pages: DataFrame, html_col: str = "html", keep_html: bool = False) -> DataFrame:
    """Add ``nodes`` and ``error`` to ``pages``; ``html`` is dropped unless kept.

    ``html_col`` may be a string, giving one node array per row, or an array of
    strings, giving an array of node arrays in the same order.
    """
    is_list = isinstance(pages.schema[html_col].dataType, T.ArrayType)
    kept = [c for c in pages.columns if keep_html or c != html_col]
    nodes_type = T.ArrayType(NODES) if is_list else NODES
    error_type = T.ArrayType(T.StringType()) if is_list else T.StringType()
    fields = [pages.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField("nodes", nodes_type), T.StructField("error", error_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(html_col)
            if is_list:
                sizes = [sum(len(s) for s in v or ()) for v in column.to_pylist()]
            else:
                sizes = [n or 0 for n in pc.binary_length(column).to_pylist()]
            for part in _chunks(batch, sizes):
                html = part.column(html_col)
                if is_list:
                    flat = html.flatten()
                    lengths = [len(v) if v.is_valid else 0 for v in html]
                    offsets = [0]
                    for n in lengths:
                        offsets.append(offsets[-1] + n)
                    offsets = pa.array(offsets, pa.int32())
                    nodes, errors = _parse_array(flat)
                    nodes = pa.ListArray.from_arrays(offsets, nodes)
                    errors = pa.ListArray.from_arrays(offsets, errors)
                else:
                    nodes, errors = _parse_array(html)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), nodes, errors], names=[*kept, "nodes", "error"]
                )

    return pages.mapInArrow(run, schema)


def node_rows(parsed: DataFrame) -> DataFrame:
    """Long form of the node array: one row per element or text node."""
    return parsed.select("page_id", F.inline("nodes"))


def parse_errors(parsed: DataFrame) -> DataFrame:
    """Pages the parser gave up on; they have no nodes and so yield nothing."""
    return parsed.filter(F.col("error").isNotNull()).select("page_id", "url", "error")
