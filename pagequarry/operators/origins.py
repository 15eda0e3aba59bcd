"""Where on the page each value stands: main fields, labelled paragraphs and table cells, with a path back to the markup.

A path names the elements from the root down by their place among their siblings, ``/*[1]/*[2]``, and ends in
``/text()[1]`` for a text node, in ``/@src`` for an attribute, or in neither for all the text of the element. It is
worked out inside the page's row, and ``values_at`` follows it in the stored markup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.dom import Selector, attr, below, cell_text, elements, is_below, is_text, own_text_nodes, string_value, subtree, touched
from pagequarry.functions.labels import match_field
from pagequarry.functions.sql import each, each_indexed, first, keep, let, lit, lits, some, struct
from pagequarry.functions.text import clean_text, is_paragraph_length, strip
from pagequarry.labels import field_names
from pagequarry.operators.fields import FIELD_SELECTORS, PARAGRAPH_MIN_SCORE, URL_FIELDS
from pagequarry.operators.parse import parse_pages
from pagequarry.operators.tables import body_rows, header_texts, map_headers, skeleton
from pagequarry.schema import ITEM_FIELDS

# elements above a node are walked one by one up to this depth, then found among all nodes of the page
WALKED = 64
# most nodes are reached in so many steps
FEW = 8
NO_ROW, NO_SELECTOR, NO_ATTRIBUTE = "cast(NULL as int)", "cast(NULL as bigint)", "cast(NULL as string)"


def _source(n: str, value: str, reading: str, attribute: str = NO_ATTRIBUTE) -> str:
    return struct(id=f"{n}.id", parent=f"{n}.parent", reading=lit(reading), attribute=attribute, raw=value)


def _origin(source: str, extractor: str, field: str, value: str, selector: str = NO_SELECTOR, row_id: str = NO_ROW) -> str:
    return struct(
        extractor=lit(extractor), field=field, value=value, selector=selector, row_id=row_id,
        id=f"{source}.id", parent=f"{source}.parent", reading=f"{source}.reading", attribute=f"{source}.attribute",
    )


def _results(selector: Selector, nodes: str, found: str) -> list[str]:
    """What a selector may take in the first round, in order."""

    def as_text(candidates: str) -> str:
        return let(first(candidates), lambda n: f"case when {n} is not null then {_source(n, f'{n}.text', 'text')} end")

    if selector.take == "text":
        return [as_text(own_text_nodes(nodes, found))]
    if selector.take == "deep":
        return [as_text(own_text_nodes(nodes, found)), as_text(keep(below(nodes, found), is_text))]
    having = keep(found, lambda n: f"{attr(n, selector.take)} is not null")
    source = let(
        first(having), lambda n: f"case when {n} is not null then {_source(n, attr(n, selector.take), 'attribute', lit(selector.take))} end"
    )
    return [source]


def main_origins(nodes: str, selectors: dict[str, list[Selector]] = FIELD_SELECTORS, clean_urls: bool = True) -> str:
    """Origins of the values of ``fields.main_fields``, with the number of the selector."""

    def of(field: str, chain: list[Selector], among: str) -> str:
        keep_whole = field in URL_FIELDS and not clean_urls

        def pick(m: str) -> str:
            found = [f"{m}[{i}]" for i in range(len(chain))]
            none = " and ".join(f"size({f}) = 0" for f in found)
            tried = [(i, r) for i, s in enumerate(chain) for r in _results(s, nodes, found[i])]
            tried += [
                (i, let(first(f), lambda n: f"case when {n} is not null then {_source(n, string_value(nodes, n), 'whole')} end"))
                for i, f in enumerate(found)
            ]
            numbered = "array(" + ", ".join(struct(number=f"{i}L", source=s) for i, s in tried) + ")"
            chosen = first(keep(numbered, lambda t: f"{strip(f'{t}.source.raw')} <> ''"))

            def made(t: str) -> str:
                raw = f"{t}.source.raw"
                value = f"nullif({strip(raw) if keep_whole else clean_text(raw)}, '')"
                return _origin(f"{t}.source", "main", lit(field), value, selector=f"{t}.number")

            return f"if({none}, NULL, {let(chosen, made)})"

        return let(f"array({', '.join(s.matches(among) for s in chain)})", pick)

    def all_of(among: str) -> str:
        return "array(" + ", ".join(of(f, chain, among) for f, chain in selectors.items() if chain) + ")"

    found = let(touched(nodes, [s for chain in selectors.values() for s in chain]), all_of)
    return keep(found, lambda o: f"{o}.value is not null")


def paragraph_origins(nodes: str, content_type: str = "movies") -> str:
    """Origins of the values of ``fields.paragraph_fields``: a text node, or a whole paragraph."""

    def candidates(paragraphs: str) -> str:
        own = each(own_text_nodes(nodes, paragraphs), lambda n: _source(n, strip(f"{n}.text"), "text"))
        whole = each(paragraphs, lambda p: _source(p, strip(string_value(nodes, p)), "whole"))
        return keep(f"concat({own}, {whole})", lambda s: is_paragraph_length(f"{s}.raw"))

    def once(sources: str) -> str:
        # a paragraph of plain text is there as its own text and as a whole; the first of equal texts is the one that counts
        return let(f"{sources}.raw", lambda raws: f"filter({sources}, (s, i) -> array_position({raws}, s.raw) = i + 1)")

    def hits(sources: str) -> str:
        matched = each(sources, lambda s: struct(source=s, match=match_field(f"{s}.raw", content_type)))
        return keep(matched, lambda h: f"{h}.match.field is not null and {h}.match.score > {PARAGRAPH_MIN_SCORE}")

    def first_of_each(found: str) -> str:
        def of(field: str) -> str:
            hit = first(keep(found, lambda h: f"{h}.match.field = {field}"))
            made = lambda h: _origin(f"{h}.source", "paragraph", field, clean_text(f"{h}.source.raw"))
            return let(hit, lambda h: f"if({h} is null, NULL, {made(h)})")

        return keep(each(f"array({lits(field_names(content_type))})", of), lambda o: f"{o} is not null")

    paragraphs = Selector("p", inside=Selector("div", "entry-content")).matches(nodes)
    return let(let(let(let(paragraphs, candidates), once), hits), first_of_each)


def table_origins(nodes: str, content_type: str = "movies", align: str = "text") -> str:
    """Origins of the values of ``tables.table_items``: a cell each, with the row it stands in."""

    def row_origins(row: str, headers: str) -> str:
        def cell(c: str, i: str) -> str:
            return _origin(_source(c, "''", "cell"), "table", f"get({headers}, {i})", cell_text(nodes, c), row_id=f"{row}.id")

        cells = each_indexed(elements(subtree(nodes, row), "td"), cell)
        named = keep(cells, lambda o: f"{o}.value <> '' and {o}.field in ({lits(ITEM_FIELDS)})")
        # of several cells under one field the last one counts
        last_ones = lambda os: keep(os, lambda o: f"not {some(os, lambda p: f'{p}.field = {o}.field and {p}.id > {o}.id')}")
        return let(named, lambda os: f"if(size(array_distinct({os}.field)) = size({os}), {os}, {last_ones(os)})")

    def one_table(table: str) -> str:
        def rows(part: str) -> str:
            headers = map_headers(header_texts(nodes, part, align), content_type)
            return let(headers, lambda h: f"if(size({h}) > 0, flatten({each(body_rows(part), lambda r: row_origins(r, h))}), NULL)")

        return let(skeleton(nodes, table), rows)

    return f"flatten({keep(each(elements(nodes, 'table'), one_table), lambda os: f'{os} is not null')})"


def _step(nodes: str, a: str) -> str:
    """The last step of the path of a node."""
    siblings = keep(f"slice({nodes}, {a}.parent + 2, {a}.id - {a}.parent)", lambda t: f"{is_text(t)} and {t}.parent = {a}.parent")
    return f"if({is_text(a)}, concat('/text()[', size({siblings}), ']'), concat('/*[', {a}.sib + 1, ']'))"


def element_path(nodes: str, n: str) -> str:
    """Path of an element from the root of the page; empty for no element."""

    def up(acc: str) -> str:
        climbed = let(f"get({nodes}, {acc}.id)", lambda a: struct(id=f"{a}.parent", path=f"concat('/*[', {a}.sib + 1, ']', {acc}.path)"))
        return f"if({acc}.id < 0, {acc}, {climbed})"

    above = each(f"concat({keep(nodes, lambda a: is_below(n, a))}, array({n}))", lambda a: _step(nodes, a))
    walked = lambda steps, start: f"aggregate(sequence(1, {steps}), {start}, (acc, i) -> {up('acc')})"
    few = walked(FEW, struct(id=f"coalesce({n}.id, -1)", path=lit("")))
    walk = let(few, lambda w: f"if({w}.id < 0, {w}, {walked(WALKED - FEW, w)})")
    return let(walk, lambda w: f"if({w}.id < 0, {w}.path, array_join({above}, ''))")


def field_origins(parsed: DataFrame, *origins: str) -> DataFrame:
    """``page_id, extractor, field, value, row_id, selector, source_url, html_hash, reading, path``.

    ``parsed`` keeps its markup; ``origins`` are expressions of this module. One row for each value, also when two
    extractors find the same. ``row_id`` is the table row, ``selector`` the number of the main selector, else NULL. A page
    without markup or without a value has no rows.
    """

    def with_path(o: str, parents: str, paths: str) -> str:
        end = f"if({o}.attribute is null, '', concat('/@', {o}.attribute))"
        above = f"get({paths}, cast(array_position({parents}, {o}.parent) as int) - 1)"
        path = f"concat({above}, {let(f'get(nodes, {o}.id)', lambda n: _step('nodes', n))}, {end})"
        names = ("extractor", "field", "value", "row_id", "selector")
        return struct(**{c: f"{o}.{c}" for c in names}, reading=f"{o}.reading", path=path)

    def with_paths(found: str) -> str:
        # values often stand side by side, so the way up from a parent is gone once
        paths = lambda ps: each(ps, lambda p: let(f"get(nodes, {p})", lambda n: element_path("nodes", n)))
        return let(f"array_distinct({found}.parent)", lambda ps: let(paths(ps), lambda up: each(found, lambda o: with_path(o, ps, up))))

    rows = parsed.select(
        "page_id",
        F.col("url").alias("source_url"),
        F.sha2("html", 256).alias("html_hash"),
        F.explode(F.expr(let(f"concat({', '.join(origins)})", with_paths))).alias("o"),
    )
    found = [f"o.{c}" for c in ("extractor", "field", "value", "row_id", "selector")]
    return rows.select("page_id", *found, "source_url", "html_hash", "o.reading", "o.path")


def _places(nodes: str) -> str:
    """Of each node, one number made of its parent and its place among the elements there; NULL for a text."""
    return each(nodes, lambda n: f"{n}.parent * 4294967296L + {n}.sib")


def _followed(nodes: str, places: str, path: str) -> str:
    """The node that a path without its attribute leads to, NULL when the page has none."""

    def down(at: str, step: str) -> str:
        place = f"cast(regexp_extract({step}, '[0-9]+', 0) as int)"
        start = f"if({at} < 0, {nodes}, {let(f'get({nodes}, {at})', lambda n: subtree(nodes, n))})"
        texts = keep(start, lambda c: f"{c}.parent = {at} and {is_text(c)}")
        element = f"cast(nullif(array_position({places}, {at} * 4294967296L + {place} - 1), 0) - 1 as int)"
        return f"if({at} is null, NULL, if({step} like 'text%', get({texts}, {place} - 1).id, {element}))"

    steps = f"filter(split({path}, '/'), s -> s <> '' and not startswith(s, '@'))"
    return f"get({nodes}, aggregate({steps}, -1, (at, step) -> {down('at', 'step')}))"


def values_at(rows: DataFrame, parsed: DataFrame, clean_urls: bool = True) -> DataFrame:
    """Adds ``again``: the value read anew at each path in the pages of the same ``page_id``, NULL when it is not there.

    ``parsed`` holds ``nodes``, or else the ``html`` of the pages, which is then parsed behind the join: markup is moved, a
    fraction of its nodes. The paths of a page are brought together, so that it is moved once. ``page_id`` names one page.
    Spark cannot know the size of markup and nodes and takes the pages for a small table, so the join is a merge join:
    no pages are gathered on the driver.
    """
    names = [c for c in rows.columns if c != "page_id"]
    asked = rows.groupBy("page_id").agg(F.collect_list(F.struct(*names)).alias("asked"))

    def raw(o: str, n: str) -> str:
        attribute = f"{n}.attrs[regexp_extract({o}.path, '@(.*)$', 1)]"
        cell = cell_text("nodes", n)
        return f"case {o}.reading when 'text' then {n}.text when 'attribute' then {attribute} when 'cell' then {cell} else {string_value('nodes', n)} end"

    def read(o: str, places: str) -> str:
        def cleaned(v: str) -> str:
            whole = "false" if clean_urls else f"{o}.field in ({lits(URL_FIELDS)}) and {o}.extractor = 'main'"
            # a paragraph is stripped before it is cleaned
            return f"case when {v} is null then NULL when {o}.reading = 'cell' then {v} when {whole} then {strip(v)} else {clean_text(v)} end"

        return let(_followed("nodes", places, f"{o}.path"), lambda n: f"if({n} is null, NULL, {let(raw(o, n), cleaned)})")

    stored = "nodes" if "nodes" in parsed.columns else "html"
    both = asked.join(parsed.select("page_id", stored).hint("merge"), "page_id", "left")
    if stored == "html":
        both = parse_pages(both)
    read_all = let(_places("nodes"), lambda places: each("asked", lambda o: struct(o=o, again=read(o, places))))
    answers = both.select("page_id", F.explode(F.expr(read_all)).alias("a"))
    return answers.select("page_id", "a.o.*", "a.again")
