"""HTML tables as rows of catalogue fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.dom import below, cell_text, elements, own_texts, string_value, subtree
from pagequarry.functions.labels import match_field
from pagequarry.functions.sql import each, each_indexed, keep, last, let, lits, struct
from pagequarry.functions.text import strip
from pagequarry.schema import ITEM_FIELDS


def skeleton(nodes: str, table: str) -> str:
    """The descendants of a table that headers and rows are found by."""
    return elements(subtree(nodes, table), "th", "td", "tr", "thead", "tbody")


def header_texts(nodes: str, part: str, align: str = "text") -> str:
    """Headers of a table; ``part`` holds its descendants, or those of them that are cells, rows and parts of tables.

    Cells of ``thead``, else cells of a first row.  ``align='text'`` gives one
    header per text node, so an empty header cell shifts the columns after it;
    ``align='cell'`` gives one per cell.
    """

    def of(cells: str) -> str:
        if align == "cell":
            return each(cells, lambda c: strip(string_value(nodes, c)))
        return each(own_texts(nodes, cells), strip)

    def pick(cells: str) -> str:
        first_rows = keep(part, lambda n: f"{n}.tag = 'tr' and {n}.sib = 0")
        in_head = let(below(cells, elements(part, "thead")), of)
        in_first_row = let(below(cells, first_rows), of)
        return let(in_head, lambda head: f"if(size({head}) > 0, {head}, {in_first_row})")

    return let(elements(part, "th", "td"), pick)


def body_rows(part: str) -> str:
    """Rows of the table bodies, else all rows but the first."""

    def pick(rows: str) -> str:
        return let(
            below(rows, elements(part, "tbody")),
            lambda body: f"if(size({body}) > 0, {body}, slice({rows}, 2, greatest(size({rows}), 1)))",
        )

    return let(elements(part, "tr"), pick)


def map_headers(headers: str, content_type: str) -> str:
    """The field of each header, NULL for none."""
    return each(headers, lambda h: f"{match_field(h, content_type)}.field")


def table_items(nodes: str, content_type: str = "movies", align: str = "text") -> str:
    """``array<struct<table_id, row_id, values map>>`` over all tables of a page, nested ones included."""
    def row_values(row: str, fields: str) -> str:
        texts = each(
            elements(subtree(nodes, row), "td"), lambda c: cell_text(nodes, c)
        )
        # a cell past the headers gets no field; a blank one is skipped
        cells = each_indexed(texts, lambda t, i: struct(field=f"get({fields}, {i})", value=t))
        return keep(cells, lambda e: f"{e}.value <> '' and {e}.field in ({lits(ITEM_FIELDS)})")

    def as_map(entries: str) -> str:
        def values(keys: str) -> str:
            chosen = each(keys, lambda f: f"{last(keep(entries, lambda e: f'{e}.field = {f}'))}.value")
            # with a field to each cell there is nothing to choose
            return f"map_from_arrays({keys}, if(size({keys}) = size({entries}), {entries}.value, {chosen}))"

        return let(f"array_distinct({entries}.field)", values)

    def rows_of(table: str, part: str, fields: str) -> str:
        def one(row: str) -> str:
            return let(
                row_values(row, fields),
                lambda e: struct(table_id=f"{table}.id", row_id=f"{row}.id", values=as_map(e)),
            )

        return keep(each(body_rows(part), one), lambda r: f"size({r}.values) > 0")

    def one_table(table: str) -> str:
        return let(
            skeleton(nodes, table),
            lambda part: let(
                map_headers(header_texts(nodes, part, align), content_type),
                lambda fields: f"if(size({fields}) > 0, {rows_of(table, part, fields)}, NULL)",
            ),
        )

    tables = each(elements(nodes, "table"), one_table)
    return f"flatten({keep(tables, lambda rows: f'{rows} is not null')})"


def extract_tables(parsed: DataFrame, content_type: str = "movies", align: str = "text") -> DataFrame:
    """``page_id, url, table_id, row_id`` and the item fields, one row per table row."""
    rows = parsed.select("page_id", "url", F.inline(F.expr(table_items("nodes", content_type, align))))
    return rows.select("page_id", "url", "table_id", "row_id", *[F.col("values")[f].alias(f) for f in ITEM_FIELDS])
