"""Extraction for SQL users: functions of a session, called by name on a column of markup.

``page_nodes(html)`` parses a page; ``page_links``, ``page_fields``, ``page_tables`` and the others are SQL functions over it
and stay built-in expressions after it. ``page_parts(html, url)`` is a table function that gives one row a page::

    select p.url, t.* from pages p, lateral page_parts(p.html, p.url) parts
    lateral view outer inline(parts.tables) t where t.row_id is not null

Spark folds it into the scan of ``pages``: no join, no shuffle, and only the parts that are asked for are worked out.
Without ``outer`` the answer is the same, but Spark first filters on the array's size and parses every page twice.
A table function that gave a row for each table row would have Spark join the pages with themselves on their markup.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.sql import override
from pagequarry.operators.fields import main_fields, paragraph_fields
from pagequarry.operators.links import link_array, next_page, rejects, valid_links
from pagequarry.operators.parse import nodes_of
from pagequarry.operators.tables import table_items
from pagequarry.schema import NODES


@F.arrow_udf(NODES)
def page_nodes(html: pa.Array) -> pa.Array:
    """The nodes of each page; none for a page without markup or one that cannot be parsed."""
    return nodes_of(html)


def parts(content_type: str = "movies", clean_urls: bool = True) -> dict[str, str]:
    """What is read from a page, by name: expressions over ``nodes`` and ``url``."""
    main, labelled = main_fields("nodes", clean_urls=clean_urls), paragraph_fields("nodes", content_type)
    return {
        "links": valid_links(link_array("nodes", "url")),
        "rejected": rejects(link_array("nodes", "url")),
        "next_page": next_page("nodes"),
        "main_fields": main,
        "paragraph_fields": labelled,
        "fields": override(main, labelled),
        "tables": table_items("nodes", content_type),
    }


def register_functions(spark: SparkSession, content_type: str = "movies", clean_urls: bool = True) -> list[str]:
    """Makes the functions known to the session and returns their names; a second call replaces them.

    ``page_nodes(html)``; ``page_<part>(html, url)`` for each of ``parts``, where ``url`` matters to links only and
    may be left out; ``page_parts(html, url)``, a table function with all parts in one row, to be used laterally.
    NULL or empty markup has empty arrays and maps and a NULL next page.
    """
    spark.udf.register("page_nodes", page_nodes)
    known = spark.createDataFrame([], f"nodes {NODES.simpleString()}, url string")
    columns, names = [], ["page_nodes"]
    for name, expression in parts(content_type, clean_urls).items():
        kind = known.selectExpr(expression).schema[0].dataType.simpleString()
        arguments = f"nodes {NODES.simpleString()}, url string"
        spark.sql(f"create or replace temporary function nodes_{name}({arguments}) returns {kind} return {expression}")
        call = f"nodes_{name}(page_nodes(html), url)"
        spark.sql(f"create or replace temporary function page_{name}(html string, url string default NULL) returns {kind} return {call}")
        columns.append((name, kind))
        names += [f"nodes_{name}", f"page_{name}"]
    table = ", ".join(f"{name} {kind}" for name, kind in columns)
    calls = ", ".join(f"nodes_{name}(nodes, page_parts.url) as {name}" for name, _ in columns)
    body = f"select {calls} from (select page_nodes(html) as nodes)"
    spark.sql(f"create or replace temporary function page_parts(html string, url string) returns table({table}) return {body}")
    return [*names, "page_parts"]
