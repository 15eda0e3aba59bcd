"""The jobs a user runs: one parse of the pages, everything else in the same pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.dom import Selector
from pagequarry.functions.sql import let, override
from pagequarry.operators.candidates import picked_block
from pagequarry.operators.classify import CATALOGUE_RULES, THRESHOLDS, Rule, with_class
from pagequarry.operators.fields import FIELD_SELECTORS, main_fields, page_fields, paragraph_fields
from pagequarry.operators.links import link_array, next_page, rejects, valid_links
from pagequarry.operators.parse import parse_pages
from pagequarry.operators.tables import table_items
from pagequarry.operators.validate import check_items
from pagequarry.schema import ITEM_FIELDS


def classify_pages(
    pages: DataFrame,
    rules: list[Rule] = CATALOGUE_RULES,
    thresholds: Mapping[str, int] = THRESHOLDS,
    mode: str = "as_coded",
) -> DataFrame:
    """``page_id, url, stats.*, rules, score, page_type``."""
    classed = with_class(parse_pages(pages), rules, thresholds, mode)
    return classed.select("page_id", "url", "stats.*", "rules", "score", "page_type")


def extract_all(
    pages: DataFrame,
    content_type: str = "movies",
    selectors: dict[str, list[Selector]] = FIELD_SELECTORS,
    clean_urls: bool = True,
) -> DataFrame:
    """Links, main fields, paragraph fields, both merged, and table items, one row per page."""
    found = parse_pages(pages).select(
        "page_id",
        "url",
        F.expr(valid_links(link_array("nodes", "url"))).alias("links"),
        F.expr(main_fields("nodes", selectors, clean_urls)).alias("main_fields"),
        F.expr(paragraph_fields("nodes", content_type)).alias("paragraph_fields"),
        F.expr(table_items("nodes", content_type)).alias("items"),
        "error",
    )
    return found.withColumn("fields", F.expr(override("main_fields", "paragraph_fields")))


def process_pages(
    pages: DataFrame,
    content_type: str = "movies",
    selectors: dict[str, list[Selector]] = FIELD_SELECTORS,
    clean_urls: bool = True,
    rules: list[Rule] = CATALOGUE_RULES,
    thresholds: Mapping[str, int] = THRESHOLDS,
    mode: str = "as_coded",
    keep: tuple[str, ...] = (),
    min_evidence: int = 0,
) -> DataFrame:
    """Route every page and extract what its type calls for.

    ``page_id, url, page_type, links, rejected, next_page, fields, from_block, error``.
    A page that is neither catalogue nor detail is read as a detail page made of
    its best candidate block; without one it stays ``unknown``.  Each page is parsed once, a block is a slice of its
    nodes; no shuffle.  A page without markup has an
    error, no type and no fields.  Columns named in ``keep`` go along.  With ``min_evidence``, a block is
    a candidate only if it shows so many of title, year and director.
    """
    block = picked_block("nodes", min_evidence=min_evidence, content_type=content_type)
    classed = with_class(parse_pages(pages, keep_html="html" in keep), rules, thresholds, mode)
    routed = classed.withColumn("page_type", F.expr("if(error is null, page_type, NULL)"))
    routed = routed.withColumn("block", F.expr(f"if(page_type = 'unknown', {block}, NULL)"))
    routed = routed.withColumn("all_links", F.expr(f"if(page_type = 'catalogue', {link_array('nodes', 'url')}, NULL)"))
    # the nodes that fields are read from: of a detail page all, else those of the block
    source = "if(page_type = 'detail', nodes, block.nodes)"
    fields = let(source, lambda n: f"if({n} is null, NULL, {page_fields(n, selectors, content_type, clean_urls)})")
    return routed.selectExpr(
        "page_id",
        "url",
        "if(block is null, page_type, 'detail') as page_type",
        f"{valid_links('all_links')} as links",
        f"{rejects('all_links')} as rejected",
        f"if(page_type = 'catalogue', {next_page('nodes')}, NULL) as next_page",
        f"{fields} as fields",
        "block is not null as from_block",
        "error",
        *keep,
    )


def item_columns(fields: Column) -> list[Column]:
    """The item fields of a field map as columns, any others left in ``extra``."""
    known = [fields[f].alias(f) for f in ITEM_FIELDS]
    return [*known, F.map_filter(fields, lambda k, v: ~k.isin(*ITEM_FIELDS)).alias("extra")]


def detail_items(processed: DataFrame) -> DataFrame:
    """One raw item per detail page, before validation."""
    details = processed.filter(F.col("page_type") == "detail")
    return details.select("page_id", "url", *item_columns(F.col("fields")))


def validate_items(items: DataFrame, as_of_year: int, mode: str = "strict", local_digits: bool = False) -> DataFrame:
    return check_items(items, as_of_year, mode, local_digits)


def run_counters(processed: DataFrame) -> DataFrame:
    """One row: pages, items before validation, rejected links, pages that failed."""
    return processed.agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("page_type") == "detail").alias("items_scraped"),
        F.coalesce(F.sum(F.size("rejected")), F.lit(0)).alias("invalid_links"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def run_summary(
    processed: DataFrame,
    name: str,
    start_time: str,
    end_time: str,
    close_reason: str,
    items_path: str | None = None,
    errors_path: str | None = None,
    warnings: list[str] | None = None,
) -> DataFrame:
    """The run as one row.  Failed pages are counted here and listed in a table
    of their own, as a list of them has no bound."""
    start, end = F.lit(start_time).cast("timestamp"), F.lit(end_time).cast("timestamp")
    return run_counters(processed).select(
        F.lit(name).alias("spider_name"),
        start.alias("start_time"),
        end.alias("end_time"),
        (F.unix_micros(end) - F.unix_micros(start)).cast("double").__truediv__(1e6).alias("runtime_seconds"),
        "items_scraped",
        "invalid_links",
        F.array(*[F.lit(w) for w in warnings or []]).cast("array<string>").alias("warnings"),
        "errors",
        F.lit(items_path).cast("string").alias("movies_output_file"),
        F.lit(errors_path).cast("string").alias("errors_file"),
        F.lit(close_reason).alias("close_reason"),
    )
