"""Page statistics, catalogue rules, score and page type."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.dom import below, elements
from pagequarry.functions.sql import let, struct

# The thresholds of the rules.
THRESHOLDS = {
    "link_heavy_min_links": 50,
    "link_heavy_max_iframes": 0,
    "text_heavy_min_paragraphs": 50,
    "text_heavy_max_images": 5,
    "fallback_min_links": 30,
    "fallback_max_images": 5,
    "table_min_rows": 3,
    "score_threshold": 4,
}
# Fixed value: a page with a frame and fewer links than this looks like a detail page.
DETAIL_MAX_LINKS = 30

STATS = ["links", "images", "iframes", "paragraphs", "tables", "table_rows"]


@dataclass(frozen=True)
class Rule:
    """A named test over the page statistics; ``test(stats, thresholds)`` gives a boolean Column."""

    name: str
    test: Callable[[Mapping[str, Column], Mapping[str, int]], Column]
    weight: int


def detail_like(s: Mapping[str, Column]) -> Column:
    return ~((s["iframes"] >= 1) & (s["links"] < DETAIL_MAX_LINKS))


def link_heavy(s, t) -> Column:
    return (s["links"] > t["link_heavy_min_links"]) & (s["iframes"] <= t["link_heavy_max_iframes"])


def text_heavy(s, t) -> Column:
    return (s["paragraphs"] > t["text_heavy_min_paragraphs"]) & (s["images"] <= t["text_heavy_max_images"])


def table_catalogue(s, t) -> Column:
    return (s["tables"] >= 1) & (s["table_rows"] >= t["table_min_rows"])


def fallback_links(s, t) -> Column:
    return (s["links"] > t["fallback_min_links"]) & (s["images"] <= t["fallback_max_images"])


# The weights.
CATALOGUE_RULES = [
    Rule("link_heavy", link_heavy, 2),
    Rule("text_heavy", text_heavy, 2),
    Rule("table_catalogue", table_catalogue, 3),
    Rule("fallback_links", fallback_links, 1),
]


def stats_struct(nodes: str) -> str:
    """Element counts of a page; ``table_rows`` are the rows in table bodies, or all rows when there are none."""

    def rows_under(part: str, containers: str) -> str:
        return f"size({below(elements(part, 'tr'), containers)})"

    def table_rows(part: str) -> str:
        bodies = below(elements(part, "tbody"), elements(part, "table"))
        return let(
            rows_under(part, bodies),
            lambda body: f"cast(if({body} > 0, {body}, {rows_under(part, elements(part, 'table'))}) as bigint)",
        )

    def build(tags: str) -> str:
        def count(tag: str) -> str:
            return f"cast(size({tags}) - size(array_remove({tags}, '{tag}')) as bigint)"

        return struct(
            links=count("a"),
            images=count("img"),
            iframes=count("iframe"),
            paragraphs=count("p"),
            tables=count("table"),
            table_rows=f"if(array_contains({tags}, 'table'), {let(elements(nodes, 'table', 'tbody', 'tr'), table_rows)}, 0L)",
        )

    return let(f"coalesce({nodes}.tag, array())", build)


def page_stats(parsed: DataFrame) -> DataFrame:
    """One row per page, pages without any element included."""
    return parsed.select("page_id", "url", F.expr(stats_struct("nodes")).alias("s")).select("page_id", "url", "s.*")


def rule_results(
    stats: Mapping[str, Column], rules: list[Rule] = CATALOGUE_RULES, thresholds: Mapping[str, int] = THRESHOLDS
) -> Column:
    """``array<struct<name, passed, weight>>``; a rule that cannot be evaluated counts as failed."""

    def one(rule: Rule) -> Column:
        try:
            passed = F.coalesce(rule.test(stats, thresholds), F.lit(False))
        except Exception:
            passed = F.lit(False)
        return F.struct(F.lit(rule.name).alias("name"), passed.alias("passed"), F.lit(rule.weight).alias("weight"))

    return F.array(*[one(r) for r in rules])


def catalogue_score(results: Column, method: str = "sum") -> Column:
    """``weighted_average`` (0-100), ``strict_majority`` (boolean) or the sum of the passed weights."""

    def weight_of(rows: Column) -> Column:
        return F.aggregate(rows, F.lit(0).cast("long"), lambda total, r: total + r["weight"])

    passed = F.filter(results, lambda r: r["passed"])
    if method == "weighted_average":
        total = weight_of(results)
        return F.when(total == 0, F.lit(0.0)).otherwise(weight_of(passed) / total * 100)
    if method == "strict_majority":
        return F.size(passed) > F.size(results) / 2
    return weight_of(passed)


def page_type(stats: Mapping[str, Column], score: Column, thresholds: Mapping[str, int] = THRESHOLDS, mode: str = "as_coded") -> Column:
    """``catalogue``, ``detail`` or ``unknown``.

    ``as_coded`` scores only pages with a frame and few links and calls all
    others detail.  ``intended`` swaps the two sides of that gate.
    """
    high = score >= thresholds["score_threshold"]
    gate = detail_like(stats)
    if mode == "as_coded":
        return F.when(~gate & high, "catalogue").when(gate, "detail").otherwise("unknown")
    if mode == "intended":
        return F.when(gate & high, "catalogue").when(~gate, "detail").otherwise("unknown")
    raise ValueError(f"unknown mode {mode!r}")


def with_class(
    parsed: DataFrame,
    rules: list[Rule] = CATALOGUE_RULES,
    thresholds: Mapping[str, int] = THRESHOLDS,
    mode: str = "as_coded",
) -> DataFrame:
    """Add ``stats``, ``rules``, ``score`` and ``page_type`` to parsed pages."""
    stats = {name: F.col("stats")[name] for name in STATS}
    return (
        parsed.withColumn("stats", F.expr(stats_struct("nodes")))
        .withColumn("rules", rule_results(stats, rules, thresholds))
        .withColumn("score", catalogue_score(F.col("rules")))
        .withColumn("page_type", page_type(stats, F.col("score"), thresholds, mode))
    )
