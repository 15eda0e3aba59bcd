"""Curating a catalogue of records: merging sources, provenance, quality, drift, retries, search.

Items are rows with ``item_id, source_url, trust`` and the item fields they have. Groups by title and year are
reduced by partial aggregates, so a title that very many sources share meets as one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.dom import Selector, select_value
from pagequarry.functions.sql import lit
from pagequarry.functions.urls import host_of
from pagequarry.operators.fields import FIELD_SELECTORS

FIELDS = ("title", "year", "director", "genre")
NEEDED = ("title", "year", "director")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = r"(?<![\w.])\+?\d(?:[ ()./-]{0,2}\d){6,14}(?![\w])"


def title_key(title: Column) -> Column:
    """Lower case, letters and digits with single blanks."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{M}\p{N}]+", " "))


def merge_items(items: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One record for each title and year: ``title_key, year, <fields>, n_sources``.

    Each field comes from the most trusted source that has it; of equally trusted ones, from the smallest
    ``item_id``. Items without a title or year are left out, as they name no record.
    """
    rank = F.struct("trust", -F.col("item_id"))
    best = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), rank)).alias(f) for f in fields if f != "year"]
    keyed = items.withColumn("title_key", title_key(F.col("title"))).where("title_key <> '' and year is not null")
    return keyed.groupBy("title_key", "year").agg(*best, F.count("*").alias("n_sources"))


def provenance(parsed: DataFrame, fields: str, selectors: str = "cast(map() as map<string, bigint>)") -> DataFrame:
    """Where each value came from: ``page_id, field, value, source_url, selector, html_hash``; ``parsed`` keeps its markup.

    ``selectors`` gives the number of the selector of each field, as ``fields.main_selectors`` does; ``selector``
    is NULL for a field that it does not name.
    """
    found = parsed.select(
        "page_id", F.col("url").alias("source_url"), F.sha2("html", 256).alias("html_hash"), F.expr(fields).alias("f"), F.expr(selectors).alias("s")
    )
    rows = found.select("page_id", F.explode("f").alias("field", "value"), "source_url", "s", "html_hash")
    return rows.select("page_id", "field", "value", "source_url", F.try_element_at("s", "field").alias("selector"), "html_hash")


def with_enrichment(items: DataFrame, needed: tuple[str, ...] = NEEDED) -> DataFrame:
    """Adds ``title_only`` and ``enrichment_needed``."""
    others = [f for f in FIELDS if f != "title"]
    empty = F.lit(True)
    for f in others:
        empty = empty & F.col(f).isNull()
    missing = F.lit(False)
    for f in needed:
        missing = missing | F.col(f).isNull()
    return items.withColumn("title_only", F.col("title").isNotNull() & empty).withColumn("enrichment_needed", missing)


def retry_queue(errors: DataFrame, max_attempts: int) -> DataFrame:
    """Failed URLs with attempts left: ``url, attempts``; ``errors`` has a row for each failure."""
    return errors.groupBy("url").agg(F.count("*").alias("attempts")).where(F.col("attempts") < max_attempts)


def at_most_per_domain(pages: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` pages of each host by ``page_id``; a limit only because the caller asks for one."""
    hosts = pages.withColumn("host", F.expr(host_of("url")))
    order = Window.partitionBy("host").orderBy("page_id")
    return hosts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")


def quality_report(items: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One pass, one row a field: ``field, n_rows, n_missing, min_length, max_length``."""
    measures = [
        F.struct(
            F.lit(f).alias("field"),
            F.count("*").alias("n_rows"),
            F.count_if(F.col(f).isNull() | (F.col(f) == "")).alias("n_missing"),
            F.min(F.length(f)).cast("long").alias("min_length"),
            F.max(F.length(f)).cast("long").alias("max_length"),
        ).alias(f"m_{f}")
        for f in fields
    ]
    one = items.agg(*measures)
    return one.select(F.inline(F.array(*[F.col(f"m_{f}") for f in fields])))


def kpis(items: DataFrame, fields: tuple[str, ...] = FIELDS, crawled: DataFrame | None = None) -> DataFrame:
    """One row: ``n_items, title_only_ratio, provenance_coverage, avg_fields``.

    With ``crawled``, the result of ``frontier.crawl``, also ``median_depth`` of the stored pages that were
    reached, each once; NULL when there is none.
    """
    filled = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))
    row = with_enrichment(items).agg(
        F.count("*").alias("n_items"),
        F.avg(F.col("title_only").cast("double")).alias("title_only_ratio"),
        F.avg(F.col("source_url").isNotNull().cast("double")).alias("provenance_coverage"),
        F.avg(filled.cast("double")).alias("avg_fields"),
    )
    if crawled is None:
        return row
    depths = crawled.where("page_type is not null").groupBy("url").agg(F.min("depth").alias("depth"))
    return row.crossJoin(depths.agg(F.percentile("depth", F.lit(0.5)).alias("median_depth")))


def shape_hash(parsed: DataFrame) -> DataFrame:
    """``url, shape``: a hash of the element tags of a page in order."""
    tags = F.array_join(F.transform(F.filter("nodes", lambda n: n["tag"] != "#text"), lambda n: n["tag"]), " ")
    return parsed.select("url", F.sha2(tags, 256).alias("shape"))


def drift(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``url, status``: ``same``, ``changed``, ``new`` or ``gone`` against the last snapshot of shapes."""
    old, now = previous.select("url", F.col("shape").alias("was")), current.select("url", F.col("shape").alias("is"))
    status = (
        F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(F.col("was") == F.col("is"), "same").otherwise("changed")
    )
    return old.join(now, "url", "full").select("url", status.alias("status"))


def scrubbed(text: Column) -> Column:
    """E-mail addresses and telephone numbers replaced by their kind."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "[email]"), PHONE, "[phone]")


def upsert_items(existing: DataFrame, incoming: DataFrame, seen: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Items by title and year after a run: ``title_key, year, <fields>, first_seen, last_seen``.

    A newer value replaces an older one, a missing one does not. Both inputs may hold a key more than once.
    """
    rest = [f for f in fields if f != "year"]
    fresh = incoming.select(*fields, "item_id", F.lit(seen).alias("first_seen"), F.lit(seen).alias("last_seen"))
    both = existing.select(*fields, "item_id", "first_seen", "last_seen").unionByName(fresh)
    keyed = both.withColumn("title_key", title_key(F.col("title"))).where("title_key <> '' and year is not null")
    rank = F.struct("last_seen", -F.col("item_id"))
    newest = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), rank)).alias(f) for f in rest]
    return keyed.groupBy("title_key", "year").agg(*newest, F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def item_history(runs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The values of each item over time: ``item_id, <fields>, valid_from, valid_to, changed``.

    ``runs`` holds a row for each item and run, with the run's time as ``seen``. A row stands for the time from the run
    that brought its values to the next run that brought others; ``valid_to`` is NULL while they hold, and ``changed``
    names the fields that differ from the row before. A NULL value differs from any other. Of several rows of an item
    in one run the least counts. An item that a run does not hold keeps its values.
    """
    values = F.struct(*fields)
    once = runs.groupBy("item_id", "seen").agg(F.min(values).alias("v"))
    order = Window.partitionBy("item_id").orderBy("seen")
    before = once.withColumn("was", F.lag("v").over(order))
    differs = [F.when(~F.col(f"v.{f}").eqNullSafe(F.col(f"was.{f}")), F.lit(f)) for f in fields]
    changed = F.when(F.col("was").isNull(), F.lit("")).otherwise(F.concat_ws(",", *differs))
    kept = before.withColumn("changed", changed).where("was is null or changed <> ''")
    return kept.select("item_id", "v.*", F.col("seen").alias("valid_from"), F.lead("seen").over(order).alias("valid_to"), "changed")


def likely_items(items: DataFrame, at_least: int = 2) -> DataFrame:
    """Records with at least two of title, year and director."""
    held = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in NEEDED), F.lit(0))
    return items.where(held >= at_least)


def selector_success(parsed: DataFrame, selectors: dict[str, list[Selector]] = FIELD_SELECTORS) -> DataFrame:
    """``field, selector, hit_rate, rank``: how often each selector alone gives a value, best first in its field."""
    hits = [
        f"named_struct('field', {lit(field)}, 'selector', {i}L, 'hit', {select_value('nodes', [s])} is not null)"
        for field, chain in selectors.items()
        for i, s in enumerate(chain)
    ]
    rows = parsed.select(F.inline(F.expr(f"array({', '.join(hits)})")))
    rates = rows.groupBy("field", "selector").agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"))
    # as many rows as there are selectors
    order = Window.partitionBy("field").orderBy(F.desc("hit_rate"), "selector")
    return rates.withColumn("rank", F.row_number().over(order).cast("long"))


def search_titles(items: DataFrame, words: str) -> DataFrame:
    """Items whose title holds every word of ``words``: ``item_id, title``."""
    wanted = sorted(set(words.lower().split()))
    tokens = F.split(title_key(F.col("title")), " ")
    return items.where(F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in wanted]).cast("array<string>"))) == len(wanted)).select(
        "item_id", "title"
    )


def export_items(items: DataFrame, path: str, condition: str) -> None:
    """The items that meet an SQL condition, as JSON lines."""
    items.where(condition).write.mode("overwrite").json(path)
