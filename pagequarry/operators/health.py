"""How a catalogue and its crawl are doing: ranges of values, coverage by field, merged records, retries of failed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.operators.curate import FIELDS, title_key
from pagequarry.operators.validate import YEAR_MIN, YEARS_AHEAD

FIRST_WAIT_MINUTES = 30
LONGEST_WAIT_MINUTES = 7 * 24 * 60
MAX_ATTEMPTS = 5


def value_report(
    items: DataFrame, as_of_year: int, fields: tuple[str, ...] = FIELDS, ranges: dict[str, tuple[int, int]] | None = None
) -> DataFrame:
    """One pass, one row a field: ``field, n_rows, n_missing, missing_share, smallest, largest, n_not_whole, n_outside``.

    ``ranges`` gives the least and greatest whole number of a field; the year has its own unless one is given. ``smallest``
    and ``largest`` are the whole numbers of such a field, ``n_not_whole`` counts its values that are none and
    ``n_outside`` those outside the range; all four are NULL for other fields. NULL and blank values are missing. An empty
    table has no rows counted, a NULL share and NULL bounds.
    """
    known = {"year": (YEAR_MIN, as_of_year + YEARS_AHEAD), **(ranges or {})}
    measures = []
    for f in fields:
        value = F.nullif(F.trim(F.col(f).cast("string")), F.lit(""))
        whole = F.when(value.rlike(r"^[+-]?\d+$"), value.try_cast("long"))
        missing = F.count_if(value.isNull())
        none = F.lit(None).cast("long")
        low, high = known.get(f, (None, None))
        measures.append(
            F.struct(
                F.lit(f).alias("field"),
                F.count("*").alias("n_rows"),
                missing.alias("n_missing"),
                F.try_divide(missing, F.count("*")).alias("missing_share"),
                (F.min(whole) if f in known else none).alias("smallest"),
                (F.max(whole) if f in known else none).alias("largest"),
                (F.count_if(value.isNotNull() & whole.isNull()) if f in known else none).alias("n_not_whole"),
                (F.count_if(~whole.between(low, high)) if f in known else none).alias("n_outside"),
            ).alias(f"m_{f}")
        )
    one = items.agg(*measures)
    return one.select(F.inline(F.array(*[F.col(f"m_{f}") for f in fields])))


def alarms(report: DataFrame, most_missing: dict[str, float], most_bad: float = 0.0) -> DataFrame:
    """``field, reason, share``: fields of a ``value_report`` with too many missing or too many bad values.

    ``most_missing`` gives the tolerated share of missing values by field; ``most_bad`` that of values that are no whole
    number or outside their range, among those present.
    """
    limits = F.create_map(*[F.lit(x) for pair in most_missing.items() for x in (pair[0], float(pair[1]))]) if most_missing else None
    limit = F.try_element_at(limits, "field") if most_missing else F.lit(None).cast("double")
    bad = F.try_divide(F.col("n_not_whole") + F.col("n_outside"), F.col("n_rows") - F.col("n_missing"))
    found = F.array(
        F.when(F.col("missing_share") > limit, F.struct(F.lit("missing").alias("reason"), F.col("missing_share").alias("share"))),
        F.when(bad > most_bad, F.struct(F.lit("bad").alias("reason"), bad.alias("share"))),
    )
    return report.select("field", F.inline(F.array_compact(found)))


def field_coverage(values: DataFrame) -> DataFrame:
    """``field, n_values, n_sourced, coverage, n_pages`` of provenance rows: the share of a field's values with a source.

    ``values`` holds ``field, value, source_url, page_id``; NULL values are not counted, a blank source is none.
    """
    sourced = F.coalesce(F.trim("source_url"), F.lit("")) != ""
    counted = values.where("value is not null").groupBy("field", "page_id")
    # each page once before the pages of a field are counted
    once = counted.agg(F.count("*").alias("n"), F.count_if(sourced).alias("s"))
    totals = once.groupBy("field").agg(F.sum("n").alias("n_values"), F.sum("s").alias("n_sourced"), F.count("page_id").alias("n_pages"))
    return totals.withColumn("coverage", F.col("n_sourced") / F.col("n_values"))


def merge_kpis(items: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row about the records that ``curate.merge_items`` makes.

    ``n_films, merged_entry_rate, avg_sources, avg_fields_per_merged_entry, enrichment_backlog``: a film is merged when its
    values come from more than one item; its sources are its different ``source_url``; the backlog counts films
    without a director or genre. Without films the count is 0, the backlog 0 and the rest NULL.
    """
    rest = [f for f in fields if f not in ("title", "year")]
    rank = F.struct("trust", -F.col("item_id"))
    named = items.withColumn("title_key", title_key(F.col("title"))).where("title_key <> '' and year is not null")
    winner = [F.max_by("item_id", F.when(F.col(f).isNotNull(), rank)).alias(f"by_{f}") for f in ("title", *rest)]
    films = named.groupBy("title_key", "year").agg(*winner)
    sources = named.where("source_url is not null").groupBy("title_key", "year", "source_url").agg(F.lit(1).alias("one"))
    sources = sources.groupBy("title_key", "year").agg(F.count("*").alias("n_sources"))
    won = F.array(*[F.col(f"by_{f}") for f in ("title", *rest)])
    both = films.join(sources, ["title_key", "year"], "left").select(
        F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
        (F.size(F.array_distinct(F.array_compact(won))) > 1).alias("merged"),
        # the year is there
        (F.size(F.array_compact(won)) + 1).alias("n_fields"),
        F.exists(F.array(*[F.col(f"by_{f}") for f in rest]), lambda x: x.isNull()).alias("wanting"),
    )
    return both.agg(
        F.count("*").alias("n_films"),
        F.avg(F.col("merged").cast("double")).alias("merged_entry_rate"),
        F.avg("n_sources").alias("avg_sources"),
        F.avg(F.when(F.col("merged"), F.col("n_fields"))).alias("avg_fields_per_merged_entry"),
        F.count_if("wanting").alias("enrichment_backlog"),
    )


def _wait_minutes(attempts: Column) -> Column:
    """Doubled for each attempt, up to the longest."""
    # beyond 2^20 the longest wait is long reached
    return F.least(F.lit(FIRST_WAIT_MINUTES) * F.pow(F.lit(2), F.least(attempts - 1, F.lit(20))), F.lit(LONGEST_WAIT_MINUTES)).cast("long")


def retry_table(fetches: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The retry queue that a log of fetches leaves.

    ``fetches`` holds ``url, at`` (a timestamp) and ``error`` (NULL when the fetch went well). Gives
    ``url, attempts, first_failed, last_failed, last_error, next_at`` for each URL that has failed since it last went
    well; ``next_at`` is NULL once ``max_attempts`` are used up. Of two errors at one time the greater text is the last, and a
    failure at the time of a success counts as before it. Repeated rows of the log count once. Rows without ``url`` or ``at`` are
    left out.
    """
    log = fetches.where("url is not null and at is not null").groupBy("url", "at", "error").agg(F.lit(1).alias("one"))
    went_well = log.where("error is null").groupBy("url").agg(F.max("at").alias("well"))
    since = log.where("error is not null").join(went_well, "url", "left").where("well is null or at > well")
    queue = since.groupBy("url").agg(
        F.count("*").alias("attempts"),
        F.min("at").alias("first_failed"),
        F.max("at").alias("last_failed"),
        F.max_by("error", F.struct("at", "error")).alias("last_error"),
    )
    again = F.timestamp_add("MINUTE", _wait_minutes(F.col("attempts")), F.col("last_failed"))
    return queue.withColumn("next_at", F.when(F.col("attempts") < max_attempts, again))


def due(queue: DataFrame, now: str) -> DataFrame:
    """``url``: what the next crawl starts from again (see ``frontier.crawl``)."""
    return queue.where(F.col("next_at") <= F.lit(now).cast("timestamp")).select("url")


def retry_kpis(fetches: DataFrame) -> DataFrame:
    """One row: ``n_failed`` URLs that ever failed, ``recovered_share`` of them fetched later, ``avg_delay_minutes`` from a failure to the next try.

    A time at which a fetch went well counts as well. The tries of one URL are sorted in one task, which may spill.
    """
    failed = F.when(F.count_if(F.col("error").isNull()) == 0, F.max("error"))
    log = fetches.where("url is not null and at is not null").groupBy("url", "at").agg(failed.alias("error"))
    order = Window.partitionBy("url").orderBy("at")
    tries = log.withColumn("next_try", F.lead("at").over(order))
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    delay = (seconds("next_try") - seconds("at")) / 60
    by_url = tries.groupBy("url").agg(
        F.min(F.when(F.col("error").isNotNull(), F.col("at"))).alias("failed"),
        F.max(F.when(F.col("error").isNull(), F.col("at"))).alias("well"),
        F.sum(F.when(F.col("error").isNotNull(), delay)).alias("delay"),
        F.count(F.when(F.col("error").isNotNull(), F.col("next_try"))).alias("n"),
    )
    return by_url.where("failed is not null").agg(
        F.count("*").alias("n_failed"),
        F.avg(F.coalesce(F.col("well") > F.col("failed"), F.lit(False)).cast("double")).alias("recovered_share"),
        F.try_divide(F.sum("delay"), F.sum("n")).alias("avg_delay_minutes"),
    )
