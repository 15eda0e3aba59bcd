"""Record checks: one list of errors per item, plus the normalised values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.functions.sql import each, keep, let, lit, lits
from pagequarry.functions.text import burmese_digits, strip
from pagequarry.schema import ITEM_FIELDS

# Fixed values.
YEAR_MIN, YEARS_AHEAD = 1800, 5
HTTP_URL = r"(?s)^(?i:https?)://([^\s/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[\p{L}\p{N}_][\p{L}\p{N}_.~%-]*)(:\d*)?([/?#].*)?$"
SYNOPSIS_MAX, URL_MAX = 1000, 2083
NO_SYNOPSIS = ["n/a", "not available", "no synopsis", ""]


def year_value(raw: str, local_digits: bool = False) -> str:
    """Whole number in a text, NULL when it is none."""
    text = strip(burmese_digits(raw) if local_digits else raw)
    return let(text, lambda t: rf"if({t} rlike r'^[+-]?\d+$', try_cast({t} as int), NULL)")


def year_ok(year: str, as_of_year: int) -> str:
    return f"coalesce({year} between {YEAR_MIN} and {as_of_year + YEARS_AHEAD}, false)"


def cast_list(cast: str, is_array: bool) -> str:
    """Names of a comma list (or array), stripped, blank ones dropped."""
    names = cast if is_array else f"split({cast}, ',')"
    return keep(each(names, strip), lambda n: f"{n} <> ''")


def synopsis_value(raw: str) -> str:
    return let(strip(raw), lambda s: f"if(lower({s}) in ({lits(NO_SYNOPSIS)}), NULL, {s})")


def synopsis_ok(raw: str) -> str:
    """Length of the text as delivered, blanks counted."""
    return f"coalesce(length({raw}) <= {SYNOPSIS_MAX}, true)"


def url_ok(url: str) -> str:
    """Scheme, a host of host characters, perhaps a port; a missing URL passes."""
    return f"coalesce({url} rlike {lit(HTTP_URL)} and length({url}) <= {URL_MAX}, true)"


def check_items(items: DataFrame, as_of_year: int, mode: str = "strict", local_digits: bool = False) -> DataFrame:
    """Add the normalised fields and ``errors``; the delivered fields move to ``raw_*``.

    ``strict`` needs title, year and director; ``partial`` needs the title only.
    """
    if mode not in ("strict", "partial"):
        raise ValueError(f"unknown mode {mode!r}")
    given = set(items.columns)
    others = [c for c in items.columns if c not in ITEM_FIELDS]
    raw = [(F.col(f) if f in given else F.lit(None).cast("string")).alias(f"raw_{f}") for f in ITEM_FIELDS]
    is_array = "cast" in given and isinstance(items.schema["cast"].dataType, T.ArrayType)
    normal = items.select(*others, *raw).select(
        "*",
        F.expr(strip("raw_title")).alias("title"),
        F.expr(year_value("raw_year", local_digits)).alias("year"),
        F.expr(strip("raw_director")).alias("director"),
        F.expr(cast_list("raw_cast", is_array)).alias("cast"),
        F.col("raw_genre").alias("genre"),
        F.expr(synopsis_value("raw_synopsis")).alias("synopsis"),
        F.col("raw_poster_url").alias("poster_url"),
        F.col("raw_streaming_link").alias("streaming_link"),
    )

    def needed(field: str) -> str:
        return "true" if mode == "strict" or field == "title" else f"raw_{field} is not null"

    failed = {
        "title": "coalesce(length(title), 0) = 0",
        "year": f"not {year_ok('year', as_of_year)} and {needed('year')}",
        "director": f"coalesce(length(director), 0) = 0 and {needed('director')}",
        "synopsis": f"not {synopsis_ok('raw_synopsis')}",
        "poster_url": f"not {url_ok('raw_poster_url')}",
        "streaming_link": f"not {url_ok('raw_streaming_link')}",
    }
    tests = ", ".join(f"if({test}, '{field}', NULL)" for field, test in failed.items())
    return normal.withColumn("errors", F.expr(f"array_compact(array({tests}))"))


def valid_items(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") == 0)


def dropped_items(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") > 0)
