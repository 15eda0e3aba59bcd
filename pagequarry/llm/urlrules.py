"""URL filters: a sort-merge range join of URL keys with rule intervals.

A host is turned round (``www.example.com`` becomes ``com\\x01example\\x01www\\x01``), so a rule's host
and all its subdomains are one interval of keys. URLs and rules are cut into the same key ranges; each
range is sorted and swept once with a stack of the rules whose interval is open. Open intervals of a
tree of host names are nested, so the top of the stack is the most specific one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm.common import slices

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "\x01"  # ends each label; sorts before anything a host name holds
OPEN, URL = 0, 1


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), STEP), F.lit(STEP))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def judge_urls(pages: DataFrame, rules: DataFrame, *, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (``page_id, url``).

    A rule ``(verdict, host, path)`` fits a URL of its host or a subdomain of it whose path starts with
    the rule's path. The rule with the longest ``host + path`` wins; of several equal ones, ``block``
    does. No fitting rule: ``rule`` is NULL and the verdict is ``default``. A NULL URL or one without
    ``://`` has an empty host and path and no rule. Repeated rows are judged each for itself; other
    columns of ``pages`` are ignored. Only ids, hosts and paths are shuffled. A host with very many
    URLs spreads over several ranges, because keys go on with the path and the id.
    """
    spark = pages.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = urls.select(
        "page_id", "host", "path", host_key(F.col("host")).alias("key"),
        F.xxhash64("path", "page_id").alias("salt"),
    )
    clean = (
        rules.where("host is not null and path is not null and verdict is not null")
        .groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("key", host_key(F.col("host")))
    )
    cuts = range_cuts(keyed, n)
    placed = cuts_of(keyed, cuts)
    opened = (
        cuts_of(clean, cuts)
        .select("host", "path", "verdict", "key", F.explode(F.sequence("low", "high")).alias("part"))
    )
    both = placed.select(
        "part", "key", F.lit(URL).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict")
    ).unionByName(
        opened.select(
            "part", "key", F.lit(OPEN).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict"
        )
    )
    swept = both.repartition(n, "part").sortWithinPartitions("part", "key", "kind")
    return swept.mapInArrow(
        lambda batches: sweep(batches, default), "page_id long, host string, path string, rule string, verdict string"
    )


def range_cuts(keyed: DataFrame, n: int) -> list[tuple[str, int]]:
    """At most ``n - 1`` cut points ``(key, salt)`` that split the keys evenly, from a bounded sample."""
    sample = keyed.select("key", "salt").where(F.abs(F.col("salt")) % 64 < 1).select("key", "salt")
    rows = sample.orderBy(F.hash("salt")).limit(50 * n).collect()
    points = sorted((r.key, r.salt) for r in rows)
    return sorted({points[i * len(points) // n] for i in range(1, n)}) if len(points) >= n else points[:: max(1, len(points) // n)]


def cuts_of(df: DataFrame, cuts: list[tuple[str, int]]) -> DataFrame:
    """Adds the range of each row: ``part`` by ``(key, salt)``, or for rules ``low`` and ``high``."""
    keys = np.array([k for k, _ in cuts], dtype=object)

    @F.pandas_udf("long")
    def first(key):
        import pandas as pd

        return pd.Series(np.searchsorted(keys, key.to_numpy(object), "left"))

    @F.pandas_udf("long")
    def last(key):
        import pandas as pd

        return pd.Series(np.searchsorted(keys, key.to_numpy(object) + "\U0010ffff", "right"))

    @F.pandas_udf("long")
    def exact(key, salt):
        import bisect

        import pandas as pd

        return pd.Series([bisect.bisect_right(cuts, pair) for pair in zip(key, salt, strict=True)], dtype="int64")

    if "salt" in df.columns:
        return df.withColumn("part", exact("key", "salt"))
    return df.withColumn("low", first("key")).withColumn("high", last("key"))


def sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Rows in key order; rules open intervals, URLs are answered from the stack."""
    stack: list[tuple[str, str, dict[str, str], set[int]]] = []  # key, host, path -> verdict, path lengths
    part = None
    for batch in slices(batches, 4096):
        out = []
        for at, key, kind, page_id, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != part:
                part, stack = at, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == OPEN:
                if not stack or stack[-1][0] != key:
                    stack.append((key, host, {}, set()))
                stack[-1][2][path] = verdict
                stack[-1][3].add(len(path))
            else:
                out.append((page_id, host, path, *answer(stack, path, default)))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), *[pa.string()] * 4), strict=True)],
                ["page_id", "host", "path", "rule", "verdict"],
            )


def answer(stack: list, path: str, default: str) -> tuple[str | None, str]:
    """The longest rule among the open ones whose path starts this path."""
    best = None
    for _, host, paths, sizes in reversed(stack):
        for size in sorted(sizes, reverse=True):
            found = paths.get(path[:size]) if size <= len(path) else None
            if found is not None:
                if best is None or len(host) + size > best[0]:
                    best = (len(host) + size, host + path[:size], found)
                break
    return (best[1], best[2]) if best else (None, default)
