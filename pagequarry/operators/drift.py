"""How far the markup of a page has moved since the last snapshot.

The fingerprint of a page is the multiset of its subtrees: for every element a hash of its tag, its class and the
hashes of the elements below it, in order. A change deep in a page changes the subtrees around it and no others, so
the share of subtrees that two snapshots have in common falls with the size of the change. Fingerprints are kept as
a table; comparing two snapshots needs no markup.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.schema import TEXT_TAG

#: Degree above which a page counts as changed enough to look at.
SIGNIFICANT = 0.2


def _hash(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big", signed=True)


def subtree_hashes(tags: list[str], classes: list[str | None], parents: list[int]) -> list[int]:
    """A hash for every element subtree, the n-th of equal ones told apart by n, so that the multiset is a set.

    Nodes stand in document order; one pass from the last to the first settles children before their parents.
    """
    below: list[list[bytes]] = [[] for _ in tags]
    seen: Counter[int] = Counter()
    out = []
    for at in range(len(tags) - 1, -1, -1):
        if tags[at] == TEXT_TAG:
            continue
        own = f"{tags[at]}\0{classes[at] or ''}\0".encode()
        value = _hash(own + b"".join(reversed(below[at])))
        if parents[at] is not None and parents[at] >= 0:
            below[parents[at]].append(value.to_bytes(8, "big", signed=True))
        out.append(_hash(f"{value} {seen[value]}".encode()))
        seen[value] += 1
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(1, 4)), strict=True)
        shapes = pa.array([subtree_hashes(*row) for row in rows], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), shapes], ["url", "shape"])


def fingerprints(parsed: DataFrame) -> DataFrame:
    """``url, shape`` of every page that could be read, each URL once; the texts of a page do not count.

    Of several pages with one URL the least shape stands for all. A page without elements has an empty shape.
    """
    columns = parsed.where("error is null and url is not null").select(
        "url", F.expr("nodes.tag").alias("tags"), F.expr("transform(nodes, n -> n.attrs['class'])").alias("classes"), F.expr("nodes.parent").alias("parents")
    )
    return columns.mapInArrow(_batches, "url string, shape array<bigint>").groupBy("url").agg(F.min("shape").alias("shape"))


def drift_degree(previous: DataFrame, current: DataFrame, significant: float = SIGNIFICANT) -> DataFrame:
    """``url, status, n_was, n_is, n_lost, n_added, degree, significant`` for the URLs of two tables of fingerprints.

    ``status`` is ``same``, ``changed``, ``new`` or ``gone``. ``degree`` is the share of the subtrees of both
    snapshots that the other does not have: 0 for the same markup, 1 for none in common or a page of one snapshot only.
    """
    was, now = previous.select("url", F.col("shape").alias("was")), current.select("url", F.col("shape").alias("now"))
    empty = F.array().cast("array<bigint>")
    both = was.join(now, "url", "full").select(
        "url",
        F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").alias("alone"),
        F.coalesce("was", empty).alias("was"),
        F.coalesce("now", empty).alias("now"),
    )
    counted = both.select(
        "url",
        "alone",
        F.size("was").cast("long").alias("n_was"),
        F.size("now").cast("long").alias("n_is"),
        F.size(F.array_intersect("was", "now")).cast("long").alias("shared"),
    )
    held = F.col("n_was") + F.col("n_is")
    measured = counted.withColumn(
        "degree", F.when(F.col("alone").isNotNull(), 1.0).when(held == 0, 0.0).otherwise((held - 2 * F.col("shared")) / held.cast("double"))
    )
    return measured.select(
        "url",
        F.coalesce("alone", F.when(F.col("degree") == 0, "same").otherwise("changed")).alias("status"),
        "n_was",
        "n_is",
        (F.col("n_was") - F.col("shared")).alias("n_lost"),
        (F.col("n_is") - F.col("shared")).alias("n_added"),
        "degree",
        (F.col("degree") > significant).alias("significant"),
    )
