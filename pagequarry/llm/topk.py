"""Exact top-k inner products by norm buckets.

Vectors are grouped by length. A first pass over the longest ones gives every query a lower bound of its
k-th product. In the second pass a bucket is skipped for the queries whose bound its length cannot reach;
the bound divided by the lengths of query and bucket is the cosine that a partner must have. Where that
local threshold is high, only the vectors whose value at the query's strongest coordinate allows it are
looked at; where it is low, those that are long enough. Products of what is left are computed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import stored

#: Vectors of a bucket and queries of a block: what one task holds at a time.
BUCKET_ROWS = 8192
BLOCK_ROWS = 4096
#: Length classes that boundaries are computed for; larger classes are split by a hash of the id.
CLASSES = 256
#: Local cosine from which coordinates prune better than lengths.
STEEP = 0.55
HITS = "query_id long, vec_id long, score long"


def quantised(embeddings: DataFrame, factor: int = 64) -> DataFrame:
    """``vec_id, v array<long>, norm``: each component times ``factor``, rounded down.

    Vectors that are NULL or hold NULL or non-finite components, and rows without id, take no part.
    """
    bad = "exists(embedding, x -> x is null or isnan(cast(x as double)) or abs(cast(x as double)) = double('Infinity'))"
    return (
        embeddings.select("vec_id", "embedding")
        .where("vec_id is not null and embedding is not null and size(embedding) > 0")
        .where(f"not {bad}")
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"transform(embedding, x -> floor({factor} * cast(x as double)))").alias("v"))
        .withColumn("norm", F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + cast(x as double) * cast(x as double)))"))
    )


def bucketed(vectors: DataFrame) -> tuple[DataFrame, list]:
    """``vectors`` with their bucket, and the buckets: class, part, rows, longest and shortest length.

    Classes hold vectors of similar length and one dimension; class 0 is the longest. A class that many
    vectors of the same length make large is split into parts by a hash of the id.
    """
    probs = [i / CLASSES for i in range(1, CLASSES)]
    edges = sorted(set(vectors.agg(F.percentile_approx("norm", probs, 5000)).first()[0] or []), reverse=True)
    place = F.array_position(F.transform(F.lit(edges) if edges else F.array(F.lit(-1.0)), lambda e: F.col("norm") > e), True)
    ranked = vectors.withColumn("class", F.when(place == 0, F.lit(len(edges))).otherwise(place - 1).cast("int"))
    ranked = ranked.withColumn("dim", F.size("v"))
    sizes = ranked.groupBy("dim", "class").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()
    # neighbouring small classes become one bucket; large ones get several
    plan, number = [], 0
    for dim in sorted({s.dim for s in sizes}):
        group: list = []
        for s in sorted((s for s in sizes if s.dim == dim), key=lambda s: s["class"]):
            if group and sum(g.n for g in group) + s.n > BUCKET_ROWS:
                plan.append((dim, group))
                group = []
            group.append(s)
        plan.append((dim, group))
    rows, buckets = [], []
    for dim, group in plan:
        total = sum(g.n for g in group)
        parts = -(-total // BUCKET_ROWS)
        buckets += [(number + p, dim, max(g.longest for g in group), total // parts) for p in range(parts)]
        rows += [(dim, g["class"], number, parts) for g in group]
        number += parts
    spark = vectors.sparkSession
    lookup = spark.createDataFrame(rows, "dim int, class int, first int, parts int")
    out = ranked.join(F.broadcast(lookup), ["dim", "class"]).select(
        "vec_id", "v", "norm", "dim", (F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts")).cast("int").alias("bucket")
    )
    return out, buckets


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where they hold every sum exactly, else in 64-bit integers."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if most < 2**53:
        return np.rint(left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


def best_of(query_id: int, ids: np.ndarray, scores: np.ndarray, k: int, bound: float) -> list[tuple[int, int, int]]:
    """The k best of one query in a bucket, ties to the smaller id, none below the bound."""
    keep = np.flatnonzero((scores >= bound) & (ids != query_id))
    if len(keep) > k:
        least = np.partition(scores[keep], len(keep) - k)[len(keep) - k]
        keep = keep[scores[keep] >= least]
    order = np.lexsort((ids[keep], -scores[keep]))[:k]
    return [(query_id, int(ids[i]), int(scores[i])) for i in keep[order]]


def search_bucket(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """Hits of a block of queries in one bucket; ``queries`` carry the bound known so far."""
    hits: list[tuple[int, int, int]] = []
    if len(queries) and len(vectors):
        vectors = vectors.sort_values("norm", ascending=False, kind="stable")
        ids, norms = vectors["vec_id"].to_numpy(), vectors["norm"].to_numpy()
        matrix = np.stack(vectors["v"].to_numpy())
        wanted = np.stack(queries["v"].to_numpy())
        bounds, lengths = queries["bound"].to_numpy(np.float64), queries["norm"].to_numpy()
        longest = norms[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(bounds > 0, bounds / (lengths * longest) - 1e-9, -1.0)
        steep = (local >= STEEP) & (local <= 1)
        if steep.any():
            hits += by_coordinate(queries, wanted, lengths, bounds, local, ids, matrix, norms, np.flatnonzero(steep), k)
        flat = np.flatnonzero(local < STEEP)
        # by length: queries with near bounds share one product over the longest prefix any of them needs
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(bounds > 0, bounds / lengths * (1 - 1e-9), 0.0)
        for at in range(0, len(flat), 256):
            part = flat[np.argsort(reach[flat], kind="stable")][at : at + 256]
            upto = int(np.searchsorted(-norms, -reach[part].min(), "right"))
            scores = product(wanted[part], matrix[:upto])
            for row, q in enumerate(part):
                hits += best_of(int(queries["vec_id"].iat[q]), ids[:upto], scores[row], k, bounds[q])
    return pd.DataFrame(hits, columns=["query_id", "vec_id", "score"]).astype("int64")


def by_coordinate(queries, wanted, lengths, bounds, local, ids, matrix, norms, which, k) -> list[tuple[int, int, int]]:
    """Vectors whose angle to the query's strongest axis leaves room for the local threshold."""
    with np.errstate(divide="ignore", invalid="ignore"):
        units = np.where(norms[:, None] > 0, matrix / norms[:, None], 0.0)
    orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    hits = []
    for q in which:
        unit = wanted[q] / lengths[q]
        axis = int(np.abs(unit).argmax())
        if axis not in orders:
            order = np.argsort(units[:, axis], kind="stable")
            orders[axis] = order, units[order, axis]
        order, values = orders[axis]
        turn, spread = math.acos(max(-1.0, min(1.0, unit[axis]))), math.acos(max(-1.0, min(1.0, local[q])))
        low = math.cos(min(math.pi, turn + spread)) - 1e-9
        high = math.cos(max(0.0, turn - spread)) + 1e-9
        near = order[np.searchsorted(values, low, "left") : np.searchsorted(values, high, "right")]
        scores = product(wanted[q : q + 1], matrix[near])[0] if len(near) else np.empty(0, np.int64)
        hits += best_of(int(queries["vec_id"].iat[q]), ids[near], scores, k, bounds[q])
    return hits


def search(queries: DataFrame, vectors: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Hits of each block of queries in each bucket that ``pairs`` (``query_id, bucket, bound``) names."""
    asked = queries.join(pairs, queries["vec_id"] == pairs["query_id"]).select(
        "block", "bucket", "vec_id", "v", "norm", "bound"
    )
    wanted = asked.select(F.col("block").alias("to_block"), F.col("bucket").alias("to_bucket")).distinct()
    held = vectors.join(wanted, vectors["bucket"] == F.col("to_bucket")).select(
        F.col("to_block").alias("block"), F.col("to_bucket").alias("bucket"), *[F.col(c).alias(c) for c in ("vec_id", "v", "norm")]
    )
    return asked.groupBy("block", "bucket").cogroup(held.groupBy("block", "bucket")).applyInPandas(
        lambda a, b: search_bucket(a, b, k), HITS
    )


def merged(hits: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_products(embeddings: DataFrame, *, every: int = 20, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest integer products of every query.

    Queries are the rows whose ``vec_id`` is divisible by ``every``, candidates all rows with another
    ``vec_id``. Ties go to the smaller ``vec_id``; with fewer candidates all are returned, and none for a
    query alone. Repeated rows count once; of rows that share an id but not the vector, the smallest
    vector counts. Vectors of different dimension have no product. Products must fit in a long.
    """
    clean = quantised(embeddings)
    clean = clean.groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("x")).select("vec_id", "x.*")
    vectors, buckets = bucketed(stored(clean, "vectors"))
    spark = embeddings.sparkSession
    vectors = stored(vectors, "buckets")
    asked = vectors.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    queries = asked.drop("bucket").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    queries = stored(queries, "queries")
    plan = spark.createDataFrame(buckets, "bucket int, dim int, longest double, n long")
    # the buckets of longest vectors of each dimension that hold more than k rows give the first bounds
    heads, seen = [], {}
    for bucket, dim, _, n in buckets:
        if seen.get(dim, 0) <= k:
            heads.append(bucket)
            seen[dim] = seen.get(dim, 0) + n
    first_pairs = queries.select(F.col("vec_id").alias("query_id"), "dim").join(
        F.broadcast(plan.where(F.col("bucket").isin(heads))), "dim"
    ).select("query_id", "bucket", F.lit(float("-inf")).alias("bound"))
    first = stored(merged(search(queries, vectors, first_pairs, k), k), "hits")
    bound = first.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("bound"))
    known = queries.select(F.col("vec_id").alias("query_id"), "dim", "norm").join(bound, "query_id", "left")
    known = known.withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    rest = known.join(F.broadcast(plan.where(~F.col("bucket").isin(heads))), "dim").where(
        F.col("bound") <= F.col("norm") * F.col("longest") * (1 + 1e-9)
    ).select("query_id", "bucket", "bound")
    second = search(queries, vectors, rest, k)
    both = first.select("query_id", "vec_id", "score").unionByName(second)
    return merged(both, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
