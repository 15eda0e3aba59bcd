"""Fuzzy merge of records across sources: blocking, weighted evidence, clusters, conflicts settled by trust.

Records with one title and year are one node from the start, so a title that very many sources share is reduced by a
partial aggregate. Titles are compared as sets of letter pairs, so word order does not count and a misspelt letter
changes few of them. Nodes meet under a year and one of the rarest letter pairs of their titles: a title shares at
least one pair of its prefix with every title that can still reach the threshold, so blocking loses no link. Blocks
with many nodes are cut into tiles of bounded size; only links leave a tile, never its pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.operators.curate import FIELDS, title_key
from pagequarry.session import stored

#: Evidence: ten points for each hundredth of the title similarity, and these for year and director.
YEAR_OFF_BY_ONE = -310
SAME_DIRECTOR, OTHER_DIRECTOR = 50, -200
LINK = 700
#: The least similarity, in hundredths, of any link.
LEAST_SIMILARITY = (LINK - SAME_DIRECTOR) // 10
#: Nodes of half a tile.
TILE = 128


def letter_pairs(key: str) -> str:
    """SQL: the distinct pairs of neighbouring letters of the words of a title key, the edges of a word included."""
    pairs = "transform(sequence(1, length(w) + 1), i -> substr(concat('_', w, '_'), i, 2))"
    return f"array_distinct(flatten(transform(split({key}, ' '), w -> {pairs})))"


def title_nodes(items: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``node, title_key, year, pairs, n_sources, b_<field>`` of each title and year; ``b_`` holds trust, id and value.

    The node is the smallest ``item_id``. A year that is no number names no record, like a missing title or year.
    """
    keyed = items.withColumn("title_key", title_key(F.col("title"))).withColumn("__year", F.expr("try_cast(year as int)"))
    keyed = keyed.where("title_key <> '' and __year is not null")
    best = [
        F.max(F.when(F.col(f).isNotNull(), F.struct("trust", (-F.col("item_id")).alias("id"), F.col(f).alias("value")))).alias(f"b_{f}")
        for f in fields
    ]
    nodes = keyed.groupBy("title_key", "__year").agg(F.min("item_id").alias("node"), F.count("*").alias("n_sources"), *best)
    return nodes.withColumnRenamed("__year", "year").withColumn("pairs", F.expr(letter_pairs("title_key")))


def blocks(nodes: DataFrame) -> DataFrame:
    """``pair, at, node, pairs, director, late``: each node under the rarest pairs of its title and two years.

    ``late`` rows stand under the year after their own, where the nodes of that year meet them.
    """
    spread = nodes.select("node", F.explode("pairs").alias("pair"))
    often = spread.groupBy("pair").agg(F.count("*").alias("df"))
    ordered = spread.join(often, "pair").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "pair"))).alias("o"))
    # sets that reach the threshold share a pair among the first n - ceil(t * n) + 1
    size = f"cast(size(o) - ceil({LEAST_SIMILARITY} * size(o) / 100) + 1 as int)"
    prefix = ordered.select("node", F.explode(F.expr(f"slice(o, 1, {size}).pair")).alias("pair"))
    return (
        prefix.join(nodes.select("node", "year", "pairs", F.col("b_director.value").alias("director")), "node")
        .withColumn("late", F.explode(F.array(F.lit(0), F.lit(1))))
        .select("pair", (F.col("year") + F.col("late")).alias("at"), "node", "pairs", "director", "late")
    )


def evidence(x: str, y: str) -> str:
    """SQL: points of two nodes of a block for being one film."""
    both = f"size(array_intersect({x}.pairs, {y}.pairs))"
    title = f"10 * ((100 * {both}) div (size({x}.pairs) + size({y}.pairs) - {both}))"
    director = f"case when {x}.director = {y}.director then {SAME_DIRECTOR} when {x}.director <> {y}.director then {OTHER_DIRECTOR} else 0 end"
    return f"({title} + {director} + if({x}.late = {y}.late, 0, {YEAR_OFF_BY_ONE}))"


def links(blocked: DataFrame, tile: int = TILE) -> DataFrame:
    """``a, b, points`` of the pairs with enough evidence, ``a < b``, each once."""
    sizes = blocked.groupBy("pair", "at").agg(F.count("*").alias("k"), F.count_if(F.col("late") == 0).alias("own"))
    sizes = stored(sizes.where("k > 1 and own > 0").select("pair", "at", F.ceil(F.col("k") / tile).cast("int").alias("parts")), "blocks")
    placed = blocked.join(sizes, ["pair", "at"]).withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    # a row meets every part of its block, in the tile of both
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    row = F.struct("own", "node", "pairs", "director", "late")
    tiles = met.groupBy("pair", "at", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(row).alias("rows"))
    # two late rows meet under their own year; rows of one part meet in its own tile only
    small = f"100 * least(size(x.pairs), size(y.pairs)) >= {LEAST_SIMILARITY} * greatest(size(x.pairs), size(y.pairs))"
    partner = f"x.node <> y.node and y.late = 0 and (x.late = 1 or x.node < y.node) and (i = j or x.own <> y.own) and {small}"
    hits = (
        f"flatten(transform(rows, x -> transform(filter(rows, y -> {partner} and {evidence('x', 'y')} >= {LINK}), "
        f"y -> struct(least(x.node, y.node) as a, greatest(x.node, y.node) as b, {evidence('x', 'y')} as points))))"
    )
    return tiles.select(F.inline(F.expr(hits))).groupBy("a", "b").agg(F.max("points").cast("long").alias("points"))


def clusters(found: DataFrame) -> DataFrame:
    """``node, cluster`` of every node with a link: the smallest node reachable over links.

    A round takes the least label around each node and then the label of that label, so paths halve.
    """
    edges = stored(found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        lower = around.join(labels, F.col("a") == F.col("node")).select("node", F.least("label", "least").alias("label"), F.col("label").alias("was"))
        lower = stored(lower, "labels")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = stored(
            lower.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "was"), "labels"
        )
        if labels.where("label <> was").isEmpty():
            return labels.select("node", F.col("label").alias("cluster"))


def linked_items(items: DataFrame, fields: tuple[str, ...] = FIELDS, *, tile: int = TILE) -> DataFrame:
    """One record for each film: ``item_id, <fields>, n_sources, n_titles``.

    Records are linked when titles, years and directors give enough evidence (``evidence``), and linked ones are one
    film. Each field comes from the most trusted source of the film that has it, of equally trusted ones from the
    smallest ``item_id``; a NULL trust counts least. ``item_id`` is the smallest of the film, ``n_titles`` counts its
    different spellings and years. Items without a title or with a year that is no number are left out; repeated rows
    count as sources. An empty table gives no rows.
    """
    nodes = stored(title_nodes(items, fields), "nodes")
    found = stored(links(blocks(nodes), tile), "links")
    named = nodes.join(clusters(found), "node", "left").withColumn("item_id", F.coalesce("cluster", "node"))
    films = named.groupBy("item_id").agg(
        *[F.max(f"b_{f}").alias(f"b_{f}") for f in fields], F.sum("n_sources").alias("n_sources"), F.count("*").alias("n_titles")
    )
    return films.select("item_id", *[F.col(f"b_{f}.value").alias(f) for f in fields], "n_sources", "n_titles")
