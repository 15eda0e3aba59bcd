"""Following links from page to page, round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.sql import each, let, lits, some, struct
from pagequarry.functions.urls import host_of, resolve
from pagequarry.operators.links import link_array, next_page, valid_links
from pagequarry.session import new_dir

# Fetch priorities.
CATALOGUE_PRIORITY, PAGINATION_PRIORITY, OTHER_PRIORITY = 10, 5, 0


def in_domains(url: str, domains: list[str]) -> str:
    """Host equal to, or below, one of a few allowed domains."""
    allowed = f"array({lits(d.lower() for d in domains)})"
    return let(
        host_of(url), lambda host: some(allowed, lambda d: f"{host} = {d} or endswith({host}, concat('.', {d}))")
    )


def unseen(found: DataFrame, seen: DataFrame) -> DataFrame:
    """URLs not seen before, each once, in its most urgent finding.

    ``found`` may carry ``priority`` and ``pos``: the highest priority counts, then the first position.
    Copies collapse in the partial aggregate, before the shuffle.
    """
    carried = [c for c in ("priority", "pos") if c in found.columns]
    if not carried:
        once = found.select("url").distinct()
    else:
        rank = F.struct(*[(-F.col(c) if c == "pos" else F.col(c)).alias(c) for c in carried])
        best = found.groupBy("url").agg(F.max(rank).alias("best"))
        once = best.select("url", *[(-F.col("best.pos") if c == "pos" else F.col(f"best.{c}")).alias(c) for c in carried])
    return once.join(seen.select("url"), "url", "left_anti")


def resolve_edges(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges with the stored page they lead to: ``src_page_id, dst_page_id, url``.

    A much linked page makes one hot key on the edge side only; the page side
    has one narrow row per URL, so the skew-join split of the edges applies.
    """
    targets = pages.select(F.col("page_id").alias("dst_page_id"), "url")
    return edges.select(F.col("page_id").alias("src_page_id"), "url").join(targets, "url")


def followed(classed: DataFrame) -> DataFrame:
    """Per page the links a run follows: ``url, page_type, out array<struct<url, priority, pos>>``.

    Catalogue pages give their valid links and the next-page link, which is
    resolved but not checked; other pages give none.
    """
    links = each(
        valid_links(link_array("nodes", "url")),
        lambda x: struct(url=f"{x}.url", priority=str(CATALOGUE_PRIORITY), pos=f"{x}.pos"),
    )
    following = let(
        next_page("nodes"),
        lambda href: f"if({href} is null, array(), array("
        + struct(url=resolve("url", href), priority=str(PAGINATION_PRIORITY), pos="size(nodes)")
        + "))",
    )
    out = f"if(page_type = 'catalogue', concat({links}, {following}), array())"
    return classed.select("url", "page_type", F.expr(out).alias("out"))


def next_batch(frontier: DataFrame, size: int) -> DataFrame:
    """The ``size`` most urgent URLs of a frontier (a top-k, not a full sort)."""
    return frontier.orderBy(F.desc("priority"), "pos", "url").limit(size)


def crawl(graph: DataFrame, seeds: DataFrame, domains: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """Walk ``graph`` (see ``followed``), a stored table, from ``seeds`` until nothing new is found.

    Gives ``url, depth, priority, page_type`` for every URL reached, ``page_type`` NULL when no page is stored.
    A round joins the graph with the frontier by an inner join, so a small frontier can be broadcast and the
    graph is scanned, not shuffled; each round keeps only its narrow ``url, depth, priority`` rows as a table
    below the shared folder. The driver sees whether a round found anything. ``max_depth`` is the caller's
    wish for fewer rounds.
    """
    spark = graph.sparkSession
    path = new_dir(spark, "crawl")
    row = "url string, priority int, depth int"
    start = seeds.select("url", F.lit(OTHER_PRIORITY).alias("priority")).distinct()
    depth = 0
    while True:
        here = f"{path}/depth={depth}"
        start.write.parquet(here)
        frontier = spark.read.schema("url string, priority int").parquet(here)
        if depth == max_depth or frontier.isEmpty():
            break
        reached = spark.read.schema(row).parquet(path)
        out = graph.join(frontier.select("url"), "url").select(F.inline("out")).select("url", "priority")
        if domains:
            out = out.filter(in_domains("url", domains))
        found = out.groupBy("url").agg(F.max("priority").alias("priority"))
        start = found.join(reached.select("url"), "url", "left_anti")
        depth += 1
    reached = spark.read.schema(row).parquet(path)
    return reached.join(graph.select("url", "page_type"), "url", "left").select("url", "depth", "priority", "page_type")
