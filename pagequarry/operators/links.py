"""Links of a page: resolved, checked, each kept once, the rest with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.dom import attr, elements, has_class, is_below
from pagequarry.functions.sql import each, first, keep, let, some, struct
from pagequarry.functions.urls import reject_reason, resolve, url_parts

# Links inside these blocks, or inside an article, are the primary ones.
PRIMARY_DIVS = ["item", "card", "movie", "movie-entry", "movie-card"]


def _once(items: str, key: str) -> str:
    """Sort by key, primary first, then place; keep the first of each key."""
    ordered = f"array_sort({each(items, lambda x: struct(k=f'{x}.{key}', p=f'not {x}.is_primary', o=f'{x}.pos', x=x))})"

    def heads(rows: str) -> str:
        return f"filter({rows}, (r, i) -> i = 0 or r.k <> get({rows}, i - 1).k)"

    return let(ordered, lambda rows: each(heads(rows), lambda r: f"{r}.x"))


def link_array(nodes: str, url: str) -> str:
    """One entry per different ``href`` of the page:
    ``struct(raw, url, reason, is_primary, pos)``, reason NULL for a valid link."""

    def is_block(n: str) -> str:
        classes = " or ".join(has_class(n, c) for c in PRIMARY_DIVS)
        return f"{n}.tag = 'article' or ({n}.tag = 'div' and ({classes}))"

    def hrefs(part: str) -> str:
        anchors = keep(part, lambda n: f"{n}.tag = 'a' and {attr(n, 'href')} is not null")
        return let(
            keep(part, is_block),
            lambda blocks: each(
                anchors,
                lambda n: struct(
                    raw=attr(n, "href"), is_primary=some(blocks, lambda b: is_below(n, b)), pos=f"{n}.id"
                ),
            ),
        )

    def checked(h: str, base: str) -> str:
        return let(
            resolve(url, f"{h}.raw", base),
            lambda u: struct(
                raw=f"{h}.raw", url=u, reason=reject_reason(u), is_primary=f"{h}.is_primary", pos=f"{h}.pos"
            ),
        )

    distinct = _once(let(elements(nodes, "a", "div", "article"), hrefs), "raw")

    def check_all(hs: str) -> str:
        # the page's own URL is taken apart only for a link
        return let(f"if(size({hs}) = 0, NULL, {url_parts(url)})", lambda base: each(hs, lambda h: checked(h, base)))

    return let(distinct, check_all)


def valid_links(links: str) -> str:
    """``array<struct<url, is_primary, pos>>``: the valid links, each URL once."""
    good = keep(links, lambda x: f"{x}.reason is null")
    return _once(each(good, lambda x: struct(url=f"{x}.url", is_primary=f"{x}.is_primary", pos=f"{x}.pos")), "url")


def rejects(links: str) -> str:
    """``array<struct<url, reason>>`` of the links turned down."""
    bad = keep(links, lambda x: f"{x}.reason is not null")
    return each(bad, lambda x: struct(url=f"{x}.url", reason=f"{x}.reason"))


def next_page(nodes: str) -> str:
    """First ``href`` of ``a.next.page-numbers``, as written."""
    hits = keep(
        nodes,
        lambda n: f"{n}.tag = 'a' and {has_class(n, 'next')} and {has_class(n, 'page-numbers')} "
        f"and {attr(n, 'href')} is not null",
    )
    return let(first(hits), lambda n: attr(n, "href"))


def hrefs(parsed: DataFrame) -> DataFrame:
    """Every ``href`` as written: ``page_id, pos, href``."""
    found = parsed.select("page_id", F.inline(F.expr(keep("nodes", lambda n: f"{n}.tag = 'a'"))))
    return found.select("page_id", F.col("id").alias("pos"), F.col("attrs")["href"].alias("href")).filter("href is not null")


def extract_links(parsed: DataFrame) -> DataFrame:
    """Edges ``page_id, src_url, url, is_primary, pos``."""
    links = F.expr(valid_links(link_array("nodes", "url")))
    return parsed.select("page_id", F.col("url").alias("src_url"), F.inline(links))


def rejected_links(parsed: DataFrame) -> DataFrame:
    """``page_id, src_url, url, reason`` for every link turned down."""
    return parsed.select("page_id", F.col("url").alias("src_url"), F.inline(F.expr(rejects(link_array("nodes", "url")))))
