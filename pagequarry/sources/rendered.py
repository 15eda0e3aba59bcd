"""Pages and records rendered row by row from relational tables.

They stand in for stored pages of kinds the page table lacks (frames, images,
tables, blocks): the row behind a page says what its extraction must give.
Each page comes from one row alone, so rendering is a map and grows with the
table. With ``dealt``, the rows go to all cores before they are rendered (see
``dealt_rows``); without, pages are made where the table's splits lie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.sources import pages

SITE = "https://films.example.com"
#: Set by whoever runs queries over small one-split files, such as a bench; unset, tables are read as they lie.
PARTITIONS = "spark.pagequarry.partitions"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    wanted = spark.conf.get(PARTITIONS, None)
    return pages.read_table(spark, sf_dir, name, int(wanted) if wanted else None)


def dealt_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a table that pages or texts are made from, dealt evenly to all cores.

    A stored row of a few bytes becomes a page of some thousand, so the splits of a table say nothing of the work on its
    pages: a table in one row group would be rendered, parsed and read by a single task. The narrow rows are shuffled,
    never the pages. ``PARTITIONS`` sets the number of parts; unset, it is ``spark.sql.shuffle.partitions``, at least two for each core.
    """
    if spark.conf.get(PARTITIONS, None):
        return read_table(spark, sf_dir, name)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return read_table(spark, sf_dir, name).repartition(parts)


def _text(*parts: Column | str | int) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _repeat(count: Column, one: Callable[[Column], Column]) -> Column:
    """``one(1) .. one(count)`` joined."""
    return F.array_join(F.transform(F.sequence(F.lit(1), count.cast("int")), one), "")


def detail_pages(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """One detail page per part; a frame on even keys."""
    key = F.col("p_partkey")
    frame = F.when(key % 2 == 0, _text('<iframe src="https://stream.example.com/', key, '"></iframe>')).otherwise("")
    html = _text(
        '<html><body><h1 class="entry-title">', F.col("p_name"), '</h1><span class="ytps">', F.col("p_size") + 1950,
        '</span><div class="entry-content"><img src="/img/', key, '.jpg"><p>Director: ', F.col("p_brand"),
        "</p><p>Genre: ", F.col("p_type"), "</p></div>", frame, "</body></html>",
    )
    parts = (dealt_rows if dealt else read_table)(spark, sf_dir, "part")
    return parts.select(key.alias("page_id"), _text(SITE, "/movie/", key).alias("url"), html.alias("html"))


def table_pages(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """One page per order with a table of 2 to 5 rows, in three table shapes."""
    key, year = F.col("o_orderkey"), F.year("o_orderdate")
    shape = key % 3

    def row(i: Column) -> Column:
        lead = F.when(shape == 2, _text("<td>", i, "</td>")).otherwise("")
        return _text(
            "<tr>", lead, "<td> <b>", F.col("o_orderpriority"), "</b> part ", i, "</td><td>", year + i, "</td><td>",
            F.col("o_orderstatus"), "</td></tr>",
        )

    def head(*names: str) -> Column:
        return F.lit("<tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>")

    rows = _repeat(key % 4 + 2, row)
    plain = head("Title", "Release Year", "Genre")
    html = (
        F.when(shape == 0, _text("<table><thead>", plain, "</thead><tbody>", rows, "</tbody></table>"))
        .when(shape == 1, _text("<table>", plain, rows, "</table>"))
        .otherwise(
            _text("<table><thead>", head("Random", "Title", "Release Year", "Genre"), "</thead><tbody>", rows, "</tbody></table>")
        )
    )
    orders = (dealt_rows if dealt else read_table)(spark, sf_dir, "orders")
    return orders.select(key.alias("page_id"), _text(SITE, "/order/", key).alias("url"), html.alias("html"))


def catalogue_pages(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """One listing page per customer: links to pages 3k+1 .. 3k+3, a next link on
    even keys, a frame, many paragraphs, and 1 to 5 table rows."""
    key = F.col("c_custkey")
    html = _text(
        '<html><body><iframe src="/player"></iframe>', _repeat(key % 25 + 51, lambda i: _text("<p>Note ", i, "</p>")),
        "<table><tbody>", _repeat((key + 2) % 5 + 1, lambda i: _text("<tr><td>Row ", i, "</td></tr>")),
        '</tbody></table><div class="card">',
        _repeat(F.lit(3), lambda i: _text('<a href="/list/', key * 3 + i, '">', i, "</a>")), "</div>",
        F.when(key % 2 == 0, _text('<a class="next page-numbers" href="/list/', key, '?page=2">Next</a>')).otherwise(""),
        '<a href="mailto:desk@example.com">Mail</a></body></html>',
    )
    customers = (dealt_rows if dealt else read_table)(spark, sf_dir, "customer")
    return customers.select(key.alias("page_id"), _text(SITE, "/list/", key).alias("url"), html.alias("html"))


def block_pages(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """One page per customer that is neither listing nor detail: 3 to 8 cards,
    some without an image, some with a sign-in text."""
    key = F.col("c_custkey")

    def card(i: Column) -> Column:
        image = F.when((key + i) % 7 == 0, "").otherwise(_text('<img src="/c/', i, '.jpg">'))
        notice = F.when((key + i) % 5 == 0, "Please login ").otherwise("")
        words = F.repeat(F.lit("word "), ((key + i * 7) % 17 + 3).cast("int"))
        return _text(
            '<div class="card"><a href="/card/', i, '">', image, '</a><h1 class="title">', F.col("c_name"), " card ", i,
            "</h1><p>", notice, words, "</p></div>",
        )

    html = _text(
        '<html><body><iframe src="/ad"></iframe><main>', _repeat(key % 6 + 3, card), "</main></body></html>"
    )
    customers = (dealt_rows if dealt else read_table)(spark, sf_dir, "customer")
    return customers.select(key.alias("page_id"), _text(SITE, "/blocks/", key).alias("url"), html.alias("html"))


def film_block_pages(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """One page per part with 3 to 6 cards, some without a heading, some with a year, some with a director."""
    key = F.col("p_partkey")

    def card(i: Column) -> Column:
        heading = F.when((key + i) % 3 != 0, _text("<h2>", F.col("p_name"), " ", i, "</h2>")).otherwise("")
        year = F.when((key + i) % 2 == 0, _text("<span>", F.col("p_size") + 1950, "</span>")).otherwise("")
        director = F.when((key + i) % 5 < 2, _text("<b>Director: ", F.col("p_brand"), "</b>")).otherwise("")
        words = F.repeat(F.lit("word "), (i + 10).cast("int"))
        return _text('<div class="card"><a href="/card/', i, '"><img src="/c/', i, '.jpg"></a>', heading, "<p>", words, year, director, "</p></div>")

    html = _text("<html><body><main>", _repeat(key % 4 + 3, card), "</main></body></html>")
    parts = (dealt_rows if dealt else read_table)(spark, sf_dir, "part")
    return parts.select(key.alias("page_id"), _text(SITE, "/shelf/", key).alias("url"), html.alias("html"))


def broken_pages(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The listing pages, every fourth without markup."""
    whole = catalogue_pages(spark, sf_dir, dealt)
    return whole.withColumn("html", F.when(F.col("page_id") % 4 != 0, F.col("html")))


def prose_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a detail page, one paragraph for each of its lines."""
    text = F.col("text")
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    lines = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    html = _text('<div class="entry-content">', lines, "</div>")
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("page_id"), _text(SITE, "/text/", F.col("doc_id")).alias("url"), html.alias("html"))


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delivered record per customer, good and bad ones mixed."""
    key, name = F.col("c_custkey"), F.col("c_name")
    return read_table(spark, sf_dir, "customer").select(
        key.alias("item_id"),
        _text("\t", name, "\n").alias("title"),
        (key % 300 + 1790).cast("string").alias("year"),
        F.when(key % 10 != 0, _text(" Director ", key)).alias("director"),
        _text(F.col("c_mktsegment"), ",, ", name).alias("cast"),
        F.col("c_mktsegment").alias("genre"),
        F.when(key % 4 == 0, "N/A")
        .when(key % 4 == 1, F.repeat(F.lit(" "), 1500 * (key % 3 == 0).cast("int")))
        .when(key % 4 == 2, F.repeat(F.lit("A"), (key % 2 + 1000 + key % 3).cast("int")))
        .otherwise(_text("  Story ", key, " "))
        .alias("synopsis"),
        F.when(key % 5 == 0, _text("https://img.example.com/", key, ".jpg"))
        .when(key % 5 == 1, _text("ftp://img.example.com/", key))
        .when(key % 5 == 2, _text("img.example.com/", key))
        .when(key % 5 == 3, "not-a-url")
        .alias("poster_url"),
        F.when(key % 3 == 0, _text("//stream.example.com/", key)).alias("streaming_link"),
    )


def sourced_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of one source per part; many parts name the same title and year, and some fields are missing."""
    key = F.col("p_partkey")
    return read_table(spark, sf_dir, "part").select(
        key.alias("item_id"),
        F.when(key % 19 != 0, F.concat_ws(", ", "p_type", "p_name")).alias("title"),
        F.when(key % 17 != 0, (F.col("p_size") + 1950).cast("string")).alias("year"),
        F.when(key % 3 != 0, F.col("p_brand")).alias("director"),
        F.when(key % 5 != 0, F.concat(F.lit("kind "), key % 4)).alias("genre"),
        F.when(key % 11 != 0, _text(SITE, "/movie/", key)).alias("source_url"),
        (key % 10).alias("trust"),
    )


def misspelt_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second source: every other part again, a letter of its title lost, some without a director."""
    key = F.col("p_partkey")
    at = (key % (F.length("p_type") - 1) + 2).cast("int")
    wrong = F.concat(F.substring(F.col("p_type"), F.lit(1), at - 1), F.substring(F.col("p_type"), at + 1, F.length("p_type")))
    return read_table(spark, sf_dir, "part").where(key % 2 == 0).select(
        (key + 1_000_000_000).alias("item_id"),
        F.concat_ws(" ", "p_name", wrong).alias("title"),
        (F.col("p_size") + 1950).cast("string").alias("year"),
        F.when(key % 4 != 0, F.col("p_brand")).alias("director"),
        F.lit("drama").alias("genre"),
        _text(SITE, "/film/", key).alias("source_url"),
        (key % 7).alias("trust"),
    )


def url_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reference per page, its shape chosen by ``page_id % 12``: ``page_id, base, raw``."""
    key = F.col("page_id")
    shapes = [
        _text("/a/", key), _text("./b/", key), _text("../c/", key), _text("//host", key, ".example.com/p"), _text("#s", key),
        F.lit("  "), _text("mailto:m", key, "@example.com"), F.lit("JavaScript:void(0)"), _text("tel:", key),
        _text("ftp://example.com/", key), F.lit("None"), _text(" HTTPS://example.com/x/../y", key, "?q=1#part "),
    ]
    raw = F.coalesce(*[F.when(key % len(shapes) == i, s) for i, s in enumerate(shapes)])
    return read_table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("base"), raw.alias("raw"))


def _json(**fields: Column) -> Column:
    """JSON text of the fields that are not NULL."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _block(key: Column) -> Column:
    """A fenced block on every fourth key: some with nested values and a comment, some not a map."""
    plain = _text("Text\n```yaml\ncomponent: Part", key % 1000, "\npriority: P", key % 3, "\nowner: 'team ", key % 7, "'\n```\nend")
    nested = _text(
        "Text\n```yaml\ncomponent: Part", key % 1000, "\nnested:\n  component: deep\nlist:\n- x\npriority: P", key % 3,
        " # note\nowner: null\n```\nend",
    )
    not_a_map = F.lit("Text\n```yaml\n- component: list\n```\n")
    return F.when(key % 4 == 0, F.when(key % 32 == 0, not_a_map).when(key % 8 == 0, nested).otherwise(plain))


def local_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a local record, a JSON line (``pos, value``); a third have an id that no remote record has."""
    key = F.col("o_orderkey")
    number = key + F.when(key % 3 == 0, 1_000_000_000).otherwise(0)
    value = _json(
        github_issue=F.when(key % 6 != 5, number),
        title=F.when(key % 2 == 0, _text("Local ", key)),
        component=F.when(key % 7 != 0, _text("PART", key % 1000)),
        impact=F.when(key % 5 != 1, _text("Impact: ", F.col("o_orderpriority"))),
        status=F.when(key % 4 == 1, "open").when(key % 4 == 2, "done"),
        priority=F.when(key % 11 == 0, "P9"),
    )
    return read_table(spark, sf_dir, "orders").select(key.alias("pos"), value.alias("value"))


def remote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a remote record, a JSON line; a third have a number no local record has, some are pull
    requests, and some come twice, first with an older state."""
    key = F.col("o_orderkey")
    number = key + F.when(key % 3 == 1, 2_000_000_000).otherwise(0)
    value = _json(
        number=number,
        title=_text("Remote ", key),
        state=F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open"),
        body=F.coalesce(_block(key), F.when(key % 5 == 0, "").otherwise(_text("Plain ", key))),
        labels=F.array(F.struct(F.lit("keep-this").alias("name")), F.struct(_text("k", key % 10).alias("name"))),
        pull_request=F.when(key % 50 == 0, F.struct(F.lit("x").alias("url"))),
    )
    stale = _json(number=number, title=_text("Old ", key), state=F.lit("open"), labels=F.array(F.struct(F.lit("stale").alias("name"))))
    lines = F.array(F.struct((key * 2 + 1).alias("pos"), value.alias("value")))
    old = F.array(F.struct((key * 2).alias("pos"), stale.alias("value")))
    both = F.when((key % 13 == 0) & (key % 50 != 0), F.concat(old, lines)).otherwise(lines)
    return read_table(spark, sf_dir, "orders").select(F.inline(both))


def nested_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a remote record whose block holds maps, lists and texts of several lines; some blocks are malformed."""
    key, year = F.col("o_orderkey"), F.year("o_orderdate")
    block = _text(
        "component: Part", key % 1000, "\nrelease:\n  year: ", year, "\n  price: ", key % 90, ".5\n  open: ",
        F.when(key % 2 == 0, "yes").otherwise("false"), "\npeople:\n- name: 'team ", key % 7, "'\n  roles: [lead, \"p", key % 3,
        "\"]\n- name: ~\nnotes: |\n  first ", key, "\n  # second\nempty: {}\npriority: P", key % 3, " # note",
    )
    bad = _text("component: Part", key % 1000, "\n  release: deeper\n- item")
    fenced = _text("Text\n```yaml\n", F.when(key % 7 == 0, bad).otherwise(block), "\n```\nend")
    value = _json(number=key, title=_text("Remote ", key), body=F.when(key % 7 != 1, fenced).otherwise("no block"))
    return read_table(spark, sf_dir, "orders").select(key.alias("pos"), value.alias("value"))


def framed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one paragraph between a menu, a list of related links and a notice."""
    key, text = F.col("doc_id"), F.col("text")
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    menu = _repeat(key % 9 + 3, lambda i: _text('<li><a href="/m/', i, '">Menu entry ', i, " of many</a></li>"))
    related = _repeat(key % 5 + 4, lambda i: _text('<div class="card"><a href="/r/', i, '"><b>Read more about this</b></a> today</div>'))
    html = _text(
        "<html><head><title>A title of some words for all pages here and there</title></head><body><div><p>Welcome</p><ul>", menu,
        '</ul></div><div class="story"><script>var words = "never shown";</script><p>', text, "</p></div><div>", related,
        "</div><p>All rights reserved by us</p></body></html>",
    )
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(key.alias("page_id"), _text(SITE, "/framed/", key).alias("url"), html.alias("html"))


def detail_page_snapshots(spark: SparkSession, sf_dir: str, dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """The detail pages at two times: some gone, some new, some with more or other markup."""
    pages = detail_pages(spark, sf_dir, dealt)
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), "p_size")
    both = pages.join(parts, "page_id")
    size, html = F.col("p_size"), F.col("html")
    longer = F.replace(html, F.lit("</body>"), F.lit("<hr><hr></body>"))
    wrapped = F.replace(F.replace(html, F.lit("<body>"), F.lit("<body><main>")), F.lit("</body>"), F.lit("</main></body>"))
    rebuilt = F.lit('<section class="film"><h2>Film</h2></section>')
    was = F.when(size % 5 == 0, longer).when(size % 5 == 1, wrapped).when(size % 5 == 2, rebuilt).otherwise(html)
    columns = ["page_id", "url", "html"]
    return both.where("p_size <> 11").withColumn("html", was).select(columns), both.where("p_size <> 7").select(columns)


def project_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a side-table entry, a JSON line; one in five has the number of a record."""
    key = F.col("o_orderkey")

    def node(kind: str, name: Column | None = None, title: Column | None = None, field: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("__typename"),
            (none if name is None else name).alias("name"),
            (none if title is None else title).alias("title"),
            F.struct((none if field is None else field).alias("name")).alias("field"),
        )

    select, iteration = "ProjectV2ItemFieldSingleSelectValue", "ProjectV2ItemFieldIterationValue"
    nodes = F.array(
        node(select, name=F.lit("P0")),
        node(select, name=_text("P", key % 4)),
        node(select, name=F.when(key % 3 != 0, F.when(key % 2 == 0, "XS").otherwise("L"))),
        node(iteration, title=_text("Sprint ", key % 9), field=F.when(key % 2 == 1, "Sprint").otherwise("Other")),
    )
    content = F.struct(
        F.when(key % 20 == 0, "DraftIssue").otherwise("Issue").alias("__typename"),
        (key + F.when(key % 5 != 0, 3_000_000_000).otherwise(0)).alias("number"),
        _text("Remote ", key).alias("title"),
        F.when(key % 15 != 0, _text("Body ", key)).alias("body"),
        F.when(key % 25 != 0, "closed").alias("state"),
    )
    value = _json(content=content, fieldValues=F.struct(nodes.alias("nodes")))
    return read_table(spark, sf_dir, "orders").select(key.alias("pos"), value.alias("value"))
