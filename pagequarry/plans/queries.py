"""One query per operator, each over whole tables: ``(spark, sf_dir) -> DataFrame``.

Pages come from the page table, or are rendered from a table whose rows say what
the extraction must give (see ``sources.rendered``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.dom import Selector, elements, own_texts, select_value, string_value, stripped_texts, subtree
from pagequarry.functions.labels import label_dim, match_field
from pagequarry.functions.sql import each, first, keep, let, struct
from pagequarry.functions.text import clean_text, is_blacklisted, is_paragraph_length, strip
from pagequarry.functions.urls import reject_reason, resolve
from pagequarry.operators import (
    candidates,
    classify,
    curate,
    drift,
    fields,
    frontier,
    health,
    itemstore,
    linkage,
    links,
    maintext,
    origins,
    snapshots,
    tables,
    titleindex,
    validate,
)
from pagequarry.operators.parse import parse_errors, parse_pages
from pagequarry.plans import jobs, sqlfunctions
from pagequarry.schema import ITEM_FIELDS, TEXT_TAG
from pagequarry.session import new_dir
from pagequarry.sources import pages as stored
from pagequarry.sources import blocks, htmlstore, records, rendered, sinks
from pagequarry.streaming import arrivals, seen

Query = Callable[[SparkSession, str], DataFrame]

AS_OF_YEAR = 2025
DOMAINS = ["example.net", "blog.tiontion.example.com"]

QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return rendered.read_table(spark, sf_dir, name)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.conf.get(rendered.PARTITIONS, None)
    return stored.read_pages(spark, f"{sf_dir}/pages.parquet", int(wanted) if wanted else None)


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pages(pages(spark, sf_dir))


def mixed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail, listing and block pages together."""
    return (
        rendered.detail_pages(spark, sf_dir, dealt=True)
        .unionByName(rendered.catalogue_pages(spark, sf_dir, dealt=True))
        .unionByName(rendered.block_pages(spark, sf_dir, dealt=True))
    )


# ---- scans ----


@query
def page_scan(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", stored.page_key(F.col("url")).alias("key"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored URLs and all link targets."""
    targets = links.extract_links(parsed_pages(spark, sf_dir)).select("url")
    return read(spark, sf_dir, "pages").select("url").unionByName(targets).distinct()


@query
def snapshot_lookup(spark, sf_dir):
    return stored.stored_pages(_requests(spark, sf_dir), _snapshot(spark, sf_dir)).select("request_url", "key", "page_id")


@query
def store_round_trip(spark, sf_dir):
    """Every page written to a folder of files and read from it."""
    path = new_dir(spark, "store")
    htmlstore.write_store(pages(spark, sf_dir), path)
    return htmlstore.read_store(spark, path)


@query
def store_requests(spark, sf_dir):
    """The part of every line item as a request, answered by the file of its page."""
    path = new_dir(spark, "store")
    htmlstore.write_store(rendered.detail_pages(spark, sf_dir, dealt=True), path)
    requests = read(spark, sf_dir, "lineitem").select(F.concat(F.lit(f"{rendered.SITE}/movie/"), "l_partkey").alias("url"))
    return htmlstore.opened_pages(requests, path).select("url", F.length("html").cast("long").alias("size"))


@query
def missing_snapshots(spark, sf_dir):
    return stored.missing_pages(_requests(spark, sf_dir), _snapshot(spark, sf_dir))


# ---- nodes and selectors ----


@query
def tag_counts(spark, sf_dir):
    tags = parsed_pages(spark, sf_dir).select("page_id", F.explode(F.col("nodes")["tag"]).alias("tag"))
    return tags.filter(F.col("tag") != TEXT_TAG).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query
def parse_failures(spark, sf_dir):
    return parse_errors(parse_pages(rendered.broken_pages(spark, sf_dir, dealt=True)))


@query
def failed_pages(spark, sf_dir):
    """Pages without markup through the whole job: an error, no type, no item."""
    done = jobs.process_pages(rendered.broken_pages(spark, sf_dir, dealt=True))
    return done.filter("error is not null").select("page_id", "url", "page_type", F.col("fields").isNotNull().alias("has_item"), "error")


@query
def label_table(spark, sf_dir):
    """The label dimension beside the fields found on the pages, so that labels without a hit show too."""
    found = jobs.extract_all(rendered.detail_pages(spark, sf_dir, dealt=True)).select(F.explode(F.map_keys("fields")).alias("field"))
    hits = found.groupBy("field").agg(F.count("*").alias("n_pages"))
    fields_ = label_dim(spark).groupBy("field").agg(F.max("threshold").cast("long").alias("threshold"), F.count("*").alias("n_labels"))
    return fields_.join(hits, "field", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)).cast("long"))


@query
def seed_pages(spark, sf_dir):
    """A caller's start URLs, each with its stored page."""
    listing = rendered.catalogue_pages(spark, sf_dir, dealt=True)
    start = stored.seeds(spark, [f"{rendered.SITE}/list/{k}" for k in (1, 2, 3)] + [f"{rendered.SITE}/nowhere"])
    return start.join(listing.select("url", "page_id"), "url", "left")


@query
def own_text(spark, sf_dir):
    parsed = parse_pages(rendered.detail_pages(spark, sf_dir, dealt=True))
    found = let(elements("nodes", "p"), lambda ps: own_texts("nodes", ps))
    return parsed.select("page_id", F.posexplode(F.expr(found)).alias("pos", "text"))


@query
def heading_text(spark, sf_dir):
    """Whole text of the first ``h1``."""
    value = let(first(elements("nodes", "h1")), lambda n: string_value("nodes", n))
    return parsed_pages(spark, sf_dir).select("page_id", F.expr(value).alias("heading"))


@query
def cell_text(spark, sf_dir):
    """Text of every table cell, its stripped parts joined by blanks."""
    parsed = parse_pages(rendered.table_pages(spark, sf_dir, dealt=True))
    value = each(elements("nodes", "td"), lambda c: f"array_join({stripped_texts(subtree('nodes', c))}, ' ')")
    return parsed.select("page_id", F.explode(F.expr(value)).alias("cell"))


@query
def selector_counts(spark, sf_dir):
    """Descendant, class, substring, attribute and first-child selectors."""
    counts = {
        "nav_links": Selector("a", inside=Selector("nav")).matches("nodes"),
        "ad_blocks": Selector("div", "ad").matches("nodes"),
        "ad_like": Selector(class_like="a").matches("nodes"),
        "article_headings": Selector("h1", inside=Selector("article")).matches("nodes"),
        "with_lang": keep("nodes", lambda n: f"{n}.attrs['lang'] is not null"),
        "first_items": keep("nodes", lambda n: f"{n}.tag = 'li' and {n}.sib = 0"),
        "headings_or_items": elements("nodes", "h1", "li"),
    }
    return parsed_pages(spark, sf_dir).selectExpr("page_id", *[f"cast(size({c}) as bigint) as {n}" for n, c in counts.items()])


@query
def raw_links(spark, sf_dir):
    return links.hrefs(parsed_pages(spark, sf_dir)).select("page_id", "href")


@query
def field_by_selector(spark, sf_dir):
    """A caller's own selectors: by class, by tag and class, then any depth."""
    value = select_value("nodes", [Selector("h2"), Selector("div", "ad", take="deep"), Selector("h1")])
    return parsed_pages(spark, sf_dir).select("page_id", F.expr(strip(value)).alias("value"))


# ---- text ----


@query
def cleaned_texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.expr(clean_text("text")).alias("cleaned"))


@query
def stripped_texts_of_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.expr(strip("text")).alias("stripped"))


@query
def paragraph_lengths(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    kept = lines.select("doc_id", F.expr(strip("line")).alias("line")).filter(F.expr(is_paragraph_length("line")))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"))


@query
def blacklisted_texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.expr(is_blacklisted("text")).alias("is_junk"))


# ---- classification ----


def _stat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pages(pages(spark, sf_dir).unionByName(rendered.catalogue_pages(spark, sf_dir, dealt=True)))


@query
def page_stats(spark, sf_dir):
    return classify.page_stats(_stat_pages(spark, sf_dir)).drop("page_id")


@query
def page_rules(spark, sf_dir):
    # a page always has rules; without outer Spark filters on the array's size first and counts the elements again for each rule
    rows = classify.with_class(_stat_pages(spark, sf_dir)).select("url", F.inline_outer("rules"))
    return rows.select("url", "name", "passed", F.col("weight").cast("long").alias("weight"))


@query
def page_scores(spark, sf_dir):
    scored = classify.with_class(_stat_pages(spark, sf_dir))
    return scored.select(
        "url",
        classify.catalogue_score(F.col("rules"), "sum").alias("score_sum"),
        classify.catalogue_score(F.col("rules"), "weighted_average").alias("score_average"),
        classify.catalogue_score(F.col("rules"), "strict_majority").alias("score_majority"),
    )


@query
def detail_like_pages(spark, sf_dir):
    stats = classify.page_stats(parse_pages(mixed_pages(spark, sf_dir)))
    test = classify.detail_like({s: F.col(s) for s in classify.STATS})
    return stats.select("url", test.alias("is_detail_like"))


def _classes(mode: str) -> Query:
    def run(spark, sf_dir):
        everything = pages(spark, sf_dir).unionByName(mixed_pages(spark, sf_dir))
        return jobs.classify_pages(everything, mode=mode).select("url", "score", "page_type")

    return run


QUERIES["classify_as_coded"] = _classes("as_coded")
QUERIES["classify_intended"] = _classes("intended")


@query
def classify_own_rules(spark, sf_dir):
    """A caller's rules and thresholds."""
    rules = [
        classify.Rule("many_links", lambda s, t: s["links"] >= t["links"], 3),
        classify.Rule("short", lambda s, t: s["paragraphs"] <= t["paragraphs"], 2),
        classify.Rule("broken", lambda s, t: s["links"] > t["not given"], 5),
    ]
    limits = {"links": 6, "paragraphs": 3, "score_threshold": 3}
    classed = jobs.classify_pages(pages(spark, sf_dir), rules, limits, "intended")
    return classed.select("page_id", "score", "page_type")


# ---- links ----


@query
def resolved_urls(spark, sf_dir):
    cases = rendered.url_cases(spark, sf_dir)
    return cases.select("page_id", F.expr(resolve("base", "raw")).alias("url")).select(
        "page_id", "url", F.expr(reject_reason("url")).alias("reason")
    )


@query
def link_reasons(spark, sf_dir):
    """Checks on references as written, not resolved first."""
    return rendered.url_cases(spark, sf_dir).select("page_id", F.expr(reject_reason("raw")).alias("reason"))


@query
def extracted_links(spark, sf_dir):
    return links.extract_links(_stat_pages(spark, sf_dir)).select("src_url", "url", "is_primary")


@query
def rejected_links(spark, sf_dir):
    return links.rejected_links(_stat_pages(spark, sf_dir)).select("src_url", "url", "reason")


@query
def next_pages(spark, sf_dir):
    parsed = parse_pages(rendered.catalogue_pages(spark, sf_dir, dealt=True))
    return parsed.select("page_id", F.expr(links.next_page("nodes")).alias("next_page"))


def _catalogue_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    listing = rendered.catalogue_pages(spark, sf_dir, dealt=True)
    return links.extract_links(parse_pages(listing)), listing.select("page_id", "url")


@query
def unseen_links(spark, sf_dir):
    edges, listing = _catalogue_edges(spark, sf_dir)
    return frontier.unseen(edges.select("url"), listing)


@query
def links_in_domains(spark, sf_dir):
    edges = links.extract_links(parsed_pages(spark, sf_dir)).select("page_id", "url")
    return edges.filter(F.expr(frontier.in_domains("url", DOMAINS)))


@query
def link_graph(spark, sf_dir):
    return frontier.resolve_edges(*_catalogue_edges(spark, sf_dir))


@query
def frontier_order(spark, sf_dir):
    """The whole frontier with what orders it."""
    edges, listing = _catalogue_edges(spark, sf_dir)
    priority = F.when(F.col("is_primary"), frontier.CATALOGUE_PRIORITY).otherwise(frontier.PAGINATION_PRIORITY)
    found = edges.select("url", priority.alias("priority"), F.col("page_id").alias("pos"))
    return frontier.unseen(found, listing)


@query
def crawl(spark, sf_dir):
    graph = frontier.followed(classify.with_class(parse_pages(rendered.catalogue_pages(spark, sf_dir, dealt=True))))
    path = new_dir(spark, "graph")
    graph.write.parquet(path)
    start = stored.seeds(spark, [f"{rendered.SITE}/list/0"])
    return frontier.crawl(spark.read.parquet(path), start, ["films.example.com"])


# ---- fields ----


@query
def matched_labels(spark, sf_dir):
    """Labels, near misses and prose, nine texts for each part."""
    shapes = [
        F.lit("Title"), F.lit("Film Titles"), F.lit("Release Yaer"), F.concat(F.lit("Running Time: "), "p_size"),
        F.lit("year release"), F.col("p_name"), F.concat(F.lit("Genre - "), "p_type"), F.concat(F.lit("Actors "), "p_name"),
        F.concat("p_brand", F.lit(" Directd by")), F.concat(F.lit("He was cast away near "), "p_name", F.lit(" for seventeen long years")),
    ]
    texts = rendered.dealt_rows(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.posexplode(F.array(*shapes)).alias("shape", "text"))
    return texts.select("key", F.col("shape").cast("long"), "text", F.expr(match_field("text")).alias("m")).select(
        "key", "shape", "text", "m.field", F.col("m.score").cast("long").alias("score")
    )


@query
def paragraph_fields_prose(spark, sf_dir):
    """Every document as a page, one paragraph a line: prose gives no fields, or only those it is like."""
    found = fields.extract_paragraph_fields(parse_pages(rendered.prose_pages(spark, sf_dir)))
    return found.select("page_id", "title", "year", "director", "genre", "duration", "cast")


@query
def main_fields(spark, sf_dir):
    return fields.extract_main_fields(parse_pages(rendered.detail_pages(spark, sf_dir, dealt=True))).drop("url")


@query
def main_fields_whole_urls(spark, sf_dir):
    parsed = parse_pages(rendered.detail_pages(spark, sf_dir, dealt=True))
    return fields.extract_main_fields(parsed, clean_urls=False).drop("url")


@query
def paragraph_fields(spark, sf_dir):
    found = fields.extract_paragraph_fields(parse_pages(rendered.detail_pages(spark, sf_dir, dealt=True)))
    return found.select("page_id", "title", "year", "director", "genre", "duration", "cast")


@query
def paragraph_fields_games(spark, sf_dir):
    found = fields.extract_paragraph_fields(parse_pages(rendered.detail_pages(spark, sf_dir, dealt=True)), "games")
    return found.select("page_id", "genre", "developer", "platform")


@query
def merged_fields(spark, sf_dir):
    parsed = parse_pages(rendered.detail_pages(spark, sf_dir, dealt=True))
    found = parsed.select("page_id", F.expr(fields.page_fields("nodes")).alias("f"))
    return found.select("page_id", F.explode("f").alias("field", "value"))


# ---- tables ----


@query
def table_items(spark, sf_dir):
    rows = tables.extract_tables(parse_pages(rendered.table_pages(spark, sf_dir, dealt=True)))
    return rows.select("page_id", "title", "year", "genre", "director")


@query
def table_item_counts(spark, sf_dir):
    rows = tables.extract_tables(parse_pages(rendered.table_pages(spark, sf_dir, dealt=True)))
    return rows.groupBy("page_id").agg(F.count("*").alias("n_items"))


@query
def tables_in_sql(spark, sf_dir):
    """Table rows by a table function in SQL."""
    sqlfunctions.register_functions(spark)
    return spark.sql(
        """select p.page_id, t.values['title'] as title, t.values['year'] as year, t.values['genre'] as genre, t.values['director'] as director
        from {pages} p, lateral page_parts(p.html, p.url) parts lateral view outer inline(parts.tables) t where t.row_id is not null""",
        pages=rendered.table_pages(spark, sf_dir, dealt=True),
    )


@query
def links_in_sql(spark, sf_dir):
    """Valid links of every stored page by a function in SQL."""
    sqlfunctions.register_functions(spark)
    return spark.sql(
        """select p.url as src_url, l.url, l.is_primary from {pages} p, lateral page_parts(p.html, p.url) parts
        lateral view outer inline(parts.links) l where l.url is not null""",
        pages=pages(spark, sf_dir).unionByName(rendered.catalogue_pages(spark, sf_dir, dealt=True)),
    )


@query
def header_fields(spark, sf_dir):
    """Header to field, with the number of tables that use it."""
    parsed = parse_pages(rendered.table_pages(spark, sf_dir, dealt=True))
    headers = each(elements("nodes", "table"), lambda t: let(subtree("nodes", t), lambda p: tables.header_texts("nodes", p)))
    counted = (
        parsed.select(F.explode(F.flatten(F.expr(headers))).alias("header")).groupBy("header").agg(F.count("*").alias("n_tables"))
    )
    return counted.select("header", F.expr(f"{match_field('header')}.field").alias("field"), "n_tables")


@query
def table_rows_per_page(spark, sf_dir):
    """Rows in table bodies, or all rows where there are none."""
    stats = classify.page_stats(parse_pages(rendered.table_pages(spark, sf_dir, dealt=True)))
    return stats.select("page_id", "tables", "table_rows")


# ---- candidate blocks and routing ----


@query
def candidate_blocks(spark, sf_dir):
    parsed = parse_pages(rendered.block_pages(spark, sf_dir, dealt=True), keep_html=True)
    found = candidates.candidate_blocks(parsed)
    return found.select("page_id", F.col("rank").cast("long"), F.col("text_length").cast("long"), "snippet")


@query
def evident_blocks(spark, sf_dir):
    """Candidate blocks that show at least two of title, year and director."""
    parsed = parse_pages(rendered.film_block_pages(spark, sf_dir, dealt=True), keep_html=True)
    found = candidates.candidate_blocks(parsed, min_evidence=2)
    return found.select("page_id", F.col("rank").cast("long"), F.col("text_length").cast("long"), "snippet")


@query
def block_features(spark, sf_dir):
    """Blocks with an image and a link below them, with their text."""
    parsed = parse_pages(rendered.block_pages(spark, sf_dir, dealt=True))
    found = each(candidates.block_features("nodes"), lambda f: struct(text=f"{f}.text"))
    return parsed.select("page_id", F.inline(F.expr(found)))


@query
def best_blocks(spark, sf_dir):
    best = candidates.pick_block(parse_pages(rendered.block_pages(spark, sf_dir, dealt=True)))
    return best.select(
        "page_id",
        (F.col("block_no") + 1).cast("long").alias("rank"),
        F.expr(candidates.block_score("nodes")).cast("long").alias("score"),
    ).filter("rank is not null")


@query
def extracted_everything(spark, sf_dir):
    source = mixed_pages(spark, sf_dir).unionByName(rendered.table_pages(spark, sf_dir, dealt=True))
    return jobs.extract_all(source).select(
        "url",
        F.size("links").cast("long").alias("n_links"),
        F.size("main_fields").cast("long").alias("n_main_fields"),
        F.size("paragraph_fields").cast("long").alias("n_paragraph_fields"),
        F.size("items").cast("long").alias("n_items"),
        F.col("fields")["title"].alias("title"),
        F.col("fields")["director"].alias("director"),
    )


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.process_pages(mixed_pages(spark, sf_dir))


@query
def processed_pages(spark, sf_dir):
    f = F.col("fields")
    return _processed(spark, sf_dir).select(
        "url",
        "page_type",
        "from_block",
        F.coalesce(F.size("links"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.size("rejected"), F.lit(0)).cast("long").alias("n_rejected"),
        "next_page",
        *[f[c].alias(c) for c in ("title", "year", "director", "genre", "poster_url", "streaming_link")],
    )


@query
def processed_stored_pages(spark, sf_dir):
    done = jobs.process_pages(pages(spark, sf_dir))
    return done.select("page_id", "page_type", F.size("fields").cast("long").alias("n_fields"), "error")


# ---- validation and reports ----


@query
def checked_items(spark, sf_dir):
    checked = validate.check_items(rendered.raw_items(spark, sf_dir), AS_OF_YEAR)
    return checked.select(
        "item_id",
        "title",
        F.col("year").cast("long").alias("year"),
        "director",
        F.array_join("cast", "|").alias("cast_names"),
        "genre",
        "synopsis",
        F.array_join("errors", ",").alias("errors"),
    )


@query
def checked_items_partial(spark, sf_dir):
    checked = validate.check_items(rendered.raw_items(spark, sf_dir), AS_OF_YEAR, "partial")
    return validate.dropped_items(checked).select("item_id", F.array_join("errors", ",").alias("errors"))


@query
def dropped_by_reason(spark, sf_dir):
    checked = validate.check_items(rendered.raw_items(spark, sf_dir), AS_OF_YEAR)
    reasons = validate.dropped_items(checked).select(F.explode("errors").alias("reason"))
    return reasons.groupBy("reason").agg(F.count("*").alias("n_items"))


@query
def run_counters(spark, sf_dir):
    return jobs.run_counters(_processed(spark, sf_dir))


@query
def run_summary(spark, sf_dir):
    summary = jobs.run_summary(
        _processed(spark, sf_dir), "films", "2025-01-01T00:00:00", "2025-01-01T00:01:30.5", "finished", warnings=["slow"]
    )
    return summary.select(
        "spider_name", "runtime_seconds", "items_scraped", "errors", F.size("warnings").cast("long").alias("n_warnings"), "close_reason"
    )


@query
def written_items(spark, sf_dir):
    """Valid items through the JSON sink and back."""
    checked = validate.check_items(rendered.raw_items(spark, sf_dir), AS_OF_YEAR, "partial")
    path = new_dir(spark, "items")
    sinks.write_items(validate.valid_items(checked).select("item_id", *ITEM_FIELDS), path, "r1")
    back = spark.read.schema("item_id long, title string, year long, director string, run_ts string").json(path)
    return back.select("run_ts", "item_id", "title", "year", "director")


@query
def written_rejects(spark, sf_dir):
    path = new_dir(spark, "rejected")
    done = new_dir(spark, "processed")
    _processed(spark, sf_dir).write.parquet(done)
    sinks.write_rejected(spark.read.parquet(done), path, "r1")
    return spark.read.schema("page_id long, reason string, url string").json(path).select("page_id", "reason", "url")


@query
def written_errors(spark, sf_dir):
    path = new_dir(spark, "errors")
    sinks.write_errors(jobs.process_pages(rendered.broken_pages(spark, sf_dir, dealt=True)), path, "r1")
    return spark.read.schema("url string, error string, run_ts string").json(path).select("run_ts", "url", "error")


@query
def written_summary(spark, sf_dir):
    path = new_dir(spark, "summary")
    done = jobs.process_pages(rendered.broken_pages(spark, sf_dir, dealt=True))
    summary = jobs.run_summary(done, "films", "2025-01-01T00:00:00", "2025-01-01T00:00:09", "finished")
    sinks.write_summary(summary, path, "r1")
    back = spark.read.schema("spider_name string, runtime_seconds double, items_scraped long, errors long, run_ts string").json(path)
    return back.select("run_ts", "spider_name", "runtime_seconds", "items_scraped", "errors")


# ---- streams ----


def _arrival_parts(spark: SparkSession) -> int:
    """Files of each of the four arrivals: a batch reads those of two, so all cores have one."""
    return max(1, -(-spark.sparkContext.defaultParallelism // 2))


def _arrivals(spark: SparkSession, sf_dir: str) -> str:
    """The page table as four arrivals of some files each; every third page comes again in another one."""
    path = new_dir(spark, "arrivals")
    key, parts = F.col("page_id"), _arrival_parts(spark)
    twice = F.when(key % 3 == 0, F.array(key % 4, (key + 1) % 4)).otherwise(F.array(key % 4))
    arriving = pages(spark, sf_dir).withColumn("file", F.explode(twice))
    place = F.coalesce("file", F.lit(0)) * parts + F.pmod(F.xxhash64("url", "page_id"), F.lit(parts))
    arriving.repartitionById(4 * parts, place.cast("int")).drop("file").write.parquet(path)
    return path


@query
def streamed_pages(spark, sf_dir):
    """All stored pages through the arrival stream, each URL once although some arrive twice."""
    out = new_dir(spark, "stream")
    once = arrivals.processed_once(arrivals.arriving_pages(spark, _arrivals(spark, sf_dir), files_per_trigger=2 * _arrival_parts(spark)))
    arrivals.store_stream(once, f"{out}/rows", f"{out}/state").awaitTermination()
    done = spark.read.parquet(f"{out}/rows")
    return done.select("page_id", "page_type", F.size("fields").cast("long").alias("n_fields"), "error")


@query
def streamed_exactly_once(spark, sf_dir):
    """The same stream with every URL remembered: no page comes twice, whatever lies between its arrivals."""
    out = new_dir(spark, "exact")
    done = jobs.process_pages(arrivals.arriving_pages(spark, _arrivals(spark, sf_dir), files_per_trigger=2 * _arrival_parts(spark)), keep=("arrived",))
    slim = done.select("page_id", "url", "page_type", F.size("fields").cast("long").alias("n_fields"), "error")
    arrivals.store_stream(seen.first_of_each_key(slim), f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("page_id", "page_type", "n_fields", "error")


@query
def streamed_batches(spark, sf_dir):
    """Arriving pages through a caller's own job for each micro-batch."""
    out = new_dir(spark, "batches")
    arriving = arrivals.arriving_pages(spark, _arrivals(spark, sf_dir))
    arrivals.process_stream(arriving, f"{out}/rows", f"{out}/state", job=jobs.classify_pages).awaitTermination()
    done = spark.read.parquet(f"{out}/rows")
    return done.groupBy("page_id", "page_type").agg(F.count("*").alias("n_seen"))


@query
def streamed_counts(spark, sf_dir):
    """Pages by type, counted as they arrive; the last state of the counts."""
    out = new_dir(spark, "counts")
    arriving = arrivals.arriving_pages(spark, _arrivals(spark, sf_dir))
    counts = arrivals.running_counts(arriving, mode="intended")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows")

    writer = counts.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{out}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("page_type", "n")


# ---- record snapshots ----


@query
def local_records(spark, sf_dir):
    found = records.local_records(rendered.local_lines(spark, sf_dir))
    return found.select("pos", "id", F.explode("fields").alias("field", "value"))


@query
def remote_records(spark, sf_dir):
    found = records.remote_records(rendered.remote_lines(spark, sf_dir))
    return found.select("number", "title", "state", F.transform("labels", lambda x: x["name"]).alias("l")).select(
        "number", "title", "state", F.array_join("l", ",").alias("labels")
    )


@query
def skipped_pull_requests(spark, sf_dir):
    return records.skipped_pull_requests(rendered.remote_lines(spark, sf_dir))


@query
def embedded_blocks(spark, sf_dir):
    found = records.remote_records(rendered.remote_lines(spark, sf_dir))
    return found.select("number", F.explode("embedded").alias("field", "value"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.remote_records(rendered.nested_lines(spark, sf_dir))
    return found.withColumn("block", blocks.nested_block(F.col("body")))


@query
def nested_blocks(spark, sf_dir):
    """Every value of every block, however deep."""
    return blocks.block_leaves(_nested(spark, sf_dir), "block", "number")


@query
def nested_known_keys(spark, sf_dir):
    """Typed values at known places of a block; a malformed or missing block has none."""
    get = lambda path, kind: F.try_variant_get("block", path, kind)
    return _nested(spark, sf_dir).select(
        "number",
        get("$.component", "string").alias("component"),
        get("$.release.year", "int").alias("year"),
        get("$.release.open", "boolean").alias("open"),
        get("$.people[0].roles[1]", "string").alias("role"),
    )


@query
def nested_push_pull(spark, sf_dir):
    """Blocks written into a text and read again."""
    sent = _nested(spark, sf_dir).select("number", blocks.nested_body(F.col("block"), F.lit("Sent")).alias("body"))
    return blocks.block_leaves(sent.withColumn("block", blocks.nested_block(F.col("body"))), "block", "number")


@query
def project_records(spark, sf_dir):
    return records.project_records(rendered.project_lines(spark, sf_dir))


def _pulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.pull(
        records.local_records(rendered.local_lines(spark, sf_dir)),
        records.remote_records(rendered.remote_lines(spark, sf_dir)),
        records.side_fields(records.project_records(rendered.project_lines(spark, sf_dir))),
    )


PULLED_FIELDS = ["title", "description", "status", "priority", "size", "sprint", "component", "impact", "owner"]


@query
def pulled_records(spark, sf_dir):
    merged = _pulled(spark, sf_dir)
    return merged.select(
        "id", "change", "status_changed", *[F.col("fields")[c].alias(c) for c in [records.ID_KEY, *PULLED_FIELDS]]
    )


@query
def pull_summary(spark, sf_dir):
    return snapshots.pull_summary(_pulled(spark, sf_dir))


@query
def saved_records(spark, sf_dir):
    """Merged records through the JSON sink and back."""
    path = new_dir(spark, "records")
    sinks.write_records(_pulled(spark, sf_dir), path)
    back = records.local_records(records.read_lines(spark, path))
    return back.select("id", *[F.col("fields")[c].alias(c) for c in PULLED_FIELDS])


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.push_plan(
        records.local_records(rendered.local_lines(spark, sf_dir)),
        records.remote_records(rendered.remote_lines(spark, sf_dir)),
    )


@query
def push_plan(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    return plan.select("pos", "action", "number", "title", "description", "state", F.array_join("labels", ",").alias("labels"))


@query
def push_then_pull(spark, sf_dir):
    """What is sent, read back as it will be pulled: every key of the block as it was."""
    sent = _plan(spark, sf_dir).filter("action <> 'skip'").select("pos", F.explode(F.array(F.expr(records.embedded_block("description")))).alias("b"))
    return sent.select("pos", *[F.col("b")[c].alias(c) for c in ("component", "impact", "status", "priority")])


@query
def push_summary(spark, sf_dir):
    return snapshots.push_summary(_plan(spark, sf_dir))


# ---- curating ----


@query
def merged_items(spark, sf_dir):
    return curate.merge_items(rendered.sourced_items(spark, sf_dir))


def _two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered.sourced_items(spark, sf_dir).unionByName(rendered.misspelt_items(spark, sf_dir))


@query
def linked_items(spark, sf_dir):
    """Films of two sources whose titles are spelt differently, as one record each."""
    return linkage.linked_items(_two_sources(spark, sf_dir))


@query
def item_links(spark, sf_dir):
    """The evidence behind each link."""
    return linkage.links(linkage.blocks(linkage.title_nodes(_two_sources(spark, sf_dir))))


@query
def field_provenance(spark, sf_dir):
    parsed = parse_pages(rendered.detail_pages(spark, sf_dir, dealt=True), keep_html=True)
    rows = curate.provenance(parsed, fields.main_fields("nodes"))
    return rows.select("page_id", "field", "value", "source_url", F.length("html_hash").cast("long").alias("hash_length"))


@query
def field_selectors(spark, sf_dir):
    """The selector behind each value."""
    parsed = parse_pages(rendered.detail_pages(spark, sf_dir, dealt=True), keep_html=True)
    rows = curate.provenance(parsed, fields.main_fields("nodes"), fields.main_selectors("nodes"))
    return rows.select("page_id", "field", "value", "selector")


def _origins(pages: DataFrame) -> DataFrame:
    found = origins.main_origins("nodes"), origins.paragraph_origins("nodes"), origins.table_origins("nodes")
    return origins.field_origins(parse_pages(pages, keep_html=True), *found)


@query
def value_origins(spark, sf_dir):
    """Main and paragraph fields, with the place of each value on its page."""
    rows = _origins(rendered.detail_pages(spark, sf_dir, dealt=True))
    return rows.select("page_id", "extractor", "field", "value", "selector", "source_url", "html_hash", "reading", "path")


@query
def cell_origins(spark, sf_dir):
    """Table fields, with the place of each cell on its page."""
    return _origins(rendered.table_pages(spark, sf_dir, dealt=True)).select("page_id", "extractor", "field", "value", "reading", "path")


@query
def values_read_again(spark, sf_dir):
    """Every value of both kinds of pages, read anew at its path in the stored markup."""
    found = []
    for pages_of in (rendered.detail_pages, rendered.table_pages):
        shown = pages_of(spark, sf_dir, dealt=True)
        rows = _origins(shown).select("page_id", "extractor", "field", "value", "reading", "path")
        found.append(origins.values_at(rows, shown).select("page_id", "extractor", "field", "value", "again"))
    return found[0].unionByName(found[1])


@query
def enrichment_flags(spark, sf_dir):
    flagged = curate.with_enrichment(rendered.sourced_items(spark, sf_dir))
    return flagged.select("item_id", "title_only", "enrichment_needed")


@query
def retries(spark, sf_dir):
    events = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    errors = events.select(F.concat(F.lit(f"{rendered.SITE}/movie/"), "l_partkey").alias("url"))
    return curate.retry_queue(errors, max_attempts=12)


def _fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a fetch of its part's page, that failed if the item was sent back."""
    error = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("HTTP "), F.col("l_linenumber") + 500))
    url = F.concat(F.lit(f"{rendered.SITE}/movie/"), "l_partkey")
    return read(spark, sf_dir, "lineitem").select(url.alias("url"), F.col("l_shipdate").alias("at"), error.alias("error"))


@query
def retry_table(spark, sf_dir):
    times = [F.col(c).cast("string").alias(c) for c in ("first_failed", "last_failed", "next_at")]
    return health.retry_table(_fetches(spark, sf_dir), max_attempts=4).select("url", "attempts", "last_error", *times)


@query
def retries_due(spark, sf_dir):
    """The URLs that the next crawl starts from again."""
    return health.due(health.retry_table(_fetches(spark, sf_dir)), "2001-09-06")


@query
def retry_rates(spark, sf_dir):
    return health.retry_kpis(_fetches(spark, sf_dir))


@query
def capped_domains(spark, sf_dir):
    return curate.at_most_per_domain(pages(spark, sf_dir), limit=5).select("host", "page_id")


@query
def item_quality(spark, sf_dir):
    return curate.quality_report(rendered.sourced_items(spark, sf_dir))


def _value_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.value_report(rendered.sourced_items(spark, sf_dir), 1990, (*curate.FIELDS, "trust"), {"trust": (0, 8)})


@query
def value_ranges(spark, sf_dir):
    """Missing values, whole numbers and ranges of every field, with years up to five after 1990."""
    return _value_report(spark, sf_dir)


@query
def quality_alarms(spark, sf_dir):
    return health.alarms(_value_report(spark, sf_dir), {"title": 0.01, "year": 0.5, "genre": 0.1}, most_bad=0.05)


@query
def coverage_by_field(spark, sf_dir):
    """Share of each field's values that have a source."""
    values = F.create_map(*[x for f in curate.FIELDS for x in (F.lit(f), F.col(f))])
    items = rendered.sourced_items(spark, sf_dir)
    return health.field_coverage(items.select(F.col("item_id").alias("page_id"), "source_url", F.explode(values).alias("field", "value")))


@query
def merge_kpis(spark, sf_dir):
    return health.merge_kpis(rendered.sourced_items(spark, sf_dir))


@query
def item_kpis(spark, sf_dir):
    return curate.kpis(rendered.sourced_items(spark, sf_dir))


@query
def crawl_kpis(spark, sf_dir):
    """The KPIs with the median depth of the crawl."""
    return curate.kpis(rendered.sourced_items(spark, sf_dir), crawled=crawl(spark, sf_dir))


@query
def page_drift(spark, sf_dir):
    was, now = rendered.detail_page_snapshots(spark, sf_dir, dealt=True)
    return curate.drift(curate.shape_hash(parse_pages(was)), curate.shape_hash(parse_pages(now)))


@query
def page_drift_degree(spark, sf_dir):
    was, now = rendered.detail_page_snapshots(spark, sf_dir, dealt=True)
    return drift.drift_degree(drift.fingerprints(parse_pages(was)), drift.fingerprints(parse_pages(now)))


@query
def scrubbed_texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", curate.scrubbed(F.col("text")).alias("text"))


@query
def upserted_items(spark, sf_dir):
    """Every item in both runs: the incoming one has lost the director of two items in three and the genre of the rest."""
    items = rendered.sourced_items(spark, sf_dir)
    before = items.withColumns({"first_seen": F.lit("2024-01-01"), "last_seen": F.lit("2024-06-01")})
    third = F.col("item_id") % 3 == 0
    incoming = items.withColumns({"director": F.when(third, F.col("director")), "genre": F.when(~third, F.col("genre"))})
    return curate.upsert_items(before, incoming, "2025-01-01")


@query
def item_history(spark, sf_dir):
    """Three runs over every item: the values of each, and from when to when they held."""
    items = rendered.sourced_items(spark, sf_dir).withColumn("seen", F.lit("2024-01-01"))
    renamed = F.when(F.col("trust") < 5, F.concat(F.lit("new "), "genre")).otherwise(F.col("genre"))
    second = items.withColumns({"seen": F.lit("2024-06-01"), "genre": renamed})
    third = items.withColumns({"seen": F.lit("2025-01-01"), "director": F.when(F.col("trust") != 7, F.col("director"))})
    return curate.item_history(items.unionByName(second).unionByName(third))


@query
def stored_item_history(spark, sf_dir):
    """Three runs over every item laid over a stored catalogue: its values from run to run."""
    items = rendered.sourced_items(spark, sf_dir)
    renamed = F.when(F.col("trust") < 5, F.concat(F.lit("new "), "genre")).otherwise(F.col("genre"))
    signed = F.when(F.col("trust") == 7, F.concat(F.lit("by "), "director")).when(F.col("trust") > 7, F.col("director"))
    store = itemstore.ItemStore(spark, new_dir(spark, "items"))
    store.apply(items, "2024-01-01")
    store.apply(items.withColumn("genre", renamed), "2024-06-01")
    store.apply(items.withColumn("director", signed), "2025-01-01")
    return store.history()


@query
def upserted_all_items(spark, sf_dir):
    """Every item in both runs: the incoming one has lost some directors and renamed some genres."""
    items = rendered.sourced_items(spark, sf_dir)
    before = items.withColumns({"first_seen": F.lit("2024-01-01"), "last_seen": F.lit("2024-06-01")})
    renamed = F.when(F.col("trust") < 5, F.concat(F.lit("new "), "genre")).otherwise(F.col("genre"))
    incoming = items.withColumns({"director": F.when(F.col("trust") < 5, F.col("director")), "genre": renamed})
    return curate.upsert_items(before, incoming, "2025-01-01")


@query
def likely_items(spark, sf_dir):
    return curate.likely_items(rendered.sourced_items(spark, sf_dir)).select("item_id")


@query
def selector_ranking(spark, sf_dir):
    return curate.selector_success(parse_pages(mixed_pages(spark, sf_dir)))


@query
def title_search(spark, sf_dir):
    return curate.search_titles(rendered.sourced_items(spark, sf_dir), "Widget economy")


@query
def title_ranking(spark, sf_dir):
    """Every fiftieth record's title as a query against all records, from an index built in two runs."""
    index = titleindex.TitleIndex(spark, new_dir(spark, "titles"))
    index.add(rendered.sourced_items(spark, sf_dir))
    index.add(rendered.misspelt_items(spark, sf_dir))
    asked = rendered.sourced_items(spark, sf_dir).where("item_id % 50 = 0")
    return index.search(asked.select(F.col("item_id").alias("query_id"), F.col("title").alias("query")))


@query
def exported_items(spark, sf_dir):
    path = new_dir(spark, "export")
    curate.export_items(rendered.sourced_items(spark, sf_dir), path, "trust >= 5 and director is not null")
    return spark.read.schema("item_id long, title string, director string").json(path)


@query
def main_texts(spark, sf_dir):
    """The text of every document, found between menus and link lists."""
    return maintext.main_texts(parse_pages(rendered.framed_texts(spark, sf_dir)))
