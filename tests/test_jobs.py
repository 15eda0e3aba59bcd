"""Routing, candidates, validation, frontier, streams, sinks."""

import re

import pytest
from pyspark.sql import functions as F

from pagequarry.operators.candidates import candidate_blocks, pick_block
from pagequarry.operators.frontier import crawl, followed, in_domains, next_batch, unseen
from pagequarry.operators.classify import with_class
from pagequarry.operators.parse import node_rows, parse_errors, parse_pages
from pagequarry.operators.validate import dropped_items, valid_items
from pagequarry.plans.jobs import detail_items, extract_all, process_pages, run_counters, run_summary, validate_items
from pagequarry.schema import ITEM_FIELDS, PAGES
from pagequarry.sources import rendered, sinks
from pagequarry.sources.pages import missing_pages, page_key, read_html_dir, read_pages, seeds, stored_pages
from pagequarry.streaming.arrivals import arriving_pages, each_url_once, process_stream, processed_once, running_counts, store_stream

CARD = "<div class='card'><a href='/w'><img src='p.jpg'></a><h1 class='title'>{}</h1><p>{}</p></div>"
FRAME = "<iframe src='/ad'></iframe>"


def test_block_with_an_open_paragraph(parsed):
    html = "<section><a href='/reel/4'><img src='still.webp'><p>A keeper counts ships until the fog lifts</section>"
    rows = candidate_blocks(parsed([html], keep_html=True)).collect()
    assert len(rows) == 1 and "keeper counts" in rows[0]["snippet"]


def test_candidate_filters(parsed):
    long, short = "word " * 20, "tiny"
    html = (
        CARD.format("A", long) + CARD.format("B", short) + CARD.format("C", "Subscribe " + long)
        + f"<section><a href='/x'>{long}</a></section>" + CARD.format("D", long + "more")
    )
    rows = candidate_blocks(parsed([html], keep_html=True)).orderBy("rank").collect()
    assert ["D" in r["snippet"] for r in rows] == [True, False] and "A" in rows[1]["snippet"]


def test_candidates_script_text_does_not_count(parsed):
    html = f"<div><a href='/x'></a><img src='i'><script>{'login ' * 20}</script>{'word ' * 10}</div>"
    assert candidate_blocks(parsed([html], keep_html=True)).count() == 1


def test_candidates_at_most_five_and_cut(parsed):
    html = "".join(CARD.format(i, "x" * (3000 + i)) for i in range(8))
    rows = candidate_blocks(parsed([html], keep_html=True)).orderBy("rank").collect()
    assert [r["text_length"] for r in rows] == [3008, 3007, 3006, 3005, 3004]
    assert all(len(r["snippet"]) == 1500 for r in rows)


def test_process_pages(spark):
    pages = spark.createDataFrame(
        [
            (0, "https://e.com/detail", "<h1 class='title'>T</h1>"),
            (1, "https://e.com/block", FRAME + CARD.format("Small", "word " * 10) + CARD.format("Big", "word " * 20)),
            (2, "https://e.com/none", FRAME + "<p>nothing</p>"),
            (
                3,
                "https://e.com/list",
                FRAME + "<p>x</p>" * 51 + "<table>" + "<tr><td>1</td></tr>" * 3 + "</table>"
                "<a href='/a#f'>a</a><a href='tel:1'>b</a><a class='page-numbers next' href='/n'>n</a>",
            ),
            (4, "https://e.com/empty", ""),
        ],
        PAGES,
    )
    processed = process_pages(pages).orderBy("page_id")
    rows = processed.collect()
    assert [(r["page_type"], r["from_block"]) for r in rows] == [
        ("detail", False), ("detail", True), ("unknown", False), ("catalogue", False), ("detail", False)
    ]
    assert rows[0]["fields"] == {"title": "T"} and rows[1]["fields"]["title"] == "Big" and rows[2]["fields"] is None
    assert [x["url"] for x in rows[3]["links"]] == ["https://e.com/a", "https://e.com/n"]
    assert [(x["reason"], x["url"]) for x in rows[3]["rejected"]] == [("Non-crawlable scheme", "tel:1")]
    assert rows[3]["next_page"] == "/n" and rows[4]["fields"] == {}
    counters = run_counters(processed).first().asDict()
    assert counters == {"pages": 5, "items_scraped": 3, "invalid_links": 1, "errors": 0}
    assert detail_items(processed).count() == 3


def test_process_pages_has_no_shuffle(spark, sf_dir):
    plan = process_pages(read_pages(spark, f"{sf_dir}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" not in plan


def test_pages_are_parsed_once(spark, sf_dir):
    plan = process_pages(read_pages(spark, f"{sf_dir}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapInArrow", plan)) == 1


def test_block_nodes_equal_a_parse_of_the_snippet(parsed):
    """A block cut out of the page's nodes is what its first 1500 characters of source give by themselves."""
    blocks = [
        CARD.format("A", "word " * 20),
        "<article class='k'><nav><a href='/m'>menu</a></nav><img src='i.png'><h2>T &amp; U</h2><p>some words that are long enough</article>",
        CARD.format("C", "x" * 2000),
        f"<section><a href='/y'><img src='j'></a><div><p>{'long text ' * 140}</p><p>{'after the cut ' * 40}</p></div></section>",
    ]
    pages = [f"<body><ul><li>one<li>two</ul>{b}<footer>end</footer></body>" for b in blocks]
    whole = parsed(pages, keep_html=True)
    cut = {r.page_id: r.snippet for r in candidate_blocks(whole, max_candidates=1).collect()}
    assert len(cut) == len(blocks) and max(map(len, cut.values())) == 1500
    got = {r.page_id: r.nodes for r in pick_block(whole, max_candidates=1).collect()}
    want = {r.page_id: r.nodes for r in parsed([cut[i] for i in range(len(blocks))]).collect()}
    assert got == want


def test_missing_markup_is_an_error(spark):
    done = process_pages(spark.createDataFrame([(1, "u", None), (2, "v", "")], PAGES))
    rows = {r["page_id"]: r for r in done.collect()}
    assert (rows[1]["error"], rows[1]["page_type"], rows[1]["fields"]) == ("no markup", None, None)
    assert rows[2]["error"] is None and detail_items(done).count() == 1


def test_partition_count_does_not_matter(spark, sf_dir):
    pages = rendered.block_pages(spark, sf_dir)
    one, many = (
        {r["page_id"]: r["fields"] for r in process_pages(pages.repartition(n)).collect()} for n in (1, 16)
    )
    assert one == many


def test_extract_all_empty_page(spark):
    row = extract_all(spark.createDataFrame([(1, "https://e.com/x", "")], PAGES)).first()
    assert row["links"] == [] and row["main_fields"] == {} and row["fields"] == {} and row["items"] == []


def test_bad_page_is_reported(spark, monkeypatch):
    from pagequarry.operators import parse

    def fail_on_marker(source, real=parse._attributes):
        if "boom" in source:
            raise ValueError("bad page")
        return real(source)

    monkeypatch.setattr(parse, "_attributes", fail_on_marker)
    pages = spark.createDataFrame([(1, "u1", "<p a=1>x"), (2, "u2", "<p b=2>y<i boom>"), (3, "u3", "<p c=3>z")], PAGES)
    parsed = parse_pages(pages)
    assert [(r["url"], r["error"]) for r in parse_errors(parsed).collect()] == [("u2", "ValueError: bad page")]
    rows = node_rows(parsed).filter("tag = 'p'").orderBy("page_id").collect()
    assert [(r["page_id"], r["attrs"]) for r in rows] == [(1, {"a": "1"}), (3, {"c": "3"})]


ITEM = {"title": "T", "year": "2000", "director": "D"}


@pytest.mark.parametrize(
    "change, errors, values",
    [
        ({}, [], {"title": "T", "year": 2000}),
        ({"title": " \v Low Tide\n"}, [], {"title": "Low Tide"}),
        ({"director": "\r\tA. Wren "}, [], {"director": "A. Wren"}),
        ({"title": "\n \n"}, ["title"], {}),
        ({"title": None, "director": " "}, ["title", "director"], {}),
        ({"year": "1799"}, ["year"], {}),
        ({"year": "2999"}, ["year"], {}),
        ({"year": "-44"}, ["year"], {}),
        ({"year": "12345678901234"}, ["year"], {}),
        ({"year": "c. 1920"}, ["year"], {}),
        ({"year": None}, ["year"], {}),
        ({"year": " 1800 "}, [], {"year": 1800}),
        ({"year": "2030"}, [], {"year": 2030}),
        ({"year": "2031"}, ["year"], {}),
        ({"cast": " Mo ,Zi Li,\tAda"}, [], {"cast": ["Mo", "Zi Li", "Ada"]}),
        ({"cast": ",, x ,"}, [], {"cast": ["x"]}),
        ({"cast": " "}, [], {"cast": []}),
        ({"cast": None}, [], {"cast": None}),
        ({"synopsis": "n/A"}, [], {"synopsis": None}),
        ({"synopsis": "No Synopsis "}, [], {"synopsis": None}),
        ({"synopsis": "\t"}, [], {"synopsis": None}),
        ({"synopsis": "é" * 1001}, ["synopsis"], {}),
        ({"synopsis": "\n" * 1200}, ["synopsis"], {}),
        ({"synopsis": "é" * 1000}, [], {}),
        ({"poster_url": "still.webp"}, ["poster_url"], {}),
        ({"poster_url": "file:///still.webp"}, ["poster_url"], {}),
        ({"poster_url": "http://?q"}, ["poster_url"], {}),
        ({"poster_url": "http://:80/x"}, ["poster_url"], {}),
        ({"poster_url": "http://a b.com/"}, ["poster_url"], {}),
        ({"poster_url": "http://[::1]:8080/x?y"}, [], {}),
        ({"poster_url": " "}, ["poster_url"], {}),
        ({"poster_url": "HTTP://img.test:81/p", "streaming_link": "//x"}, ["streaming_link"], {}),
    ],
)
def test_validation(spark, change, errors, values):
    schema = ", ".join(f"{f} string" for f in ITEM_FIELDS)
    items = spark.createDataFrame([tuple({**ITEM, **change}.get(f) for f in ITEM_FIELDS)], schema)
    row = validate_items(items, as_of_year=2025).first()
    assert row["errors"] == errors
    for field, value in values.items():
        assert row[field] == value
    assert row["raw_title"] == {**ITEM, **change}["title"]


def test_validation_partial_and_digits(spark):
    items = spark.createDataFrame([("T", None, None), ("T", "၂၀၂၃", "D"), ("T", "x", None)], "title string, year string, director string")
    assert [r["errors"] for r in validate_items(items, 2025, "partial", local_digits=True).collect()] == [[], [], ["year"]]
    strict = validate_items(items, 2025)
    assert valid_items(strict).count() == 0 and dropped_items(strict).count() == 3


def test_validation_cast_array(spark):
    items = spark.createDataFrame([("T", "2000", "D", [" Alice ", "Bob", "", "\t"])], "title string, year string, director string, cast array<string>")
    assert validate_items(items, 2025).first()["cast"] == ["Alice", "Bob"]


def test_snapshot_lookup(spark, tmp_path):
    key = spark.range(1).select(page_key(F.lit("https://e.com/1"))).first()[0]
    (tmp_path / f"{key}.html").write_text("<p>မြန်မာ</p>", encoding="utf-8")
    snapshot = read_html_dir(spark, str(tmp_path))
    requests = seeds(spark, ["https://e.com/1", "https://e.com/2", "https://e.com/2"])
    assert [r["html"] for r in stored_pages(requests, snapshot).collect()] == ["<p>မြန်မာ</p>"]
    assert [r["url"] for r in missing_pages(requests, snapshot).collect()] == ["https://e.com/2"]


def test_domains(spark):
    df = spark.createDataFrame([("https://a.e.com/x",), ("https://e.com:8080/",), ("https://fake-e.com/",), ("https://e.com.evil.org/",)], "u string")
    assert [r[0] for r in df.select(F.expr(in_domains("u", ["e.com"]))).collect()] == [True, True, False, False]


def test_crawl_matches_plain_walk(spark, sf_dir):
    pages = rendered.catalogue_pages(spark, sf_dir)
    graph = followed(with_class(parse_pages(pages))).cache()
    plain = {r["url"]: (r["page_type"], [x["url"] for x in r["out"]]) for r in graph.collect()}
    start = f"{rendered.SITE}/list/0"
    depth, todo = {start: 0}, [start]
    while todo:
        url = todo.pop(0)
        if depth[url] < 4:
            for nxt in plain.get(url, (None, []))[1]:
                if nxt not in depth:
                    depth[nxt] = depth[url] + 1
                    todo.append(nxt)
    got = {r["url"]: (r["depth"], r["page_type"]) for r in crawl(graph, seeds(spark, [start]), max_depth=4).collect()}
    assert got == {u: (d, plain.get(u, (None,))[0]) for u, d in depth.items()} and len(got) > 20


def test_crawl_stops_without_pages(spark, parsed):
    graph = followed(with_class(parsed(["<p>x</p>"])))
    rows = crawl(graph, seeds(spark, ["https://e.com/gone"])).collect()
    assert [(r["url"], r["depth"], r["page_type"]) for r in rows] == [("https://e.com/gone", 0, None)]


def test_crawl_ends_in_a_cycle(spark):
    rows = [("a", "catalogue", [("b", 5, 0), ("b", 10, 1), ("c", 5, 2)]), ("b", "catalogue", [("a", 10, 0), ("d", 5, 1)]), ("c", "catalogue", [("d", 10, 0)])]
    graph = spark.createDataFrame(rows, "url string, page_type string, out array<struct<url: string, priority: int, pos: int>>")
    got = sorted((r["url"], r["depth"], r["priority"], r["page_type"]) for r in crawl(graph, seeds(spark, ["a", "a"])).collect())
    assert got == [("a", 0, 0, "catalogue"), ("b", 1, 10, "catalogue"), ("c", 1, 5, "catalogue"), ("d", 2, 10, None)]


def test_unseen_takes_the_most_urgent(spark):
    found = spark.createDataFrame([("a", 5, 1), ("a", 10, 4), ("a", 10, 3), ("b", 1, 1)], "url string, priority int, pos int")
    rows = unseen(found, spark.createDataFrame([("b",)], "url string")).collect()
    assert [tuple(r) for r in rows] == [("a", 10, 3)]


def test_unseen_and_next_batch(spark):
    found = spark.createDataFrame([("a", 10, 1), ("a", 10, 1), ("b", 5, 0), ("c", 10, 0)], "url string, priority int, pos int")
    fresh = unseen(found, spark.createDataFrame([("b",)], "url string"))
    assert [r["url"] for r in next_batch(fresh, 1).collect()] == ["c"] and fresh.count() == 2


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    source = str(tmp_path / "in")
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    for part in range(4):
        # page 5 arrives twice
        pages.filter(f"page_id % 4 = {part} or (page_id = 5 and {part} = 3)").coalesce(1).write.mode("append").parquet(source)
    once = processed_once(arriving_pages(spark, source, files_per_trigger=1))
    store_stream(once, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    flat = lambda df: sorted((r["page_id"], r["page_type"], sorted((r["fields"] or {}).items())) for r in df.collect())
    assert flat(got) == flat(process_pages(pages))
    process_stream(arriving_pages(spark, source), str(tmp_path / "all"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "all")).count() == pages.count() + 1
    query = (
        running_counts(arriving_pages(spark, source)).writeStream.outputMode("complete").format("memory")
        .queryName("counts").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sum(r["n"] for r in spark.table("counts").collect()) == pages.count() + 1


def test_watermarked_dedup(spark, tmp_path):
    src = str(tmp_path / "w")
    spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-01"), ("b", "2024-01-01")], "url string, at string").select(
        "url", F.col("at").cast("timestamp").alias("at")
    ).write.parquet(src)
    stream = spark.readStream.schema("url string, at timestamp").parquet(src)
    q = each_url_once(stream, "at").writeStream.format("memory").queryName("wm").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["url"] for r in spark.table("wm").collect()) == ["a", "b"]


def test_sinks(spark, sf_dir, tmp_path):
    processed = process_pages(rendered.catalogue_pages(spark, sf_dir)).cache()
    base = str(tmp_path)
    checked = validate_items(detail_items(processed), 2025, "partial")
    sinks.write_items(valid_items(checked), f"{base}/items", "t1")
    sinks.write_rejected(processed, f"{base}/rejected", "t1")
    sinks.write_errors(processed, f"{base}/errors", "t1")
    sinks.write_rejected(processed.filter("page_id < 0"), f"{base}/none", "t1")
    summary = run_summary(processed, "films", "2025-01-01T00:00:00", "2025-01-01T00:01:30.5", "finished")
    sinks.write_summary(summary, f"{base}/summary", "t1")
    row = spark.read.json(f"{base}/summary").first()
    assert row["runtime_seconds"] == 90.5 and row["errors"] == 0 and row["close_reason"] == "finished"
    assert spark.read.json(f"{base}/rejected").count() == row["invalid_links"] > 0
    assert not (tmp_path / "none").exists()
