"""Field, paragraph, table and link extraction on small pages with known answers."""

import pytest
from pyspark.sql import functions as F

from pagequarry.functions.labels import label_dim, match_field, match_patterns
from pagequarry.labels import field_mapping, field_names, labels_for, threshold_for
from pagequarry.operators.fields import extract_main_fields, extract_paragraph_fields, page_fields, paragraph_fields
from pagequarry.operators.links import extract_links, rejected_links
from pagequarry.operators.tables import extract_tables
from pagequarry.schema import ITEM_FIELDS

HARBOUR = """<!doctype html><body class=wide>
<main><table>
 <tr><th>Category</th><th>Starring</th><th>Film Title</th></tr>
 <tr><td>Noir</td><td>I. Voss</td><td>Salt Pier</td></tr>
</table>
<div class="post entry-content"><p>Starring: P. Okafor, L. Hahn</p><figure><img src=/covers/88.webp></figure>
<p><i>Category</i> – Thriller</p><p>Running Time - 97 min</p></div>
<span class="ytps">1974</span><header><h1 class="big entry-title">Harbour Fog</h1></header>
<footer><ul><li><a href="../archive/b?page=3#end">b</a></ul><section class="movie"><a href="/archive/c">c</a></section></footer>
<iframe src="http://cdn.harbour.test:81/play"></iframe></main>"""


def found(row, names):
    return {n: row[n] for n in names if row[n] is not None}


# one selector rule each; the first field of the page is what the rule gives
MAIN = {
    "class before tag order": ("<h1 class='title'>low</h1><section><h1 class='entry-title'>high</h1></section>", {"title": "high"}),
    "fallback class": ("<article><h1 class='x title y'>Kelp</h1></article>", {"title": "Kelp"}),
    "first of equal ones": ("<h1 class=entry-title>one<h1 class=entry-title>two", {"title": "one"}),
    "nothing inside": ("<p><h1 class='entry-title'> \n </h1><span class='ytps'>\t</span>", {}),
    "cut off": ("<h1 class='entry-title'>Unfinished sente", {"title": "Unfinished sente"}),
    "script in a comment": ("<!-- <span class='ytps'>1</span> --><script><span class='ytps'>2</span></script>", {}),
    "deep text": ("<h1 class='entry-title'> <b>Deep</b> tail</h1>", {"title": "Deep tail"}),
    "next selector before deep text": ("<h1 class='entry-title'> <b>Deep</b></h1><div class='movie-title'>Third</div>", {"title": "Third"}),
    "burmese": ("<h1 class='entry-title'>ပင်လယ်</h1>", {"title": "ပင်လယ်"}),
    "long": (f"<h1 class='entry-title'>{'ab ' * 700}</h1>", {"title": ("ab " * 700).strip()}),
    "year among classes": ("<span class='release-year x'>1999</span>", {"year": "1999"}),
    "frame text": ("<iframe>inner</iframe>", {"streaming_link": "inner"}),
    "frame with a source": ("<iframe></iframe><iframe src='v.mp4'></iframe>", {"streaming_link": "v.mp4"}),
    "image in the content only": ("<img src='out.gif'><div class='x entry-content'><p><img src='in.gif'></p></div>", {"poster_url": "in.gif"}),
    "text before a dash goes": ("<h1 class='entry-title'>Part 2 - Low Tide</h1>", {"title": "Low Tide"}),
    "empty page": ("", {}),
}


def test_main_fields(parsed):
    rows = extract_main_fields(parsed([h for h, _ in MAIN.values()])).orderBy("page_id").collect()
    names = ["title", "year", "poster_url", "streaming_link"]
    assert {k: found(r, names) for k, r in zip(MAIN, rows, strict=True)} == {k: e for k, (_, e) in MAIN.items()}


@pytest.mark.parametrize(("clean", "link"), [(True, "//cdn.harbour.test:81/play"), (False, "http://cdn.harbour.test:81/play")])
def test_urls_cut_or_whole(parsed, clean, link):
    row = extract_main_fields(parsed([HARBOUR]), clean_urls=clean).first()
    assert row["streaming_link"] == link and row["poster_url"] == "/covers/88.webp"


def content(*paragraphs):
    return f"<div id=c class='entry-content wide'><div>{''.join(f'<p>{p}' for p in paragraphs)}</div></div>"


PARAGRAPHS = {
    "two labels": (content("Filmmaker: Ida Brandt", "Type: Opera"), {"director": "Ida Brandt", "genre": "Opera"}),
    "first of a field": (content("Runtime: 81", "Duration: 99"), {"duration": "81"}),
    "blanks around": (content(" \n Starring   :\t Noor Haddad "), {"cast": "Noor Haddad"}),
    "entity blank": (content("Actors&nbsp;: Bo"), {"cast": "Bo"}),
    "no label": (content("Nothing to see, move along.", ""), {}),
    "label in an element": (content("<em>Category</em>: Elegy"), {"genre": "Elegy"}),
    "accent": (content("Durée : deux heures"), {"duration": "deux heures"}),
    "burmese": (content("သရုပ်ဆောင် - မေ"), {"cast": "မေ"}),
    "too long": (content("Director: " + "very " * 40), {}),
    "outside the content": ("<p>Director: Nobody</p>", {}),
    "prose": (
        content(
            "He was cast away on a lonely island for seventeen years before anyone came.",
            "The best movie about war that was ever made in this part of the country.",
            "This type of story is always told twice, once by the winner.",
            "Later in the same year he left the town for good and never wrote.",
            "その年の冬はとても寒かったと祖母は言った。",
        ),
        {},
    ),
}


def test_paragraph_fields(parsed):
    rows = extract_paragraph_fields(parsed([h for h, _ in PARAGRAPHS.values()])).orderBy("page_id").collect()
    assert {k: found(r, field_names()) for k, r in zip(PARAGRAPHS, rows, strict=True)} == {k: e for k, (_, e) in PARAGRAPHS.items()}


def test_games_labels(parsed):
    row = extract_paragraph_fields(parsed([content("Game Studio: Quill", "Publisher: Vane")]), "games").first()
    assert found(row, field_names("games")) == {"developer": "Quill", "publisher": "Vane"}


def test_paragraph_overrides_main(parsed):
    html = "<h1 class='title'>Heading</h1><span class='ytps'>1950</span>" + content("Movie: Lantern Row", "Release Year: 1951")
    fields = parsed([html]).select(F.expr(page_fields("nodes")).alias("f")).first()["f"]
    assert fields == {"title": "Lantern Row", "year": "1951"}


def grid(*rows, head="th"):
    lines = ["".join(f"<{head if i == 0 else 'td'}>{c}" for c in r) for i, r in enumerate(rows)]
    return "<table>" + "".join(f"<tr>{line}" for line in lines) + "</table>"


TABLES = {
    "plain": (grid(["Movie", "Year"], ["Moss", "1971"], ["Fern", "1964"]), [{"title": "Moss", "year": "1971"}, {"title": "Fern", "year": "1964"}]),
    "head and body": (
        "<table><thead><tr><th>RELEASE year<th>Genre</thead><tbody><tr><td> 1933 <td>\nFarce</tbody></table>",
        [{"year": "1933", "genre": "Farce"}],
    ),
    "empty cell": (grid(["Movie", "Genre"], ["", "Satire"]), [{"genre": "Satire"}]),
    "unknown header": (grid(["Shelf", "Movie"], ["B7", "Gravel"]), [{"title": "Gravel"}]),
    "burmese": (grid(["ဒါရိုက်တာ", "နှစ်"], ["လှ", "၁၉၉၈"]), [{"director": "လှ", "year": "၁၉၉၈"}]),
    "short row": (grid(["Movie", "Genre", "Actors"], ["Quay"]), [{"title": "Quay"}]),
    "no header": (grid(["alone"], head="td"), []),
    "later column wins, extra cells go": (grid(["Movie", "Film Title"], ["A", "<b>B</b> <i>C</i>", "extra"]), [{"title": "B C"}]),
    "an empty header shifts": (grid(["", "Movie"], ["shifted", "x"]), [{"title": "shifted"}]),
    "nothing": ("<table></table>", []),
}


def test_tables(parsed):
    rows = extract_tables(parsed([h for h, _ in TABLES.values()])).orderBy("page_id", "table_id", "row_id").collect()
    got = {k: [found(r, ITEM_FIELDS) for r in rows if r["page_id"] == i] for i, k in enumerate(TABLES)}
    assert got == {k: e for k, (_, e) in TABLES.items()}


def test_table_align_cell(parsed):
    row = extract_tables(parsed([TABLES["an empty header shifts"][0]]), align="cell").first()
    assert found(row, ITEM_FIELDS) == {"title": "x"}


def test_whole_page(parsed):
    pages = parsed([("http://harbour.test/films/noir/", HARBOUR)])
    assert pages.select(F.expr(page_fields("nodes")).alias("f")).first()["f"] == {
        "title": "Harbour Fog", "year": "1974", "poster_url": "/covers/88.webp", "streaming_link": "//cdn.harbour.test:81/play",
        "cast": "P. Okafor, L. Hahn", "genre": "Thriller", "duration": "97 min",
    }
    assert [(r["genre"], r["cast"], r["title"]) for r in extract_tables(pages).collect()] == [("Noir", "I. Voss", "Salt Pier")]
    assert {r["url"] for r in extract_links(pages).collect()} == {"http://harbour.test/films/archive/b?page=3", "http://harbour.test/archive/c"}


# href, the link it gives or the reason against it, and whether it stands in a listing block
HREFS = [
    ("q/7", "http://d.test/s/q/7", True), (" /q/8\n", "http://d.test/q/8", True), ("/q/8#top", "http://d.test/q/8", False),
    ("//cdn.d.test/z", "http://cdn.d.test/z", False), ("?p=2", "http://d.test/s/t?p=2", False), ("../", "http://d.test/", False),
    ("mailto:x@d.test", "Non-crawlable scheme", True), ("TEL:12", "Non-crawlable scheme", False), ("javascript:go()", "Non-crawlable scheme", True),
    ("none", "Empty or None", True), ("gopher://d.test/1", "Unsupported or malformed URL format", False), ("http:/d", "http://d.test/d", False),
]


def test_links(parsed):
    blocks = "".join(f"<div class=card><a href='{h}'>t</a></div>" if primary else f"<a href='{h}'>t</a>" for h, _, primary in HREFS)
    pages = parsed([("http://d.test/s/t", blocks + "<a>no address</a>")])
    links = extract_links(pages).collect()
    good = {out for _, out, _ in HREFS if out.startswith("http")} - {"http://d.test/"}
    assert sorted(r["url"] for r in links) == sorted(good)
    assert {r["url"] for r in links if r["is_primary"]} == {"http://d.test/s/q/7", "http://d.test/q/8"}
    reasons = [r["reason"] for r in rejected_links(pages).collect()]
    assert {out for _, out, _ in HREFS if not out.startswith("http")} <= set(reasons) and "Fragment-only link or base URL" in reasons


def test_label_lookup(spark):
    assert threshold_for("nothing") == 70 and labels_for("nothing") == []
    assert field_names() == ["title", "year", "director", "genre", "duration", "cast"]
    with pytest.raises(ValueError, match="movies, games"):
        field_mapping("books")
    assert list(field_mapping("m", {"m": {"a": {"labels": ["A"]}, "b": {"type": "string"}, "c": 3}})) == ["a"]
    dim = label_dim(spark)
    assert dim.count() == 33 and dim.filter("field = 'year'").first()["threshold"] == 70


def scores(spark, texts, patterns):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(texts)], "i int, t string")
    rows = df.select("i", F.expr(match_patterns("t", patterns)).alias("m")).orderBy("i").collect()
    return [(r["m"]["field"], r["m"]["score"]) for r in rows]


def test_match_patterns(spark):
    got = scores(spark, ["Ship Name", "ship nmae", "totally unrelated", "", None, "CAPTAIN", "name ship"], {"ship": (["Ship Name"], 75), "who": (["Captain"], 70)})
    assert got[0] == ("ship", 100) and got[1][0] == "ship" and 75 <= got[1][1] < 100
    assert got[2:5] == [(None, 0)] * 3 and got[5] == ("who", 100) and got[6] == ("ship", 95)


def test_label_inside_a_text_counts_by_length(spark):
    eight, nine = "port " + "x" * 27, "port " + "x" * 28
    assert scores(spark, [eight, nine], {"p": (["Port"], 60)}) == [("p", 90), ("p", 60)]
    assert scores(spark, [nine], {"p": (["Port"], 61)}) == [(None, 0)]
    assert scores(spark, ["x" * 500 + "y"], {"p": (["Port"], 1)}) == [(None, 0)]
    row = spark.range(1).select(F.expr(match_field("'Genre: a rather long list of kinds'")).alias("m")).first()["m"]
    assert (row["field"], row["score"]) == ("genre", 90)


def test_earlier_field_wins_tie(spark):
    assert scores(spark, ["same"], {"a": (["Same"], 70), "b": (["Same"], 70)})[0][0] == "a"


def test_empty_and_missing_paragraphs(parsed):
    rows = parsed(["", "<div class='entry-content'></div>"]).select(F.expr(paragraph_fields("nodes")).alias("f")).collect()
    assert [r["f"] for r in rows] == [{}, {}]
