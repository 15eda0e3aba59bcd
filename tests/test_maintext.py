"""Main text against a plain search over all runs of nodes."""

import random
import re

from pyspark.sql import functions as F

from pagequarry.operators import maintext
from pagequarry.operators.parse import parse_pages

WORD = re.compile(maintext.WORD)


def by_hand(nodes):
    """Best points over all runs, and the shown texts of the first best run."""
    link = skip = -1
    points = []
    for n in nodes:
        if n.id <= skip:
            points.append(0)
        elif n.tag == "#text":
            points.append(len(WORD.findall(n.text)) * (-1 if n.id <= link else 1))
        else:
            points.append(0 if n.tag in maintext.INLINE_TAGS else -maintext.TAG)
        link = max(link, n.last) if n.tag == "a" else link
        skip = max(skip, n.last) if n.tag in maintext.SKIPPED_TAGS else skip
    best = max((sum(points[i:j]) for i in range(len(points)) for j in range(i + 1, len(points) + 1)), default=0)
    return max(best, 0)


def random_page(rng):
    def words(n):
        return " ".join(rng.choice(["river", "film", "a", "of"]) for _ in range(n))

    def some(depth):
        out = ""
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if depth < 3 and kind < 0.35:
                tag = rng.choice(["div", "ul", "section", "b", "nav", "script", "em"])
                out += f"<{tag}>{some(depth + 1) if tag != 'script' else words(9)}</{tag}>"
            elif kind < 0.6:
                out += f"<a href=/x>{words(rng.randint(1, 5))}</a>"
            else:
                out += f"<p>{words(rng.randint(0, 14))}</p>"
        return out

    return some(0)


def test_points_of_random_pages(parsed):
    rng = random.Random(4)
    pages = parsed([random_page(rng) for _ in range(60)]).cache()
    want = {r.page_id: by_hand(r.nodes) for r in pages.collect()}
    got = {r.page_id: r.points for r in maintext.main_texts(pages).collect()}
    assert got == want


def test_body_between_menus(parsed):
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Entry {i} of the menu</a></li>" for i in range(30)) + "</ul>"
    body = "<div><h2>Head line</h2><p>One two three four <b>five</b> six <a href=/x>seven</a> eight nine ten.</p><script>var x = 1</script>"
    body += "<p>Eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen</p></div>"
    pages = parsed([f"<html><body>{menu}{body}{menu}<div>Footer words here</div></body></html>", menu, "", None, "few words", "w " * 100_000])
    got = [r.main_text for r in maintext.main_texts(pages).orderBy("page_id").collect()]
    assert got[0] == (
        "One two three four five six seven eight nine ten. Eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    )
    assert got[1:5] == [None] * 4 and len(got[5].split()) == 100_000


def test_block_with_most_main_text(spark):
    links = "<div>" + "<a href=/x>many words inside of links do not count at all</a>" * 9 + "</div>"
    prose = "<div><p>But a sentence of a dozen words outside of links does count for it</p></div>"
    pages = spark.createDataFrame([(1, [links, prose, prose]), (2, []), (3, None)], "page_id int, html array<string>")
    got = parse_pages(pages).select("page_id", F.expr(maintext.best_block_by_text("nodes")).alias("i")).collect()
    assert {r.page_id: r.i for r in got} == {1: 1, 2: None, 3: None}
