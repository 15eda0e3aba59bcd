"""Fields of a detail page: by selector priority, and by labelled paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.dom import Selector, own_texts, select_number, select_value, string_value, touched
from pagequarry.functions.labels import match_field
from pagequarry.functions.sql import each, first, keep, let, lits, override, sparse_map, struct, without_nulls
from pagequarry.functions.text import clean_text, is_paragraph_length, strip
from pagequarry.labels import field_names

# Selectors in order of priority.
FIELD_SELECTORS = {
    "title": [Selector("h1", "entry-title"), Selector("h1", "title"), Selector("div", "movie-title")],
    "year": [Selector(None, "ytps"), Selector("span", class_like="year")],
    "poster_url": [Selector("img", inside=Selector("div", "entry-content"), take="src")],
    "streaming_link": [Selector("iframe", take="src")],
}
URL_FIELDS = ["poster_url", "streaming_link"]
# Fixed value: a paragraph is taken only when it scores above this.
PARAGRAPH_MIN_SCORE = 70


def main_fields(nodes: str, selectors: dict[str, list[Selector]] = FIELD_SELECTORS, clean_urls: bool = True) -> str:
    """``map<field, value>`` of the fields found.

    ``clean_urls=True`` cuts URL fields at the first separator too, scheme and
    all; ``False`` keeps them whole.
    """

    def value(field: str, chain: list[Selector], among: str) -> str:
        found = select_value(nodes, chain, among)
        keep_whole = field in URL_FIELDS and not clean_urls
        return f"nullif({strip(found) if keep_whole else clean_text(found)}, '')"

    chains = [s for chain in selectors.values() for s in chain]
    return let(touched(nodes, chains), lambda among: sparse_map({f: value(f, chain, among) for f, chain in selectors.items()}))


def main_selectors(nodes: str, selectors: dict[str, list[Selector]] = FIELD_SELECTORS) -> str:
    """``map<field, bigint>``: the number, from 0, of the selector behind each value of ``main_fields``."""
    return sparse_map({f: select_number(nodes, chain) for f, chain in selectors.items()})


def paragraph_texts(nodes: str) -> str:
    """Candidate texts of ``div.entry-content p``: own text nodes first, then whole paragraphs."""

    def collect(paragraphs: str) -> str:
        own = each(own_texts(nodes, paragraphs), strip)
        whole = each(paragraphs, lambda p: strip(string_value(nodes, p)))
        return keep(f"concat({own}, {whole})", is_paragraph_length)

    return let(Selector("p", inside=Selector("div", "entry-content")).matches(nodes), collect)


def paragraph_fields(nodes: str, content_type: str = "movies") -> str:
    """``map<field, value>``: the first paragraph that matches each field."""
    def matched(texts: str) -> str:
        pairs = each(
            texts,
            lambda t: let(match_field(t, content_type), lambda m: struct(text=t, field=f"{m}.field", score=f"{m}.score")),
        )
        return keep(pairs, lambda m: f"{m}.field is not null and {m}.score > {PARAGRAPH_MIN_SCORE}")

    def first_of_each(hits: str) -> str:
        def value(field: str) -> str:
            hit = first(keep(hits, lambda h: f"{h}.field = {field}"))
            return let(hit, lambda h: f"if({h} is null, NULL, {clean_text(f'{h}.text')})")

        fields = f"array({lits(field_names(content_type))})"
        return without_nulls(f"map_from_arrays({fields}, {each(fields, value)})")

    # a paragraph of plain text is there as its own text and as a whole; the first of equal texts is the one that counts
    return let(let(f"array_distinct({paragraph_texts(nodes)})", matched), first_of_each)


def page_fields(
    nodes: str,
    selectors: dict[str, list[Selector]] = FIELD_SELECTORS,
    content_type: str = "movies",
    clean_urls: bool = True,
) -> str:
    """Main fields with the paragraph fields laid over them."""
    return override(main_fields(nodes, selectors, clean_urls), paragraph_fields(nodes, content_type))


def extract_main_fields(parsed: DataFrame, selectors: dict = FIELD_SELECTORS, clean_urls: bool = True) -> DataFrame:
    """One column per selector field, NULL when not found."""
    found = parsed.select("page_id", "url", F.expr(main_fields("nodes", selectors, clean_urls)).alias("f"))
    return found.select("page_id", "url", *[F.col("f")[name].alias(name) for name in selectors])


def extract_paragraph_fields(parsed: DataFrame, content_type: str = "movies") -> DataFrame:
    """One column per labelled field, NULL when not found."""
    found = parsed.select("page_id", "url", F.expr(paragraph_fields("nodes", content_type)).alias("f"))
    return found.select("page_id", "url", *[F.col("f")[name].alias(name) for name in field_names(content_type)])
