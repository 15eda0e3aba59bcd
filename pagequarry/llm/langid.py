"""Language by compression: the language whose dictionary shortens a text most.

Each language has a zstandard raw-content dictionary made of samples of its texts. A text, reduced to its
letters, is compressed in blocks with every dictionary; the language with the smallest sum wins. When the
second best is nearly as small, the text is rejected. Every fourth text of the fit is kept out of the
dictionaries; compression level and margin are chosen on these.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import bucket_of, slices

#: Bounds of the fit: texts a language, characters of each, bytes of a dictionary.
SAMPLE_ROWS = 300
SAMPLE_CHARS = 600
DICTIONARY_BYTES = 96 * 1024
#: Texts are compressed in blocks of so many bytes, so that the dictionary serves all of a long text.
BLOCK = 4096
#: Compression levels to choose from; the lowest of those with most choice texts right.
LEVELS = (3, 6, 9)
#: A text is rejected when the second best language needs less than this share more: the widest of these that
#: rejects no more than ``REJECTED`` of the choice texts that are judged rightly.
MARGINS = (0.001, 0.0025, 0.005, 0.01)
REJECTED = 1 / 200
#: Every so-manieth text of a language is a choice text; a language with fewer than two of them has none.
CHOICE = 4
UNKNOWN = "und"
NOT_LETTERS = regex.compile(r"[^\p{L}]+")


def letters(text: str | None) -> bytes:
    """Lower-case letters with single blanks between."""
    return NOT_LETTERS.sub(" ", (text or "").lower()).strip().encode()


class Fit(NamedTuple):
    """What the tasks get: a dictionary for each language in order, the level, the margin."""

    dictionaries: tuple[tuple[str, bytes], ...] = ()
    level: int = LEVELS[0]
    margin: float = MARGINS[0]


def learn(docs: DataFrame, *, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, size: int = DICTIONARY_BYTES) -> Fit:
    """A dictionary for each value of ``lang``, from about ``rows`` texts of it, spread by a hash of the id, and the
    level and margin that serve best on the texts kept out of them.

    NULL ``lang`` or ``text`` takes no part. Counts are over all rows; rows that share an id give one text; what
    comes to the driver is bounded by about ``rows * chars`` for each language.
    """
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Fit()
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, rows / n))).otherwise(share)
    drawn = (F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 20)) / (1 << 20)) < share
    # a middle part of the text, so that a heading shared by many texts does not fill the dictionary
    cut = F.substring("text", F.greatest(F.lit(1), (F.length("text") - chars) / 2).cast("int"), F.lit(chars))
    # one text of each id, so that an id that very many rows repeat is one text to the driver
    one = known.where(drawn).groupBy("lang", "doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), cut.alias("text"))).alias("t"))
    taken = one.select("lang", "doc_id", F.col("t.text").alias("text")).collect()
    parts: dict[str, list[bytes]] = {}
    for row in sorted(taken, key=lambda r: (r.lang, str(r.doc_id), r.text)):
        if part := letters(row.text):
            parts.setdefault(row.lang, []).append(part)
    return fit(parts, size)


def fit(parts: dict[str, list[bytes]], size: int = DICTIONARY_BYTES) -> Fit:
    """Dictionaries of all but the choice texts, and the level and margin these choose."""
    kept, choice = {}, []
    for lang, texts in sorted(parts.items()):
        apart = len(texts) >= 2 * CHOICE
        kept[lang] = [t for i, t in enumerate(texts) if not apart or i % CHOICE]
        choice += [(lang, t) for t in texts[::CHOICE] if apart]
    dictionaries = tuple((lang, b" ".join(texts)[:size]) for lang, texts in kept.items())
    found = []
    for level in LEVELS:
        by_lang = compressors(dictionaries, level)
        judged = [(lang, sizes(t, by_lang)) for lang, t in choice]
        gaps = [ranked[1][0] / ranked[0][0] - 1 for lang, ranked in judged if ranked[0][1] == lang and len(ranked) > 1]
        fits = [m for m in MARGINS if gaps and sum(g < m for g in gaps) <= REJECTED * len(gaps)]
        found.append((len(gaps), -level, max(fits, default=MARGINS[0])))
    _, level, margin = max(found)
    return Fit(dictionaries, -level, margin)


@functools.lru_cache(maxsize=len(LEVELS))
def compressors(dictionaries: tuple[tuple[str, bytes], ...], level: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, content in dictionaries:
        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=level)
        out.append(
            (lang, zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=False, write_dict_id=False))
        )
    return out


def sizes(plain: bytes, by_lang: list[tuple[str, zstandard.ZstdCompressor]]) -> list[tuple[int, str]]:
    """Compressed size with each dictionary, smallest first, ties by language."""
    blocks = [plain[i : i + BLOCK] for i in range(0, len(plain), BLOCK)]
    return sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in by_lang)


def classify(text: str | None, by_lang: list[tuple[str, zstandard.ZstdCompressor]], margin: float) -> tuple[str, float, bool]:
    """Language, score from 0 to 1, and whether the margin is too narrow."""
    plain = letters(text)
    if not plain or not by_lang:
        return UNKNOWN, 0.0, True
    ranked = sizes(plain, by_lang)
    best, lang = ranked[0]
    scale = 2.0 + 0.01 * best
    score = 1.0 / sum(math.exp(-min(700.0, (size - best) / scale)) for size, _ in ranked)
    narrow = len(ranked) > 1 and ranked[1][0] - best < margin * best
    return lang, score, narrow


def label_batches(batches: Iterator[pa.RecordBatch], made: Fit, margin: float) -> Iterator[pa.RecordBatch]:
    by_lang = compressors(made.dictionaries, made.level)
    for batch in slices(batches):
        found = [classify(t, by_lang, margin) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        lang, score, narrow = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(narrow, pa.bool_())],
            ["doc_id", "held_out", "lang_pred", "score", "rejected"],
        )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(bucket_of(doc_id, 4) == 2, F.lit(False))


def identify(docs: DataFrame, *, margin: float | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row of ``docs``.

    Learns, level and margin included, from the rows whose ``crc32(doc_id) mod 4`` is not 2; ``margin`` replaces the one
    learnt. A NULL text, one without a letter, and
    every text when nothing could be learned are ``und`` with score 0, rejected. A tie of sizes goes to the
    language first in order, rejected. Very long texts are compressed block by block, whole. Repeated rows
    are judged each for itself; other columns are ignored; an empty table gives no rows. Row-local after
    the fit; the dictionaries travel with the tasks and are bounded in size.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    made = learn(docs.where(~held_out(F.col("doc_id"))))
    margin = made.margin if margin is None else margin
    return rows.mapInArrow(
        lambda batches: label_batches(batches, made, margin),
        "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean",
    )


def keep_batches(batches: Iterator[pa.RecordBatch], made: Fit, margin: float, at: int) -> Iterator[pa.RecordBatch]:
    by_lang = compressors(made.dictionaries, made.level)
    for batch in slices(batches):
        keep = [not classify(t, by_lang, margin)[2] for t in batch.column(at).to_pylist()]
        yield batch.filter(pa.array(keep, pa.bool_()))


def keep_identified(docs: DataFrame, *, margin: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is clear, with all their columns, whatever their names.

    Rows go whose text is NULL or without a letter, whose margin is narrow or tied, and all rows when nothing could
    be learned. Repeated rows are judged each for itself, very long texts whole; an empty table gives no rows.
    """
    made = learn(docs.where(~held_out(F.col("doc_id"))))
    margin = made.margin if margin is None else margin
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda batches: keep_batches(batches, made, margin, at), docs.schema)
