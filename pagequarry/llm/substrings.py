"""Repeated passages by seed and extend.

Every document is cut into words. Winnowing picks an anchor in each stretch of words: of the neighbouring
runs of ``SEED`` words the one with the least hash. Two equal stretches of ``LENGTH`` words pick the same
anchor, so a repeat of that length always has an anchor in common. Documents are joined on anchors that
occur more than once. From such a seed the match is extended both ways: each stretch of ``LENGTH`` words
around the seed is ranked among the equal stretches around its other occurrences, by a 96-bit hash. All but
the first are matched; neighbouring ones join to maximal repeats, which are then taken out.

Nothing compares all pairs of a group. A stretch that very many documents share is ranked in parts, whose
firsts are ranked again, so no group is gathered in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import BASES, as_bytes, slices, stored, window_hashes, word_hashes

LENGTH = 20
SEED = 8
#: Occurrences of a seed from which its stretches are ranked in parts of about that size.
PART = 2000


def chosen(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` values the place of the least one, the last of equal ones."""
    count = len(hashes) - span + 1
    if count <= 0:
        return np.empty(0, np.int64)
    best = np.arange(count)
    least = hashes[:count].copy()
    for k in range(1, span):
        here = hashes[k : k + count]
        better = here <= least
        best[better] = np.flatnonzero(better) + k
        np.copyto(least, here, where=better)
    return best


def anchor_batches(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """``text hash, place, anchor hash`` of every winnowed anchor."""
    for batch in slices(batches):
        own, places, anchors = [], [], []
        for mark, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            words = (text or b"").split()
            if len(words) < length:
                continue
            runs = window_hashes(word_hashes(words)[:, 0], seed, BASES[0])
            at = np.unique(chosen(runs, length - seed + 1))
            own += [mark] * len(at)
            places.append(at)
            anchors.append(runs[at])
        if own:
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(anchors).view(np.int64))],
                ["__text", "place", "anchor"],
            )


def extend_batches(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Stretches of ``length`` words whose own anchor is repeated: ``id, text hash, start, h1, h2, parts``."""
    for batch in slices(batches):
        ids, own, starts, first, second, parts = [], [], [], [], [], []
        rows = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist())
        for doc_id, mark, text, seeds in zip(*rows, strict=True):
            words = (text or b"").split()
            hashes = word_hashes(words)
            anchors = chosen(window_hashes(hashes[:, 0], seed, BASES[0]), length - seed + 1)
            often = np.zeros(len(words), np.int32)
            often[[x["place"] for x in seeds]] = [x["parts"] for x in seeds]
            at = np.flatnonzero(often[anchors])
            ids += [doc_id] * len(at)
            own += [mark] * len(at)
            starts.append(at)
            first.append(window_hashes(hashes[:, 0], length, BASES[0])[at])
            second.append(window_hashes(hashes[:, 1], length, BASES[1])[at] >> np.uint64(32))
            parts.append(often[anchors[at]])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array(own, pa.int64()), pa.array(np.concatenate(starts).astype(np.int32)),
                pa.array(np.concatenate(first).view(np.int64)), pa.array(np.concatenate(second).astype(np.uint32).view(np.int32)),
                pa.array(np.concatenate(parts), pa.int32()),
            ],
            ["__id", "__text", "start", "h1", "h2", "parts"],
        )


def marks(text: str) -> list:
    """Two hashes that together stand for a text."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("__text"), F.xxhash64(F.lit("second"), whole).alias("__more")]


def keyed(docs: DataFrame) -> DataFrame:
    """``__id, __text, __more, text``: rows with the same id and text are one document."""
    return docs.select(F.col("doc_id").cast("long").alias("__id"), *marks("text"), F.col("text").alias("text"))


def repeats(texts: DataFrame, *, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``t1, t2, first_id, starts``: for each text that needs it, its first document and what repeats there.

    ``texts`` is ``keyed``. ``starts`` are the stretches of the first document with that text that also start
    earlier; every later document with the same text repeats as a whole. Earlier is a smaller
    ``(doc_id, hash of the text, start)``.
    """
    copies = texts.groupBy("__text", "__more").agg(
        F.min(F.struct("__id")).alias("low"), F.max(F.struct("__id")).alias("high")
    )
    copies = stored(
        copies.select(
            F.col("__text").alias("t1"), F.col("__more").alias("t2"), F.col("low.__id").alias("first_id"),
            (F.col("low") != F.col("high")).alias("copied"),
        ),
        "copies",
    )
    anchors = stored(
        texts.select("__text", "text").mapInArrow(
            lambda b: anchor_batches(b, length, seed), "__text long, place int, anchor long"
        ),
        "anchors",
    )
    often = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    often = often.select("anchor", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    seeds = anchors.join(often, "anchor").groupBy(F.col("__text").alias("of")).agg(
        F.collect_set(F.struct("place", "parts")).alias("seeds")
    )
    seeds = stored(seeds, "seeds")
    # a text that occurs more than once is looked at once, in its first document
    wanted = seeds.join(copies.select("t1", "first_id"), F.col("of") == F.col("t1")).select("of", "first_id", "seeds")
    seeded = texts.join(wanted, texts["__text"] == wanted["of"]).where(F.col("__id").eqNullSafe(F.col("first_id")) & F.col("__more").isNotNull())
    stretches = seeded.select("__id", "__text", "text", "seeds").mapInArrow(
        lambda b: extend_batches(b, length, seed), "__id long, __text long, start int, h1 long, h2 int, parts int"
    )
    order = ["__id", "__text", "start"]
    part = F.pmod(F.xxhash64("__id", "__text"), F.col("parts"))
    within = Window.partitionBy("h1", "h2", "part").orderBy(*order)
    ranked = stretches.withColumn("part", part).withColumn("rank", F.rank().over(within)).where("rank > 1 or parts > 1")
    ranked = stored(ranked.select(*order, "h1", "h2", "rank"), "ranked")
    # the firsts of the parts of one stretch: all but one of them are matched too
    among = Window.partitionBy("h1", "h2").orderBy(*order)
    firsts = ranked.where("rank = 1").withColumn("among", F.rank().over(among)).where("among > 1")
    matched = ranked.where("rank > 1").select("__text", "start").unionByName(firsts.select("__text", "start"))
    later = matched.groupBy(F.col("__text").alias("of")).agg(F.sort_array(F.collect_set("start")).alias("starts"))
    found = copies.join(later, F.col("t1") == F.col("of"), "left").where("copied or starts is not null")
    return found.select("t1", "t2", "first_id", "starts")


def with_repeats(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ``starts`` and ``whole``, which is true for later copies of a text.

    Joined on one hash, as the seeds are, so that a plan that does both shuffles the texts once; the other
    hash is compared besides.
    """
    joined = rows.join(found, (rows["__text"] == found["t1"]) & F.expr("__more - t2 = 0"), "left")
    return joined.withColumn("whole", F.col("t1").isNotNull() & ~F.col("__id").eqNullSafe(F.col("first_id")))


def covered(starts: list[int] | None, whole: bool, length: int, words: int) -> np.ndarray:
    """True for each word inside a matched stretch; a later copy is one, if long enough."""
    if whole and words >= length:
        return np.ones(words, bool)
    step = np.zeros(words + 1, np.int32)
    if starts and not whole:
        at = np.asarray(starts, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + length, -1)
    return np.cumsum(step[:words]) > 0


def spans(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered words, as start and end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def digest_batches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        columns = (batch.column(0).to_pylist(), as_bytes(batch.column(1)), *(batch.column(i).to_pylist() for i in (2, 3)))
        for doc_id, text, starts, whole in zip(*columns, strict=True):
            words = (text or b"").split()
            kept, found = words, []
            if starts or whole:
                mask = covered(starts, whole, length, len(words))
                kept = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                found = [{"start": a, "end": b} for a, b in spans(mask)]
            rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), found))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "repeats"],
        )


def removed_words(docs: DataFrame, *, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, repeats`` of every row of ``docs``.

    Removed is each word covered by ``length`` consecutive words that also start earlier, in a document of
    smaller ``doc_id`` or earlier in the same one; all is judged on the input. ``repeats`` are the maximal
    removed stretches. A NULL text has no words. A NULL ``doc_id`` comes before all others. Rows that agree
    in ``doc_id`` and text are one document and get the same answer; texts that share a ``doc_id`` are
    ordered by a hash. Texts shorter than ``length`` words lose nothing. Other columns are ignored; an empty
    table gives no rows.
    """
    texts = keyed(docs)
    joined = with_repeats(texts, repeats(texts, length=length, seed=seed)).select("__id", "text", "starts", "whole")
    return joined.mapInArrow(
        lambda b: digest_batches(b, length),
        "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start: long, end: long>>",
    )


def cut_batches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """``row, text, starts, whole``: the row and its text without the repeats."""
    for batch in slices(batches):
        texts = []
        for text, starts, whole in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if text and (starts or whole):
                words = text.split()
                mask = covered(starts, whole, length, len(words))
                text = b" ".join(w for w, m in zip(words, mask.tolist(), strict=True) if not m)
            texts.append(None if text is None else text.decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["__row", "text"])


def without_repeats(docs: DataFrame, *, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; a document without any keeps its text as it is.

    All columns stay; ``n_chars``, if there is one, follows the new text. A document of which nothing is
    left goes.
    """
    found = repeats(keyed(docs), length=length, seed=seed)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("__id"),
        *marks("text"),
        F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("__row"),
        docs["text"],
    )
    joined = with_repeats(rows, found).select("__row", "text", "starts", "whole")
    row_type = joined.schema["__row"].dataType.simpleString()
    cut = joined.mapInArrow(lambda b: cut_batches(b, length), f"__row {row_type}, text string")
    cut = cut.where("text is null or text != ''")
    columns = [
        F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("text") if c == "text" else F.col("__row").getField(c).alias(c)
        for c in docs.columns
    ]
    return cut.select(*columns)
