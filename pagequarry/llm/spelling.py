"""Spelling variants: words one edit apart, by dense tiles of common prefixes and suffixes.

Two words are one insertion, deletion or replacement apart exactly when their common prefix and suffix together
reach the longer length minus one. Words stand in padded code-point matrices, and blocks of them are compared pair
by pair of blocks: the first mismatch from the left and from the right gives both lengths at once.

Which words meet is settled by windows. A window ``[low, high)`` says where the edit lies in the longer word; all
outside it must be equal, so words are grouped by the longer length, the window and what they hold outside it. A
group with too many words for its tiles is parted by halving its window, and again; a window of one place leaves
only words that differ in that place, at most as many as there are letters. A pair is found in the one window that
holds the length of its common prefix.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import slices, stored

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form must be so many times as frequent as the word.
RATIO = 5
#: One run of a document in so many loses a code point.
PERIOD = 199
#: Words of a group, above which its window is halved, and the cells of a tile.
GROUP = 256
CELLS = 1 << 20
#: Different words counted at a time in a task.
COUNTED = 1 << 19

#: Latin-1 bytes: letters and U+00C0 to U+00FF stay, A-Z in lower case, all else parts runs.
FOLD = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """Lower-cased runs as Latin-1; what Latin-1 does not hold parts runs like any other character."""
    return (text or "").encode("latin-1", "replace").translate(FOLD).split(b" ")


def respelled(run: bytes, seed: int) -> bytes:
    """A run as counted: without one code point if its checksum says so. ``seed``: checksum of ``<doc_id>:``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % PERIOD:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n``: the words of this task that are long enough, counted in parts of bounded size."""
    held: Counter[bytes] = Counter()

    def settle() -> pa.RecordBatch:
        rows = [pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())]
        held.clear()
        return pa.RecordBatch.from_arrays(rows, ["word", "n"])

    for batch in slices(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for run, n in Counter(runs(text)).items():
                if len(run) >= LEAST_LENGTH:
                    held[respelled(run, seed)] += n
            if len(held) >= COUNTED:
                yield settle()
    if held:
        yield settle()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of all words long and frequent enough, counted over all of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = texts.mapInArrow(count_batches, "word string, n long").where(F.length("word") >= LEAST_LENGTH)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def outside() -> Column:
    """What a word holds outside the window ``low, high`` of the longer length ``size``, as a hash."""
    tail = F.expr("if(high = size, '', right(word, size - high))")
    return F.xxhash64(F.expr("left(word, low)"), F.lit("\0"), tail)


def placed(words: DataFrame) -> DataFrame:
    """Every word in the two halves of its own length and of the length above, with the hash of the rest."""
    sized = words.withColumn("size", F.explode(F.array(F.length("word"), F.length("word") + 1)))
    windows = "array(struct(0 as low, size div 2 as high), struct(size div 2 as low, size as high))"
    return sized.select("word", "n", "size", F.inline(F.expr(windows))).withColumn("rest", outside())


def halved(crowded: DataFrame) -> DataFrame:
    """The words of crowded groups in the two halves of their window."""
    middle = "(low + high) div 2"
    windows = f"array(struct(low, {middle} as high), struct({middle} as low, high))"
    return crowded.select("word", "n", "size", F.inline(F.expr(windows))).withColumn("rest", outside())


KEY = ["size", "low", "high", "rest"]
SCHEMA = "word string, n_near long, best struct<fewer: bigint, form: string>"


def near_words(words: DataFrame, *, group: int = GROUP, cells: int = CELLS) -> DataFrame:
    """``word, n_near, best``: how many words are near each word, and the most frequent of them (first of equals).

    Words without a near word are left out. Each group gives at most one row a word, never its pairs.
    """
    rows, found = placed(words), None
    while True:
        # a group of one word, or without a word of the longer length, has no pair
        sizes = rows.groupBy(*KEY).agg(F.count("*").alias("held"), F.max(F.length("word")).alias("most"))
        sizes = stored(sizes.where("held > 1 and most = size").drop("most"), "groups")
        keyed = stored(rows.join(sizes, KEY), "windows")
        crowded = ((F.col("held") > group) | (F.col("held") * F.col("size") > 4 * cells)) & (F.col("high") - F.col("low") > 1)
        sorted_groups = keyed.where(~crowded).drop("held").repartition(*KEY).sortWithinPartitions(*KEY, "word")
        part = stored(sorted_groups.mapInArrow(lambda b: tile_batches(b, cells), SCHEMA), "near")
        found = part if found is None else found.unionByName(part)
        rest = keyed.where(crowded)
        if rest.isEmpty():
            break
        rows = halved(rest.drop("held"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def tile_batches(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """``word, n_near, best`` from rows sorted by group: whole groups of one length at a time, of bounded size."""
    waiting: list[tuple] = []
    last = None
    for batch in slices(batches, 4096):
        for row in zip(*(batch.column(c).to_pylist() for c in (*KEY, "word", "n")), strict=True):
            if row[:4] != last:
                if waiting and (row[0] != last[0] or len(waiting) * last[0] >= cells // 4):
                    yield near_in_groups(waiting, cells)
                    waiting = []
                last = row[:4]
            waiting.append(row)
    if waiting:
        yield near_in_groups(waiting, cells)


def matrices(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points padded with zeros, from the left and from the right, and the lengths."""
    lengths = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    # letters here fit in a byte each; others take four
    codes = codes.astype(np.uint8) if codes.max() < 256 else codes
    row = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ahead, back = np.zeros((len(words), size), codes.dtype), np.zeros((len(words), size), codes.dtype)
    ahead[row, place] = codes
    back[row, np.repeat(lengths, lengths) - 1 - place] = codes
    return ahead, back, lengths


def shared_start(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of every row of ``a`` with every row of ``b``; 0 also if no cell differs."""
    return (a[:, None, :] != b[None, :, :]).argmax(axis=2)


def near_in_groups(rows: list[tuple], cells: int) -> pa.RecordBatch:
    """Sorted rows of one length as dense tiles: two blocks of rows that share a group, ``cells`` cells at most.

    Padding differs from every letter, so two different words of a group always differ in a cell.
    """
    words, counts, size = [r[4] for r in rows], [r[5] for r in rows], rows[0][0]
    ahead, back, lengths = matrices(words, size)
    starts = np.array([i == 0 or rows[i][:4] != rows[i - 1][:4] for i in range(len(rows))])
    group = np.cumsum(starts)
    low, high = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    near = np.zeros(len(rows), np.int64)
    best: list[tuple[int, str] | None] = [None] * len(rows)
    block = max(1, min(64, int((cells / size) ** 0.5)))
    for i in range(0, len(rows), block):
        left = slice(i, i + block)
        for j in range(i, len(rows), block):
            if group[j] > group[min(i + block, len(rows)) - 1]:
                break
            right = slice(j, j + block)
            start, end = shared_start(ahead[left], ahead[right]), shared_start(back[left], back[right])
            hit = (
                (start + end >= size - 1)
                & (group[left][:, None] == group[right][None, :])
                & (np.maximum(lengths[left][:, None], lengths[right][None, :]) == size)
                & (start >= low[left][:, None])
                & (start < high[left][:, None])
            )
            if i == j:
                hit = np.triu(hit, 1)
            for x, y in zip(*(k.tolist() for k in np.nonzero(hit)), strict=True):
                for a, b in ((i + x, j + y), (j + y, i + x)):
                    near[a] += 1
                    offer = (-counts[b], words[b])
                    if best[a] is None or offer < best[a]:
                        best[a] = offer
    kept = np.flatnonzero(near).tolist()
    form = pa.array([{"fewer": best[k][0], "form": best[k][1]} for k in kept], pa.struct([("fewer", pa.int64()), ("form", pa.string())]))
    return pa.RecordBatch.from_arrays([pa.array([words[k] for k in kept], pa.string()), pa.array(near[kept], pa.int64()), form], ["word", "n_near", "best"])


def with_roots(words: DataFrame) -> DataFrame:
    """Adds ``root``: from ``word`` over ``form`` to the last, itself if it has none.

    Every step leads to a far more frequent word, so paths are short and end; each round doubles the steps taken.
    """
    steps = stored(words.where("form is not null").select("word", F.col("form").alias("to")), "steps")
    while True:
        on = steps.select(F.col("word").alias("to"), F.col("to").alias("next"))
        longer = stored(steps.join(on, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "steps")
        steps = longer.select("word", "to")
        if longer.where("moved").isEmpty():
            break
    return words.join(steps, "word", "left").withColumn("root", F.coalesce("to", "word")).drop("to")


def spelling_variants(docs: DataFrame, *, group: int = GROUP, cells: int = CELLS, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs`` that is long and frequent enough.

    Words are runs of letters (A-Z in lower case, U+00C0 to U+00FF as they are); the checksum of document and run
    takes a code point out of a few. A near word differs by one inserted, deleted or replaced code point. The form
    is the most frequent near word (first in code-point order of equals) if it is at least ``ratio`` times as
    frequent. A NULL or empty text has no words; a NULL id counts as an empty one in the checksum; repeated rows
    count again. Words may be of any length; an empty table gives no rows; other columns are ignored.
    """
    words = stored(word_counts(docs), "words")
    near = near_words(words, group=group, cells=cells)
    likely = F.when(-F.col("best.fewer") >= ratio * F.col("n"), F.col("best"))
    with_form = words.join(near, "word", "left").withColumn("best", likely)
    named = stored(
        with_form.select(
            "word", F.col("best.form").alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            (-F.col("best.fewer")).alias("form_n"),
        ),
        "forms",
    )
    return with_roots(named).select("word", "form", "root", "n", "n_near", "form_n")
