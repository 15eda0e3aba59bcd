"""Ranked lexical search with per-term geometric blocking.

Documents are kept as sparse vectors of the terms that a block of queries asks for. A shard is a bounded number of
such vectors. Within a shard every posting list that a query still needs is clustered by the similarity of its
documents into small blocks, and each block stores the largest value of every coordinate over its documents. The
product of a query with such a summary bounds the score of every document of the block, whatever else it holds; a
block is skipped only when that bound stays below the query's tenth score so far. Terms are taken from the rarest
on, and a query is done with a shard when the terms left cannot lift a new document to its threshold.

Numbers: a term's weight and a document's value for it are integers as the contract of the query fixes them, so all
bounds and scores are exact integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.llm.common import as_bytes, slices, stored

TOP = 10
#: Queries searched at a time, and the bytes of their texts: bounds what is sent to the tasks.
QUERIES_AT_ONCE = 500
BYTES_AT_ONCE = 1 << 20
#: Documents of a posting list that form one block, documents of a shard, and cells of its matrix.
BLOCK = 32
SHARD = 1024
CELLS = 1 << 22
#: Length of the sketches by which documents are clustered.
SKETCH = 32
#: Documents searched first; their tenth scores are lower bounds for all others.
FIRST = 4096

#: ASCII other than letters and digits parts terms; A-Z in lower case; everything beyond ASCII belongs to a term.
FOLD = bytes(ord(" ") if c < 128 and not chr(c).isalnum() else ord(chr(c).lower()) if c < 128 else c for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def query_blocks(items: DataFrame, at_once: int, bytes_at_once: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The queries in blocks of at most so many rows and, but for a single longer one, bytes of text."""
    waiting, held = [], 0
    # one row of each query, read by the driver partition by partition
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct().toLocalIterator():
        text = row.text.encode()
        if waiting and (len(waiting) == at_once or held + len(text) > bytes_at_once):
            yield waiting
            waiting, held = [], 0
        waiting.append((row.item_id, text))
        held += len(text)
    if waiting:
        yield waiting


def vector_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """``doc_id, n, columns, times`` of every document with a term: those of the vocabulary it holds, how often."""
    number = shared.value
    for batch in slices(batches):
        ids, sizes, columns, times = [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            words = terms(text)
            if not words:
                continue
            held = Counter(words)
            own = sorted((number[w], k) for w, k in held.items() if w in number)
            ids.append(doc)
            sizes.append(len(words))
            columns.append(np.array([c for c, _ in own], "<i4").tobytes())
            times.append(np.array([k for _, k in own], "<i8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(columns, pa.binary()), pa.array(times, pa.binary())],
            ["doc_id", "n", "columns", "times"],
        )


def frequency_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """``term, df``: the documents of this task that hold each term, with -1 for all documents and -2 for their terms."""
    held = np.zeros(size, np.int64)
    documents = total = 0
    for batch in batches:
        documents += batch.num_rows
        total += int(np.sum(batch.column(0).to_numpy(zero_copy_only=False)))
        found = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4")
        held += np.bincount(found, minlength=size)
    used = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([[-1, -2], used]), pa.int64()), pa.array(np.concatenate([[documents, total], held[used]]), pa.int64())],
        ["term", "df"],
    )


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def values(times: np.ndarray, n: int, documents: int, total: int) -> np.ndarray:
    m = 100 - 75 + (75 * n * documents) // total
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


class Queries:
    """A block of queries over a numbered vocabulary: for each its columns and the weights times repeats."""

    def __init__(self, texts: list[bytes], number: dict[bytes, int], weights: np.ndarray):
        self.columns, self.weights = [], []
        for text in texts:
            held = Counter(number[w] for w in terms(text))
            own = np.array(sorted(held), np.int64)
            self.columns.append(own)
            self.weights.append(weights[own] * np.array([held[c] for c in own.tolist()], np.int64))
        self.asking: list[list[int]] = [[] for _ in number]
        for q, own in enumerate(self.columns):
            for c in own.tolist():
                self.asking[c].append(q)
        # rarest terms first
        self.order = sorted((c for c in range(len(number)) if weights[c] > 0), key=lambda c: (-weights[c], c))

    def matrix(self, columns: np.ndarray, queries: list[int]) -> np.ndarray:
        """Weights of some queries at some columns (sorted; all that these queries hold)."""
        out = np.zeros((len(columns), len(queries)), np.int64)
        for at, q in enumerate(queries):
            out[np.searchsorted(columns, self.columns[q]), at] = self.weights[q]
        return out


class Shard:
    """A bounded number of document vectors and the search in them."""

    def __init__(self, ids: list[int], rows: list[tuple[np.ndarray, np.ndarray]], size: int):
        # in the order of ids, so that of equal scores the first row wins; NULL ids come last
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids = [ids[i] for i in order]
        self.cells = np.zeros((len(ids), size), np.int64)
        for at, i in enumerate(order):
            self.cells[at, rows[i][0]] = rows[i][1]
        directions = np.random.default_rng(7).standard_normal((size, SKETCH)).astype(np.float32)
        sketch = self.cells.astype(np.float32) @ directions
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        self.most = self.cells.max(axis=0, initial=0)

    def blocks(self, column: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a posting list, those of a block side by side, and where the blocks start.

        Each document goes to the pivot whose sketch is most like its own; what is too large is cut.
        """
        listed = np.flatnonzero(self.cells[:, column])
        if len(listed) <= BLOCK:
            return listed, np.zeros(1, np.int64)
        pivots = listed[:: BLOCK]
        nearest = np.argmax(self.sketch[listed] @ self.sketch[pivots].T, axis=1)
        order = np.argsort(nearest, kind="stable")
        nearest = nearest[order]
        place = np.arange(len(order)) - np.searchsorted(nearest, nearest)
        return listed[order], np.flatnonzero(place % BLOCK == 0)

    def search(self, queries: Queries, floors: np.ndarray, top: int) -> list[list[tuple[int, int]]]:
        """``(score, row)`` of the best documents of each query; those below its floor may be missing."""
        best: list[list[tuple[int, int]]] = [[] for _ in queries.columns]
        bar = floors.copy()
        # what the terms not yet taken can give at most
        left = np.array([int(w @ self.most[c]) for c, w in zip(queries.columns, queries.weights, strict=True)], np.int64)
        scored = np.zeros((len(queries.columns), len(self.ids)), bool)
        for column in queries.order:
            if not self.most[column]:
                continue
            live = [q for q in queries.asking[column] if left[q] > 0 and left[q] >= bar[q]]
            if live:
                self.visit(column, live, queries, best, bar, scored, top)
            for q in queries.asking[column]:
                own = int(queries.weights[q][np.searchsorted(queries.columns[q], column)])
                left[q] -= own * int(self.most[column])
        return best

    def visit(self, column, live, queries, best, bar, scored, top) -> None:
        """One posting list: summaries of its blocks against the queries, then the documents of blocks not ruled out."""
        rows, starts = self.blocks(column)
        columns = np.unique(np.concatenate([queries.columns[q] for q in live]))
        part = self.cells[np.ix_(rows, columns)]
        summaries = np.maximum.reduceat(part, starts, axis=0)
        weights = queries.matrix(columns, live)
        bounds = exact_product(summaries, weights)
        ends = np.append(starts[1:], len(rows))
        for at, q in enumerate(live):
            open_blocks = np.flatnonzero(bounds[:, at] >= bar[q])
            # the most promising block first: it lifts the threshold for the others
            for b in open_blocks[np.argsort(-bounds[open_blocks, at], kind="stable")].tolist():
                if bounds[b, at] < bar[q]:
                    break
                here = np.arange(starts[b], ends[b])
                here = here[~scored[q, rows[here]]]
                if not len(here):
                    continue
                scored[q, rows[here]] = True
                found = part[here] @ weights[:, at]
                keep = found >= max(1, bar[q])
                best[q] += zip(found[keep].tolist(), rows[here][keep].tolist(), strict=True)
                if len(best[q]) >= top:
                    best[q].sort(key=lambda x: (-x[0], x[1]))
                    del best[q][top:]
                    bar[q] = max(bar[q], best[q][-1][0])


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer product; by floating point where all sums stay below 2**53 and so are exact."""
    most = float(a.max(initial=0)) * float(b.sum(axis=0).max(initial=0))
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if most < 2.0**53 else a @ b


def search_batches(batches: Iterator[pa.RecordBatch], shared, top: int) -> Iterator[pa.RecordBatch]:
    """``query, doc_id, score``: the best documents of each shard of this task for every query."""
    queries, size, documents, total, floors = shared.value
    rows_at_once = max(16, min(SHARD, CELLS // max(1, size)))
    floors = np.array(floors, np.int64)

    def settle(ids, rows) -> pa.RecordBatch:
        shard = Shard(ids, rows, size)
        found = [(q, shard.ids[row], score) for q, own in enumerate(shard.search(queries, floors, top)) for score, row in own]
        return pa.RecordBatch.from_arrays(
            [pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["query", "doc_id", "score"]
        )

    ids, rows = [], []
    for batch in slices(batches):
        for doc, n, columns, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if columns:
                ids.append(doc)
                rows.append((np.frombuffer(columns, "<i4"), values(np.frombuffer(times, "<i8"), n, documents, total)))
            if len(ids) == rows_at_once:
                yield settle(ids, rows)
                ids, rows = [], []
    if ids:
        yield settle(ids, rows)


def best_of(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` best rows of each query; tasks keep their own best before anything is shuffled."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search_block(texts: DataFrame, block: list[tuple[int | None, bytes]], top: int) -> DataFrame:
    """``item_id, rank, doc_id, score`` for a bounded block of queries."""
    spark = texts.sparkSession
    context = spark.sparkContext
    vocabulary = sorted({w for _, text in block for w in terms(text)})
    number = {w: i for i, w in enumerate(vocabulary)}
    known = context.broadcast(number)
    vectors = stored(
        texts.mapInArrow(lambda b: vector_batches(b, known), "doc_id long, n long, columns binary, times binary"), "vectors"
    )
    size = len(vocabulary)
    counted = vectors.select("n", "columns").mapInArrow(lambda b: frequency_batches(b, size), "term long, df long")
    counts = {r.term: r.df for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    documents, total = counts.get(-1, 0), counts.get(-2, 0)
    weights = np.array([weight(documents, counts[c]) if c in counts else 0 for c in range(size)], np.int64)
    queries = Queries([text for _, text in block], number, weights)

    def run(rows: DataFrame, floors: list[int]) -> DataFrame:
        shared = context.broadcast((queries, size, documents, total, floors))
        return rows.mapInArrow(lambda b: search_batches(b, shared, top), "query long, doc_id long, score long")

    seeds = run(vectors.limit(FIRST), [0] * len(block))
    worst = best_of(seeds, top).where(F.col("rank") == top).select("query", "score").collect()
    floors = {r.query: r.score for r in worst}
    found = best_of(run(vectors, [floors.get(q, 0) for q in range(len(block))]), top)
    names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], "query long, item_id long")
    return found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def ranked_documents(
    docs: DataFrame, items: DataFrame, *, top: int = TOP, at_once: int = QUERIES_AT_ONCE, bytes_at_once: int = BYTES_AT_ONCE
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of ``docs`` for every row of ``items``.

    Terms are the longest runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case; a NULL
    text has none. Only scores above 0 count; equal scores go by ascending ``doc_id``, a NULL id last. Every row of
    ``docs`` is a document, so repeated rows take ranks of their own; repeated rows of ``items`` (id and text) are
    one query, rows of one id with different texts are answered each for itself. Texts may be of any length: what a
    task holds is bounded by the shard's cells. Empty tables give no rows; other columns are ignored. Queries are
    taken in blocks of bounded size, and all documents are read once a block.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    blocks = [stored(search_block(texts, block, top), "ranked") for block in query_blocks(items, at_once, bytes_at_once)]
    for part in blocks:
        out = out.unionByName(part)
    return out
