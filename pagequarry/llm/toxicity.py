"""Toxicity by a small convolutional network over hashed words, trained in numpy.

Each half of a word's embedding is a row of a table of its own, chosen by a hash of its own, so that two words are
seldom alike in both. Filters of one, two and three words run over the text; the largest response of each filter over the
whole text goes into a logistic output. The rows start from the log-odds of the words that share them, brought
so many standard errors towards zero, so that few passes are enough and words without evidence start at zero. A word table also gives the
likeliest language of a text; the threshold of the logit is set for each language, and the score is the logistic
of the distance to it. One fifth of the training texts is kept from the fit: it chooses the number of standard errors
and sets the thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import BASES, as_bytes, bucket_of, slices

#: Bounds of the fit: texts of each label, and words of a text that may train.
SAMPLE_ROWS = 3000
SAMPLE_WORDS = 1200
#: Rows of each of the two word tables; row 0 is the blank around a text.
ROWS = 1 << 20
#: Buckets of the language table.
COARSE = 1 << 14
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6
BATCH = 64
#: Standard errors taken off the log-odds, to choose from, and the passes of a trial.
CAUTION = (1.0, 1.5, 2.0, 3.0)
TRIAL_EPOCHS = 2
#: Every so-manieth training text is kept from the fit to choose and calibrate with.
FOLD = 5
#: Threshold where nothing was learnt: no evidence, no toxicity.
UNLEARNT = 1.0
RATE = 0.01
#: Words run through the filters at a time.
BLOCK = 1 << 14
MEMORY = 400_000
EDGES = b".,!?;:*#&%$|\"'()-<>[]{}"


class Hasher:
    """Words of a text as 63-bit hashes."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashed(self, word: bytes) -> int:
        if len(self.known) >= MEMORY:
            self.known.clear()
        found = xxhash.xxh3_64_intdigest(word.strip(EDGES)) >> 1 | 1  # never 0, so "or" is safe
        self.known[word] = found
        return found

    def ids(self, text: bytes | None) -> np.ndarray:
        known, hashed = self.known.get, self.hashed
        words = (text or b"").decode().lower().encode().split()
        return np.fromiter((known(w) or hashed(w) for w in words), np.int64, len(words))


def table_rows(ids: np.ndarray) -> np.ndarray:
    """Row of each word in the first and in the second table, as two columns."""
    return np.stack([ids >> 1 & (ROWS - 1), ids >> 32 & (ROWS - 1)], 1) + 1


@dataclass
class Model:
    tables: np.ndarray  # two tables of ROWS + 1 rows of half an embedding
    filters: list[np.ndarray]  # for each width: width * SIZE x FILTERS
    shifts: list[np.ndarray]
    weights: np.ndarray
    bias: float
    languages: np.ndarray  # COARSE x languages: log-probabilities of words
    thresholds: np.ndarray

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """Table rows of a text's words, with blanks around."""
        edge = np.zeros((max(WIDTHS) - 1, 2), np.int64)
        return np.concatenate([edge, table_rows(ids), edge])

    def words(self, rows: np.ndarray) -> np.ndarray:
        """Embeddings of words given by their rows."""
        return np.concatenate([self.tables[k][rows[..., k]] for k in (0, 1)], -1)

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        """Largest response of every filter over the whole text."""
        most = max(WIDTHS)
        padded = self.rows(ids)
        best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        for at in range(0, len(padded) - most + 1, BLOCK):
            words = self.words(padded[at : at + BLOCK + most - 1])
            for k, (width, filt, shift) in enumerate(zip(WIDTHS, self.filters, self.shifts, strict=True)):
                out = responses(words, width, filt)
                if len(out):
                    part = slice(k * FILTERS, (k + 1) * FILTERS)
                    best[part] = np.maximum(best[part], out.max(0) + shift)
        return best

    def language(self, ids: np.ndarray) -> int:
        total = np.zeros(self.languages.shape[1], np.float64)
        for at in range(0, len(ids), BLOCK):
            total += self.languages[ids[at : at + BLOCK] >> 1 & (COARSE - 1)].sum(0)
        return int(total.argmax())

    def logit(self, ids: np.ndarray) -> float:
        return float(self.pooled(ids) @ self.weights) + self.bias

    def score(self, ids: np.ndarray) -> float:
        above = self.logit(ids) - self.thresholds[self.language(ids)]
        return float(1.0 / (1.0 + np.exp(-np.clip(above, -30, 30))))


def responses(words: np.ndarray, width: int, filt: np.ndarray) -> np.ndarray:
    """Filter outputs at every place; the windows are sums of shifted products, never copied out."""
    count = len(words) - width + 1
    if count <= 0:
        return np.empty((0, filt.shape[1]), np.float32)
    out = words[:count] @ filt[:SIZE]
    for k in range(1, width):
        out += words[k : k + count] @ filt[k * SIZE : (k + 1) * SIZE]
    return out


def evidence(texts: list[np.ndarray], labels: np.ndarray, table: int, caution: float) -> np.ndarray:
    """For each row of a table the log-odds of its words, brought ``caution`` standard errors towards 0."""
    seen = np.zeros((2, ROWS + 1))
    for ids, label in zip(texts, labels, strict=True):
        seen[int(label), np.unique(table_rows(ids)[:, table])] += 1
    total = np.array([[max(1, int((labels == k).sum()))] for k in (0, 1)])
    odds = np.log((seen + 0.5) / (total - seen + 0.5))
    error = np.sqrt((1 / (seen + 0.5) + 1 / (total - seen + 0.5)).sum(0))
    apart = np.where(seen.sum(0) > 0, odds[1] - odds[0], 0)
    return np.sign(apart) * np.clip(np.abs(apart) - caution * error, 0, 3)


def start(texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None], caution: float) -> Model:
    """A model in which the first value of each half of an embedding is the evidence of its row."""
    rng = np.random.default_rng(7)
    half = SIZE // 2
    tables = np.zeros((2, ROWS + 1, half), np.float32)
    for k in (0, 1):
        clear = evidence(texts, labels, k, caution)
        told = np.flatnonzero(clear)
        tables[k, told] = rng.normal(0, 0.05, (len(told), half))
        tables[k, :, 0] = clear
    filters = [rng.normal(0, 0.1, (w * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for filt, width in zip(filters, WIDTHS, strict=True):
        for k in (0, 1):
            filt[[j * SIZE + k * half for j in range(width)], : FILTERS // 2] += 0.5 / width
    names = sorted({x for x in langs if x})
    table = np.zeros((COARSE, max(1, len(names))), np.float32)
    for ids, lang in zip(texts, langs, strict=True):
        if lang:
            np.add.at(table[:, names.index(lang)], ids >> 1 & (COARSE - 1), 1)
    table = np.log((table + 0.1) / (table.sum(0) + 0.1 * COARSE)).astype(np.float32)
    weights = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    shifts = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    return Model(tables, filters, shifts, weights, 0.0, table, np.full(table.shape[1], UNLEARNT))


class Adam:
    def __init__(self, value: np.ndarray):
        self.m, self.v, self.t = np.zeros_like(value), np.zeros_like(value), 0

    def step(self, value: np.ndarray, grad: np.ndarray, rate: float = RATE) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        value -= rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-6)


def train(texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None]) -> Model:
    """A model of all but every fifth text; these choose the caution and set the thresholds.

    When one of the two parts lacks a label, as with few texts, all texts serve for both. Without both labels nothing is
    learnt.
    """
    if not len(texts) or labels.min() == labels.max():
        return start(texts, labels, langs, CAUTION[-1])
    # within each label, so that both parts hold both where they can
    rank = np.empty(len(texts), np.int64)
    for label in (0, 1):
        own = np.flatnonzero(labels == label)
        rank[own] = np.arange(len(own))
    apart = rank % FOLD == FOLD - 1
    if any(len(np.unique(labels[part])) < 2 for part in (apart, ~apart)):
        inner = outer = np.arange(len(texts))
    else:
        inner, outer = np.flatnonzero(~apart), np.flatnonzero(apart)

    def of(part: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, list[str | None]]:
        return [texts[i] for i in part], labels[part], [langs[i] for i in part]

    trials = [(missed(trained(*of(inner), caution, TRIAL_EPOCHS), *of(outer)[:2]), -caution) for caution in CAUTION]
    model = trained(*of(inner), -min(trials)[1], EPOCHS)  # the most cautious of the best
    calibrate(model, *of(outer)[:2])
    return model


def missed(model: Model, texts: list[np.ndarray], labels: np.ndarray) -> float:
    """Loss at the best single threshold."""
    logits = np.array([model.logit(t) for t in texts])
    return loss_at(cut(logits, labels), logits, labels)[0]


def loss_at(threshold: float, logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Share of each label on the wrong side of a threshold, summed, and its standard error."""
    wrong = [(logits[labels == 1] <= threshold), (logits[labels == 0] > threshold)]
    # half a miss is added on each side, as no miss among few does not mean none
    shares = [(w.sum() + 0.5) / (len(w) + 1) for w in wrong]
    return float(sum(w.mean() for w in wrong)), float(np.sqrt(sum(p * (1 - p) / len(w) for p, w in zip(shares, wrong, strict=True))))


def trained(texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None], caution: float, epochs: int) -> Model:
    """Logistic loss, both labels weighing the same; only the places that won a pool get a gradient."""
    model = start(texts, labels, langs, caution)
    rng = np.random.default_rng(11)
    cost = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    params = [*model.filters, *model.shifts, model.weights]
    steps = [Adam(p) for p in params]
    bias, bias_step = np.zeros(1, np.float32), Adam(np.zeros(1, np.float32))
    rows = [model.rows(t) for t in texts]
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            grads = [np.zeros_like(p) for p in params]
            moved: list[tuple[np.ndarray, np.ndarray]] = []
            for i in part:
                ids = rows[i]
                words = model.words(ids)
                outs = [responses(words, w, f) for w, f in zip(WIDTHS, model.filters, strict=True)]
                places = [o.argmax(0) for o in outs]
                raw = np.concatenate([o[p, np.arange(FILTERS)] + s for o, p, s in zip(outs, places, model.shifts, strict=True)])
                pool = np.maximum(raw, 0)
                logit = float(pool @ model.weights + bias[0])
                miss = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[i]) * cost[i] / len(part)
                grads[-1] += miss * pool
                bias_grad = miss
                back = np.where(raw > 0, miss * model.weights, 0)
                for k, width in enumerate(WIDTHS):
                    own = back[k * FILTERS : (k + 1) * FILTERS]
                    grads[len(WIDTHS) + k] += own
                    span = places[k][:, None] + np.arange(width)  # FILTERS x width
                    window = words[span].reshape(FILTERS, -1)
                    grads[k] += (window * own[:, None]).T
                    spread = (model.filters[k] * own).T.reshape(FILTERS, width, SIZE)
                    moved.append((ids[span].reshape(-1, 2), spread.reshape(-1, SIZE)))
                bias_step.step(bias, np.array([bias_grad], np.float32), RATE / len(part))
            for step, value, grad in zip(steps, params, grads, strict=True):
                step.step(value, grad)
            for where, grad in moved:
                for k in (0, 1):
                    np.add.at(model.tables[k], where[:, k], -0.05 * grad[:, k * SIZE // 2 : (k + 1) * SIZE // 2])
            model.tables[:, 0] = 0
    model.bias = float(bias[0])
    return model


def calibrate(model: Model, texts: list[np.ndarray], labels: np.ndarray) -> None:
    """The threshold with the fewest weighted misses, in the middle of its gap, for all languages.

    A language for which this one is clearly worse than its own gets its own.
    """
    logits = np.array([model.logit(t) for t in texts])
    groups = np.array([model.language(t) for t in texts])
    everywhere = cut(logits, labels)
    model.thresholds[:] = everywhere
    for k in range(len(model.thresholds)):
        x, y = logits[groups == k], labels[groups == k]
        if len(np.unique(y)) == 2:
            own = cut(x, y)
            loss, error = loss_at(everywhere, x, y)
            if loss - loss_at(own, x, y)[0] > error:
                model.thresholds[k] = own


def cut(logits: np.ndarray, labels: np.ndarray) -> float:
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], labels[order]
    missed = np.concatenate([[0], np.cumsum(y == 1) / max(1, (y == 1).sum())])
    wrong = np.concatenate([[0], np.cumsum(y == 0)])
    loss = missed + (wrong[-1] - wrong) / max(1, wrong[-1])
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    gaps = np.concatenate([[0], x[1:] - x[:-1], [0]])
    return float(edges[best[np.argmax(gaps[best])]])


def learn(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS, words: int = SAMPLE_WORDS) -> Model:
    """Fits on about ``rows`` training texts of each label, of at most ``words`` words each.

    Rows are drawn by a hash of the id from all labelled rows whose ``crc32(doc_id) mod 5`` is not 0; a
    text with more words is left out of the fit, not cut, since its label may rest on any part of it. Of an id
    that several rows share, one text is taken, the first by hash, so the driver gets one row an id at most.
    """
    usable = (
        labels.where("doc_id is not null and toxic is not null")
        .where(bucket_of(F.col("doc_id"), 5) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for toxic, n in counts.items():
        share = F.when(F.col("toxic") == toxic, F.lit(min(1.0, rows / n))).otherwise(share)
    drawn = usable.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)) < share)
    short = docs.where("text is not null").where(F.length("text") < 12 * words).select("doc_id", "text", "lang")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "lang")).alias("one")
    found = short.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(one)
    taken = sorted(found.select("doc_id", "toxic", "one.text", "one.lang").collect(), key=lambda r: r.doc_id)
    hasher = Hasher()
    texts, marks, langs = [], [], []
    seen: set[int] = set()
    for row in taken:
        ids = hasher.ids(row.text.encode())
        if len(ids) <= words and fresh(ids, seen):
            texts.append(ids)
            marks.append(row.toxic)
            langs.append(row.lang)
    return train(texts, np.array(marks, np.float64), langs)


def fresh(ids: np.ndarray, seen: set[int]) -> bool:
    """False for a near copy of a text before: copies would make their chance words look telling.

    A text is known by its least hashed word triple in each of four classes.
    """
    if len(ids) < 3:
        return True
    with np.errstate(over="ignore"):
        triples = (ids[:-2].astype(np.uint64) * np.uint64(BASES[0]) + ids[1:-1].astype(np.uint64)) * np.uint64(BASES[1])
        triples = (triples + ids[2:].astype(np.uint64)) * np.uint64(BASES[0])
    marks = {int(own.min()) for k in range(4) if len(own := triples[(triples >> np.uint64(40)) % 4 == k])}
    known = len(marks & seen) > 1
    seen |= marks
    return not known


def score_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model, hasher = shared.value, Hasher()
    for batch in slices(batches):
        scores = [model.score(hasher.ids(t)) for t in as_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
            ["doc_id", "held_out", "score", "predicted"],
        )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(bucket_of(doc_id, 5) == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    A NULL text counts as empty; an empty text gets the score of no evidence. Texts are scored whole, long
    ones in overlapping blocks. Without training rows, or with one label only, every score is below 0.5 (predicted
    0). Repeated rows are scored each for itself; several labels of one document
    count as the largest; other columns are ignored; an empty table gives no rows. The model is broadcast;
    its size is that of the two word tables, 32 MB, whatever the data.
    """
    model = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(
        lambda batches: score_batches(batches, shared), "doc_id long, held_out boolean, score double, predicted int"
    )
