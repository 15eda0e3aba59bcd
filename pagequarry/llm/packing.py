"""Packing token sequences into windows of a fixed length, online and in bounded space.

A task tokenizes its documents one by one and keeps a fixed number of open windows. The part of a document
beyond whole windows goes to the open window with the least room that still holds it. When none does, the
fullest window is filled up with a cut of the piece and emitted. At the end of a task the open windows are
poured together, which leaves at most one that is not full. These rests, at most one a task, are merged in
groups, and what the groups leave again, until one group is left. Only rests carry their ids; what is
emitted is digested at once.
"""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import as_bytes, slices, stored

WINDOW = 2048
OPEN_WINDOWS = 32
#: Rests merged by one task of a merging round.
GROUP = 64
END = 1
#: Words remembered in a worker.
MEMORY = 500_000
MARKS = b".,!?;:*#&%$|\"()-"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "rest long, ids binary"
)
TYPES = [*[pa.int64()] * 8, pa.binary()]
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "rest", "ids"]


#: The characters that a byte-level vocabulary writes bytes with: printable ones stand for themselves.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in PRINTED} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(PRINTED))}


class Words:
    """Ids of texts by a tokenizer that drops white space: tokenized word by word and memoised.

    The tokenizer's rules never join characters across ASCII white space, so the ids of a text are those of
    its words. A word of letters is one piece to the tokenizer and goes straight to its model, and marks behind
    it are pieces of their own; all other words go through the whole tokenizer.
    """

    def __init__(self, path: str, control_ids: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not control_ids
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def raw(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def letters(self, piece: str) -> bytes:
        return array("I", [token.id for token in self.model.tokenize(piece)]).tobytes()

    def part(self, key: bytes, make, piece: str) -> bytes:
        found = self.parts.get(key)
        if found is None:
            if len(self.parts) >= MEMORY:
                self.parts.clear()
            found = self.parts[key] = make(piece)
        return found

    def word(self, key: bytes) -> bytes:
        core = key.rstrip(MARKS)
        tail = key[len(core) :]
        core = core.lower()
        if core.isalpha():  # ASCII letters only
            found = self.part(core, self.letters, core.decode())
        else:
            text = core.decode()
            plain = text.isalpha() and max(text) < "\u2000" and "\u0130" not in text and "\u03a3" not in text
            if not plain or not unicodedata.is_normalized("NFC", text):
                return self.raw(key.decode())
            core = text.lower().encode()
            found = self.part(core, self.letters, core.decode("latin-1").translate(BYTES))
        return found + self.part(tail, self.raw, tail.decode()) if tail else found

    def ids(self, text: bytes) -> bytes:
        """All ids of a text and the closing one, as little-endian unsigned 32-bit integers."""
        words = text.split()
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > MEMORY and new:
            known.clear()
            new = set(words)
        for key in new:
            known[key] = self.word(key)
        return b"".join(map(known.__getitem__, words)) + END.to_bytes(4, "little")


@functools.lru_cache(maxsize=1)
def tokenizer(path: str, control_ids: bool) -> Words:
    return Words(path, control_ids)


class Packer:
    """Open windows of one task. A piece is ``(doc_id, start, doc_tokens, ids)``."""

    def __init__(self, window: int, open_windows: int, first_id: int):
        self.window, self.most, self.next_id = window, open_windows, first_id
        self.open: list[tuple[int, list]] = []  # used, pieces
        self.out: list[tuple] = []

    def emit(self, pieces: list, rest: int | None = None) -> None:
        """Rows of one window; a rest keeps its ids for the next round."""
        offset = 0
        for doc_id, start, total, ids in pieces:
            n = len(ids) // 4
            self.out.append(
                (doc_id, start, n, zlib.crc32(ids), total, self.next_id, offset, rest, ids if rest is not None else None)
            )
            offset += n
        self.next_id += 1

    def add(self, piece: tuple) -> None:
        doc_id, start, total, ids = piece
        full = 4 * self.window
        at = 0
        while len(ids) - at >= full:  # whole windows stand alone
            self.emit([(doc_id, start + at // 4, total, ids[at : at + full])])
            at += full
        if at < len(ids):
            self.place((doc_id, start + at // 4, total, ids[at:]))

    def place(self, piece: tuple) -> None:
        doc_id, start, total, ids = piece
        n = len(ids) // 4
        fits = [i for i, (used, _) in enumerate(self.open) if used + n <= self.window]
        if fits:
            best = max(fits, key=lambda i: self.open[i][0])
            used, pieces = self.open[best]
            pieces.append(piece)
            self.open[best] = (used + n, pieces)
            if used + n == self.window:
                self.emit(self.open.pop(best)[1])
            return
        if len(self.open) < self.most:
            self.open.append((n, [piece]))
            return
        fullest = max(range(len(self.open)), key=lambda i: self.open[i][0])
        used, pieces = self.open.pop(fullest)
        room = self.window - used
        pieces.append((doc_id, start, total, ids[: 4 * room]))
        self.emit(pieces)
        self.place((doc_id, start + room, total, ids[4 * room :]))

    def close(self, rest: int | None) -> None:
        """Pours the open windows together; what is left over becomes the rest, or the last window."""
        pieces = [p for _, window in sorted(self.open, key=lambda w: -w[0]) for p in window]
        self.open = []
        at, window = 0, []
        for doc_id, start, total, ids in pieces:
            while ids:
                take = min(len(ids) // 4, self.window - at)
                window.append((doc_id, start, total, ids[: 4 * take]))
                start, ids, at = start + take, ids[4 * take :], at + take
                if at == self.window:
                    self.emit(window)
                    at, window = 0, []
        if window:
            self.emit(window, rest)

    def rows(self) -> pa.RecordBatch:
        columns = zip(*self.out, strict=True) if self.out else [[]] * len(NAMES)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)
        self.out = []
        return batch


def first_id(level: int) -> int:
    """Sequence ids of a task: its round and partition in the high bits."""
    return (level << 56) | (TaskContext.get().partitionId() << 32)


def pack_texts(
    batches: Iterator[pa.RecordBatch], path: str, window: int, open_windows: int, control_ids: bool
) -> Iterator[pa.RecordBatch]:
    words = tokenizer(path, control_ids)
    packer = Packer(window, open_windows, first_id(0))
    for batch in slices(batches):
        texts = [t or b"" for t in as_bytes(batch.column(1))]
        for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            ids = words.ids(text)
            packer.add((doc_id, 0, len(ids) // 4, ids))
        yield packer.rows()
    packer.close(TaskContext.get().partitionId())
    yield packer.rows()


def pack_rests(
    batches: Iterator[pa.RecordBatch], level: int, last: bool, window: int, open_windows: int
) -> Iterator[pa.RecordBatch]:
    packer = Packer(window, open_windows, first_id(level))
    for batch in slices(batches):
        for piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            packer.place(piece)
        yield packer.rows()
    packer.close(None if last else TaskContext.get().partitionId())
    yield packer.rows()


def pack_documents(
    docs: DataFrame, path: str, *, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, group: int = GROUP,
    control_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every document is its ids followed by id 1; a NULL or empty text is that id alone. Documents are cut
    where it saves padding: each id lies in one piece, and at most one window of the whole result is not
    full. ``offset`` is the place of the piece in its window, without gaps. Repeated rows are packed each
    for itself and keep their ``doc_id``; an empty table gives no rows; other columns are ignored. Windows
    depend on the partitions of ``docs``; the ids in them do not. Memory: ``open_windows`` windows and one
    document a task, ``group`` windows in a merging task. Text is not shuffled.
    """
    wanted = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    done = stored(wanted.mapInArrow(lambda b: pack_texts(b, path, window, open_windows, control_ids), PIECES), "packed")
    rests = done.where("rest is not null")
    parts = rests.agg(F.countDistinct("rest")).first()[0]
    out = done.where("rest is null")
    level = 1
    while parts:
        groups = -(-parts // group)
        rows = rests.select("doc_id", "start", "doc_tokens", "ids", "rest")
        last = groups == 1
        merged = rows.repartition(groups, "rest").sortWithinPartitions("rest", "doc_id", "start").select(
            "doc_id", "start", "doc_tokens", "ids"
        )
        step = stored(
            merged.mapInArrow(lambda b, k=level, z=last: pack_rests(b, k, z, window, open_windows), PIECES), "packed"
        )
        out = out.unionByName(step.where("rest is null"))
        if last:
            break
        rests = step.where("rest is not null")
        parts = rests.agg(F.countDistinct("rest")).first()[0]
        level += 1
    return out.select(*NAMES[:7])
