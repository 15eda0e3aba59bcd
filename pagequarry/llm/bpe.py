"""Byte-level BPE by automaton and backtracking.

The bytes of a piece are read as Latin-1 text, so that an Aho-Corasick automaton over the vocabulary finds
the longest token at every place. Tokens are laid from the left, longest first; two neighbours must be
compatible, that is, merging their joined bytes gives just these two. Where nothing fits, the last token is
shortened to its longest proper prefix that is a token, and the dead place is remembered, so each place
fails once. A sequence whose neighbours are all compatible is the one the merges give. Compatibility and
whole pieces are memoised; both memories have a fixed size.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pagequarry.llm.common import slices

#: Most pieces and pairs remembered in a worker.
MEMORY = 300_000


def merged(text: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The merges by definition: join the leftmost neighbours of lowest rank until none can be joined."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], len(ranks) + 1 << 32), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class Codec:
    """Encoder and decoder of one rank file (``base64 rank`` per line)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pieces = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token in self.ranks:
            self.automaton.add_word(token.decode("latin-1"), token)
        self.automaton.make_automaton()
        self.spelled: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.spelled[rank] = token
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[str, bytes] = {}

    def shorter(self, token: bytes) -> bytes | None:
        """The longest proper prefix that is a token."""
        for size in range(len(token) - 1, 0, -1):
            if token[:size] in self.ranks:
                return token[:size]
        return None

    def compatible(self, left: bytes, right: bytes) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            found = merged(left + right, self.ranks) == ([left, right] if left else [right])
            self.pairs[left, right] = found
        return found

    def tokens(self, piece: bytes) -> list[bytes]:
        """Tokens of one piece."""
        if not piece or piece in self.ranks:
            return [piece] if piece else []
        longest: list[bytes] = [b""] * len(piece)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - len(token)
            if len(token) > len(longest[start]):
                longest[start] = token
        out: list[bytes] = []
        dead: set[int] = set()
        at, token = 0, longest[0]
        while at < len(piece):
            if at + len(token) not in dead and self.compatible(out[-1] if out else b"", token):
                out.append(token)
                at += len(token)
                token = longest[at] if at < len(piece) else b""
                continue
            prefix = self.shorter(token)
            if prefix is None:
                dead.add(at)
                prefix = out.pop()
                at -= len(prefix)
            token = prefix
        return out

    def packed(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            found = np.array([self.ranks[t] for t in self.tokens(piece.encode())], "<u4").tobytes()
            if len(piece) <= 64:
                self.known[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text, each match of the pattern by itself."""
        known, packed = self.known.get, self.packed
        return b"".join([known(p) or packed(p) for p in self.pieces.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str, ids: bool) -> Iterator[pa.RecordBatch]:
    coder = codec(path, pattern)
    for batch in slices(batches):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            coded = coder.encode(text or "")
            row = (doc_id, len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256(coder.decode(coded)).hexdigest())
            rows.append((*row, coded) if ids else row)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * ids]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names
        )


def encode_documents(docs: DataFrame, path: str, pattern: str, *, ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, with ``ids=True`` also the ids.

    ``path`` is a rank file every executor can read, ``pattern`` splits a text into pieces. A NULL text
    counts as empty: no tokens, the digests of nothing. Repeated rows give repeated results, an empty table
    none; other columns are ignored. Row-local, so no shuffle; a text is coded whole, whatever its length.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(
        lambda batches: encode_batches(batches, path, pattern, ids), schema
    )
