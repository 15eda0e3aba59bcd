"""Plain Python answers the operators are held against."""

import zlib

import numpy as np
import public_tokenizers

WORDS = public_tokenizers.path("word_bpe_49k.json")


def pieces_by_hand(rows, got):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(WORDS)
    tool.encode_special_tokens = True
    for doc_id, text in rows:
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in got if r.doc_id == doc_id), key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def sets_of(text, size):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def components_by_hand(rows, size, percent):
    sets = [sets_of(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)]
