"""Control strings in texts."""

import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("public_tokenizers")

from pagequarry.llm.queries import QUERIES  # noqa: E402


def test_control_strings_as_the_tokenizer_has_them(spark, tmp_path):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    texts = ["one <|endoftext|> two", "a<|startoftext|>b, <|endoftext|>. c", "<|ENDOFTEXT|> <| endoftext |>", "plain words", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(QUERIES["op3_packing"](spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.start))
    assert {r.doc_id for r in rows} == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids, at = [*tool.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in rows:
            if r.doc_id == i:
                assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
        assert at == len(ids)
