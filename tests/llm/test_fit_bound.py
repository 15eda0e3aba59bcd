"""What the fit brings to the driver."""

import zlib

from pagequarry.llm import toxicity


def test_fit_takes_one_text_an_id(spark, monkeypatch):
    fits = []
    monkeypatch.setattr(toxicity, "train", lambda texts, marks, langs: fits.append(sorted(marks)))
    rows = [(i if i < 9 else 1, " ".join(f"w{i}x{k}" for k in range(9)), "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int")
    for parts in (1, 7):
        toxicity.learn(docs.repartition(parts), labels)
    held = [i for i in range(9) if zlib.crc32(str(i).encode()) % 5]
    assert 1 in held and fits == [sorted(float(i % 2) for i in held)] * 2


def test_one_text_of_each_id_for_the_language(spark, monkeypatch):
    """Very many rows of one id, or of none, are one text of the fit."""
    from pagequarry.llm import langid

    rows = spark.range(20_000).selectExpr("if(id % 2 = 0, 5L, null) as doc_id", "concat('some text ', id) as text", "'en' as lang")
    taken = []
    collect = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda self: taken.append(collect(self)) or taken[-1])
    langid.learn(rows, rows=30_000)
    assert [len(t) for t in taken] == [1, 2]
