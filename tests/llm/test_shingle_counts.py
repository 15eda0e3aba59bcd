"""Counts of shingles over many partitions."""

from pagequarry.llm import jaccard


def test_shingle_counts_do_not_depend_on_partitions(spark):
    rows = [(f"all rights are reserved here u{i} v{i} w{i} x{i}",) for i in range(60)]
    docs = spark.createDataFrame(rows, "text string")
    one, many = (jaccard.frequent_shingles(docs.repartition(n), 4) for n in (1, 20))
    assert one[1].tolist() == [60, 60] and many[1].tolist() == [60, 60] and one[0].tolist() == many[0].tolist()
