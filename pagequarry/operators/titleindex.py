"""Title search over a stored inverted index, ranked by BM25.

The index holds distinct titles, so a title that very many records share is one entry with a count. Postings lie in
folders by a hash of their token and are sorted by it: a search reads the folders of its tokens and of the titles it
returns, never the records. Each run appends its own postings and counts; older ones are not read or rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.operators.curate import title_key

BUCKETS = 64
TOP = 10
TITLES = "bucket int, title_key string, n long, n_items long, ids array<bigint>"
POSTINGS = "bucket int, token string, title_key string, n long, n_items long, tf long"


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")


class TitleIndex:
    """An index under ``path``, a folder that all executors reach; made empty if it is not there."""

    def __init__(self, spark: SparkSession, path: str, keep: int = TOP):
        self.spark, self.path, self.keep = spark, path, keep
        for name, schema in (("titles", TITLES), ("postings", POSTINGS)):
            spark.createDataFrame([], schema).write.mode("ignore").partitionBy("bucket").parquet(f"{path}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def add(self, items: DataFrame) -> None:
        """Appends ``item_id, title`` records; those without a word in the title are left out.

        A record is a document of its own, so one that is added twice counts twice.
        """
        keyed = items.select(F.col("item_id").cast("long").alias("item_id"), title_key(F.col("title")).alias("title_key"))
        keyed = keyed.where("title_key <> '' and item_id is not null")
        order = Window.partitionBy("title_key").orderBy("item_id")
        # tasks keep the first ids of their own titles before anything is shuffled
        first = keyed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= self.keep)
        ids = first.groupBy("title_key").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
        titles = keyed.groupBy("title_key").agg(F.count("*").alias("n_items")).join(ids, "title_key")
        titles = titles.withColumn("n", F.size(F.split("title_key", " ")).cast("long"))
        titles.select(bucket_of("title_key"), "title_key", "n", "n_items", "ids").repartition("bucket").sortWithinPartitions(
            "bucket", "title_key"
        ).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/titles")
        tokens = titles.select("title_key", "n", "n_items", F.explode(F.split("title_key", " ")).alias("token"))
        counted = tokens.groupBy("token", "title_key", "n", "n_items").agg(F.count("*").alias("tf"))
        # a frequent token has a folder's files written by several tasks
        counted.select(bucket_of("token"), "token", "title_key", "n", "n_items", "tf").repartition(
            "bucket", F.pmod(F.xxhash64("title_key"), F.lit(8))
        ).sortWithinPartitions("bucket", "token").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")

    def search(self, queries: DataFrame, top: int = TOP) -> DataFrame:
        """``query_id, rank, item_id, score``: the best records for the words of each ``query_id, query``.

        A record scores when it shares a word; equal scores go by ascending ``item_id``. Scores are whole numbers of
        BM25 with k1 = 8/10 and b = 3/4 in thousandths: a token weighs ``floor(1000 ln((2N + 2) / (2df + 1)))``. Words
        may repeat. Queries without a word have no rows, repeated query rows are answered once. ``top`` is at most
        the number of ids kept for a title.
        """
        if top > self.keep:
            raise ValueError(f"the index keeps {self.keep} ids for a title")
        titles = self._read("titles", TITLES)
        corpus = titles.agg(F.sum("n_items").alias("docs"), F.sum(F.col("n") * F.col("n_items")).alias("total"))
        asked = queries.select("query_id", title_key(F.col("query")).alias("asked")).where("asked <> ''").distinct()
        words = asked.select("asked").distinct().select("asked", F.explode(F.split("asked", " ")).alias("token"))
        words = words.groupBy("asked", "token").agg(F.count("*").alias("k")).withColumn("bucket", bucket_of("token"))
        postings = self._read("postings", POSTINGS)
        # runs are added up; only the folders and tokens that are asked for are read
        wanted = words.select("bucket", "token").distinct()
        # at most as many numbers as there are folders
        folders = [r.bucket for r in wanted.select("bucket").distinct().collect()]
        met = postings.where(F.col("bucket").isin(folders)).join(wanted, ["bucket", "token"], "left_semi")
        met = met.groupBy("token", "title_key", "n", "tf").agg(F.sum("n_items").alias("n_items"))
        weights = met.groupBy("token").agg(F.sum("n_items").alias("df")).crossJoin(F.broadcast(corpus))
        weights = weights.select(
            "token", "docs", "total", F.floor(1000 * F.log((2 * F.col("docs") + 2) / (2 * F.col("df") + 1))).alias("weight")
        )
        part = F.expr("k * weight * ((1000000000 * tf) div (1000 * tf + 8 * (100 - 75 + (75 * n * docs) div total)))")
        scores = words.join(weights, "token").join(met, "token").groupBy("asked", "title_key").agg(F.sum(part).alias("score"))
        names = titles.groupBy("bucket", "title_key").agg(F.flatten(F.collect_list("ids")).alias("ids"))
        names = names.select("title_key", F.slice(F.sort_array("ids"), 1, top).alias("ids"))
        firsts = names.select("title_key", "ids", F.col("ids")[0].alias("first"))
        # the best records lie in the best titles by score and first id
        by_title = Window.partitionBy("asked").orderBy(F.desc("score"), "first")
        best = scores.where("score > 0").join(firsts, "title_key").withColumn("place", F.row_number().over(by_title)).where(F.col("place") <= top)
        by_item = Window.partitionBy("asked").orderBy(F.desc("score"), "item_id")
        ranked = best.select("asked", "score", F.explode("ids").alias("item_id")).withColumn("rank", F.row_number().over(by_item))
        return asked.join(ranked.where(F.col("rank") <= top), "asked").select("query_id", "rank", "item_id", "score")
