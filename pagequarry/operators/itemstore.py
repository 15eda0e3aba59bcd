"""A stored catalogue that runs update: only the buckets a run touches are rewritten, and old values are kept.

Records lie by title and year in hash buckets, one folder each. A run reads the buckets its records fall into, writes the
values that it replaces to a folder of its own, then overwrites just those buckets. Both writes depend on nothing but the
state before the run, so a run that was cut off is repeated and ends as if it had run once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.operators.curate import FIELDS, title_key
from pagequarry.session import stored

BUCKETS = 64
# a bucket is written by so many tasks at most
WRITERS = 4
KEY = ["bucket", "title_key", "year"]


class ItemStore:
    """Items under ``path``, a folder that all executors reach; made empty if it is not there.

    ``buckets`` counts when the store is made; one that exists keeps its own number. Choose it so that a bucket holds
    some hundred megabytes. One run at a time.
    """

    def __init__(self, spark: SparkSession, path: str, fields: tuple[str, ...] = FIELDS, buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        self.values = [f for f in fields if f != "year"]
        columns = ", ".join(f"{f} string" for f in self.values)
        keyed = f"bucket int, title_key string, year string, {columns}, valid_from string, changed string"
        self.schemas = {
            "current": f"{keyed}, first_seen string, last_seen string",
            "closed": f"seen string, {keyed}",
            "runs": "seen string, state string",
            "buckets": "buckets int",
        }
        empty = {"current": ["bucket"], "closed": ["seen", "bucket"], "runs": []}
        for name, parts in empty.items():
            spark.createDataFrame([], self.schemas[name]).write.mode("ignore").partitionBy(*parts).parquet(f"{path}/{name}")
        spark.createDataFrame([(buckets,)], self.schemas["buckets"]).write.mode("ignore").parquet(f"{path}/buckets")
        self.buckets = self._read("buckets").first().buckets

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")

    def _note(self, seen: str, state: str) -> None:
        self.spark.createDataFrame([(seen, state)], self.schemas["runs"]).coalesce(1).write.mode("append").parquet(f"{self.path}/runs")

    def _begin(self, seen: str) -> bool:
        """Whether the run is still to be done."""
        # two rows a run
        states = self._read("runs").groupBy("seen").agg(F.max_by("state", F.col("state") == "done").alias("state")).collect()
        done = [r.seen for r in states if r.state == "done"]
        begun = [r.seen for r in states if r.state != "done"]
        if seen in done:
            return False
        if begun and begun != [seen]:
            raise ValueError(f"run {begun[0]} was cut off: repeat it first")
        if done and seen < max(done):
            raise ValueError(f"run {seen} is older than run {max(done)}")
        if not begun:
            self._note(seen, "begun")
        return True

    def _once(self, incoming: DataFrame) -> DataFrame:
        """The run's values by title and year, of the least ``item_id`` that has one."""
        named = incoming.select(title_key(F.col("title")).alias("title_key"), "year", *self.values, "item_id")
        named = named.where("title_key <> '' and year is not null")
        best = [F.min_by(f, F.when(F.col(f).isNotNull(), F.struct("item_id", f))).alias(f) for f in self.values]
        bucket = F.pmod(F.xxhash64("title_key", "year"), F.lit(self.buckets)).cast("int")
        return named.groupBy("title_key", "year").agg(*best).withColumn("bucket", bucket)

    def _write(self, rows: DataFrame, name: str, *parts: str) -> None:
        spread = rows.repartition(*parts, F.pmod(F.xxhash64("title_key"), F.lit(WRITERS)))
        spread.sortWithinPartitions(*parts, "title_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            *parts
        ).parquet(f"{self.path}/{name}")

    def apply(self, incoming: DataFrame, seen: str) -> list[int]:
        """Lays a run over the store; returns the buckets that were rewritten.

        ``incoming`` holds ``item_id`` and the fields. A value that the run has replaces the stored one, a missing one
        does not. Rows without a title or year are left out; of repeated ones the least ``item_id`` with a value counts.
        ``seen`` is the run's time as text that sorts by time. A run that is done is not done again (no buckets are
        returned). An older one raises ``ValueError``, as does any other run while one that was cut off waits for its
        repetition with the same rows.
        """
        if not self._begin(seen):
            return []
        fresh = stored(self._once(incoming), "run")
        # at most as many numbers as there are buckets
        touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())
        if touched:
            old = self._read("current").where(F.col("bucket").isin(touched))
            both = old.alias("o").join(fresh.withColumn("in_run", F.lit(True)).alias("n"), KEY, "full")
            now = {f: F.coalesce(f"n.{f}", f"o.{f}") for f in self.values}
            differs = F.concat_ws(",", *[F.when(~now[f].eqNullSafe(F.col(f"o.{f}")), F.lit(f)) for f in self.values])
            both = both.withColumn("is_new", F.col("o.first_seen").isNull()).withColumn("differs", differs)
            self._write(self._replaced(both, seen), "closed", "seen", "bucket")
            self._write(self._renewed(both, now, seen), "current", "bucket")
        self._note(seen, "done")
        return touched

    def _replaced(self, both: DataFrame, seen: str) -> DataFrame:
        was = [F.col(f"o.{f}").alias(f) for f in self.values]
        changed = both.where("not is_new and differs <> ''")
        return changed.select(F.lit(seen).alias("seen"), *KEY, *was, "o.valid_from", "o.changed")

    def _renewed(self, both: DataFrame, now: dict[str, Column], seen: str) -> DataFrame:
        moved = F.expr("is_new or differs <> ''")
        return both.select(
            *KEY,
            *[v.alias(f) for f, v in now.items()],
            F.when(moved, F.lit(seen)).otherwise(F.col("o.valid_from")).alias("valid_from"),
            F.when(F.col("is_new"), F.lit("")).when(moved, F.col("differs")).otherwise(F.col("o.changed")).alias("changed"),
            F.coalesce("o.first_seen", F.lit(seen)).alias("first_seen"),
            F.when(F.col("n.in_run"), F.lit(seen)).otherwise(F.col("o.last_seen")).alias("last_seen"),
        )

    def current(self) -> DataFrame:
        """``title_key, year, <fields>, first_seen, last_seen, valid_from, changed``.

        ``valid_from`` is the run that last changed a field, ``changed`` the fields it changed (empty for the first run).
        """
        return self._read("current").select("title_key", "year", *self.values, "first_seen", "last_seen", "valid_from", "changed")

    def history(self) -> DataFrame:
        """``title_key, year, <fields>, valid_from, valid_to, changed``: the values from run to run, NULL for those that hold."""
        columns = ["title_key", "year", *self.values, "valid_from"]
        closed = self._read("closed").select(*columns, F.col("seen").alias("valid_to"), "changed")
        holds = self._read("current").select(*columns, F.lit(None).cast("string").alias("valid_to"), "changed")
        return closed.unionByName(holds)

    def as_of(self, seen: str) -> DataFrame:
        """``title_key, year, <fields>`` as they were after the run at ``seen``."""
        held = (F.col("valid_from") <= seen) & (F.col("valid_to").isNull() | (F.col("valid_to") > seen))
        return self.history().where(held).select("title_key", "year", *self.values)
