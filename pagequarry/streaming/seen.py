"""Exact once-only streams: the set of keys seen, kept as state of the stream for as long as the caller wants.

A watermark forgets a key when it is old, so a page that comes back after months counts as new. Here every key has a
record of its own in a RocksDB state store: when it was first seen and how often it came. The store keeps its data on
the executors' disks and writes changes to the checkpoint, so state may grow beyond memory and survives restarts and
lost executors. ``forget_after_seconds`` lets records expire, each so long after its last sight; expiry goes by the
clock, so such a stream has to run on: one that is to end when all is read (``availableNow``) would not end.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: JSON text carries times to the microsecond.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
# rows of a key put in order at once
AT_ONCE = 10_000
OUT = "row string, n_before long, first_seen timestamp"


class SeenKeys(StatefulProcessor):
    """Keeps ``first_seen, n`` for a key; gives every row of it with how many came before."""

    def __init__(self, forget_ms: int | None, repeats: bool):
        self.forget_ms, self.repeats = forget_ms, repeats

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "first_seen timestamp, n long", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.record.get() if self.record.exists() else None
        first, before = (known[0], known[1]) if known else (datetime.now(), 0)
        if self.repeats:
            while came := sorted(r.row for r in islice(rows, AT_ONCE)):
                for row in came:
                    yield Row(row=row, n_before=before, first_seen=first)
                    before += 1
            self.record.update((first, before))
            return
        # the least row of a key and batch stands for it, however the rows were dealt; no others are kept
        least, n = None, 0
        for r in rows:
            n += 1
            if least is None or r.row < least:
                least = r.row
        if before == 0 and n:
            yield Row(row=least, n_before=0, first_seen=first)
        self.record.update((first, before + n))

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, as per-key state needs; older checkpoints keep theirs."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)


def _with_history(rows: DataFrame, key: str, forget_after_seconds: int | None, repeats: bool) -> DataFrame:
    use_rocksdb(rows.sparkSession)
    forget_ms = None if forget_after_seconds is None else 1000 * forget_after_seconds
    packed = rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false", **TIMES}).alias("row"))
    done = packed.groupBy("key").transformWithState(
        SeenKeys(forget_ms, repeats), outputStructType=OUT, outputMode="append", timeMode="None" if forget_ms is None else "ProcessingTime"
    )
    return done.select(F.from_json("row", rows.schema, TIMES).alias("r"), "n_before", "first_seen")


def first_of_each_key(rows: DataFrame, key: str = "url", *, forget_after_seconds: int | None = None) -> DataFrame:
    """The first row of every key of a stream, exactly once over all batches and restarts of its checkpoint.

    Of the rows of a key in one batch the least (as JSON text) is the first. A NULL key is a key like any other. Only
    the columns of ``rows`` are shuffled, so take what is wanted from pages first. Column types must be ones that JSON
    text carries; state is one small record a key.
    """
    return _with_history(rows, key, forget_after_seconds, False).select("r.*")


def with_repeats(rows: DataFrame, key: str = "url", *, forget_after_seconds: int | None = None) -> DataFrame:
    """Every row with ``n_before``, how many rows of its key came before, and ``first_seen``, when the first did."""
    return _with_history(rows, key, forget_after_seconds, True).select("r.*", "n_before", "first_seen")


def keys_held(query: StreamingQuery) -> int:
    """Records in the state after the last batch."""
    progress = query.lastProgress
    return sum(s["numRowsTotal"] for s in progress["stateOperators"]) if progress else 0
