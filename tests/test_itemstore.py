"""A stored catalogue: runs against a replay, untouched buckets, cut-off and repeated runs."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from pagequarry.operators.itemstore import ItemStore

SCHEMA = "item_id long, title string, year string, director string, genre string, clash string"
FIELDS = ("title", "director", "genre")


def random_runs():
    rng = random.Random(5)
    words = [None, "", "Low Tide", "low tide!", "Kelp", "Reef", "--", "Drift"]
    return {
        f"t{n}": [
            (i, rng.choice(words), rng.choice(["1951", "1951", "1960", None]), rng.choice([None, "A", "B"]), rng.choice([None, "x"]), "c")
            for i in range(rng.choice([0, 3, 12, 25]))
        ]
        for n in range(1, 7)
    }


def key_of(row):
    title = " ".join("".join(c.lower() if c.isalnum() else " " for c in row[1] or "").split())
    return (title, row[2]) if title and row[2] is not None else None


def replay(runs):
    """Rows of ``history`` as plain Python makes them."""
    held, rows = {}, []
    for seen, items in runs.items():
        fresh = {}
        for row in sorted(items):
            if key := key_of(row):
                values = fresh.setdefault(key, [None] * 3)
                for i, v in enumerate((row[1], row[3], row[4])):
                    values[i] = v if values[i] is None else values[i]
        for key, values in fresh.items():
            if key not in held:
                held[key] = (tuple(values), seen, "")
                continue
            old, since, changed = held[key]
            new = tuple(o if n is None else n for n, o in zip(values, old))
            if new != old:
                rows.append((*key, *old, since, seen, changed))
                held[key] = (new, seen, ",".join(f for f, a, b in zip(FIELDS, old, new) if a != b))
    return rows + [(*key, *values, since, None, changed) for key, (values, since, changed) in held.items()]


def in_order(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


def files(path, bucket):
    return {os.path.basename(f) for f in glob.glob(f"{path}/current/bucket={bucket}/*.parquet")}


def test_history_equals_a_replay(spark, tmp_path):
    runs = random_runs()
    for name, buckets in (("one", 1), ("many", 5)):
        store = ItemStore(spark, str(tmp_path / name), buckets=buckets)
        assert store.current().collect() == [] and store.history().collect() == []
        for seen, rows in runs.items():
            store.apply(spark.createDataFrame(rows, SCHEMA), seen)
        assert in_order(store.history().collect()) == in_order(replay(runs))
        early = [r[:5] for r in replay({t: runs[t] for t in ("t1", "t2", "t3")}) if r[6] is None]
        assert in_order(store.as_of("t3").collect()) == in_order(early)
        # an existing store keeps its number of buckets
        assert ItemStore(spark, str(tmp_path / name), buckets=9).buckets == buckets


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path)
    store = ItemStore(spark, path, buckets=8)
    rows = [(i, f"film {i}", "1951", "A", None, None) for i in range(60)]
    assert store.apply(spark.createDataFrame(rows, SCHEMA), "t1") == list(range(8))
    before = {b: files(path, b) for b in range(8)}
    touched = store.apply(spark.createDataFrame([(7, "film 7", "1951", "B", "x", None)], SCHEMA), "t2")
    assert len(touched) == 1
    assert [b for b in range(8) if files(path, b) != before[b]] == touched
    rows = {r.title: r for r in store.current().collect()}
    assert len(rows) == 60
    changed = rows["film 7"]
    assert (changed.director, changed.genre, changed.first_seen, changed.last_seen, changed.valid_from, changed.changed) == (
        "B", "x", "t1", "t2", "t2", "director,genre",
    )
    assert {r.last_seen for t, r in rows.items() if t != "film 7"} == {"t1"}
    # seen again without a change: only last_seen moves
    store.apply(spark.createDataFrame([(7, "film 7", "1951", None, "x", None)], SCHEMA), "t3")
    again = store.current().where("title = 'film 7'").first()
    assert (again.valid_from, again.last_seen, again.director) == ("t2", "t3", "B")


def test_cut_off_run_is_repeated(spark, tmp_path, monkeypatch):
    runs = random_runs()
    store = ItemStore(spark, str(tmp_path), buckets=4)
    for seen in ("t1", "t2", "t3"):
        store.apply(spark.createDataFrame(runs[seen], SCHEMA), seen)
    write = store._write

    def half(rows, name, *parts):
        """The driver is lost when two of the buckets of the current table are in place."""
        write(rows.where("bucket < 2") if name == "current" else rows, name, *parts)
        if name == "current":
            raise RuntimeError("lost")

    last = [(99, "Low Tide", "1951", "new", "new", None), *[(i, w, "1960", "C", None, None) for i, w in enumerate(("Kelp", "Reef", "Drift"))]]
    runs = {t: runs[t] for t in ("t1", "t2", "t3")} | {"t4": last}
    monkeypatch.setattr(store, "_write", half)
    with pytest.raises(RuntimeError):
        store.apply(spark.createDataFrame(last, SCHEMA), "t4")
    store = ItemStore(spark, str(tmp_path))
    with pytest.raises(ValueError, match="t4 was cut off"):
        store.apply(spark.createDataFrame(last, SCHEMA), "t5")
    assert store.apply(spark.createDataFrame(last, SCHEMA), "t4")
    assert in_order(store.history().collect()) == in_order(replay(runs))
    # done is done, older is refused
    assert store.apply(spark.createDataFrame(last, SCHEMA).withColumn("genre", F.lit("other")), "t4") == []
    with pytest.raises(ValueError, match="older"):
        store.apply(spark.createDataFrame(last, SCHEMA), "t0")
    assert in_order(store.history().collect()) == in_order(replay(runs))
