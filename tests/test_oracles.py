"""Every registered query against its SQL twin on the same tables."""

import glob
import os

import duckdb
import pytest

from pagequarry.plans.oracles import ORACLES
from pagequarry.plans.queries import QUERIES


def normal(value):
    return repr(round(value, 9)) if isinstance(value, float) else repr(value)


def compare(spark, sf_dir, name):
    """Difference between the two answers as text, empty when they agree."""
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got = QUERIES[name](spark, sf_dir)
    relation = db.sql(ORACLES[name])
    columns = sorted(relation.columns)
    if sorted(got.columns) != columns:
        return f"columns {sorted(got.columns)} != {columns}"
    left = sorted(tuple(normal(r[c]) for c in columns) for r in got.collect())
    right = sorted(tuple(map(normal, r)) for r in relation.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    if left == right:
        return "" if left else "no rows"
    a, b = set(left) - set(right), set(right) - set(left)
    return f"{len(left)} vs {len(right)} rows\nspark only {sorted(a)[:3]}\nsql only {sorted(b)[:3]}"


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, name):
    assert compare(spark, sf_dir, name) == ""
