"""Where results go.  Every run or batch writes to a folder of its own, so a
repeated attempt replaces its own output and nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_items(items: DataFrame, path: str, run_ts: str) -> None:
    """JSON items; a run adds its folder to those already there."""
    _write(items, f"{path}/run_ts={run_ts}")


def write_rejected(processed: DataFrame, path: str, run_ts: str) -> None:
    """``page_id, reason, url`` of the links turned down; nothing is written when there are none.

    The rows are looked at twice, so pass a result that is already stored.
    """
    rows = processed.select("page_id", F.inline("rejected")).select("page_id", "reason", "url")
    if not rows.isEmpty():
        _write(rows, f"{path}/run_ts={run_ts}")


def write_errors(processed: DataFrame, path: str, run_ts: str) -> None:
    rows = processed.filter(F.col("error").isNotNull()).select("url", "error")
    _write(rows, f"{path}/run_ts={run_ts}")


def write_summary(summary: DataFrame, path: str, run_ts: str) -> None:
    """One row, one file."""
    _write(summary.coalesce(1), f"{path}/run_ts={run_ts}")


def write_records(pulled: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Write merged records unless ``dry_run``, one JSON object a line with the keys of the record at the top,
    as ``local_records`` reads them; the records are returned either way."""
    if not dry_run:
        pulled.select(F.to_json("fields").alias("value")).write.mode("overwrite").text(path)
    return pulled


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
