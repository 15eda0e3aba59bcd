"""Files that appear with an old modification time."""

import os
import time

from pagequarry.sources.pages import read_pages
from pagequarry.streaming.arrivals import arriving_pages, processed_once, store_stream


def test_old_files_are_not_late(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    pages = read_pages(spark, f"{sf_dir}/pages.parquet").where("page_id < 40")
    done = set()
    for part in range(3):  # a run each, so that the watermark has moved on; each file looks older than the last
        pages.where(f"page_id % 3 = {part} or page_id = 0").coalesce(1).write.mode("append").parquet(str(source))
        for path in set(source.glob("*.parquet")) - done:
            os.utime(path, (time.time() - part * 10 * 86400,) * 2)
            done.add(path)
        once = processed_once(arriving_pages(spark, str(source)))
        store_stream(once, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted(r.page_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r.page_id for r in pages.collect())
