import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pagequarry.session import build_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "8"},
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture
def sf_dir():
    return SF


@pytest.fixture
def parsed(spark):
    """``parsed([html, ...])`` or ``parsed([(url, html), ...])`` -> parsed pages numbered from 0."""
    from pagequarry.operators.parse import parse_pages
    from pagequarry.schema import PAGES

    def build(pages, keep_html=False):
        rows = [
            (i, *p) if isinstance(p, tuple) else (i, "https://example.com/x", p) for i, p in enumerate(pages)
        ]
        return parse_pages(spark.createDataFrame(rows, PAGES), keep_html=keep_html)

    return build
