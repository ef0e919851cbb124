from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rackpulse.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", 4, "tests", **{"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def fleet(spark):
    rows = [
        (f"node-{i:04d}", f"rack-{i // 5:03d}", f"zone-{i // 8}", f"zone-{i // 8}/feed-0", "spine-0") for i in range(20)
    ]
    return spark.createDataFrame(rows, "node_id string, rack_id string, zone_id string, feed_id string, spine_id string")
