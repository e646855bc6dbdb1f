import sys
from datetime import timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from loadpulse.session import build_session  # noqa: E402
from message_times import T0  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", **{
        "spark.master": "local[8]",
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_messages(spark):
    """Messages from (seconds after T0, text) pairs."""
    def make(*pairs):
        rows = [(T0 + timedelta(seconds=s), text) for s, text in pairs]
        return spark.createDataFrame(rows, "publish_time timestamp, data string")
    return make


@pytest.fixture
def make_records(spark):
    """Records from (seconds after T0, job, operation, success, start, end) tuples."""
    def make(*rows):
        return spark.createDataFrame(
            [(T0 + timedelta(seconds=s), job, "w", op, ok, a, b, a, b)
             for s, job, op, ok, a, b in rows],
            "publish_time timestamp, job_id string, workload_id string, operation string, "
            "success boolean, connection_start double, connection_end double, "
            "transaction_start double, transaction_end double")
    return make


@pytest.fixture
def make_series(spark):
    """Series from (job, action, latency, timestamp) tuples."""
    def make(*rows):
        return spark.createDataFrame(
            [(job, action, latency, 0.0, ts) for job, action, latency, ts in rows],
            "job_id string, query_action string, average_latency double, "
            "failure_percent float, timestamp bigint")
    return make


@pytest.fixture
def folder(tmp_path):
    def make(name):
        return str(tmp_path / name)
    return make
