import pytest
from pyspark.sql import functions as F

from loadpulse.operators import charts, load


@pytest.fixture
def jobs(spark):
    return spark.createDataFrame(
        [("one", 1, 2, 1, 2), ("two", 2, 3, 2, 1), ("three", 3, 1, 3, 2), ("none", None, 9, 1, 1)],
        "job_id string, read_pattern int, write_pattern int, read_intensity int, "
        "write_intensity int")


def test_planned_transactions_per_pattern(jobs):
    got = {r.job_id: r["count"] for r in load.expected_load(jobs, "read").groupBy("job_id").count().collect()}
    assert got == {"one": 300, "two": 1500, "three": 600}


def test_offsets_of_a_spiky_plan(jobs):
    rows = load.expected_load(jobs, "read").where("job_id = 'three'").orderBy("offset_seconds").collect()
    assert rows[0].offset_seconds == 0.0
    assert rows[1].offset_seconds == pytest.approx(1 / 60)
    assert rows[120].offset_seconds == 2.0       # the first slow segment
    assert rows[121].offset_seconds == pytest.approx(2.1)
    assert rows[200].offset_seconds == 10.0      # the second spike
    assert rows[-1].offset_seconds == pytest.approx(29.9)
    assert {r.pods for r in rows} == {12}


def test_reads_and_writes_together(jobs):
    both = load.planned_reads_and_writes(jobs)
    got = {(r.job_id, r.operation): r["count"] for r in both.groupBy("job_id", "operation").count().collect()}
    assert got == {("one", "read"): 300, ("one", "write"): 1500, ("two", "read"): 1500,
                   ("two", "write"): 600, ("three", "read"): 600, ("three", "write"): 300}


def test_expected_and_observed_from_either_side(jobs, make_records):
    records = make_records((0, "one", "read", True, 1.0, 2.0), (0, "stray", "write", True, 1.0, 2.0))
    got = {(r.job_id, r.operation): (r.expected, r.observed)
           for r in load.expected_vs_observed(jobs, records).collect()}
    assert got[("one", "read")] == (300, 1)
    assert got[("two", "read")] == (1500 * 6, 0)
    assert got[("three", "write")] == (300 * 6, 0)
    assert got[("stray", "write")] == (0, 1)


def test_expected_counts_are_the_schedule_unfolded(jobs, make_records):
    records = make_records((0, "one", "read", True, 1.0, 2.0))
    unfolded = load.planned_reads_and_writes(jobs).groupBy("job_id", "operation").agg(
        F.sum("pods").alias("expected"))
    counted = load.expected_vs_observed(jobs, records).select("job_id", "operation", "expected")
    assert unfolded.exceptAll(counted).isEmpty()


def test_chart_lines(spark, make_series):
    series = make_series(("j", "read", 0.002, 5000), ("j", "write", 0.01, 6500), ("k", "read", 0.001, 9000))
    got = sorted(tuple(r) for r in charts.chart_series(series, ["job_id"]).collect())
    assert got == [
        ("j", "failure_percent", 0.0, 0.0), ("j", "failure_percent", 1.5, 0.0),
        ("j", "read_latency", 0.0, 2.0), ("j", "write_latency", 1.5, 10.0),
        ("k", "failure_percent", 0.0, 0.0), ("k", "read_latency", 0.0, 1.0)]


def test_chart_seed_filter(make_series):
    series = make_series(("j", "read", 0.002, 1000), ("j", "read", 0.003, 2000)).withColumn(
        "seed", F.when(F.col("timestamp") == 1000, F.lit("4")))
    with_seed = charts.chart_series(series, ["job_id"], seed=4).where("line = 'read_latency'").collect()
    assert [(r.x, r.y) for r in with_seed] == [(0.0, 2.0)]
    without = charts.chart_series(series, ["job_id"]).where("line = 'read_latency'").collect()
    assert [(r.x, r.y) for r in without] == [(0.0, 3.0)]


def test_series_order(make_series):
    series = make_series(("b", "read", 1.0, 1), ("a", "write", 1.0, 2), ("a", "read", 1.0, 2))
    assert [(r.job_id, r.query_action) for r in charts.series_ordered(series).collect()] == [
        ("a", "read"), ("a", "write"), ("b", "read")]
