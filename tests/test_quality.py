import math

import pytest
from pyspark.sql import functions as F

from loadpulse.operators import quality
from loadpulse.sources import read_job_list

NAN = float("nan")


@pytest.fixture
def one_job(spark):
    jobs = spark.createDataFrame(
        [("j", 1, 2, 1, 3, 2)],
        "job_id string, db_type int, db_size int, read_pattern int, write_pattern int, "
        "read_intensity int")
    return jobs, spark.createDataFrame([("j", 0)], "job_id string, seq int")


def series_of(make_series, latencies, span=60_000):
    step = span / max(len(latencies) - 1, 1)
    return make_series(*[("j", "read", float(y), round(i * step)) for i, y in enumerate(latencies)])


def verdict(make_series, one_job, latencies, span=60_000, **options):
    rows = quality.validate_series(series_of(make_series, latencies, span), *one_job, **options)
    return rows.first()


def test_row_and_span_limits(make_series, one_job):
    steady = [1.0, 2.0] * 20
    assert verdict(make_series, one_job, steady, 20_000).passed
    assert not verdict(make_series, one_job, steady, 19_999).long_enough
    short = verdict(make_series, one_job, steady[:39])
    assert (short.enough_rows, short.long_enough, short.no_outliers) == (False, True, True)


@pytest.mark.parametrize("n,found", [(64, 0), (66, 1)])
def test_one_extreme_needs_more_than_65_rows_to_be_an_outlier(make_series, one_job, n, found):
    latencies = [1.0] * (n - 1) + [100.0]
    series = series_of(make_series, latencies)
    assert quality.series_outliers(series).count() == found
    assert verdict(make_series, one_job, latencies).no_outliers == (found == 0)


def test_low_extremes_count_too(make_series, one_job):
    assert not verdict(make_series, one_job, [100.0] * 79 + [1.0]).no_outliers


def test_equal_latencies_have_no_outliers(make_series, one_job):
    series = series_of(make_series, [3.0] * 50)
    assert all(math.isnan(r.z) for r in quality.series_zscores(series).collect())
    assert quality.series_outliers(series, limit=0.0).count() == 0
    assert verdict(make_series, one_job, [3.0] * 50).passed


def test_a_nan_hides_outliers_unless_ignored(make_series, one_job):
    latencies = [1.0] * 80 + [100.0, NAN]
    series = series_of(make_series, latencies)
    assert quality.series_outliers(series).count() == 0
    assert verdict(make_series, one_job, latencies).no_outliers
    assert [r.average_latency for r in quality.series_outliers(series, ignore_nan=True).collect()] == [100.0]
    assert not verdict(make_series, one_job, latencies, ignore_nan=True).no_outliers


def test_verdict_agrees_with_the_rows(make_series, one_job, spark):
    for seed in range(4):
        values = [r.v for r in spark.range(70).select(F.exp(F.randn(seed) * 2).alias("v")).collect()]
        for limit in (2.0, 4.0, 6.0):
            rows = quality.series_outliers(series_of(make_series, values), limit).count()
            assert verdict(make_series, one_job, values, z_limit=limit).no_outliers == (rows == 0)


def test_extent_does_not_depend_on_row_order(make_series):
    series = make_series(("j", "read", 1.0, 500), ("j", "read", 1.0, 100), ("j", "write", 1.0, 300))
    row = quality.series_extent(series).first()
    assert (row.row_count, row.first_timestamp, row.last_timestamp, row.span_ms) == (3, 100, 500, 400)


def test_a_row_without_timestamp_fails_its_own_job_only(make_series, spark):
    jobs = spark.createDataFrame(
        [("j", 1, 1, 1, 1, 1), ("k", 1, 1, 1, 2, 1)],
        "job_id string, db_type int, db_size int, read_pattern int, write_pattern int, "
        "read_intensity int")
    listed = spark.createDataFrame([("j", 0), ("k", 1)], "job_id string, seq int")
    good = [(job, "read", 1.0 + i % 2, i * 1000) for i in range(50) for job in ("j", "k")]
    series = make_series(*good, ("j", "read", 1.0, None))
    got = {r.job_id: (r.all_timed, r.passed)
           for r in quality.validate_series(series, jobs, listed).collect()}
    assert got == {"j": (False, False), "k": (True, True)}


def test_skipped_and_unlisted_jobs_have_no_say(make_series, spark):
    jobs = spark.createDataFrame(
        [("j", 1, 1, 1, 1, 1), ("incomplete", 1, None, 1, 1, 1), ("unlisted", 1, 1, 1, 1, 1)],
        "job_id string, db_type int, db_size int, read_pattern int, write_pattern int, "
        "read_intensity int")
    listed = spark.createDataFrame(
        [("j", 0), ("incomplete", 1), ("unknown", 2), ("j", 3)], "job_id string, seq int")
    series = make_series(*[("j", "read", 1.0 + i % 2, i * 1000) for i in range(50)],
                         ("unlisted", "read", 1.0, 0))
    verdicts = quality.validate_series(series, jobs, listed)
    assert [(r.job_id, r.key, r.pattern, r.seq) for r in verdicts.collect()] == [
        ("j", "sql-1-1", "1-1", 0)]
    assert quality.batch_verdict(verdicts).first().passed is True
    assert sorted(r.job_id for r in quality.skipped_jobs(listed, jobs).collect()) == [
        "incomplete", "unknown"]
    assert sorted(r.job_id for r in quality.listed_only(jobs, listed).collect()) == [
        "incomplete", "j"]


def test_a_listed_job_without_series_fails(make_series, one_job):
    row = quality.validate_series(make_series(("other", "read", 1.0, 0)), *one_job).first()
    assert (row.row_count, row.enough_rows, row.passed) == (0, False, False)
    verdicts = quality.validate_series(make_series(("other", "read", 1.0, 0)), *one_job)
    assert quality.batch_verdict(verdicts).first().passed is False


def test_job_list_keeps_line_order_and_whole_last_line(spark, tmp_path):
    path = tmp_path / "jobs.txt"
    path.write_text("zeta\nalpha\n\n  mid \nlast")
    rows = read_job_list(spark, str(path)).orderBy("seq").collect()
    assert [r.job_id for r in rows] == ["zeta", "alpha", "mid", "last"]


def test_job_list_order_over_many_splits(spark, tmp_path):
    names = [f"job-{(i * 7919) % 5000:05d}" for i in range(5000)]
    path = tmp_path / "jobs.txt"
    path.write_text("\n".join(names))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        listed = read_job_list(spark, str(path))
        assert listed.rdd.getNumPartitions() > 1
        assert [r.job_id for r in listed.orderBy("seq").collect()] == names
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def moments_of(df):
    return {r.job_id: r for r in df.collect()}


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_moments_kept_over_appends_are_those_of_the_whole(spark, make_series, folder, offset):
    rows = [(f"j{i % 3}", "read", offset + (i * 37 % 101) / 100, i * 1000 if i % 40 else None) for i in range(120)]
    rows += [("n", "read", NAN, 5), ("n", "read", 2.0, 7), ("m", "read", None, 9)]
    for number, start in enumerate(range(0, len(rows), 13)):
        assert quality.keep_moments(make_series(*rows[start:start + 13]), folder("m"), "w", number)
    kept = moments_of(quality.read_moments(spark, folder("m")))
    whole = moments_of(quality.series_moments(make_series(*rows)))
    assert kept.keys() == whole.keys()
    for job, expected in whole.items():
        for name in quality.MOMENTS.fieldNames():
            got, wanted = kept[job][name], expected[name]
            assert got == (pytest.approx(wanted, rel=1e-6) if name in ("mean", "m2") and wanted is not None else wanted)
    assert (kept["n"].nan_rows, kept["n"].judged, kept["m"].judged, kept["m"].mean) == (1, 1, 0, None)


def test_an_append_that_runs_again_is_counted_once(spark, make_series, folder):
    series = make_series(("j", "read", 1.0, 1), ("j", "read", 3.0, 2))
    assert quality.keep_moments(series, folder("m"), "w", 0)
    assert not quality.keep_moments(series, folder("m"), "w", 0)
    assert quality.keep_moments(series, folder("m"), "another", 0)
    kept = quality.read_moments(spark, folder("m")).first()
    assert (kept.row_count, kept.judged, kept.mean, kept.m2) == (4, 4, 2.0, 4.0)


@pytest.mark.parametrize("ignore_nan", [False, True])
@pytest.mark.parametrize("latencies", [
    [1.0, 2.0] * 20, [1.0] * 65 + [100.0], [1.0] * 70 + [100.0], [1.0] * 70 + [100.0, NAN], [NAN] * 50, [5.0] * 50,
    [None] * 45, [1e9 + i % 7 for i in range(60)] + [1e9 + 900]])
def test_verdicts_from_moments_are_those_from_the_series(make_series, one_job, latencies, ignore_nan):
    series = make_series(*[("j", "read", y, i * 1000) for i, y in enumerate(latencies)])
    halves = [quality.series_moments(series.where(F.pmod("timestamp", F.lit(2000)) == r)) for r in (0, 1000)]
    merged = quality.merged_moments(*halves)
    assert quality.validate_moments(merged, *one_job, ignore_nan=ignore_nan).collect() == \
        quality.validate_series(series, *one_job, ignore_nan=ignore_nan).collect()


def test_verdicts_from_moments_fail_untimed_rows_and_absent_series(spark, make_series, one_job):
    untimed = make_series(*[("j", "read", 1.0 + i % 2, i * 1000 if i else None) for i in range(60)])
    verdict_ = quality.validate_moments(quality.series_moments(untimed), *one_job).first()
    assert not verdict_.all_timed and verdict_.enough_rows and not verdict_.passed
    none = quality.validate_moments(spark.createDataFrame([], quality.MOMENTS), *one_job).first()
    assert (none.row_count, none.enough_rows, none.passed) == (0, False, False)
