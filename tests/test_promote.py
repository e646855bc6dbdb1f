import threading

import pytest
from pyspark.sql import functions as F

from loadpulse import sources
from loadpulse.operators import promote, quality
from loadpulse.sources import occupancy, snapshots, stores
from loadpulse.sources.occupancy import Place

JOB = ("job_id string, db_type int, db_size int, read_pattern int, write_pattern int, "
       "read_intensity int")


@pytest.fixture
def campaign(spark, make_series):
    """a and b share a location (b listed first), c has its own, d fails."""
    jobs = spark.createDataFrame(
        [("a", 1, 1, 1, 1, 1), ("b", 1, 1, 1, 1, 1), ("c", 3, 2, 1, 3, 2), ("d", 2, 2, 2, 2, 2)], JOB)
    listed = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2), ("d", 3)], "job_id string, seq int")
    series = make_series(
        *[(job, "read", 1.0 + i % 2, i * 1000) for i in range(50) for job in ("a", "b", "c")],
        ("d", "read", 1.0, 0))
    return series, quality.validate_series(series, jobs, listed)


def locations(df):
    return sorted({(r.key, r.pattern, r.job_id) for r in df.select("key", "pattern", "job_id").collect()})


def test_first_listed_job_that_passed_wins(campaign):
    assert locations(promote.first_wins(campaign[1])) == [
        ("spanner-2-2", "1-3", "c"), ("sql-1-1", "1-1", "b")]


def test_a_failing_first_job_leaves_the_place_to_the_next(campaign):
    verdicts = campaign[1].withColumn("passed", F.col("passed") & (F.col("job_id") != "b"))
    assert ("sql-1-1", "1-1", "a") in locations(promote.first_wins(verdicts))


def test_promotion_twice_changes_nothing(spark, campaign, folder):
    series, verdicts = campaign
    stage = folder("stage")
    promote.promote_to_stage(spark, series, verdicts, stage)
    first = sources.read_cached_series(spark, stage).count()
    promote.promote_to_stage(spark, series, verdicts, stage)
    staged = sources.read_cached_series(spark, stage)
    assert first == staged.count() == 100
    assert locations(staged) == [("spanner-2-2", "1-3", "c"), ("sql-1-1", "1-1", "b")]


def test_occupied_locations_are_left_alone(spark, campaign, folder):
    series, verdicts = campaign
    stage = folder("stage")
    taken = series.where("job_id = 'a'").withColumns(
        {"key": F.lit("sql-1-1"), "pattern": F.lit("1-1")})
    stores.append_partitioned(taken, stage, stores.CACHE_PARTITIONS)
    promote.promote_to_stage(spark, series, verdicts, stage)
    assert locations(sources.read_cached_series(spark, stage)) == [
        ("spanner-2-2", "1-3", "c"), ("sql-1-1", "1-1", "a")]


def test_seed_promotion_refuses_a_seed_in_use(spark, campaign, folder):
    series, verdicts = campaign
    stage, live = folder("stage"), folder("live")
    promote.promote_to_stage(spark, series, verdicts, stage)
    promote.promote_with_seed(spark, stage, live, 1)
    with pytest.raises(promote.SeedInUse):
        promote.promote_with_seed(spark, stage, live, "1")
    promote.promote_with_seed(spark, stage, live, 2)
    seeds = sources.read_cached_series(spark, live).groupBy("seed").count().collect()
    assert {r.seed: r["count"] for r in seeds} == {"1": 100, "2": 100}


def test_the_seed_guard_looks_at_every_pattern(spark, campaign, folder):
    series, verdicts = campaign
    stage, live = folder("stage"), folder("live")
    promote.promote_to_stage(spark, series, verdicts, stage)
    other_pattern = promote.with_seed(series.where("job_id = 'c'"), 5).withColumns(
        {"key": F.lit("spanner-2-2"), "pattern": F.lit("1-3")})
    stores.append_partitioned(other_pattern, live, stores.CACHE_PARTITIONS)
    with pytest.raises(promote.SeedInUse):
        promote.promote_with_seed(spark, stage, live, 5)


def test_copy_with_and_without_seed(spark, make_series, folder):
    source, plain, tagged = folder("a"), folder("b"), folder("c")
    series = make_series(("j", "read", 1.0, 1), ("k", "read", 2.0, 2))
    stores.append_partitioned(series, source, stores.SERIES_PARTITIONS)
    sources.copy_series(spark, source, plain, ["job_id"])
    sources.copy_series(spark, source, tagged, ["job_id"], where=F.col("job_id") == "k", seed=0)
    assert sources.read_series(spark, plain).count() == 2
    assert [(r.job_id, r.seed) for r in spark.read.parquet(tagged).collect()] == [("k", "0")]


def test_reading_one_location_prunes_folders(spark, campaign, folder):
    series, verdicts = campaign
    stage, store = folder("stage"), folder("store")
    promote.promote_to_stage(spark, series, verdicts, stage)
    one = sources.read_cached_series(spark, stage, "sql-1-1", "1-1")
    assert locations(one) == [("sql-1-1", "1-1", "b")]
    stores.append_partitioned(series, store, stores.SERIES_PARTITIONS)
    job = sources.read_series(spark, store, "c")
    assert job.count() == 50
    for df, column in ((one, "key"), (job, "job_id")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f"PartitionFilters: [isnotnull({column}" in plan


def test_missing_runs_cover_the_whole_campaign(spark, campaign):
    everything = promote.all_locations(spark)
    assert everything.distinct().count() == everything.count() == 243
    cached = promote.first_wins(campaign[1])
    missing = promote.missing_runs(spark, cached)
    assert missing.count() == 241
    assert missing.where("key = 'sql-1-1' and pattern = '1-1'").count() == 0


def test_first_run_of_an_instance_is_its_warm_up(spark):
    jobs = spark.createDataFrame(
        [("a", 1, 1, 5), ("b", 1, 1, 3), ("c", 1, 2, 9), ("d", 1, 1, 3)],
        "job_id string, db_type int, db_size int, start int")
    got = {r.job_id: r.warm_up for r in promote.first_run_per_instance(jobs).collect()}
    assert got == {"a": False, "b": True, "c": True, "d": False}


def counts(spark, path):
    return {(r.key, r.pattern, r.seed): (r.cached_rows, r.first_timestamp, r.last_timestamp)
            for r in occupancy.occupancy(spark, path).collect()}


def test_the_index_tells_what_the_cache_holds(spark, campaign, folder):
    series, verdicts = campaign
    stage, live = folder("stage"), folder("live")
    assert counts(spark, stage) == {}
    promote.promote_to_stage(spark, series, verdicts, stage)
    expected = {("sql-1-1", "1-1", ""): (50, 0, 49_000), ("spanner-2-2", "1-3", ""): (50, 0, 49_000)}
    assert counts(spark, stage) == expected
    promote.promote_with_seed(spark, stage, live, 3)
    assert counts(spark, live) == {(k, p, "3"): v for (k, p, _), v in expected.items()}
    more = sources.read_cached_series(spark, stage).where("key = 'sql-1-1'").withColumn(
        "timestamp", F.col("timestamp") + 100_000)
    occupancy.append(more.drop("seed"), stage, stores.CACHE_PARTITIONS)
    assert counts(spark, stage)["sql-1-1", "1-1", ""] == (100, 0, 149_000)
    assert occupancy.abandoned(spark, stage) == {}


def test_a_cache_without_an_index_gets_one_before_it_grows(spark, campaign, folder):
    series, verdicts = campaign
    stage = folder("stage")
    taken = series.where("job_id = 'a'").withColumns({"key": F.lit("sql-1-1"), "pattern": F.lit("1-1")})
    stores.append_partitioned(taken, stage, stores.CACHE_PARTITIONS)
    promote.promote_to_stage(spark, series, verdicts, stage)
    assert {k: v[0] for k, v in counts(spark, stage).items()} == {
        ("sql-1-1", "1-1", ""): 50, ("spanner-2-2", "1-3", ""): 50}


def test_promotion_reads_only_the_folders_it_needs(spark, campaign, folder):
    series, verdicts = campaign
    store, stage = folder("store"), folder("stage")
    stores.append_partitioned(series, store, stores.SERIES_PARTITIONS)
    stored = sources.read_series(spark, store)
    rows = promote.promoted_rows(stored, {"b": ("sql-1-1", "1-1"), "c": ("spanner-2-2", "1-3")})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert " IN (b,c)" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert rows.count() == 100
    promote.promote_to_stage(spark, stored, verdicts, stage)
    one = occupancy.read_places(spark, stage, [Place("sql-1-1", "1-1")])
    filters = one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert "(key" in filters and "= sql-1-1)" in filters and "= 1-1)" in filters
    assert locations(one) == [("sql-1-1", "1-1", "b")]
    assert occupancy.read_places(spark, stage, []).count() == 0


def at_once(runs, monkeypatch):
    """Start the calls together, and let none claim before all have looked."""
    looked, claim, first = threading.Barrier(len(runs)), occupancy.claim, threading.local()

    def wait_and_claim(*args):
        if not getattr(first, "over", False):
            first.over = True
            looked.wait(120)
        return claim(*args)

    monkeypatch.setattr(occupancy, "claim", wait_and_claim)
    errors = []

    def run(call):
        try:
            call()
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=run, args=(call,)) for call in runs]
    [t.start() for t in threads]
    [t.join() for t in threads]
    monkeypatch.setattr(occupancy, "claim", claim)
    return errors


def test_promotions_at_once_leave_one_set_of_rows(spark, campaign, folder, monkeypatch):
    series, verdicts = campaign
    stage = folder("stage")
    assert not at_once([lambda: promote.promote_to_stage(spark, series, verdicts, stage)] * 3, monkeypatch)
    staged = sources.read_cached_series(spark, stage)
    assert staged.count() == 100
    assert locations(staged) == [("spanner-2-2", "1-3", "c"), ("sql-1-1", "1-1", "b")]
    assert {v[0] for v in counts(spark, stage).values()} == {50}


def test_copies_at_once_under_one_seed_leave_one(spark, campaign, folder, monkeypatch):
    series, verdicts = campaign
    stage, live = folder("stage"), folder("live")
    promote.promote_to_stage(spark, series, verdicts, stage)
    errors = at_once([lambda: promote.promote_with_seed(spark, stage, live, 1)] * 2, monkeypatch)
    assert len(errors) == 1 and isinstance(errors[0], promote.SeedInUse)
    assert sources.read_cached_series(spark, live).count() == 100


def test_a_promotion_that_fails_gives_its_claims_back(spark, campaign, folder, monkeypatch):
    series, verdicts = campaign
    stage = folder("stage")

    def broken(*args):
        raise OSError("disk full")

    with monkeypatch.context() as patch:
        patch.setattr(occupancy, "append", broken)
        with pytest.raises(OSError):
            promote.promote_to_stage(spark, series, verdicts, stage)
    promote.promote_to_stage(spark, series, verdicts, stage)
    assert sources.read_cached_series(spark, stage).count() == 100


def test_claims_of_a_dead_promotion_can_be_taken_up_or_released(spark, campaign, folder):
    series, verdicts = campaign
    stage, place = folder("stage"), Place("sql-1-1", "1-1")
    assert occupancy.claim(spark, stage, place, "dead") and occupancy.claim(spark, stage, place, "dead")
    promote.promote_to_stage(spark, series, verdicts, stage, owner="alive")
    assert locations(sources.read_cached_series(spark, stage)) == [("spanner-2-2", "1-3", "c")]
    assert occupancy.abandoned(spark, stage) == {place: "dead"}
    occupancy.release(spark, stage, [place], "alive")
    promote.promote_to_stage(spark, series, verdicts, stage, owner="dead")
    assert sources.read_cached_series(spark, stage).count() == 100
    assert occupancy.abandoned(spark, stage) == {}
    occupancy.release(spark, stage, [place], "dead")
    assert occupancy.claim(spark, stage, place, "next")
    assert snapshots.names_in(spark, f"{stage}/_claims") == ["spanner-2-2", "sql-1-1"]
