from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from loadpulse import constants as K
from loadpulse import schemas
from loadpulse.operators import ids, workload
from loadpulse.sources import dimension, ledger


@pytest.fixture
def pictures(spark):
    return spark.createDataFrame(
        [(1, 1, 2, 1, 10, 22), (2, 6, 6, 8, 9, 1), (3, 3, 1, 13, 4, 7)], schemas.PICTURE)


def test_dimension_rows(spark):
    assert [dimension(spark, n).count() for n in ("colors", "shapes", "artists")] == [6, 13, 22]
    shapes = dimension(spark, "shapes")
    assert sorted(r.shape for r in shapes.where("sides is null").collect()) == ["circle", "oval"]
    assert sorted(r.id for r in shapes.where("shape = 'square'").collect()) == [1, 10]


def test_joins(spark, pictures):
    colors, shapes, artists = (dimension(spark, n) for n in ("colors", "shapes", "artists"))
    assert sorted(r.color for r in workload.pictures_fill_color(pictures, colors).collect()) == [
        "orange", "purple", "red"]
    assert sorted(tuple(r) for r in workload.pictures_two_shapes(pictures, shapes).collect()) == [
        ("circle", "oval"), ("decagon", "triangle"), ("square", "square")]
    star = workload.pictures_star(pictures, colors, shapes, artists)
    assert star.columns == workload.CHANGEABLE
    assert ("red", "orange", "square", "square", "Yasmin") in {tuple(r) for r in star.collect()}
    assert workload.pictures_count(pictures).first().pictures == 3


def test_unused_dimension_rows_have_no_uses(spark, pictures):
    usage = workload.dimension_usage(
        pictures, *(dimension(spark, n) for n in ("colors", "shapes", "artists")))
    assert usage.count() == 41
    uses = {(r.dimension, r.id): r.uses for r in usage.collect()}
    assert uses[("colors", 6)] == 2 and uses[("colors", 5)] == 0 and uses[("artists", 22)] == 1
    assert sum(uses.values()) == 15


def test_updates_last_one_wins_and_unknown_ids_do_nothing(spark, pictures):
    changes = spark.createDataFrame(
        [(1, 5, "artist", 3), (1, 9, "artist", 4), (1, 7, "artist", 5), (1, 1, "shape1", 2),
         (99, 2, "artist", 1), (3, 3, "lineColor", 6)],
        "id bigint, seq bigint, col string, val int")
    after = {r.id: tuple(r)[1:] for r in workload.pictures_apply_updates(pictures, changes).collect()}
    assert after == {1: (1, 2, 2, 10, 4), 2: (6, 6, 8, 9, 1), 3: (6, 1, 13, 4, 7)}


def test_append_continues_the_ids(spark, pictures):
    inserts = spark.range(100).select(
        F.col("id").alias("arrival"),
        *[(F.col("id") % 6 + 1).cast("int").alias(code) for code in workload.CHANGEABLE])
    after = workload.pictures_append(pictures, inserts, ["arrival"])
    assert sorted(r.id for r in after.collect()) == list(range(1, 104))
    limits = after.agg(*[F.max(c).alias(c) for c in workload.CHANGEABLE],
                       *[F.min(c).alias("min_" + c) for c in workload.CHANGEABLE]).first()
    assert limits.lineColor <= 6 and limits.shape1 <= 13 and limits.artist <= 22
    assert min(limits["min_" + c] for c in workload.CHANGEABLE) >= 1


def test_append_to_an_empty_table(spark):
    empty = spark.createDataFrame([], schemas.PICTURE)
    inserts = spark.range(3).selectExpr("id as n", "1 as lineColor", "1 as fillColor", "1 as shape1",
                                        "1 as shape2", "1 as artist")
    assert sorted(r.id for r in workload.pictures_append(empty, inserts, ["n"]).collect()) == [1, 2, 3]


def test_text_ids_depend_on_the_key_alone(spark):
    rows = spark.range(50).select(
        "id", (F.col("id") % 3).alias("line"), *[F.lit(1).alias(c) for c in workload.CHANGEABLE])
    ids_ = {r.id for r in workload.with_text_ids(rows, "line", ["id", "line"]).collect()}
    again = {r.id for r in workload.with_text_ids(rows.repartition(7), "line", ["id", "line"]).collect()}
    other = {r.id for r in workload.with_text_ids(rows, "order", ["id", "line"]).collect()}
    assert ids_ == again and len(ids_) == 50 and not ids_ & other


def test_mix_reports_every_kind(spark):
    kinds = spark.createDataFrame([("insert",)] * 7 + [("color",)] * 3, "kind string")
    got = {r.kind: (r.writes, r.intended, r.share) for r in workload.workload_mix(kinds).collect()}
    assert got == {"insert": (7, 0.7, 0.7), "color": (3, 0.1, 0.3), "shape": (0, 0.1, 0.0),
                   "artist": (0, 0.1, 0.0)}
    assert sum(K.INTENDED_MIX.values()) == pytest.approx(1.0)


@pytest.fixture(params=["one small range", "many ranges"])
def ranges(spark, request):
    """Small inputs end up in one range unless coalescing is off."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(request.param[0] == "o"))
    yield request.param
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_dense_ids_follow_the_order_even_if_one_value_is_hot(spark, ranges):
    rows = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id") % 1000).alias("hot"),
        F.xxhash64("id").alias("tie"))
    numbered = ids.with_dense_ids(rows, ["hot", "tie"])
    expected = rows.orderBy("hot", "tie").collect()
    got = numbered.orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 9_001))
    assert [(r.hot, r.tie) for r in got] == [(r.hot, r.tie) for r in expected]


def test_a_hot_value_is_spread_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(10_000).select(F.lit(1).alias("hot"), "id")
        ranged = rows.repartitionByRange("hot", "id").groupBy(F.spark_partition_id()).count()
        sizes = [r["count"] for r in ranged.collect()]
        assert len(sizes) == 4 and max(sizes) < 5_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_unique_text_ids_tell_equal_rows_apart(spark):
    rows = spark.createDataFrame(
        [("k", 1, 1, 1, 1, 1)] * 5 + [("k", 2, 1, 1, 1, 1), (None, 1, 1, 1, 1, 1), (None, 1, 1, 1, 1, 1)],
        "key string, lineColor int, fillColor int, shape1 int, shape2 int, artist int")
    found = [r.id for r in workload.with_unique_text_ids(rows, "line", ["key"]).collect()]
    again = [r.id for r in workload.with_unique_text_ids(rows.repartition(5), "line", ["key"]).collect()]
    assert len(found) == len(set(found)) == 8 and set(found) == set(again)


def codes(spark, n, parts=3):
    return spark.range(0, n, 1, parts).select(
        *[(F.col("id") % 6 + 1).cast("int").alias(c) for c in workload.CHANGEABLE])


def test_ledger_ranges_follow_each_other_and_repeat_for_the_same_update(spark, folder):
    path = folder("ids")
    assert ledger.reserve(spark, path, 10, "a", first=5) == 5
    assert ledger.reserve(spark, path, 3, "b") == 15
    assert ledger.reserve(spark, path, 10, "a") == 5
    assert ledger.reserve(spark, path, 1, "a", 1) == 18
    assert ledger.next_id(spark, path) == 19
    with pytest.raises(ledger.RangeMismatch):
        ledger.reserve(spark, path, 10, "a", 0)
    with pytest.raises(ledger.RangeMismatch):
        ledger.reserve(spark, path, 2, "a", 1)
    assert len(ledger._numbers(spark, path)) == 2


def test_appends_have_ids_without_gaps(spark, folder):
    path = folder("pictures")
    assert ids.append_with_ids(codes(spark, 1000, 7), path, "load") == (1, 1000)
    assert ids.append_with_ids(codes(spark, 0), path, "inserts", 0) == (1001, 0)
    assert ids.append_with_ids(codes(spark, 50), path, "inserts", 1) == (1001, 50)
    assert ids.append_with_ids(codes(spark, 50), path, "inserts", 1) == (1001, 50)
    assert ids.append_with_ids(codes(spark, 5), path, "inserts", 2) == (1051, 5)
    kept = ids.read_with_ids(spark, path, schemas.PICTURE)
    assert sorted(r.id for r in kept.collect()) == list(range(1, 1056))
    assert kept.where("first_id = 1001").count() == 50
    plan = kept.where("first_id = 1001")._jdf.queryExecution().executedPlan().toString()
    assert "(first_id" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_appends_at_once_share_no_id(spark, folder):
    path = folder("pictures")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda n: ids.append_with_ids(codes(spark, 20 + n), path, f"w{n}"), range(4)))
    assert sorted(n for _, n in got) == [20, 21, 22, 23]
    kept = [r.id for r in ids.read_with_ids(spark, path, schemas.PICTURE).collect()]
    assert sorted(kept) == list(range(1, 87))
