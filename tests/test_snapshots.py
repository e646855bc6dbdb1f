"""Keyed tables of versions, and the streams that keep them."""

import os
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadpulse.sources import snapshots

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
def slot():
    return F.floor(F.col("id") / 10)



def put(spark, path, pairs, update, writer="w", **options):
    rows = spark.createDataFrame(pairs, SCHEMA)
    return snapshots.upsert(rows, path, ["id"], slot(), writer, update, **options)


def held(spark, path, **options):
    return {r.id: r.v for r in snapshots.read_snapshot(spark, path, SCHEMA, **options).collect()}


def files(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_a_row_replaces_the_one_with_its_key(spark, folder):
    path = folder("t")
    assert held(spark, path) == {}
    put(spark, path, [(1, "a"), (15, "b"), (-3, "c")], 0)
    put(spark, path, [(1, "A"), (2, "d")], 1)
    assert held(spark, path) == {1: "A", 2: "d", 15: "b", -3: "c"}
    assert held(spark, path, slots=(0, 0)) == {1: "A", 2: "d"}
    assert held(spark, path, slots=(-1, 0)) == {1: "A", 2: "d", -3: "c"}


def test_an_update_that_runs_again_changes_nothing(spark, folder):
    path = folder("t")
    assert put(spark, path, [(1, "a")], 4)
    assert put(spark, path, [(1, "b")], 5)
    assert not put(spark, path, [(1, "a")], 4) and not put(spark, path, [(1, "z")], 5)
    assert put(spark, path, [(2, "c")], 0, writer="another")
    assert held(spark, path) == {1: "b", 2: "c"}


def test_only_touched_slots_are_rewritten(spark, folder):
    path = folder("t")
    put(spark, path, [(i, "a") for i in range(0, 100, 10)], 0)
    before = snapshots.current(spark, path)["slots"]
    put(spark, path, [(33, "b")], 1)
    after = snapshots.current(spark, path)["slots"]
    assert [s for s in before if before[s] != after[s]] == ["3"] and len(after) == 10


def test_many_updates_leave_few_files(spark, folder):
    path = folder("t")
    for n in range(25):
        put(spark, path, [(n % 4 * 10, f"v{n}"), (7, f"v{n}")], n)
    assert held(spark, path) == {7: "v24", 0: "v24", 10: "v21", 20: "v22", 30: "v23"}
    assert len(files(path)) <= 4 * snapshots.KEPT_VERSIONS
    assert len(snapshots.names_in(spark, f"{path}/versions")) == snapshots.KEPT_VERSIONS
    assert len(os.listdir(f"{path}/data")) <= 4 * snapshots.KEPT_VERSIONS


def test_a_reader_of_the_last_version_outlives_the_next_update(spark, folder):
    path = folder("t")
    put(spark, path, [(1, "a")], 0)
    reading = snapshots.read_snapshot(spark, path, SCHEMA)
    put(spark, path, [(1, "b")], 1)
    assert [r.v for r in reading.collect()] == ["a"]


def test_an_update_without_rows_is_remembered(spark, folder):
    path = folder("t")
    assert put(spark, path, [], 0) and not put(spark, path, [], 0)
    assert held(spark, path) == {}


def test_of_writers_at_the_same_version_one_commits(spark, folder, monkeypatch):
    path, started = folder("t"), threading.Barrier(4)
    put(spark, path, [(1, "start")], 0)
    publish = snapshots.publish

    def together(*args):
        started.wait(60)
        return publish(*args)

    monkeypatch.setattr(snapshots, "publish", together)
    done, failed = [], []

    def run(name):
        try:
            put(spark, path, [(1, name)], 0, writer=name)
            done.append(name)
        except snapshots.VersionConflict:
            failed.append(name)

    threads = [threading.Thread(target=run, args=(f"w{i}",)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(done) == 1 and len(failed) == 3
    assert held(spark, path) == {1: done[0]}


def test_a_file_is_published_once_and_whole(spark, folder):
    path = folder("some/file.json")
    assert snapshots.read_small(spark, path) is None
    assert snapshots.publish(spark, path, "é" * 1000) and not snapshots.publish(spark, path, "x")
    assert snapshots.read_small(spark, path) == "é" * 1000
    assert snapshots.names_in(spark, folder("some")) == ["file.json"]


@pytest.mark.parametrize("name", ["_slot", "slot"])
def test_a_clashing_column_is_refused(spark, folder, name):
    rows = spark.createDataFrame([(1, 2)], f"id bigint, {name} bigint")
    with pytest.raises(ValueError, match=name):
        snapshots.upsert(rows, folder("t"), ["id"], slot(), "w", 0)
