import pytest

from loadpulse import schemas
from loadpulse.operators import pool
from loadpulse.sources import read_resources, stores

NOW = 1000.0


@pytest.fixture
def resources(spark):
    return spark.createDataFrame([
        ("a", 1, 1, 990.0, "ready", "10.0.0.1", None), ("b", 1, 1, 980.0, "cleaning", "10.0.0.1", None), ("c", 1, 2, 999.0, "leased", "10.0.0.1", None),
        ("d", 1, 2, 2000.0, "leased", "10.0.0.1", None), ("e", 2, 1, 500.0, "ready", "10.0.0.2", None), ("f", 2, 1, 500.0, "ready", "10.0.0.2", None),
        ("g", 3, 3, 100.0, "down", "10.0.0.3", None), ("h", 2, 2, 1000.0, "leased", "10.0.0.2", None),
    ], schemas.RESOURCE)


def names(df):
    return sorted(r.resource_id for r in df.collect())


def test_only_the_earliest_of_a_pool_can_be_leased(resources):
    got = sorted(tuple(r) for r in pool.lease_candidate(resources).collect())
    # Pool (1,1) has a ready resource, but an earlier one is being cleaned.
    assert got == [(2, 1, "e", 500.0, "10.0.0.2", None)]


def test_expired_means_before_now(resources):
    assert names(pool.expired_leases(resources, NOW)) == ["c"]
    assert names(pool.expired_leases(resources, NOW + 0.5)) == ["c", "h"]


def test_earliest_of_all(resources):
    assert names(pool.earliest_expiry(resources)) == ["g"]


def test_status_conditions(resources):
    got = sorted(tuple(r) for r in pool.status_filters(resources, NOW).collect())
    assert ("g", "down") in got and ("g", "expired") in got and ("a", "ready") in got
    assert [c for r, c in got if r == "d"] == []


def test_pool_status(resources):
    got = {(r.database_type, r.database_size): (r.ready, r.leased, r.cleaning, r.down, r.available)
           for r in pool.pool_status(resources).collect()}
    assert got[(1, 1)] == (1, 0, 1, 0, True)
    assert got[(1, 2)] == (0, 2, 0, 0, False)
    assert got[(3, 3)] == (0, 0, 0, 1, False)


def test_state_after_a_log(spark, resources):
    log = spark.createDataFrame(
        [("a", 1, "leased", 5000.0), ("a", 2, "cleaning", 0.0), ("c", 3, "cleaning", None),
         ("c", 4, "ready", None), ("zz", 5, "down", None)],
        "resource_id string, seq bigint, status string, expiry double")
    after = {r.resource_id: (r.status, r.expiry)
             for r in pool.resource_state_after(resources, log).collect()}
    assert after["a"] == ("cleaning", 5000.0)   # cleaning keeps the lease's expiry
    assert after["c"] == ("ready", 999.0)
    assert after["b"] == ("cleaning", 980.0)
    assert "zz" not in after


def test_registration(spark, resources):
    requests = spark.createDataFrame(
        [(1, 1, 1, "a"), (2, 1, 1, "new"), (3, 1, 1, "new"), (4, 2, 1, "new")],
        "seq bigint, database_type int, database_size int, resource_id string")
    got = {r.seq: (r.outcome, r.status, r.expiry)
           for r in pool.register_resources(resources, requests, NOW).collect()}
    taken = ("already in pool", None, None)
    added = ("added", "ready", 990.0)
    # The same name in another pool is another resource.
    assert got == {1: taken, 2: added, 3: taken, 4: added}


def test_resources_of_all_pools_come_back_with_their_pool(spark, resources, folder):
    path = folder("resources")
    stores.append_partitioned(resources, path, stores.RESOURCE_PARTITIONS)
    assert sorted(map(tuple, read_resources(spark, path).select(*resources.columns).collect())) == \
        sorted(map(tuple, resources.collect()))
