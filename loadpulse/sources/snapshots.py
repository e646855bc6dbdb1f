"""Keyed tables that are updated in place: snapshots of which one version is current.

A table is a folder of data folders and of version files.  A version file names, for
each time slot, the data folder that holds its rows; the last version is the table.  An
update rewrites only the slots it touches, into a new data folder, and commits by giving
the next version file its name, which succeeds for one writer only and whole.  What no
kept version names is deleted, so files grow with the table and not with its updates.

Version files need a file system where a file can get a name that no file has yet in one
step: a hard link on local disks, a rename elsewhere (HDFS and the like).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEPT_VERSIONS = 2  # the current one, and the one that readers may still be at


class VersionConflict(RuntimeError):
    """Another writer has committed in between: nothing of this update is visible."""


# --- small files ------------------------------------------------------------------

def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def publish(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file with its whole content, or return False if there is one already."""
    store, where = _at(spark, path)
    if store.exists(where):
        return False
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    store.mkdirs(where.getParent())
    out = store.create(draft, False)
    out.write(bytearray(content.encode()))
    out.close()
    try:
        if store.getScheme() == "file":
            paths = spark._jvm.java.nio.file.Paths
            local = [paths.get(store.makeQualified(p).toUri()) for p in (where, draft)]
            spark._jvm.java.nio.file.Files.createLink(*local)
        else:
            context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                store.getUri(), spark._jsc.hadoopConfiguration())
            options = spark._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(draft, where, options)
        return True
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            return False
        raise
    finally:
        store.delete(draft, False)


def read_small(spark: SparkSession, path: str) -> str | None:
    """The content of a published file, or None if there is none (any more)."""
    store, where = _at(spark, path)
    if not store.exists(where):
        return None
    file = store.open(where)
    try:
        return bytes(file.readAllBytes()).decode()
    finally:
        file.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    store, where = _at(spark, path)
    if not store.exists(where):
        return []
    return sorted(f.getPath().getName() for f in store.listStatus(where))


def delete(spark: SparkSession, path: str) -> None:
    store, where = _at(spark, path)
    store.delete(where, True)


# --- tables -----------------------------------------------------------------------

def _version_path(path: str, number: int) -> str:
    return f"{path}/versions/{number:012d}.json"


def _versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n[:-5]) for n in names_in(spark, f"{path}/versions") if n.endswith(".json")]


def current(spark: SparkSession, path: str) -> dict:
    """The last version: its ``number``, the data folder of each slot, and the last update
    of each writer.  A table that was never written to is version 0, without slots."""
    while numbers := _versions(spark, path):
        text = read_small(spark, _version_path(path, numbers[-1]))
        if text is not None:  # else deleted meanwhile, so there is a later one
            return json.loads(text)
    return {"number": 0, "slots": {}, "writers": {}}


def _folders(path: str, version: dict) -> Iterator[str]:
    for slot, folder in version["slots"].items():
        yield f"{path}/data/{folder}/slot={slot}"


def _rows(spark: SparkSession, schema: T.StructType, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def read_snapshot(
    spark: SparkSession, path: str, schema: T.StructType, slots: tuple[int, int] | None = None
) -> DataFrame:
    """The rows of the current version, or those of the slots from one to another.

    Folders of other slots are not listed, let alone read.
    """
    version = current(spark, path)
    if slots is not None:
        version["slots"] = {s: f for s, f in version["slots"].items() if slots[0] <= int(s) <= slots[1]}
    return _rows(spark, schema, list(_folders(path, version)))


def upsert(
    rows: DataFrame, path: str, keys: list[str], slot: Column, writer: str | None = None,
    update: int = 0, kept_versions: int = KEPT_VERSIONS, expected: int | None = None,
    slots: list[int] | None = None,
) -> bool:
    """Put ``rows`` in the table: a row replaces the one with its keys.

    ``slot`` is a whole number derived from the keys, so a key stays in its slot.  Keys
    are unique within ``rows``, as the results of a stream's update mode are.  ``update``
    rises with each update of a ``writer``: one that the table has already is skipped,
    so an update that runs again changes nothing; the result says whether it was applied.
    Updates without a writer are always applied.  With ``expected`` an update is made to
    the version of that number, and to no other.

    The touched slots are listed on the driver, as many as the update has slots of time,
    unless the caller names them in ``slots``; there must be rows for each.
    """
    spark, schema = rows.sparkSession, rows.schema
    for own in ("slot", "_slot", "_turn", "_values"):
        if own in rows.columns:
            raise ValueError(f"a column of the table may not be called {own}")
    before = current(spark, path)
    if expected is not None and before["number"] != expected:
        raise VersionConflict(f"{path} has version {before['number']} already")
    if writer is not None and update <= before["writers"].get(writer, -1):
        return False
    folder = uuid.uuid4().hex
    incoming = rows.withColumn("_slot", slot.cast("bigint")).select(
        *[F.col(c) for c in rows.columns], "_slot", F.lit(1).alias("_turn"))
    if slots is None:
        slots = [r["_slot"] for r in incoming.select("_slot").distinct().collect()]
    touched = [str(s) for s in slots]
    held = [f"{path}/data/{before['slots'][s]}/slot={s}" for s in touched if s in before["slots"]]
    values = [c for c in rows.columns if c not in keys]
    both = incoming.unionByName(
        _rows(spark, schema, held).withColumn("_slot", slot.cast("bigint")).withColumn("_turn", F.lit(0)))
    merged = (
        both.groupBy("_slot", *keys).agg(F.max_by(F.struct(*values), "_turn").alias("_values"))
        .select(*[F.col(c) if c in keys else F.col(f"_values.{c}").alias(c) for c in rows.columns],
                F.col("_slot").alias("slot"))
    )
    # Slots are rewritten whole: few files each, and a slot with most rows is split.
    merged.hint("rebalance", "slot").write.partitionBy("slot").parquet(f"{path}/data/{folder}")
    after = {
        "number": before["number"] + 1,
        "slots": before["slots"] | dict.fromkeys(touched, folder),
        "writers": before["writers"] | ({} if writer is None else {writer: update}),
    }
    if not publish(spark, _version_path(path, after["number"]), json.dumps(after)):
        delete(spark, f"{path}/data/{folder}")
        raise VersionConflict(f"{path} has a version {after['number']} of another writer")
    _clean(spark, path, kept_versions)
    return True


def _clean(spark: SparkSession, path: str, kept_versions: int) -> None:
    """Delete what only versions before the last ``kept_versions`` name.

    A data folder goes slot by slot, as later versions replace its slots one after
    another.  Folders that no version names yet belong to updates under way and stay.
    """
    numbers = _versions(spark, path)
    dropped, kept = numbers[:-kept_versions], numbers[-kept_versions:]

    def named(some: list[int]) -> set[str]:
        texts = [read_small(spark, _version_path(path, n)) for n in some]
        return {f for text in texts if text for f in _folders(path, json.loads(text))}

    for old in named(dropped) - named(kept):
        delete(spark, old)
    for number in dropped:
        for folder in set(json.loads(read_small(spark, _version_path(path, number)) or '{"slots":{}}')["slots"].values()):
            if not [n for n in names_in(spark, f"{path}/data/{folder}") if n.startswith("slot=")]:
                delete(spark, f"{path}/data/{folder}")
        delete(spark, _version_path(path, number))
