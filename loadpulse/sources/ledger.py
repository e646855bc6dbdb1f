"""Ids handed out in ranges, from a high-water mark that is kept in a small file.

A range is reserved by giving the next version file of the ledger its name, which one
writer can do; the others begin anew after it.  A writer numbers its updates and finds
the range of its last one again, so an update that runs again uses the same ids.  A
writer that dies after its reservation and never comes back leaves a gap.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from . import snapshots

_ATTEMPTS = 50
_KEPT = 2  # the current version, and the one that readers may still be at


class RangeMismatch(RuntimeError):
    """An update that runs again does not ask for what it has been given."""


def _version(path: str, number: int) -> str:
    return f"{path}/{number:012d}.json"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return [int(n[:-5]) for n in snapshots.names_in(spark, path) if n.endswith(".json")]


def _current(spark: SparkSession, path: str) -> dict:
    while numbers := _numbers(spark, path):
        text = snapshots.read_small(spark, _version(path, numbers[-1]))
        if text is not None:  # else deleted meanwhile, so there is a later one
            return json.loads(text)
    return {"number": 0, "next": 1, "writers": {}}


def next_id(spark: SparkSession, path: str) -> int:
    """The first id that no range has."""
    return _current(spark, path)["next"]


def reserve(spark: SparkSession, path: str, rows: int, writer: str, update: int = 0,
            first: int = 1) -> int:
    """The first of ``rows`` ids in sequence that belong to this update of ``writer``.

    ``first`` is where a ledger begins that has no range yet.  The ledger keeps the last
    range of each writer; an update before that one is refused, as is a repeated one of
    another size.
    """
    for _ in range(_ATTEMPTS):
        before = _current(spark, path)
        last, start, size = before["writers"].get(writer, (-1, 0, 0))
        if update == last and size == rows:
            return start
        if update <= last:
            raise RangeMismatch(f"{writer} has {size} ids for its update {last}, not {rows} for {update}")
        start = before["next"] if before["number"] else first
        after = {
            "number": before["number"] + 1,
            "next": start + rows,
            "writers": before["writers"] | {writer: (update, start, rows)},
        }
        if snapshots.publish(spark, _version(path, after["number"]), json.dumps(after)):
            for old in _numbers(spark, path)[:-_KEPT]:
                snapshots.delete(spark, _version(path, old))
            return start
    raise snapshots.VersionConflict(f"the ledger {path} changes all the time")
