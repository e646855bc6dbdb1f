"""Columns that translate between numeric codes, labels and location keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def lookup(code: Column, table: dict, otherwise: Column | None = None) -> Column:
    """``table[code]`` for a small fixed table; unknown codes give ``otherwise``."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*entries), code)
    return found if otherwise is None else F.coalesce(found, otherwise)


def db_key(db_type: Column, db_size: Column, intensity: Column) -> Column:
    """Location key such as ``sql-1-3``; null for an unknown type."""
    return F.concat(
        lookup(db_type, K.KEY_PREFIX), F.lit("-"),
        db_size.cast("string"), F.lit("-"), intensity.cast("string"),
    )


def pattern_key(read_pattern: Column, write_pattern: Column) -> Column:
    return F.concat(read_pattern.cast("string"), F.lit("-"), write_pattern.cast("string"))


_KEY_SHAPE = r"^([a-z]+)-([0-9]+)-([0-9]+)$"


def parse_db_key(key: Column) -> Column:
    """Struct (prefix, db_type, db_size, intensity) of a location key.

    A key of another shape gives nulls; a well-formed key with an unknown
    prefix has type -1.
    """
    part = [F.nullif(F.regexp_extract(key, _KEY_SHAPE, i), F.lit("")) for i in (1, 2, 3)]
    type_of_prefix = {prefix: code for code, prefix in K.KEY_PREFIX.items()}
    return F.struct(
        part[0].alias("prefix"),
        F.when(part[0].isNotNull(), lookup(part[0], type_of_prefix, F.lit(-1))).alias("db_type"),
        part[1].try_cast("int").alias("db_size"),
        part[2].try_cast("int").alias("intensity"),
    )


def type_label(db_type: Column) -> Column:
    return lookup(db_type, K.TYPE_LABEL)


def size_label(db_size: Column) -> Column:
    return lookup(db_size, K.SIZE_LABEL)


def size_from_name(name: Column) -> Column:
    """Size code found in an instance name, smallest first; -1 if none is."""
    sizes = [F.when(name.contains(text), code) for code, text in K.SIZE_IN_NAME.items()]
    return F.coalesce(*sizes, F.lit(-1))


def resource_name(
    prefix: Column, db_size: Column, project: str, region: str, instance: str
) -> Column:
    """Name of the instance that serves a (key prefix, size).

    Relational instances carry project and region, and a replica ends in
    ``-r``; the third type uses the bare instance name.
    """
    bare = F.concat(F.lit(f"{instance}-"), lookup(db_size, K.SIZE_IN_NAME), F.lit("1"))
    full = F.concat(F.lit(f"{project}:{region}:"), bare)
    return (
        F.when(prefix == K.KEY_PREFIX[1], full)
        .when(prefix == K.KEY_PREFIX[2], F.concat(full, F.lit("-r")))
        .when(prefix == K.KEY_PREFIX[3], bare)
    )


def intensity_multiplier(intensity: Column) -> Column:
    """Number of parallel load pods an intensity stands for."""
    return lookup(intensity, K.PODS_PER_INTENSITY, intensity)
