"""Small fixed tables as relations Catalyst knows the exact size of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import constants as K


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def values_text(rows) -> str:
    """The rows as the text of a VALUES clause."""
    return ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)


def fixed_table(spark: SparkSession, rows, columns: dict[str, str]) -> DataFrame:
    """``rows`` as a local relation with the given column types.

    Its size is part of the plan, so a join against it is broadcast by the
    optimizer's own size rule and needs no hint.
    """
    names = ", ".join(columns)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in columns.items())
    return spark.sql(f"SELECT {casts} FROM VALUES {values_text(rows)} AS t({names})")


DIMENSIONS = {
    "colors": (K.COLORS, {"id": "INT", "color": "STRING", "hex": "STRING"}),
    "shapes": (K.SHAPES, {"id": "INT", "shape": "STRING", "sides": "INT"}),
    "artists": (K.ARTISTS, {"id": "INT", "artist": "STRING", "age": "INT"}),
}


def dimension(spark: SparkSession, name: str) -> DataFrame:
    """One of the workload's seed tables: ``colors``, ``shapes`` or ``artists``."""
    rows, columns = DIMENSIONS[name]
    return fixed_table(spark, rows, columns)
