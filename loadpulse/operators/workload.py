"""The relational workload: joins over pictures, and changes to them.

Joins carry no hints: the seed dimensions are local relations of known size,
which the optimizer broadcasts, and larger dimensions of a caller's own take
whatever join their size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .ids import with_dense_ids

CHANGEABLE = ["lineColor", "fillColor", "shape1", "shape2", "artist"]


def pictures_fill_color(pictures: DataFrame, colors: DataFrame) -> DataFrame:
    return pictures.join(colors, pictures.fillColor == colors.id).select(colors.color)


def pictures_two_shapes(pictures: DataFrame, shapes: DataFrame) -> DataFrame:
    """The names of both shapes; the two outputs get a name each."""
    one, two = shapes.alias("one"), shapes.alias("two")
    return (
        pictures.join(one, F.col("shape1") == F.col("one.id"))
        .join(two, F.col("shape2") == F.col("two.id"))
        .select(F.col("one.shape").alias("shape1"), F.col("two.shape").alias("shape2"))
    )


def pictures_star(
    pictures: DataFrame, colors: DataFrame, shapes: DataFrame, artists: DataFrame
) -> DataFrame:
    """Every code of a picture replaced by its name."""
    def role(dimension: DataFrame, code: str, label: str) -> DataFrame:
        return dimension.select(F.col("id").alias(f"{code}_id"), F.col(label).alias(f"{code}_name"))

    named = pictures
    for code, dimension, label in [
        ("lineColor", colors, "color"), ("fillColor", colors, "color"),
        ("shape1", shapes, "shape"), ("shape2", shapes, "shape"), ("artist", artists, "artist"),
    ]:
        named = named.join(role(dimension, code, label), F.col(code) == F.col(f"{code}_id"))
    return named.select(*[F.col(f"{code}_name").alias(code) for code in CHANGEABLE])


def pictures_count(pictures: DataFrame) -> DataFrame:
    return pictures.agg(F.count("*").alias("pictures"))


def dimension_usage(
    pictures: DataFrame, colors: DataFrame, shapes: DataFrame, artists: DataFrame
) -> DataFrame:
    """Every row of the three dimensions with how often pictures refer to it.

    Pictures are counted per (dimension, code) before the join, so the fact table
    is read once and only the counts are shuffled.
    """
    role = {"lineColor": "colors", "fillColor": "colors", "shape1": "shapes",
            "shape2": "shapes", "artist": "artists"}
    references = F.explode(F.array(*[
        F.struct(F.lit(table).alias("dimension"), F.col(code).alias("id"))
        for code, table in role.items()
    ]))
    used = (
        pictures.select(references.alias("r"))
        .groupBy(F.col("r.dimension").alias("dimension"), F.col("r.id").alias("id"))
        .agg(F.count("*").alias("uses"))
    )

    def rows(table: DataFrame, name: str, label: str, detail: str) -> DataFrame:
        return table.select(F.lit(name).alias("dimension"), "id", F.col(label).alias("name"),
                            F.col(detail).cast("string").alias("detail"))

    dimensions = (
        rows(colors, "colors", "color", "hex")
        .unionByName(rows(shapes, "shapes", "shape", "sides"))
        .unionByName(rows(artists, "artists", "artist", "age"))
    )
    return (
        dimensions.join(used, ["dimension", "id"], "left")
        .withColumn("uses", F.coalesce("uses", F.lit(0)).cast("bigint"))
    )


def text_id(kind: str, *key: Column) -> Column:
    """A text id that depends on the row's own key, so it needs no numbering."""
    return F.md5(F.concat_ws("|", F.lit(kind), *[k.cast("string") for k in key]))


def with_text_ids(rows: DataFrame, kind: str, key: list[str]) -> DataFrame:
    """Pictures under text ids made of ``key``."""
    return rows.select(text_id(kind, *map(F.col, key)).alias("id"), *CHANGEABLE)


def with_unique_text_ids(rows: DataFrame, kind: str, key: list[str]) -> DataFrame:
    """Pictures under text ids that no two rows share, with their ``key`` columns.

    An id is made of the key, the codes and a turn among rows that are equal in all of
    them, which are counted before they are unfolded: one shuffle, and copies of one
    row, however many, are a single row in it.
    """
    equal = rows.groupBy(*key, *CHANGEABLE).agg(F.count("*").alias("copies"))
    turns = equal.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*key, *CHANGEABLE]]
    return turns.select(text_id(kind, *parts, F.col("turn")).alias("id"), *key, *CHANGEABLE)


def pictures_append(pictures: DataFrame, inserts: DataFrame, order_by: list[str]) -> DataFrame:
    """``pictures`` with one row per insert, ids going on where the table's end.

    ``inserts`` has the five code columns and whatever ``order_by`` names.
    """
    next_id = pictures.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next")).scalar()
    numbered = with_dense_ids(inserts, order_by, "id", next_id, keep=CHANGEABLE)
    return pictures.unionByName(numbered.select(*pictures.columns))


def pictures_apply_updates(pictures: DataFrame, changes: DataFrame) -> DataFrame:
    """Pictures after a log of single-column updates (id, seq, col, val).

    The last change of a column wins; changes of an unknown id do nothing.  The
    log is folded to one row per id before it meets the table.
    """
    latest = changes.groupBy("id").agg(*[
        F.max_by(F.when(F.col("col") == code, F.col("val")),
                 F.when(F.col("col") == code, F.col("seq"))).alias(f"new_{code}")
        for code in CHANGEABLE
    ])
    return (
        pictures.join(latest, "id", "left")
        .select("id", *[F.coalesce(f"new_{code}", code).alias(code) for code in CHANGEABLE])
    )


def workload_mix(kinds: DataFrame) -> DataFrame:
    """Observed share of each kind of write beside the intended one.

    ``kinds`` has a ``kind`` column: insert, color, shape or artist.  One
    aggregate counts all kinds and the total; the result is unfolded afterwards.
    """
    counted = kinds.agg(
        F.count("*").alias("total"),
        *[F.count(F.when(F.col("kind") == kind, 1)).alias(kind) for kind in K.INTENDED_MIX],
    )
    unfolded = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("writes"),
                 F.lit(share).alias("intended"))
        for kind, share in K.INTENDED_MIX.items()
    ]))
    return (
        counted.select("total", unfolded.alias("m")).select("m.*", "total")
        .withColumn("share", F.try_divide("writes", "total"))
        .drop("total")
    )
