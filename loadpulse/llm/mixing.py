"""Mixing sources to target weights by Pareto order sampling.

Sizes are words.  Sources share a multiple of all words by weight; a target stops at
``cap`` times its source's size and the excess goes to the others by weight.  A
source first gets whole copies of all its documents, as often as its target allows.
For the rest every document gets an inclusion probability in proportion to its size
(times its weight, if there is one) such that the expected words are those wanted.  Its
random odds are divided by its inclusion odds, and documents are taken in that order
until the target is met; the document on the border is taken if that comes nearer.  Long
documents are thus certain or likely, and those on the border mostly short.

Only counts are shuffled.  The border of each source is found in a histogram of the
ranks, then in a finer one inside the border's bucket, then among the few documents
left, so a source with a third of all rows is no task of its own.

Edge cases: a null or empty text has size 0 and takes no words; a null source is a
source, last in order; documents with the same id and source get the same random
number, so repeated rows are taken or left together; weights of documents that are
null or not positive count as 1; an empty table gives an empty mix; other columns,
whatever their names, are kept by ``mixed`` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SOURCE_WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = "mix"
# Buckets of a histogram level; two levels leave about one in 16 million rows.
_STEP = 4096


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD_PATTERN)), F.lit(0)).cast("bigint")


def uniform(doc_id: Column, source: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the document alone."""
    text = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("-")),
                       F.coalesce(source, F.lit("-")))
    drawn = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")
    return (drawn.cast("double") + 0.5) / float(1 << 48)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS,
                   share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source: its size, its target, whole copies and the part left to sampling.

    The windows run over one row per source.
    """
    # Squares are added up exactly: the order of adding must not change a chance.
    square = F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)")
    sources = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(square).cast("double").alias("squares"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighted = sources.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    # From the source that is capped first to the one capped last: a source is capped
    # if what is left for it and those after it reaches its cap.
    most = F.col("source_size") * F.lit(cap)
    by_cap = W.orderBy(most / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    shared = F.sum("source_size").over(everything) * F.lit(share)
    left = weighted.withColumns({
        "left": shared - F.coalesce(F.sum(most).over(before), F.lit(0.0)),
        "weight_left": F.sum("weight").over(onward),
    }).withColumn("capped", F.col("left") * F.col("weight") >= most * F.col("weight_left"))
    first_free = F.min(F.when(~F.col("capped"), F.struct(
        (most / F.col("weight")).alias("r"), F.col("left"), F.col("weight_left")))).over(everything)
    target = F.when(F.col("capped"), most).otherwise(
        first_free["left"] * F.col("weight") / first_free["weight_left"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        left.withColumn("target", target)
        .withColumn("copies", F.floor(ratio).cast("bigint"))
        .withColumn("chance", ratio - F.col("copies"))
        .withColumn("wanted", F.col("target") - F.col("copies") * F.col("source_size"))
        # The size of a document whose chance is the source's share.
        .withColumn("usual", F.when(F.col("source_size") > 0, F.col("squares") / F.col("source_size")))
        .select("source", "source_size", "target", "copies", "chance", "wanted", "usual")
    )


def pareto_rank(u: Column, chance: Column, weight: Column) -> Column:
    """The order of a document: odds of ``u`` over the inclusion odds, as ``o / (1 + o)``."""
    p = F.least(F.greatest(chance * weight, F.lit(1e-9)), F.lit(1 - 1e-9))
    return u * (1 - p) / (u * (1 - p) + p * (1 - u))


def _odds(weight: str | None) -> Column:
    """What a document's chance is multiplied by."""
    if weight is None:
        return F.lit(1.0)
    own = F.col(common.quoted(weight))
    return F.when(own > 0, own).otherwise(1.0)


def _by_size(size: Column, usual: Column) -> Column:
    return F.when(size > 0, size / usual).otherwise(1.0)


def _ranked(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents with their source's row and their ``rank``."""
    t = targets.withColumnRenamed("source", "_source")
    joined = docs.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return joined.withColumn("rank", pareto_rank(
        uniform(F.col("doc_id"), F.col("source")), F.col("chance"),
        _by_size(F.col("size"), F.col("usual")) * F.col("odds")))


def _borders(ranked: DataFrame) -> DataFrame:
    """Per source: documents ranked below ``low``, or up to ``last``, are sampled."""
    inside = ranked.select("source", "size", "wanted", "rank")
    spark = ranked.sparkSession
    found = None
    for level in (_STEP, _STEP * _STEP):
        bucket = F.floor(F.col("rank") * level)
        if found is None:
            rows = inside.withColumn("below", F.lit(0).cast("bigint"))
        else:
            rows = _in_border(inside, found, level // _STEP)
        sums = rows.groupBy("source", "wanted", "below", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"))
        upto = F.sum("words").over(W.partitionBy("source").orderBy("bucket")) + F.col("below")
        sums = sums.withColumn("upto", upto)
        border = sums.where(F.col("upto") > F.col("wanted")).groupBy("source").agg(
            F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("below"))).alias("b"))
        found = spark.read.parquet(_kept(border.select("source", "b.bucket", "b.below")))
    rows = _in_border(inside, found, _STEP * _STEP)
    by_rank = W.partitionBy("source").orderBy("rank")
    before = by_rank.rangeBetween(W.unboundedPreceding, W.currentRow)
    equal = rows.groupBy("source", "wanted", "below", "rank").agg(F.sum("size").alias("words"))
    middle = F.sum("words").over(before) + F.col("below") - F.col("words") / 2
    last = equal.withColumn("middle", middle).where(F.col("middle") <= F.col("wanted")).groupBy(
        F.col("source").alias("_s")).agg(F.max("rank").alias("last"))
    return found.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "source", (F.col("bucket") / (_STEP * _STEP)).alias("low"),
        F.coalesce("last", F.lit(-1.0)).alias("last"))


def _in_border(rows: DataFrame, found: DataFrame, level: int) -> DataFrame:
    f = found.withColumnRenamed("source", "_source")
    return rows.join(f, F.col("source").eqNullSafe(F.col("_source"))
                     & (F.floor(F.col("rank") * level) == F.col("bucket"))).drop("_source", "bucket")


def _kept(df: DataFrame) -> str:
    return common.stored(df, "mix")[1]


def plan(docs: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, share: float = SHARE,
         cap: float = CAP, weight: str | None = None) -> DataFrame:
    """Per source: size, target, whole copies, chance and the border of the sample.

    It is stored, so its size is known and joining it needs no shuffle of documents
    unless there are very many sources.
    """
    sized, _ = common.stored(docs.select(
        "doc_id", "source", size_of(F.col("text")).alias("size"), _odds(weight).alias("odds")), "sizes")
    targets, _ = common.stored(source_targets(sized, weights, share, cap), "targets")
    borders = _borders(_ranked(sized, targets)).withColumnRenamed("source", "_source")
    whole = targets.join(borders, F.col("source").eqNullSafe(F.col("_source")), "left")
    return common.stored(whole.drop("_source"), "mix-plan")[0]


def copies(planned: Column, size: Column, weight: str | None = None) -> Column:
    """How often the mix takes a document of this size, by its source's row of the plan."""
    rank = pareto_rank(uniform(F.col("doc_id"), F.col("source")), planned["chance"],
                       _by_size(size, planned["usual"]) * _odds(weight))
    sampled = F.coalesce((rank < planned["low"]) | (rank <= planned["last"]), F.lit(False))
    return planned["copies"] + F.when(sampled & (planned["wanted"] > 0), 1).otherwise(0)


def _with_plan(docs: DataFrame, planned: DataFrame, name: str) -> DataFrame:
    """Documents with their source's row of the plan as one column."""
    own = common.unused(docs, "plan_source", name)
    rows = planned.select(F.col("source").alias(own), F.struct(*planned.columns).alias(name))
    return docs.join(rows, docs["source"].eqNullSafe(rows[own])).drop(own)


def taken(docs: DataFrame, weight: str | None = None, **options) -> DataFrame:
    """What the mix takes of each document, in words."""
    planned = plan(docs, weight=weight, **options)
    size, name = (common.unused(docs, n) for n in ("size", "plan"))
    # Words are counted once, below the join.
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias(size),
                        *([common.quoted(weight)] if weight else []))
    row, n = F.col(name), F.col(size)
    return _with_plan(sized, planned, name).select(
        "doc_id", n.alias("size"), row["source_size"].alias("source_size"),
        row["target"].alias("target"), (n * copies(row, n, weight)).alias("taken"))


def mixed(docs: DataFrame, weight: str | None = None, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken."""
    planned = plan(docs, weight=weight, **options)
    size, name, turn = (common.unused(docs, n) for n in ("size", "plan", "turn"))
    sized = docs.withColumn(size, size_of(F.col("text")))
    times = copies(F.col(name), F.col(size), weight).cast("int")
    return _with_plan(sized, planned, name).withColumn(
        turn, F.explode(F.array_repeat(F.lit(1), times))).select(*map(common.quoted, docs.columns))
