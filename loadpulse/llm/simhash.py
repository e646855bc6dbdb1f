"""SimHash near-duplicates, with pigeonring filtering of candidate pairs.

A fingerprint has 64 bits, each decided by a majority of the hashes of all three-word
shingles.  Fingerprints link at ``MOST_BITS`` differing bits or fewer.  They are cut
into a ring of four segments.  If two of them differ in at most 3 bits, then some
segment starts a chain whose first 1, 2, 3, 4 segments differ in at most 0, 1, 2, 3
bits: the budget in proportion to the chain's length.  The first two links of a chain
make the join key: a segment, and the next one with up to one bit flipped.  The third
prunes candidates before the full Hamming check.

Equal fingerprints are one node, so copies cost nothing after the first grouping.

Edge cases: a null text is an empty one, and all of them share fingerprint zero; a
text of one or two words is one shingle; documents without an id still link others,
and a component of such documents alone has a null id; repeated rows are kept; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE_WORDS = 3
SEED = 42
MOST_BITS = 3
SEGMENTS, SEGMENT_BITS = 4, 16
_BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = common.lower_words(text)
    if not words:
        return 0
    data = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    span = min(SHINGLE_WORDS, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    votes, total = np.zeros(64, dtype=np.int64), len(words) - span
    for at in range(0, total, _BLOCK):
        first = starts[at:min(at + _BLOCK, total)].tolist()
        last = ends[at + span:at + span + len(first)].tolist()
        hashes = np.array([digest(data[s:e], SEED) for s, e in zip(first, last, strict=True)],
                          dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp`` with the fingerprint as a signed 64-bit integer."""
    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"),
                                "text_hash": batch["text_hash"], "fp": prints.view(np.int64)})

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text",
    ).mapInPandas(compute, "doc_id bigint, text_hash bigint, fp bigint")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS * (i % SEGMENTS)).bitwiseAND((1 << SEGMENT_BITS) - 1)


def _key(i: int, first: Column, second: Column) -> Column:
    high = F.lit(i << 2 * SEGMENT_BITS).cast("bigint")
    return high + F.shiftleft(first, SEGMENT_BITS) + second


def links(prints: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of the distinct fingerprints ``fp`` that link."""
    fp = F.col("fp")
    exact, probes = [], []
    for i in range(SEGMENTS):
        first, second = _segment(fp, i), _segment(fp, i + 1)
        exact.append(_key(i, first, second))
        probes.append(_key(i, first, second))
        probes += [_key(i, first, second.bitwiseXOR(1 << bit)) for bit in range(SEGMENT_BITS)]
    index = prints.select(F.explode(F.array(*exact)).alias("key"), fp.alias("b"))
    probe = prints.select(F.explode(F.array(*probes)).alias("key"), fp.alias("a"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    start = F.shiftright("key", 2 * SEGMENT_BITS)
    budget = F.lit(False)
    for i in range(SEGMENTS):
        third = F.bit_count(_segment(apart, i)) + F.bit_count(_segment(apart, i + 1)) + F.bit_count(
            _segment(apart, i + 2))
        budget = budget | ((start == i) & (third <= 3 * MOST_BITS // SEGMENTS))
    return (
        probe.join(index, "key")
        .where((F.col("a") < F.col("b")) & budget & (F.bit_count(apart) <= MOST_BITS))
        .select("a", "b").distinct()
    )


def _classes(prints: DataFrame) -> DataFrame:
    """``fp, component_id`` of every distinct fingerprint."""
    classes, _ = common.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    named = components(links(classes.select("fp")))
    rooted, _ = common.stored(
        classes.join(named.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "first_id", F.coalesce("component", "fp").alias("root")), "rooted")
    smallest, _ = common.stored(
        rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    return common.stored(rooted.join(smallest, "root"), "by-print")[0]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id reachable by links, itself included."""
    prints, _ = common.stored(fingerprints(docs), "prints")
    return prints.join(_classes(prints), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """Documents without near-duplicates: of each component the first by id stays, null
    ids last, then by the hash of the text; of equal rows, one."""
    prints, _ = common.stored(fingerprints(docs), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    no_id = F.lit(-1 << 63)
    kept, _ = common.stored(
        prints.join(_classes(prints), "fp").groupBy("root").agg(F.min(first).alias("k"))
        .select(F.coalesce("k.doc_id", no_id).alias("_kept_id"),
                F.col("k.text_hash").alias("_kept_hash")), "kept")
    keyed = docs.withColumns({"_kept_id": F.coalesce(F.col("doc_id").cast("bigint"), no_id),
                              "_kept_hash": F.xxhash64("text")})
    same = W.partitionBy("_kept_id", "_kept_hash").orderBy("_kept_id", "_kept_hash")
    return (
        keyed.join(kept, ["_kept_id", "_kept_hash"], "left_semi")
        .withColumn("_same", F.row_number().over(same)).where("_same = 1").select(*docs.columns)
    )
