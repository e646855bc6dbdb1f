"""Document fingerprints: quartile digests of hashed byte triplets.

Each text's bytes are read in windows; three triplets of a window are hashed into
256 buckets and counted.  Whether a bucket's count lies in the first, second, third
or last quarter of all counts is two bits of the digest.  A header holds the length
on a logarithmic scale and the ratios of the quartiles.  Two digests differ by a
bounded score, so documents can be compared without their texts.

Edge cases: a null text counts as empty; an empty or very short text has counts of
zero and so a defined digest; documents with equal ids are ordered by their texts,
null ids come first; a table of one document has that document as its own successor;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

BUCKETS = 256
# Places of a triplet's bytes within the window, and the factor of its hash.
TRIPLETS = ((0, 1, 2, 0x9E3779B1), (0, 1, 3, 0x85EBCA77), (0, 2, 4, 0xC2B2AE3D))
WINDOW = 5
BLOCK_BYTES = 1 << 20
LENGTH_BASE = 1.15
# A difference of this size or more is likeness 0.
WORST_DIFFERENCE = 600.0
LENGTH_WEIGHT, RATIO_WEIGHT, HEADER_CAP = 2.0, 2.0, 12
_STEP_COST = np.array([0, 1, 3, 6], dtype=np.int64)
_HEX_BODY = BUCKETS // 2


def bucket_counts(data: bytes) -> np.ndarray:
    """How many triplets fall into each bucket; long texts are read in blocks."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    everything = np.frombuffer(data, dtype=np.uint8)
    for start in range(0, max(len(data) - 2, 0), BLOCK_BYTES):
        block = everything[start:start + BLOCK_BYTES + WINDOW - 1].astype(np.uint32)
        for a, b, c, factor in TRIPLETS:
            places = min(len(block) - c, BLOCK_BYTES)
            if places <= 0:
                continue
            triplet = block[a:a + places] | (block[b:b + places] << 8) | (block[c:c + places] << 16)
            counts += np.bincount((triplet * np.uint32(factor)) >> 24, minlength=BUCKETS)
    return counts


def digest(text: str | None) -> str:
    """The fingerprint of a text, as lowercase hex: length, two ratios, quarters."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = bucket_counts(data)
    ranked = np.sort(counts)
    q1, q2, q3 = (int(ranked[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    quarter = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = quarter[0::4] | quarter[1::4] << 2 | quarter[2::4] << 4 | quarter[3::4] << 6
    length = min(255, int(math.log(len(data) + 1, LENGTH_BASE)))
    ratios = [q * 15 // q3 if q3 else 0 for q in (q1, q2)]
    return f"{length:02x}{ratios[0]:x}{ratios[1]:x}{packed.astype(np.uint8).tobytes().hex()}"


def _quarters(body: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(body), dtype=np.uint8)
    return np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], axis=1).astype(np.int64)


def difference(a: str, b: str) -> float:
    """How far two fingerprints are apart; 0 for equal ones."""
    header = LENGTH_WEIGHT * min(HEADER_CAP, abs(int(a[:2], 16) - int(b[:2], 16)))
    for place in (2, 3):
        header += RATIO_WEIGHT * min(HEADER_CAP, abs(int(a[place], 16) - int(b[place], 16)))
    return header + float(_STEP_COST[np.abs(_quarters(a[4:]) - _quarters(b[4:]))].sum())


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, 0 for a difference of ``WORST_DIFFERENCE`` or more."""
    return 0.0 if a == b == "" else 1.0 - min(difference(a, b), WORST_DIFFERENCE) / WORST_DIFFERENCE


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every document."""
    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"],
                                "fingerprint": [digest(t) for t in batch["text"]]})

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(compute, f"doc_id {ids}, fingerprint string")


def with_successor(docs: DataFrame) -> DataFrame:
    """Documents in buckets of neighbouring ids, each bucket followed by a copy of
    the first document of the next one (of the first bucket after the last).

    Texts are shuffled once.  The copies are one row per bucket, of which there are
    a fixed multiple of the shuffle partitions, so they are broadcast.
    """
    spark = docs.sparkSession
    partitions = common.shuffle_partitions(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bucket = common.ordered_bucket(docs.select("doc_id"), "doc_id", 4 * partitions)
    placed = docs.withColumn("bucket", bucket)
    firsts = placed.groupBy("bucket").agg(F.min("doc_id").alias("first_id"))
    in_order = W.orderBy("bucket")
    whole = in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    firsts = firsts.select(
        "first_id",
        F.coalesce(F.lag("bucket").over(in_order), F.max("bucket").over(whole)).alias("bucket"))
    heads = (
        docs.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy("bucket").agg(F.min("text").alias("text"), F.min("doc_id").alias("doc_id"))
        .select("doc_id", "text", "bucket", F.lit(1).alias("copied"))
    )
    return (
        placed.withColumn("copied", F.lit(0)).unionByName(heads)
        .repartition(partitions, "bucket")
        .sortWithinPartitions("bucket", "copied", "doc_id", "text")
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited form, and how like they are.

    The edited text has its last quarter (rounded down) replaced by as many first
    code points of the next document, or all of them if it is shorter.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
             "near_edited", "near_next"]

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for batch in batches:
            rows = []
            for doc_id, text, bucket, copied in zip(
                    batch["doc_id"], batch["text"], batch["bucket"], batch["copied"], strict=True):
                own = digest(text)
                if before is not None and before[3] == bucket:
                    rows.append(_compared(*before[:3], text, own))
                before = None if copied else (doc_id, text, own, bucket)
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "n_chars": "int64"})

    return with_successor(docs).mapInPandas(
        compute, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                 "edited_fingerprint string, near_edited double, near_next double")


def _compared(doc_id, text: str, own: str, next_text: str, next_own: str) -> tuple:
    quarter = len(text) // 4
    edited = text[:len(text) - quarter] + next_text[:quarter]
    edited_own = own if edited == text else digest(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(text), sha, own, edited_own, likeness(own, edited_own),
            likeness(own, next_own))
