"""The trie of conversation prefixes, with subtree totals by time-forward processing.

Conversations are rebuilt and read once in order; a chain of SHA-256 digests names each
prefix, so a node is a group of equal names and texts are never shuffled.  A node with one
member needs nothing from below it: it has one leaf and saves nothing.  The others are
cut into shards.  A node's weight is the rebuilt turns at or below it; nodes heavier than
a share of all turns are the top, and each subtree that hangs from the top, lighter than
that, goes to a shard whole.  In a shard nodes are sorted by reverse level order (Spark's
external sort) and send their totals forward to their parents through a priority queue
that spills to an unnamed file of the task.  The totals of the shards' roots are added up
by parent, and the top, whose size does not grow with the input, is processed alike.

Members that end at a node are hashed in numeric order.  Ids are sorted in ranges over all
tasks and joined to stretches of text first, so a node where very many end is hashed from
a few rows.

Edge cases: a null role or text is empty, a null turn comes first, equal turns are ordered
by role and then by digest; repeated rows are repeated turns; rows without ``conv_id``
belong to no conversation and are left out; an empty table has no root.  Other columns are
not read.  A conversation is read by one task, as a chain of digests must be, row by row.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

GROUP = 20                    # conversations that may share their first turns
SHARED = 4                    # the most shared turns, plus one
SHARDS_PER_PARTITION = 4
LEAST_SHARD_ROWS = 4096
QUEUE_ENTRIES = 1 << 16
SPILL_BLOCK = 1 << 12
STRETCH_IDS = 1 << 12

_ROOT = hashlib.sha256(b"root").digest()
_NONE_SHA256 = hashlib.sha256(b"").hexdigest()


# --- paths ------------------------------------------------------------------------

def _turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, words``: what a trie needs of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"),
        F.unhex(F.sha2(content, 256)).alias("digest"),
        F.regexp_count(text, F.lit(common.WORD_PATTERN)).cast("bigint").alias("words"))


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its group."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED).cast("int")


def paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, key, parent, words, left``: a row for every prefix of every
    rebuilt conversation, the empty one included; ``left`` are the turns behind it."""
    turns = _turns(conversations)
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "digest")
    firsts = (
        turns.where(F.col("conv_id") % GROUP == 0)
        .withColumn("place", F.row_number().over(in_order)).where(F.col("place") < SHARED)
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("heads"))
    )
    shared = shared_turns(F.col("conv_id"))
    # One row ahead of each conversation's turns says how it begins and how long it is.
    heads = F.slice(F.coalesce("heads", F.array().cast("array<struct<place:int,digest:binary,words:bigint>>")),
                    F.lit(1), shared)
    headers = (
        turns.groupBy("conv_id").agg(F.count("*").alias("own"))
        .withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
        .join(firsts, "base", "left")
        .select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"),
                F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit(0).cast("bigint").alias("words"),
                shared.alias("shared"), "own",
                F.transform(heads, lambda x: x["digest"]).alias("head_digests"),
                F.transform(heads, lambda x: x["words"]).alias("head_words"))
    )
    bodies = turns.select(
        "conv_id", F.lit(1).alias("kind"), F.col("turn").cast("bigint").alias("turn"), "role",
        "digest", "words", F.lit(0).alias("shared"), F.lit(0).cast("bigint").alias("own"),
        F.array().cast("array<binary>").alias("head_digests"),
        F.array().cast("array<bigint>").alias("head_words"))

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, depth, left, place, shared = _ROOT, 0, 0, 0, 0
        for batch in batches:
            rows = []

            def step(conv_id: int, digest: bytes, words: int) -> None:
                nonlocal key, depth, left
                parent, key = key, hashlib.sha256(key + digest).digest()
                depth, left = depth + 1, left - 1
                rows.append((conv_id, depth, key, parent, words, left))

            for conv_id, kind, digest, words, n_shared, own, digests, counts in zip(
                    *(batch[c] for c in ("conv_id", "kind", "digest", "words", "shared", "own",
                                         "head_digests", "head_words")), strict=True):
                if kind == 0:
                    key, depth, place, shared = _ROOT, 0, 0, n_shared
                    left = len(digests) + max(0, own - n_shared)
                    rows.append((conv_id, 0, _ROOT, None, 0, left))
                    for head, count in zip(digests, counts, strict=True):
                        step(conv_id, head, count)
                else:
                    place += 1
                    if place > shared:
                        step(conv_id, digest, words)
            if rows:
                yield pd.DataFrame(rows, columns=["conv_id", "depth", "key", "parent", "words", "left"])

    return (
        headers.unionByName(bodies).repartition("conv_id")
        .sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
        .mapInPandas(chain, "conv_id bigint, depth bigint, key binary, parent binary, "
                            "words bigint, left bigint")
    )


# --- members that end at a node ---------------------------------------------------

def _ends(path: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of every node where a conversation ends."""

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids = None, []
        for batch in batches:
            done = []
            for at, conv_id in zip(batch["key"], batch["conv_id"], strict=True):
                if ids and (at != key or len(ids) >= STRETCH_IDS):
                    done.append((key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = at
                ids.append(int(conv_id))
            if done:
                yield pd.DataFrame(done, columns=["key", "first", "ids"])
        if ids:
            yield pd.DataFrame([(key, ids[0], ",".join(map(str, ids)))], columns=["key", "first", "ids"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            done = []
            for at, ids in zip(batch["key"], batch["ids"], strict=True):
                if at == key:
                    state.update(b",")
                else:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = at, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pd.DataFrame(done, columns=["key", "ends_sha256"])
        if state:
            yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends_sha256"])

    return (
        path.where("left = 0").select("key", "conv_id")
        .repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
        .mapInPandas(stretches, "key binary, first bigint, ids string")
        .repartition("key").sortWithinPartitions("key", "first")
        .mapInPandas(hashed, "key binary, ends_sha256 string")
    )


# --- time-forward processing ------------------------------------------------------

class SpillingQueue:
    """A priority queue, smallest entry first, of which a bounded part is in memory.

    When that part is full it is sorted and written behind the runs written before, to a
    file without a name that goes with the task.  Each run has one block in memory.
    """

    def __init__(self, limit: int = QUEUE_ENTRIES):
        self._limit, self._heap, self._heads = limit, [], []
        self._file, self.spilled = None, 0

    def _run(self, offsets: list[int]) -> Iterator[tuple]:
        for offset in offsets:
            self._file.seek(offset)
            yield from pickle.load(self._file)

    def _spill(self) -> None:
        if self._file is None:
            self._file = tempfile.TemporaryFile()
        entries, offsets = sorted(self._heap), []
        for i in range(0, len(entries), SPILL_BLOCK):
            offsets.append(self._file.seek(0, 2))
            pickle.dump(entries[i:i + SPILL_BLOCK], self._file)
        self._heap.clear()
        self.spilled += 1
        run = self._run(offsets)
        heapq.heappush(self._heads, (next(run), self.spilled, run))

    def push(self, entry: tuple) -> None:
        heapq.heappush(self._heap, entry)
        if len(self._heap) >= self._limit:
            self._spill()

    def first(self) -> tuple | None:
        if self._heads and (not self._heap or self._heads[0][0] < self._heap[0]):
            return self._heads[0][0]
        return self._heap[0] if self._heap else None

    def pop(self) -> tuple:
        if not self._heads or (self._heap and self._heap[0] <= self._heads[0][0]):
            return heapq.heappop(self._heap)
        entry, number, run = self._heads[0]
        after = next(run, None)
        if after is None:
            heapq.heappop(self._heads)
        else:
            heapq.heapreplace(self._heads, (after, number, run))
        return entry


_NODE = ["key", "parent", "depth", "conv_id", "n_convs"]
_TOTALS = ["n_children", "n_leaves", "saved_tokens"]
_FORWARD = ("shard bigint, is_root boolean, key binary, parent binary, depth bigint, conv_id bigint, "
            "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint")


def _forwarded(nodes: DataFrame, entries: int) -> DataFrame:
    """Subtree totals of nodes that lie in shards.

    ``nodes`` has ``shard``, ``root`` (the key of the node that tops the subtree), the
    node's own columns and ``words``, and in ``_TOTALS`` what children outside the shard
    have sent already.  A shard's nodes must be in one partition, the deepest first.
    """
    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, queue = None, None
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                if queue is None or row.shard != shard:
                    shard, queue = row.shard, SpillingQueue(entries)
                children, leaves, saved = row.n_children, row.n_leaves, row.saved_tokens
                to_me = (-row.depth, row.key)
                while (sent := queue.first()) is not None and sent[:2] == to_me:
                    queue.pop()
                    children, leaves, saved = children + 1, leaves + sent[2], saved + sent[3]
                leaves = leaves if children else 1
                saved += (row.n_convs - 1) * row.words
                is_root = row.key == row.root
                if not is_root:
                    queue.push((1 - row.depth, row.parent, leaves, saved))
                done.append((shard, is_root, row.key, row.parent, row.depth, row.conv_id,
                             row.n_convs, children, leaves, saved))
            if done:
                yield pd.DataFrame(done, columns=["shard", "is_root", *_NODE, *_TOTALS])

    in_order = nodes.sortWithinPartitions("shard", F.desc("depth"), "key")
    return in_order.mapInPandas(forward, _FORWARD)


def _sent(totals: DataFrame) -> DataFrame:
    """What the nodes of ``totals`` send to their parents, added up."""
    return totals.groupBy(F.col("parent").alias("key")).agg(
        F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"))


def _with_sent(nodes: DataFrame, sent: DataFrame) -> DataFrame:
    return nodes.join(sent, "key", "left").na.fill(0, _TOTALS)


def trie(conversations: DataFrame, least_shard_rows: int = LEAST_SHARD_ROWS,
         queue_entries: int = QUEUE_ENTRIES) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256`` of every node."""
    spark = conversations.sparkSession
    path, path_at = common.stored(paths(conversations), "trie-paths")
    nodes, nodes_at = common.stored(
        path.groupBy("key").agg(
            F.min("parent").alias("parent"), F.min("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
            F.min("words").alias("words"), F.sum(F.col("left") + 1).alias("weight"),
            F.count(F.when(F.col("left") == 0, 1)).alias("n_ends")), "trie-nodes")
    rows = nodes.agg(F.sum("n_convs")).first()[0] or 0
    shards = SHARDS_PER_PARTITION * common.shuffle_partitions(spark)
    most = max(least_shard_rows, rows // shards)

    lone = nodes.where("n_convs = 1").select(
        *_NODE, (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"))
    many = _with_sent(nodes.where("n_convs > 1").drop("n_ends"), _sent(lone))
    # A level's weights add up to all rows at most, so a level has few heavy nodes.
    heavy, light = many.where(F.col("weight") > most), many.where(F.col("weight") <= most)

    # The first light node on a conversation's path tops the subtree of all behind it.
    tops = (
        path.join(nodes.where(F.col("weight") > most).select("key"), "key", "left_anti")
        .groupBy("conv_id").agg(F.min(F.struct("depth", "key"))["key"].alias("root"))
    )
    sharded = light.join(tops, "conv_id").withColumn(
        "shard", F.pmod(F.xxhash64("root"), F.lit(shards)))
    below, below_at = common.stored(
        _forwarded(sharded.repartition("shard"), queue_entries), "trie-shards")
    above = _with_sent(heavy.drop(*_TOTALS), _sent(
        below.where("is_root").select("parent", *_TOTALS[1:]).unionByName(lone.select("parent", *_TOTALS[1:]))))
    above = above.withColumns({"shard": F.lit(0).cast("bigint"), "root": F.lit(_ROOT)})
    totals, totals_at = common.stored(
        below.select(*_NODE, *_TOTALS).unionByName(lone)
        .unionByName(_forwarded(above.repartition(1), queue_entries).select(*_NODE, *_TOTALS)), "trie-totals")
    ends, _ = common.stored(_ends(path), "trie-ends")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found, _ = common.stored(
        totals.join(parents, "parent", "left").join(ends, "key", "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", *_TOTALS,
            F.coalesce("ends_sha256", F.lit(_NONE_SHA256)).alias("ends_sha256")), "trie")
    common.discard(spark, path_at, nodes_at, below_at, totals_at)
    return found
