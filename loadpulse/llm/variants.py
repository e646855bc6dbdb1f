"""Spelling variants: words one letter apart, found through Bloom filters.

Words are counted over all texts.  Every word then generates the words one edit away, as
64-bit hashes only: each deletion, and each replacement by a later letter of the
alphabet that occurs.  A pair of words is so met once, from its longer word or from the
one that sorts first; insertions are the other side of deletions.  The hash is a
polynomial in the letters, so an edit's hash takes a few operations whatever the word's
length, and no edited word is built before a filter says it may exist.

The vocabulary's filters are sharded by word length and blocked: a hash has one block of
64 bytes.  A round broadcasts filters of at most ``ROUND_BYTES`` in all; a larger shard
is cut by block, and every round's words are read again, so what is broadcast never grows
with the vocabulary.  Only edits that pass are built and shuffled to the exact join with
the vocabulary, which removes the false ones.

Edge cases: null and empty texts have no words; a null id counts as empty text in the
hash that damages runs; repeated rows count again; lengths of ``LAST_SHARD`` and more
share a shard; other columns are not read; an empty vocabulary gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MINIMUM_CHARS, MINIMUM_COUNT = 7, 2
DAMAGE_EVERY = 31
FORM_RATIO = 10
LAST_SHARD = 64
BLOCK_BYTES = 64
WORDS_PER_BLOCK = 32          # 16 bits a word
LEAST_BLOCKS = 64
PIECE_BLOCKS = 1 << 9         # blocks that are filled together: 32 KB, 16,384 words
ROUND_BYTES = 32 << 20
COUNTED_WORDS = 1 << 17       # words a task adds up before it passes them on
EDITS_AT_ONCE = 1 << 20

_RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % MINIMUM_CHARS)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ONE, _SIX, _LOW = np.uint64(1), np.uint64(63), np.uint64(0xFFFFFFFF)


# --- words ----------------------------------------------------------------------

def _damaged(word: str, hashed: int) -> str:
    at = hashed % len(word)
    return word[:at] + word[at + 1:]


def vocabulary(docs: DataFrame, least: int = MINIMUM_COUNT) -> DataFrame:
    """``word, n``: the words of whole texts that occur ``least`` times or more.

    Runs are counted in the task that reads them before they are shuffled.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = {}

        def counted() -> pd.DataFrame:
            found = pd.DataFrame({"word": [w.decode() for w in seen], "n": list(seen.values())})
            seen.clear()
            return found

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                start = zlib.crc32(f"{doc_id}:".encode())
                for run in _RUN.findall(text):
                    word = run.encode().lower()  # bytes: A-Z only
                    hashed = zlib.crc32(word, start)
                    if hashed % DAMAGE_EVERY == 0:
                        word = _damaged(word.decode(), hashed)
                        if len(word) < MINIMUM_CHARS:
                            continue
                        word = word.encode()
                    seen[word] = seen.get(word, 0) + 1
                if len(seen) >= COUNTED_WORDS:
                    yield counted()
        if seen:
            yield counted()

    texts = docs.where("text is not null").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return (
        texts.mapInPandas(count, "word string, n bigint")
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    )


# --- hashes and filters -----------------------------------------------------------

def _powers(length: int) -> np.ndarray:
    """``_BASE`` to the power of ``length - 1`` down to 0."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[_ONE, np.full(length - 1, _BASE)], dtype=np.uint64)[::-1].copy()


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as a table of code points."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    return flat.reshape(len(words), -1).astype(np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def _by_length(words: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    """The places of the words of each length."""
    lengths = words.str.len().to_numpy()
    for length in np.unique(lengths):
        yield int(length), np.flatnonzero(lengths == length)


def word_hashes(words: pd.Series) -> np.ndarray:
    found = np.zeros(len(words), dtype=np.uint64)
    texts = words.to_numpy()
    for length, places in _by_length(words):
        step = max(1, EDITS_AT_ONCE // length)
        for i in range(0, len(places), step):
            some = places[i:i + step]
            with np.errstate(over="ignore"):
                found[some] = (_codes(list(texts[some])) * _powers(length)).sum(axis=1, dtype=np.uint64)
    return found


def _block(mixed: np.ndarray, blocks: int) -> np.ndarray:
    return ((mixed >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def _bits(mixed: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """One of a block's eight words, and three or four bits in it."""
    if turn:
        mixed = _mixed(mixed + _BASE)
    lane = mixed & np.uint64(7)
    mask = np.zeros_like(mixed)
    for shift in (3, 9, 15, 21)[:3 + turn]:
        mask |= _ONE << ((mixed >> np.uint64(shift)) & _SIX)
    return lane, mask


class Filters:
    """The filters of one round: for a shard, its blocks in all and those held here."""

    def __init__(self, sizes: dict[int, int]):
        self._sizes, self._held = sizes, {}

    def hold(self, shard: int, first: int, blocks: np.ndarray) -> None:
        self._held.setdefault(shard, []).append((first, blocks))

    @property
    def shards(self) -> list[int]:
        return sorted(self._held)

    def joined(self) -> Filters:
        """Adjoining pieces as one."""
        for shard, pieces in self._held.items():
            pieces.sort(key=lambda p: p[0])
            self._held[shard] = [(pieces[0][0], np.concatenate([blocks for _, blocks in pieces]))]
        return self

    def may_hold(self, shard: int, hashes: np.ndarray) -> np.ndarray:
        """The places of the hashes that may be words of the shard in this round."""
        if shard not in self._held:
            return np.zeros(0, dtype=np.int64)
        (first, blocks), = self._held[shard]
        mixed = _mixed(hashes)
        at = _block(mixed, self._sizes[shard]).astype(np.int64) * 8
        at -= first * 8
        here = None
        if first or len(blocks) < self._sizes[shard] * 8:
            here = np.flatnonzero((at >= 0) & (at < len(blocks)))
            mixed, at = mixed[here], at[here]
        lane, mask = _bits(mixed, 0)
        places = np.flatnonzero(blocks[at + lane.astype(np.int64)] & mask == mask)
        lane, mask = _bits(mixed[places], 1)
        places = places[blocks[at[places] + lane.astype(np.int64)] & mask == mask]
        return places if here is None else here[places]


def _shard(length: Column) -> Column:
    return F.least(length, F.lit(LAST_SHARD))


def _blocks_of(count: int) -> int:
    return max(LEAST_BLOCKS, -(-count // WORDS_PER_BLOCK))


def filter_pieces(words: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """``shard, piece, blocks``: the filters' bytes, in pieces that single tasks fill.

    ``words`` has ``word`` and ``shard``.  A piece gets a known share of its shard's
    hashes, so no task holds more than a piece and its hashes.
    """
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            mixed = _mixed(word_hashes(batch["word"]))
            blocks = np.array([sizes[s] for s in batch["shard"]], dtype=np.uint64)
            piece = ((mixed >> np.uint64(32)) * blocks >> np.uint64(32)) // np.uint64(PIECE_BLOCKS)
            yield pd.DataFrame({"shard": batch["shard"], "piece": piece.astype(np.int32),
                                "mixed": mixed.view(np.int64)})

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard, piece = int(key[0]), int(key[1])
        first = piece * PIECE_BLOCKS
        bits = np.zeros(min(PIECE_BLOCKS, sizes[shard] - first) * 8, dtype=np.uint64)
        mixed = rows["mixed"].to_numpy().view(np.uint64)
        at = (_block(mixed, sizes[shard]).astype(np.int64) - first) * 8
        for turn in (0, 1):
            lane, mask = _bits(mixed, turn)
            np.bitwise_or.at(bits, at + lane.astype(np.int64), mask)
        return pd.DataFrame({"shard": [shard], "piece": [piece], "blocks": [bits.tobytes()]})

    placed = words.select("word", "shard").mapInPandas(place, "shard int, piece int, mixed bigint")
    return placed.groupBy("shard", "piece").applyInPandas(
        fill, "shard int, piece int, blocks binary")


def rounds(sizes: dict[int, int], limit: int = ROUND_BYTES) -> list[list[tuple[int, int]]]:
    """The (shard, piece) pairs of each round, in order; a round's bytes stay within
    ``limit`` (one piece at least), so the number of rounds grows with the vocabulary
    and what a round broadcasts does not."""
    made, room = [[]], limit
    for shard in sorted(sizes):
        for piece in range(-(-sizes[shard] // PIECE_BLOCKS)):
            size = min(PIECE_BLOCKS, sizes[shard] - piece * PIECE_BLOCKS) * BLOCK_BYTES
            if size > room and made[-1]:
                made.append([])
                room = limit
            made[-1].append((shard, piece))
            room -= size
    return made


# --- edits ------------------------------------------------------------------------

def edits(words: list[str], letters: np.ndarray, filters: Filters) -> Iterator[tuple[int, str]]:
    """Place and edited word for every edit of ``words`` (all of one length) that the
    filters may hold.  ``letters`` are the code points in use, in ascending order."""
    length = len(words[0])
    shorter, same = min(length - 1, LAST_SHARD), min(length, LAST_SHARD)
    # Power, prefix and suffix sums take a few numbers a letter, replacements one for
    # each letter of the alphabet: tables are cut by words, and by letters of long words.
    step = max(1, EDITS_AT_ONCE // (length * len(letters)))
    span = max(1, EDITS_AT_ONCE // len(letters))
    powers = _powers(length)
    for i in range(0, len(words), step):
        some = words[i:i + step]
        codes = _codes(some)
        with np.errstate(over="ignore"):
            terms = codes * powers
            hashes = terms.sum(axis=1, dtype=np.uint64)
            if shorter in filters.shards and length > 1:
                after = hashes[:, None] - np.cumsum(terms, axis=1, dtype=np.uint64)
                moved = np.zeros_like(codes)
                moved[:, 1:] = np.cumsum(codes[:, :-1] * powers[1:], axis=1, dtype=np.uint64)
                # Of equal letters in a row the last one stands for all.
                row, at = np.nonzero(np.c_[codes[:, 1:] != codes[:, :-1], np.ones(len(some), bool)])
                for hit in filters.may_hold(shorter, (moved + after)[row, at]):
                    word, place = some[row[hit]], at[hit]
                    yield i + int(row[hit]), word[:place] + word[place + 1:]
            if same in filters.shards:
                for first in range(0, length, span):
                    part = codes[:, first:first + span]
                    row, at, letter = np.nonzero(letters[None, None, :] > part[:, :, None])
                    change = (letters[letter] - part[row, at]) * powers[first + at]
                    for hit in filters.may_hold(same, hashes[row] + change):
                        word, place = some[row[hit]], first + at[hit]
                        yield i + int(row[hit]), word[:place] + chr(int(letters[letter[hit]])) + word[place + 1:]


def near_pairs(words: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of words one inserted, deleted or replaced code
    point apart, once.  ``words`` is a stored table of distinct ``word, n``."""
    spark = words.sparkSession
    # One row a shard, of which there are at most LAST_SHARD + 1.
    counts = words.groupBy(_shard(F.length("word")).cast("int").alias("shard")).count().collect()
    sizes = {r["shard"]: _blocks_of(r["count"]) for r in counts}
    # The letters in use: at most as many as the word pattern allows.
    used = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()
    letters = np.array(sorted(ord(r["c"]) for r in used if r["c"]), dtype=np.uint64)
    sharded = words.withColumn("shard", _shard(F.length("word")).cast("int"))
    pieces, _ = common.stored(filter_pieces(sharded, sizes), "filters")
    found = spark.createDataFrame([], "a string, n_a bigint, edit string")
    for held in rounds(sizes, round_bytes):
        shards = sorted({shard for shard, _ in held})
        filters = Filters(sizes)
        within = F.lit(False)
        for shard in shards:
            of_shard = [piece for s, piece in held if s == shard]
            within |= (F.col("shard") == shard) & F.col("piece").between(of_shard[0], of_shard[-1])
        # At most round_bytes.
        for r in pieces.where(within).collect() if shards else []:
            filters.hold(r["shard"], r["piece"] * PIECE_BLOCKS,
                         np.frombuffer(r["blocks"], dtype=np.uint64))
        sent = spark.sparkContext.broadcast(filters.joined())

        def probe(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            filters = sent.value
            for batch in batches:
                texts, n = batch["word"].to_numpy(), batch["n"].to_numpy()
                for _, places in _by_length(batch["word"]):
                    a, edited = [], []
                    for place, edit in edits(list(texts[places]), letters, filters):
                        a.append(places[place])
                        edited.append(edit)
                        if len(a) >= 1 << 16:
                            yield pd.DataFrame({"a": texts[a], "n_a": n[a], "edit": edited})
                            a, edited = [], []
                    if a:
                        yield pd.DataFrame({"a": texts[a], "n_a": n[a], "edit": edited})

        # Words of these lengths, and those a letter longer, have edits in these shards.
        needed = sorted({s + d for s in shards for d in (0, 1) if s + d <= LAST_SHARD})
        asking = sharded.where(F.col("shard").isin(needed)).select("word", "n")
        found = found.unionByName(asking.mapInPandas(probe, "a string, n_a bigint, edit string"))
    exact = words.select(F.col("word").alias("edit"), F.col("n").alias("n_b"))
    return found.join(exact, "edit").select("a", "n_a", F.col("edit").alias("b"), "n_b")


# --- forms ------------------------------------------------------------------------

def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for words with a form: forms are followed to the last.

    A form is ``FORM_RATIO`` times as frequent, so chains are short and cannot close; a
    round doubles the way that is followed, and four rounds reach 16 forms: more than
    any count of 64 bits allows with a ratio of 10.
    """
    ways = forms.select("word", F.col("form").alias("root"))
    longest, rounds_needed = 2 ** 63, 0
    while FORM_RATIO ** (2 ** rounds_needed) < longest:
        rounds_needed += 1
    for _ in range(rounds_needed):
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead, _ = common.stored(
            ways.join(onward, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"),
                F.col("further").isNotNull().alias("moved")), "roots")
        ways = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            break
    return ways


def grouped(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    both = pairs.select(F.col("a").alias("word"), "n_a", F.col("b").alias("near"), "n_b").unionByName(
        pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n_a"), F.col("a").alias("near"),
                     F.col("n_a").alias("n_b")))
    best = F.min(F.struct((-F.col("n_b")).alias("least"), F.col("near").alias("form")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    frequent = -F.col("best.least") >= FORM_RATIO * F.col("n")
    formed, _ = common.stored(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(frequent, F.col("best.form")).alias("form"),
            F.when(frequent, -F.col("best.least")).alias("form_n")), "forms")
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """Every word of ``docs`` with the form it is a variant of."""
    words, _ = common.stored(vocabulary(docs), "vocabulary")
    pairs, _ = common.stored(near_pairs(words, round_bytes), "pairs")
    return grouped(words, pairs)
