"""Fuzzy line deduplication by MinHash.

Equal lines (in lower case, white space as one blank) are one node from the start.
Every line gets a signature of minima over its character shingles, cut into bands; lines
that share a band are candidates.  Lines are signed where they are read, and only the
bands' keys move, dealt into buckets as arrays of a key and a line's number.  Lines that
share no band and come once have no part in anything; the others are read again, found
by a Bloom filter that costs time when it is too full but no line.

Bands with the same members are looked
at once.  First every member of a band is compared with the band's smallest line, the
pairs of all bands made distinct before any text is joined to them.  Bands whose lines
are connected by that are done.  In the others lines of different components are
compared, the lines of the largest component only with the rest; large bands are dealt
into blocks, so no task holds a whole one, and only lines with a possible partner bring
their text.  A sketch of 512 bits says who has none: it never rules out a similar pair.
Jaccard similarities are exact, on the shingles themselves.  Connected components then
keep one line each, the first by document and place.

A changed inner letter breaks ``SHINGLE_CHARS`` shingles, so with four characters lines
of 39 and more stay similar, and long lines of different words do not become so.

With 36 bands of eight out of 144 rows a pair at similarity 0.8 is a candidate with
probability 0.996, and at 0.9 with more than 0.9999; at every similarity from 0.8 on that
is more than ten bands of four rows find.  Bands of four rows are also shared by lines that only have
common letters (at 0.2 with probability 0.016, of eight rows 0.00007), and the number of
such pairs grows with the square of the lines.

Edge cases: blank lines are left alone; a null text has no lines; a line shorter than
a shingle is one shingle; equal rows (id and text) count as one document and are all
kept; null ids come last in order; an empty table gives no rows; other columns are
kept by ``deduplicated`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE_CHARS = 4
BANDS, ROWS = 36, 8  # every minimum is in two bands
MIN_SIMILARITY = 0.8
BLOCK_LINES = 512
SKETCH_WORDS = 8  # a power of two
SKETCH = [f"sketch_{i}" for i in range(SKETCH_WORDS)]
SLICE_CHARS = 32_768  # shingles that are hashed at a time, to stay in the cache
DEALT_LINES = 50_000  # lines whose keys are dealt out at a time
BUCKETS = 8  # for each shuffle partition
BITS_A_LINE, MOST_BITS = 16, 1 << 28  # of the Bloom filter, 32 MB at most
MINIMA = BANDS * ROWS // 2

_FACTORS = (np.random.default_rng(3).integers(1, 1 << 31, MINIMA, dtype=np.uint32) * 2 + 1).astype(np.uint32)
# The minima of each band: two bands have one in common at most.
_IN_BAND = np.array([[j * (BANDS // 2) + (band + turn * j) % (BANDS // 2) for j in range(ROWS)]
                     for turn in (0, 1) for band in range(BANDS // 2)])
_PRIME = np.uint32(0x01000193)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ENTRY = np.dtype([("key", "<u4"), ("line", "<i8")])


# --- signatures -----------------------------------------------------------------

def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all lines, and where each line's begin."""
    filled = [line if len(line) >= SHINGLE_CHARS else line.ljust(SHINGLE_CHARS, "\0") for line in lines]
    letters = np.frombuffer("".join(filled).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.fromiter(map(len, filled), dtype=np.int64, count=len(filled))
    total = np.zeros(len(letters) - SHINGLE_CHARS + 1, dtype=np.uint32)
    for i in range(SHINGLE_CHARS):
        total = (total ^ letters[i:i + len(total)]) * _PRIME
    total ^= total >> np.uint32(15)
    own = sizes - SHINGLE_CHARS + 1
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(len(total), dtype=bool)  # but windows that reach into the next line
    keep[(starts[1:, None] - np.arange(1, SHINGLE_CHARS)).ravel()] = False
    return total[keep], np.cumsum(own) - own


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``MINIMA x len(starts)``: least values of lines with these shingles."""
    least, own = np.empty((MINIMA, len(starts)), dtype=np.uint32), np.empty_like(hashes)
    for j in range(MINIMA):
        np.multiply(hashes, _FACTORS[j], out=own)
        np.minimum.reduceat(own, starts, out=least[j])
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """``lines x BANDS`` keys of lines with these minima."""
    keys = np.zeros((BANDS, least.shape[1]), dtype=np.uint64)
    number = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None]
    for j in range(ROWS):
        keys = (keys ^ least[_IN_BAND[:, j]]) * _MIX + number
        keys ^= keys >> np.uint64(29)
    return keys.T


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorting is faster here than a table of them."""
    ordered = np.sort(values)
    return ordered[np.r_[True, ordered[1:] != ordered[:-1]]]


def sketches(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of distinct shingles, and ``len(starts) x SKETCH_WORDS`` words of bits.

    Every distinct shingle turns one bit over, so two sketches differ in at most as many
    bits as there are shingles in one line only.
    """
    n, bits = len(starts), 64 * SKETCH_WORDS
    line = np.repeat(np.arange(n, dtype=np.uint64), np.diff(np.r_[starts, len(hashes)]))
    own = distinct(line << np.uint64(32) | hashes)
    line = (own >> np.uint64(32)).astype(np.int64)
    # The product's top bits, as many as number a sketch's bits.
    bit = ((own & np.uint64(0xFFFFFFFF)) * _MIX >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    turned = np.bincount(line * bits + bit, minlength=n * bits).astype(np.uint8).reshape(n, bits) & 1
    return np.bincount(line, minlength=n), np.packbits(turned, axis=1).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def similarities(hashes: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarities of the lines ``a`` with the lines ``b``, by their places."""
    line = np.repeat(np.arange(len(starts), dtype=np.uint64), np.diff(np.r_[starts, len(hashes)]))
    own = distinct(line << np.uint64(32) | hashes)
    size = np.bincount((own >> np.uint64(32)).astype(np.int64), minlength=len(starts))
    first = np.cumsum(size) - size

    def elements(side: np.ndarray) -> np.ndarray:
        ends = np.cumsum(size[side])
        place = np.repeat(first[side] - ends + size[side], size[side]) + np.arange(ends[-1])
        pair = np.repeat(np.arange(len(side), dtype=np.uint64), size[side])
        return pair << np.uint64(32) | own[place] & np.uint64(0xFFFFFFFF)

    every = np.sort(np.r_[elements(a), elements(b)])
    twice = every[1:][every[1:] == every[:-1]] >> np.uint64(32)
    both = np.bincount(twice.astype(np.int64), minlength=len(a))
    return both / (size[a] + size[b] - both)


# --- links ----------------------------------------------------------------------

def normalised(line: Column) -> Column:
    """The line in lower case, white space as one blank and none at its ends."""
    odd = line.contains("  ")
    for blank in "\t\x0B\f\r":
        odd |= line.contains(blank)
    lower = F.lower(line)
    return F.btrim(F.when(odd, F.regexp_replace(lower, r"\s+", " ")).otherwise(lower))


def occurrences(docs: DataFrame) -> DataFrame:
    """``line_id, doc_id, text_hash, place, line`` of every line that is not blank."""
    # Texts are hashed before they are cut, else that is done once a line; and lines are
    # normalised before they are rows, else that is done again for every filter on them.
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).select(
        "doc_id", "text_hash",
        F.posexplode(F.transform(F.split("text", "\n"), normalised)).alias("place", "line"),
    ).where("line <> ''").withColumn("line_id", F.xxhash64("line"))


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "place")


def _cut(sizes: Iterable[int]) -> list[tuple[int, int]]:
    """Ranges of what follows each other, as much as is hashed at a time."""
    ends = np.cumsum(np.fromiter(sizes, dtype=np.int64)) // SLICE_CHARS
    cuts = [0, *(1 + np.flatnonzero(ends[1:] != ends[:-1])), len(ends)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def _mixed(ids: np.ndarray) -> np.ndarray:
    mixed = ids.view(np.uint64) * _MIX
    return (mixed ^ mixed >> np.uint64(32)) * _MIX


def _blobs(bucket: np.ndarray, values: np.ndarray, buckets: int) -> pa.Array:
    """The values of each bucket as the bytes of an array."""
    order = np.argsort(bucket, kind="stable")
    ends = np.r_[0, np.cumsum(np.bincount(bucket, minlength=buckets))] * values.itemsize
    return pa.Array.from_buffers(pa.binary(), buckets, [
        None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values[order])])


def _dealt_keys(lines: DataFrame, buckets: int) -> DataFrame:
    """``bucket, entries, lines``: keys of bands with their lines, and lines (twice if they
    come more often), of some thousand lines a row."""
    def deal(ids: np.ndarray, times: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        entries = np.empty(keys.size, dtype=_ENTRY)
        entries["key"], entries["line"] = keys.ravel(), np.repeat(ids, BANDS)
        twice = np.repeat(ids, np.minimum(times, 2))

        def bucket(hashed: np.ndarray) -> np.ndarray:
            small = np.uint16 if buckets < 1 << 16 else np.int64  # short numbers sort faster
            return ((hashed >> np.uint64(32)) % np.uint64(buckets)).astype(small)

        of_keys, of_lines = bucket(keys.ravel()), bucket(_mixed(twice))
        dealt = pa.RecordBatch.from_arrays(
            [pa.array(np.arange(buckets, dtype=np.int32)), _blobs(of_keys, entries, buckets),
             _blobs(of_lines, twice, buckets)], ["bucket", "entries", "lines"])
        return dealt.take(pa.array(np.unique(np.r_[of_keys, of_lines])))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def whole() -> pa.RecordBatch:
            ids, times, keys = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            ids, first, place = np.unique(ids, return_index=True, return_inverse=True)
            return deal(ids, np.bincount(place, weights=times).astype(np.int64), keys[first])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, first, times = np.unique(
                batch["line_id"].to_numpy(), return_index=True, return_counts=True)
            texts = batch["line"].take(pa.array(first)).to_pylist()
            held.append((ids, times, band_keys(np.concatenate(
                [minima(*shingle_hashes(texts[a:b])) for a, b in _cut(map(len, texts))], axis=1))))
            if sum(len(h[0]) for h in held) >= DEALT_LINES:
                yield whole()
        if held:
            yield whole()

    return lines.select("line_id", "line").mapInArrow(sign, "bucket int, entries binary, lines binary")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``band, line_id, first, n, mark`` of bands with several lines, and lines that come
    more than once with a null for the band; rows of a bucket follow each other.

    ``first`` is the smallest of a band's ``n`` lines, ``mark`` a digest of them all.
    """
    names = ["bucket", "entries", "lines"]
    rows = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in names), strict=True))
    for bucket, group in groupby(rows, key=itemgetter(0)):
        entries, ids = (b"".join(parts) for parts in list(zip(*group, strict=True))[1:])
        ids, times = np.unique(np.frombuffer(ids, dtype=np.int64), return_counts=True)
        again = ids[times > 1]
        entries = np.frombuffer(entries, dtype=_ENTRY)
        order = np.argsort(entries["key"])
        keys = entries["key"][order]
        same = keys[1:] == keys[:-1]
        met = entries[order[np.r_[False, same] | np.r_[same, False]]] if len(order) else entries
        met = met[np.lexsort((met["line"], met["key"]))]
        key, line = met["key"], met["line"]
        new = np.ones(len(met), dtype=bool)  # the same line may come from several tasks
        new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        key, line = key[new], line[new]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
        n = np.diff(np.r_[starts, len(key)])
        mark = np.bitwise_xor.reduceat(_mixed(line), starts) if len(key) else np.zeros(0, dtype=np.uint64)
        several = np.repeat(n, n) > 1
        band, first, mark, n = (np.repeat(x, n)[several] for x in (
            key[starts].astype(np.int64) | bucket << 32, line[starts], mark.view(np.int64), n))
        gone = len(again)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[band, np.zeros(gone, dtype=np.int64)], mask=np.arange(len(band) + gone) >= len(band)),
             pa.array(np.r_[line[several], again]), pa.array(np.r_[first, again]),
             pa.array(np.r_[n, np.ones(gone, dtype=np.int64)].astype(np.int32)),
             pa.array(np.r_[mark, again])], ["band", "line_id", "first", "n", "mark"])


def shared_bands(lines: DataFrame) -> DataFrame:
    """``band, line_id, first, n, mark``: lines of bands with several, and lines that come
    more than once with a null for the band."""
    dealt = _dealt_keys(lines, BUCKETS * common.shuffle_partitions(lines.sparkSession))
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _met, "band bigint, line_id bigint, first bigint, n int, mark bigint")


def _members(shared: DataFrame) -> DataFrame:
    """``band, line_id, first``: lines of bands with three or more, bands with the same
    lines once."""
    bands = shared.where("band is not null and n > 2")
    chosen = bands.where("line_id = first").groupBy("n", "mark").agg(F.min("band").alias("band"))
    return bands.select("band", "line_id", "first").join(chosen.select("band"), "band")


def _among(rows: DataFrame, lines: DataFrame) -> tuple[DataFrame, Broadcast]:
    """The rows whose line may be one of ``lines``, and the filter that says so.

    It lets all rows of these lines through, and one in a hundred of the others or so;
    more if the filter would have to be larger than ``MOST_BITS``.
    """
    lines, lines_at = common.stored(lines.select("line_id").distinct(), "wanted")
    bits = min(MOST_BITS, 1 << max(16, (BITS_A_LINE * lines.count()).bit_length()))
    # The lines' numbers are hashes: their halves are two hashes.
    places = [F.col("line_id").bitwiseAND(bits - 1),
              F.shiftrightunsigned("line_id", 32).bitwiseAND(bits - 1)]
    turned = lines.select(F.explode(F.array(*[at + 1 for at in places])).alias("at")).groupBy(
        F.bitmap_bucket_number("at").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    filled = bytearray(bits // 8)
    for part, bitmap in turned.collect():
        filled[(part - 1) * len(bitmap):part * len(bitmap)] = bitmap
    common.discard(rows.sparkSession, lines_at)
    sent = rows.sparkSession.sparkContext.broadcast(bytes(filled))

    @F.pandas_udf("boolean")
    def may_be(line_id: pd.Series) -> pd.Series:
        at, held = line_id.to_numpy().view(np.uint64), np.frombuffer(sent.value, dtype=np.uint8)
        one, other = at & np.uint64(bits - 1), at >> np.uint64(32) & np.uint64(bits - 1)
        return pd.Series(held[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8)
                         & held[other >> np.uint64(3)] >> (other & np.uint64(7)).astype(np.uint8) & 1 > 0)

    return rows.where(may_be("line_id")), sent


def _sketched(lines: DataFrame) -> DataFrame:
    """``line_id, size`` and the sketch's words of every line."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["line"].to_pylist()
            for a, b in _cut(map(len, texts)):
                part = batch.slice(a, b - a)
                size, words = sketches(*shingle_hashes(texts[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [part["line_id"], pa.array(size.astype(np.int32)), *[pa.array(w) for w in words.T.copy()]],
                    ["line_id", "size", *SKETCH])

    words = ", ".join(f"{c} bigint" for c in SKETCH)
    return lines.select("line_id", "line").mapInArrow(sketch, f"line_id bigint, size int, {words}")


def _may_be_similar(size_a: Column, size_b: Column, words_a: list[Column], words_b: list[Column]) -> Column:
    """False only for lines whose sizes or sketches rule the similarity out."""
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(words_a, words_b, strict=True)), F.lit(0))
    return ((F.least(size_a, size_b) >= MIN_SIMILARITY * F.greatest(size_a, size_b))
            & (apart * (1 + MIN_SIMILARITY) <= (1 - MIN_SIMILARITY) * (size_a + size_b) + 1e-6))


def _to_check(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that sizes and sketches do not rule out."""
    sides = [sketched.select(*[F.col(c).alias(f"{side}_{c}") for c in sketched.columns])
             for side in "ab"]
    joined = pairs.join(sides[0], F.col("a") == F.col("a_line_id")).join(
        sides[1], F.col("b") == F.col("b_line_id"))
    words = [[F.col(f"{side}_{c}") for c in SKETCH] for side in "ab"]
    return joined.where(_may_be_similar(F.col("a_size"), F.col("b_size"), *words)).select("a", "b")


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs whose lines are similar."""
    for batch in batches:
        for start, end in _cut(batch["line_a"].map(len) + batch["line_b"].map(len)):
            part = batch.iloc[start:end]
            place, texts = pd.factorize(pd.concat([part["line_a"], part["line_b"]], ignore_index=True))
            found = similarities(*shingle_hashes(list(texts)), place[:len(part)], place[len(part):])
            yield part.loc[found >= MIN_SIMILARITY, ["a", "b"]]


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    texts = [lines.select(F.col("line_id").alias(side), F.col("line").alias(f"line_{side}"))
             for side in "ab"]
    return pairs.join(texts[0], "a").join(texts[1], "b").mapInPandas(_checked, "a bigint, b bigint")


_GROUP = ["band", "low", "high"]


def _dealt(members: DataFrame, named: DataFrame) -> DataFrame:
    """``line_id, component, side`` of the groups ``band, low, high`` to compare.

    Bands' smallest lines have met all others already.  Bands whose other lines are
    connected already are left out.  In the rest the lines of the
    largest component are not compared with each other: they are dealt into blocks that
    meet the blocks of the band's other lines, and these meet each other too.
    """
    labelled, _ = common.stored(
        members.where("line_id <> first").join(named.withColumnRenamed("node", "line_id"), "line_id", "left")
        .select("band", "line_id", F.coalesce("component", "line_id").alias("component")), "labelled")
    parts = labelled.groupBy("band", "component").agg(F.count("*").alias("n"))
    largest = F.max(F.struct("n", "component"))
    open_bands, _ = common.stored(
        parts.groupBy("band").agg(largest.alias("major"), F.sum("n").alias("n"), F.count("*").alias("parts"))
        .where("parts > 1")
        .select("band", F.col("major.component").alias("major"),
                F.ceil((F.col("n") - F.col("major.n")) / BLOCK_LINES).cast("int").alias("minors"),
                F.ceil(F.col("major.n") / BLOCK_LINES).cast("int").alias("majors")), "open-bands")
    is_major = F.col("component") == F.col("major")
    own = F.pmod(F.xxhash64("line_id"), F.when(is_major, F.col("majors")).otherwise(F.col("minors")))

    def group(low: Column, high: Column, side: Column) -> Column:
        return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"),
                        side.cast("int").alias("side"))

    minors, majors = F.sequence(F.lit(0), F.col("minors") - 1), F.sequence(F.lit(1), F.col("majors"))
    # Blocks of the largest component have negative numbers.
    groups = F.when(is_major, F.transform(minors, lambda o: group(-F.col("own") - 1, o, F.lit(0)))).otherwise(
        F.concat(F.transform(minors, lambda o: group(
            F.least("own", o.cast("int")), F.greatest("own", o.cast("int")), F.col("own") <= o)),
            F.transform(majors, lambda j: group(-j, F.col("own"), F.lit(1)))))
    return labelled.join(open_bands, "band").withColumn("own", own.cast("int")).select(
        "band", "line_id", "component", F.inline(groups))


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows that follow each other, cut where no group is torn, and the groups' starts."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        keys = rows[_GROUP].to_numpy()
        cuts = np.r_[0, 1 + np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))]
        yield rows.iloc[:cuts[-1]], cuts[:-1]
        rest = rows.iloc[cuts[-1]:].reset_index(drop=True)  # its group may go on
    if rest is not None and len(rest):
        yield rest, np.zeros(1, dtype=np.int64)


def _promising(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with a partner in their group that sizes and sketches do not rule out."""
    for rows, starts in _whole_groups(batches):
        words = rows[SKETCH].to_numpy().view(np.uint64)
        size, side, component = (rows[c].to_numpy() for c in ("size", "side", "component"))
        use = np.zeros(len(rows), dtype=bool)
        for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
            apart = sum(np.bitwise_count(words[a:b, None, k] ^ words[None, a:b, k]).astype(np.int64)
                        for k in range(SKETCH_WORDS))
            both = size[a:b, None] + size[None, a:b]
            least = np.minimum(size[a:b, None], size[None, a:b])
            near = ((apart * (1 + MIN_SIMILARITY) <= (1 - MIN_SIMILARITY) * both + 1e-6)
                    & (least >= MIN_SIMILARITY * (both - least))
                    & (component[a:b, None] != component[None, a:b]))
            if side[a:b].min() != side[a:b].max():
                near &= side[a:b, None] != side[None, a:b]
            use[a:b] = near.any(axis=1)
        yield rows.loc[use, [*_GROUP, "line_id", "component", "side"]]


def _group_links(ids: np.ndarray, side: np.ndarray, component: np.ndarray,
                 sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect the similar lines of a group beyond their components."""
    first = {c: i for i, c in reversed(list(enumerate(component)))}
    root = [first[c] for c in component]

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out, across = [], side.min() != side.max()
    for i in range(1, len(ids)):
        for j in range(i):
            if across and side[i] == side[j]:
                continue
            shorter, longer = sorted((len(sets[i]), len(sets[j])))
            if shorter < MIN_SIMILARITY * longer or top(i) == top(j):
                continue
            if similarity(sets[i], sets[j]) >= MIN_SIMILARITY:
                root[top(i)] = top(j)
                out.append((ids[i], ids[j]))
    return out


def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within groups of rows that follow each other; many small groups at a time."""
    for rows, starts in _whole_groups(batches):
        out: list[tuple[int, int]] = []
        if len(rows):
            ids, side, component = (rows[c].to_numpy() for c in ("line_id", "side", "component"))
            hashes, firsts = shingle_hashes(rows["line"].tolist())
            sets = [distinct(h) for h in np.split(hashes, firsts[1:])]
            for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
                out += _group_links(ids[a:b], side[a:b], component[a:b], sets[a:b])
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _joined(named: DataFrame, across: DataFrame) -> DataFrame:
    """``node, component`` of these components and more links ``a, b``."""
    for side in "ab":
        root = named.select(F.col("node").alias(side), F.col("component").alias("root"))
        across = across.join(root, side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    further = components(across)
    every = named.unionByName(further.select("node", F.col("node").alias("component"))).distinct()
    up = further.select(F.col("node").alias("component"), F.col("component").alias("root"))
    return every.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component"))


def groups(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """``node, component`` of distinct lines, connected if they are similar and share a band."""
    spark = lines.sparkSession
    members, members_at = common.stored(_members(shared), "members")
    sketched, sketched_at = common.stored(_sketched(lines), "sketched")
    # Of a band of two lines there is nothing else to compare.
    pairs = shared.where("band is not null and n = 2").select("line_id", "first")
    stars = members.select("line_id", "first").unionByName(pairs).where("line_id <> first").select(
        F.col("first").alias("a"), F.col("line_id").alias("b")).distinct()
    near, near_at = common.stored(_to_check(stars, sketched), "near")
    met, sent = _among(lines, near.select(F.explode(F.array("a", "b")).alias("line_id")))
    star, _ = common.stored(_verified(near, met), "star-links")
    sent.destroy()
    named = components(star)
    dealt = _dealt(members, named).join(sketched, "line_id")
    doubtful, doubtful_at = common.stored(
        dealt.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInPandas(
            _promising, "band bigint, low int, high int, line_id bigint, component bigint, side int"),
        "doubtful")
    met, sent = _among(lines, doubtful)
    texts = doubtful.join(met.select("line_id", "line"), "line_id")
    across, _ = common.stored(
        texts.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInPandas(linked, "a bigint, b bigint"),
        "across-links")
    sent.destroy()
    common.discard(spark, sketched_at, members_at, near_at, doubtful_at)
    return _joined(named, across)


# --- decisions ------------------------------------------------------------------

def removed_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, removed``: places of the lines to remove, per document."""
    spark = docs.sparkSession
    shared, shared_at = common.stored(shared_bands(occurrences(docs)), "shared")
    rows, sent = _among(occurrences(docs), shared)
    found, found_at = common.stored(rows, "found")
    sent.destroy()
    lines, lines_at = common.stored(found.select("line_id", "line").distinct(), "lines")
    named = groups(lines, shared).withColumnRenamed("node", "line_id")
    common.discard(spark, shared_at, lines_at)
    placed, _ = common.stored(
        found.drop("line").join(named, "line_id", "left")
        .withColumn("root", F.coalesce("component", "line_id")).drop("line_id", "component"), "placed")
    common.discard(spark, found_at)
    kept, _ = common.stored(placed.groupBy("root").agg(F.min(_order()).alias("kept")), "kept-lines")
    return (
        placed.join(kept, "root").where(_order() != F.col("kept"))
        .select("doc_id", "text_hash", "place").distinct()
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_list("place")).alias("removed"))
    )


def _stored_places(docs: DataFrame, id_: str, hash_: str, name: str) -> DataFrame:
    """``removed_lines`` of documents as a table with these names."""
    with common.shuffles_removed(docs.sparkSession):
        removed, _ = common.stored(
            removed_lines(docs.select("doc_id", "text")).select(
                F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_),
                F.col("removed").alias(name)), "removed")
    return removed


def with_removed(docs: DataFrame, name: str) -> DataFrame:
    """Documents with the column ``name``: places of lines to remove, or null."""
    id_, hash_ = common.unused(docs, "id", name), common.unused(docs, "hash", name)
    removed = _stored_places(docs, id_, hash_, name)
    return docs.join(removed, docs["doc_id"].eqNullSafe(F.col(id_))
                     & (F.xxhash64(docs["text"]) == F.col(hash_)), "left").drop(id_, hash_)


def deduplicated(docs: DataFrame) -> DataFrame:
    """Documents without the removed lines, other columns untouched."""
    name = common.unused(docs, "removed")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col(name), i))
    return with_removed(docs, name).withColumn("text", F.when(
        F.col(name).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))).select(
        *[common.quoted(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed``: the removed lines' places, comma-joined."""
    removed = _stored_places(docs, "id", "hash", "places")
    # Lines are counted below the join, so that no text moves.
    counted = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("bigint").alias("n_lines"))
    found = counted.join(removed, F.col("doc_id").eqNullSafe(F.col("id"))
                         & (F.col("text_hash") == F.col("hash")), "left")
    return found.select(
        "doc_id", "n_lines",
        F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.array_join("places", ","), F.lit("")).alias("removed"))
