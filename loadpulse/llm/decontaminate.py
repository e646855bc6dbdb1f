"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into overlapping word windows of several lengths, weighted by TF-IDF
over hashed terms and projected onto the leading right singular vectors of a matrix of
passages: the benchmark's own and the corpus's.  A window is a candidate for an
item if their cosine reaches ``MIN_COSINE``.  The words around candidates are then
compared with the item: by the longest common subsequence, and by whether the item's
ending (its answer) occurs word for word.

* Term weights count all documents.  Their counts are combined per task.
* The basis is fitted by randomised subspace iteration on all passages of all documents
  plus a block of the benchmark: each task adds up ``A'A`` times random signs over its
  passages, the sums are shuffled by ranges of terms and added, and one task gets the
  total, whose size is fixed.  It has ``EXTRA_RANK`` dimensions more than the block has
  items, so the items' own terms are kept almost whole.
* An item of whose words a document has too few to match, by their terms, is not
  searched for in it: whatever the cosine, the comparison of words would fail.  Where many
  items are left, the same is asked of every stretch of as many words as are compared.
* The benchmark is a stated query set; it is searched in blocks of about
  ``BLOCK_ITEMS`` items, so what a task holds does not grow with it.  A task holds what
  each term adds to the cosine with each item, so a window costs the same at any rank.

Edge cases: null and empty texts and items match nothing; items of fewer than
``MIN_WORDS`` words are compared as a whole, word for word; an item that occurs twice in a document
is one match; an item without an id is searched like any other and matches under a null
id; equal rows have equal matches; empty documents or benchmarks give no matches; other
columns are kept by ``clean`` and not read otherwise.  A window of at most ``max(WINDOWS)``
words cannot reach the cosine with an item of more than about ``max(WINDOWS)`` over its
square (1,950) words: such items are to be cut by the caller.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TERMS = 1 << 15
EXTRA_RANK = 64
PASSAGE = 40
# Passages that are multiplied at once, the terms that are multiplied as a dense matrix, the
# rows that are added at once, and terms in a row of stored products.
PASSAGES_AT_ONCE = 1024
FREQUENT = 256
ROWS_AT_ONCE = 256
SLAB = 128
# In how many parts the products of terms and items go to the driver.
PRODUCT_PARTS = 16
# The passages that a block of items counts for at least.
LEAST_WEIGHT = 30_000
BLOCK_ITEMS = 250
# Window lengths and the words from one to the next, in multiples of the grain.
GRAIN = 4
WINDOWS = {20: 4, 44: 8}
MIN_COSINE = 0.15
MIN_COMMON = 0.7
MIN_COMMON_WITH_ANSWER = 0.5
ANSWER_SHARE = 0.25
MIN_WORDS = 4
CHUNK = 4096
# Documents that may hold more items than this are looked at stretch by stretch first, so
# many stretches at once.
MANY_ITEMS = 8
STRETCHES = 64
HASHED_AT_ONCE = 1 << 17
_CACHE = 1 << 17

_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())
_PLAIN = bytes.maketrans(_MARKS + bytes(range(65, 91)), b" " * len(_MARKS) + bytes(range(97, 123)))


def words_of(text: str | None) -> list[bytes]:
    """Words without ASCII marks, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


class Terms(dict):
    """Numbers of hashed terms, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = term = xxhash.xxh32_intdigest(word) & (TERMS - 1)
        return term

    @classmethod
    def shared(cls) -> Terms:
        """The terms that this process remembers from task to task."""
        return common.remembered("terms", cls)

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > _CACHE:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


# The constants of the 32-bit xxHash.
_P1, _P2, _P3, _P4, _P5 = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], dtype=np.uint32)


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return h << np.uint32(bits) | h >> np.uint32(32 - bits)


def word_hashes(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``xxhash.xxh32_intdigest`` of many words, given by their places in an array of bytes."""
    h = sizes.astype(np.uint32) + _P5
    fours, rest = sizes // 4, sizes % 4
    fours[sizes >= 16] = rest[sizes >= 16] = 0  # long words come last
    for k in range(3):
        at = np.flatnonzero(fours > k)
        four = starts[at] + 4 * k
        lane = letters[four].astype(np.uint32)
        for byte in range(1, 4):
            lane |= letters[four + byte].astype(np.uint32) << np.uint32(8 * byte)
        h[at] = _turned(h[at] + lane * _P3, 17) * _P4
    for k in range(3):
        at = np.flatnonzero(rest > k)
        h[at] = _turned(h[at] + letters[starts[at] + 4 * fours[at] + k].astype(np.uint32) * _P5, 11) * _P1
    h = (h ^ h >> np.uint32(15)) * _P2
    h = (h ^ h >> np.uint32(13)) * _P3
    h ^= h >> np.uint32(16)
    for i in np.flatnonzero(sizes >= 16).tolist():
        h[i] = xxhash.xxh32_intdigest(letters[starts[i]:starts[i] + sizes[i]].tobytes())
    return h


def terms_of(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """What ``Terms`` has for the words of each text, many texts at a time."""
    waiting, size = [], 0
    for text in texts:
        waiting.append((text or "").encode("utf-8", "surrogatepass").translate(_PLAIN))
        size += len(waiting[-1])
        if size > HASHED_AT_ONCE:
            yield from _terms_of(waiting)
            waiting, size = [], 0
    yield from _terms_of(waiting)


def _terms_of(texts: list[bytes]) -> list[np.ndarray]:
    if not texts:
        return []
    letters = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
    held = letters != ord(" ")
    edges = np.flatnonzero(held[1:] != held[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    terms = (word_hashes(letters, starts, sizes) & np.uint32(TERMS - 1)).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64)
    return np.split(terms, np.searchsorted(starts, ends + 1))


# --- weights --------------------------------------------------------------------

def numbered(docs: DataFrame) -> DataFrame:
    """``terms`` of each document, as 16-bit numbers in the order of its words."""
    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"terms": [
                terms.astype(np.uint16).tobytes() for terms in terms_of(batch["text"])]})

    return docs.select("text").mapInPandas(number, "terms binary")


def term_counts(numbers: DataFrame) -> np.ndarray:
    """In how many documents each term is; the last entry counts the documents."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen, last = np.zeros(TERMS, dtype=np.int64), 0, np.zeros(TERMS, dtype=np.int64)
        for batch in batches:
            for packed in batch["terms"]:
                terms = np.frombuffer(packed, dtype=np.uint16)
                place = np.arange(len(terms))
                last[terms] = place  # one place of each term stays
                total[terms[last[terms] == place]] += 1
            seen += len(batch)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"term": np.r_[used, TERMS], "n": np.r_[total[used], seen]})

    counted = numbers.mapInPandas(count, "term int, n bigint").groupBy("term").agg(
        F.sum("n").alias("n")).toPandas()  # at most TERMS + 1 rows
    out = np.zeros(TERMS + 1, dtype=np.int64)
    out[counted["term"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)
    return out


def inverse_frequencies(counts: np.ndarray) -> np.ndarray:
    return np.log((counts[-1] + 1) / (counts[:-1] + 1)).astype(np.float32) + 0.05


# --- basis ----------------------------------------------------------------------

def signs(rank: int) -> np.ndarray:
    """The start of the iteration: random signs, the same in every task."""
    return np.random.default_rng(7).integers(0, 2, (TERMS, rank), dtype=np.int8) * np.int8(2) - np.int8(1)


def add_rows(out: np.ndarray, to: np.ndarray, values: np.ndarray, source: np.ndarray) -> None:
    """Add the rows ``source`` of ``values`` to the rows ``to`` of ``out``; ``to`` is in order."""
    first = np.flatnonzero(np.r_[len(to) > 0, to[1:] != to[:-1]])
    times = np.diff(np.r_[first, len(to)])
    by = np.argsort(-times, kind="stable")
    for at in range(0, len(by), ROWS_AT_ONCE):
        own = by[at:at + ROWS_AT_ONCE]
        start, fewer = first[own], -times[own]
        total = values.take(source[start], axis=0)
        for k in range(1, -int(fewer[0])):
            n = int(np.searchsorted(fewer, -k))  # as many have another one
            total[:n] += values.take(source[start[:n] + k], axis=0)
        out[to[start]] += total


class Product:
    """``A'A start``, added up over passages of length one.

    Frequent terms are multiplied as a dense matrix; of the others, which are in few
    passages each, rows are looked up and added.  Weights are in the start and in the end.
    """

    def __init__(self, start: np.ndarray, idf: np.ndarray):
        order = np.argsort(idf, kind="stable")
        self._place = np.empty(TERMS, dtype=np.int64)
        self._place[order] = np.arange(TERMS)
        self._idf = idf[order]
        self._start = start[order] * self._idf[:, None]
        self._total = np.zeros(start.shape, dtype=np.float32)

    def add(self, terms: np.ndarray, passages: np.ndarray) -> None:
        """``passages`` numbers, from 0 on and in order, the passage of each term."""
        keys = np.sort(passages * TERMS + self._place[terms])
        passage, term = np.divmod(keys, TERMS)
        n = int(passage[-1]) + 1
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        times = np.diff(np.r_[first, len(keys)])
        weights = times * self._idf[term[first]].astype(np.float64)
        squares = np.bincount(passage[first], weights * weights, minlength=n) + 1e-12
        dense = np.zeros((n, FREQUENT), dtype=np.float32)
        frequent = term[first] < FREQUENT
        dense[passage[first[frequent]], term[first[frequent]]] = times[frequent]
        rare = np.flatnonzero(term >= FREQUENT)
        passage, term = passage[rare], term[rare]
        rows = dense @ self._start[:FREQUENT]
        add_rows(rows, passage, self._start, term)
        rows /= squares[:, None].astype(np.float32)
        self._total[:FREQUENT] += dense.T @ rows
        order = np.argsort(term, kind="stable")
        add_rows(self._total, term[order], rows, passage[order])

    def total(self) -> np.ndarray:
        return (self._total * self._idf[:, None])[self._place]


def corpus_product(numbers: DataFrame, counts: np.ndarray, rank: int) -> DataFrame:
    """``slab, part``: ``A'A`` times the signs over all passages of all documents, by ranges of
    ``SLAB`` terms.  The row of slab -1 has the number of passages.
    """
    idf, slabs = inverse_frequencies(counts), TERMS // SLAB

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        product = Product(signs(rank), idf)
        waiting, at, n, total = [], [], 0, 0
        for batch in batches:
            for packed in batch["terms"]:
                own = np.frombuffer(packed, dtype=np.uint16)
                # Stretches of whole passages, however long the text is.
                for begin in range(0, len(own), PASSAGES_AT_ONCE * PASSAGE):
                    terms = own[begin:begin + PASSAGES_AT_ONCE * PASSAGE]
                    waiting.append(terms)
                    at.append(n + np.arange(len(terms)) // PASSAGE)
                    n = int(at[-1][-1]) + 1
                    if n >= PASSAGES_AT_ONCE:
                        product.add(np.concatenate(waiting), np.concatenate(at))
                        waiting, at, n, total = [], [], 0, total + n
        if waiting:
            product.add(np.concatenate(waiting), np.concatenate(at))
        yield pd.DataFrame({"slab": [-1], "part": [np.array([total + n], dtype=np.int64).tobytes()]})
        out = product.total()
        for slab in range(slabs):
            part = out[slab * SLAB:(slab + 1) * SLAB]
            if part.any():
                yield pd.DataFrame({"slab": [slab], "part": [part.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, total = None, None
        for batch in batches:
            for slab, part in zip(batch["slab"], batch["part"], strict=True):
                own = np.frombuffer(part, dtype=np.float32 if slab >= 0 else np.int64)
                if slab != current:
                    if current is not None:
                        yield pd.DataFrame({"slab": [current], "part": [total.tobytes()]})
                    current, total = slab, own.copy()
                else:
                    total += own
        if current is not None:
            yield pd.DataFrame({"slab": [current], "part": [total.tobytes()]})

    # Each task has a sum of fixed size: as many tasks as run at once keep the shuffle small.
    tasks = numbers.sparkSession.sparkContext.defaultParallelism
    return numbers.coalesce(tasks).mapInPandas(multiply, "slab int, part binary").repartition(
        "slab").sortWithinPartitions("slab").mapInPandas(add, "slab int, part binary")


def latent_basis(product: np.ndarray, passages: int, items: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """``TERMS x rank``: leading right singular vectors of all passages and the items.

    ``product`` is ``A'A`` times the signs over the corpus, with columns enough.  The
    benchmark's passages weigh as much as the corpus's together.
    """
    rank = min(len(items) + EXTRA_RANK, TERMS)
    weight = max(passages, LEAST_WEIGHT) / max(len(items), 1)
    start = signs(product.shape[1])[:, :rank].astype(np.float32)
    y, own = product[:, :rank].copy(), Product(start, idf)
    if any(map(len, items)):
        own.add(np.concatenate(items), np.repeat(np.arange(len(items)), [len(n) for n in items]))
    y += np.float32(weight) * own.total()
    q, _ = np.linalg.qr(y)
    # With one product, A'A on the subspace is what maps the start's part in it to the product's.
    inner = np.linalg.lstsq((q.T @ start).T.astype(np.float64), (q.T @ y).T.astype(np.float64), rcond=None)[0]
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    return q @ vectors[:, np.argsort(values)[::-1]].astype(np.float32)


def _term_products(basis: np.ndarray, items: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """``TERMS x items``: what a term adds to a window's product with each item."""
    projected = basis * idf[:, None]
    vectors = np.array([projected[n].sum(axis=0) for n in items]).reshape(len(items), -1)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (projected @ (vectors / (lengths + 1e-9)).T).astype(np.float32)


def term_products(product: DataFrame, items: list[np.ndarray], counts: np.ndarray, rank: int) -> np.ndarray:
    """The products of a block of items, on a basis fitted to it and to ``corpus_product``."""
    idf = inverse_frequencies(counts)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, passages = np.zeros((TERMS, rank), dtype=np.float32), 0
        for batch in batches:
            for slab, part in zip(batch["slab"], batch["part"], strict=True):
                if slab < 0:
                    passages = int(np.frombuffer(part, dtype=np.int64)[0])
                else:
                    whole[slab * SLAB:(slab + 1) * SLAB] = np.frombuffer(part, dtype=np.float32).reshape(
                        SLAB, rank)
        products = _term_products(latent_basis(whole, passages, items, idf), items, idf)
        yield pd.DataFrame({"block": range(PRODUCT_PARTS), "part": [
            part.tobytes() for part in np.split(products, PRODUCT_PARTS)]})

    # Part by part: whole, the driver would hold the products several times over.
    parts = product.repartition(1).mapInPandas(fit, "block int, part binary").repartition(PRODUCT_PARTS)
    rows = {r["block"]: np.frombuffer(r["part"], dtype=np.float32) for r in parts.toLocalIterator()}
    if not rows:  # an empty corpus may have no task at all
        empty = np.zeros((TERMS, rank), dtype=np.float32)
        return _term_products(latent_basis(empty, 0, items, idf), items, idf)
    return np.concatenate([rows[block] for block in sorted(rows)]).reshape(TERMS, -1)


# --- search ---------------------------------------------------------------------

class Index(NamedTuple):
    """A block of items: what every task needs to search it."""

    ids: list
    words: list[list[bytes]]
    # What a term adds to a window's product with each item, and to its squared length.
    added: np.ndarray
    squares: np.ndarray
    # How many of each item's words have a term.
    times: np.ndarray


def index_of(items: list[tuple[object, str]], products: np.ndarray, counts: np.ndarray) -> Index:
    idf = inverse_frequencies(counts)
    added = np.r_[products, np.zeros((1, len(items)), dtype=np.float32)]  # the last term has no weight
    words, numbers = [words_of(text) for _, text in items], Terms()
    times = np.zeros((TERMS, len(items)), dtype=np.uint32)
    for i, own in enumerate(words):
        np.add.at(times[:, i], numbers.of(own), 1)
    return Index([i for i, _ in items], words, added, np.r_[idf * idf, 0].astype(np.float32),
                 times.astype(np.min_scalar_type(int(times.max(initial=0)))))


def common_length(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, with the rows as bits of an integer."""
    places: dict[bytes, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        hit = places.get(word, 0)
        if hit:
            met = row & hit
            row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def _contains(words: list[bytes], run: list[bytes]) -> bool:
    joined = b" " + b" ".join(words) + b" "
    return b" " + b" ".join(run) + b" " in joined


def _sums_of_grains(values: np.ndarray, kind: type) -> np.ndarray:
    """The sums of the first 0, 1, 2 and so on grains of ``GRAIN`` values or rows; behind the
    last one they go on for a window, so that windows may reach over the end."""
    total = values[::GRAIN].copy()
    for i in range(1, GRAIN):
        total += values[i::GRAIN]
    n = len(total)
    sums = np.empty((n + 1 + max(WINDOWS) // GRAIN, *values.shape[1:]), dtype=kind)
    sums[0] = 0
    np.cumsum(total, axis=0, dtype=kind, out=sums[1:n + 1])
    sums[n + 1:] = sums[n]
    return sums


class Searcher:
    def __init__(self, index: Index):
        self.index = index
        self.cache = Terms.shared()
        self.times = [Counter(w) for w in index.words]
        # Items that are too short for windows are looked for word for word.
        self.short = [i for i, w in enumerate(index.words) if 0 < len(w) < MIN_WORDS]
        self.usable = np.array([len(w) >= MIN_WORDS for w in index.words], dtype=bool)
        self.needed = MIN_COMMON_WITH_ANSWER * np.array([len(w) for w in index.words])
        # The items' terms have places of their own; the last place is for all others.
        used = np.flatnonzero(index.times.any(axis=1))
        self.place = np.full(TERMS, len(used), dtype=np.int64)
        self.place[used] = np.arange(len(used))
        self.times_of_used = index.times[used]

    def possible(self, terms: np.ndarray) -> np.ndarray:
        """The items of whose words enough may be among those with these terms."""
        held = np.zeros(len(self.times_of_used) + 1, dtype=bool)
        place = self.place[terms]
        held[place] = True
        both = self.times_of_used[held[:-1].nonzero()[0]].sum(axis=0, dtype=np.uint32)
        items = (self.usable & (both >= self.needed)).nonzero()[0]
        return items[self._in_a_stretch(place, items)] if len(items) > MANY_ITEMS else items

    def _in_a_stretch(self, place: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Whether enough of each item's words may be in one stretch of two item lengths.

        Such a stretch is in three blocks of the longest item's length, one after the other.
        """
        size = max(len(self.index.words[i]) for i in items.tolist())
        blocks = -(-len(place) // size)
        if blocks <= 3:
            return np.ones(len(items), dtype=bool)
        enough = np.zeros(len(items), dtype=bool)
        for begin in range(0, blocks - 2, STRETCHES):
            part = place[begin * size:(begin + STRETCHES + 2) * size]
            held = np.zeros((-(-len(part) // size), len(self.times_of_used) + 1), dtype=bool)
            held[np.arange(len(part)) // size, part] = True
            used = held[:, :-1].any(axis=0).nonzero()[0]
            held = held[:, used]
            times = self.times_of_used[used].take(items, axis=1).astype(np.float32)
            both = (held[:-2] | held[1:-1] | held[2:]).astype(np.float32) @ times
            enough |= both.max(axis=0) >= self.needed[items]
        return enough

    def candidates(self, terms: np.ndarray, items: np.ndarray) -> dict[int, list[tuple[int, int, float]]]:
        """By item of ``items``: windows with a sufficient cosine, as start, end, cosine.

        Words are added up four at a time, so windows begin at every fourth word.
        """
        found: dict[int, list[tuple[int, int, float]]] = {}
        index, overlap = self.index, max(WINDOWS)
        few = 8 * len(items) < len(index.ids)
        for base in range(0, max(len(terms) - overlap, 1), CHUNK):
            part = terms[base:base + CHUNK + overlap]
            if len(part) % GRAIN:
                # Terms without weight.
                part = np.concatenate([part, np.full(-len(part) % GRAIN, TERMS)])
            if few:
                added = index.added.ravel().take(part[:, None] * len(index.ids) + items)
            else:
                added = index.added.take(part, axis=0)[:, items]
            sums = _sums_of_grains(added, np.float32)
            norms = _sums_of_grains(index.squares.take(part), np.float64)
            grains = len(part) // GRAIN
            for size, step in WINDOWS.items():
                span, step = size // GRAIN, step // GRAIN
                last = max(grains - span + step - 1, 0) // step * step  # where the last window begins
                begins, ends = slice(0, last + 1, step), slice(span, span + last + 1, step)
                lengths = np.sqrt(norms[ends] - norms[begins] + 1e-9).astype(np.float32)
                cosines = sums[ends] - sums[begins]
                at = (cosines >= (MIN_COSINE * lengths)[:, None]).ravel().nonzero()[0]
                if not len(at):
                    continue
                window, which = np.divmod(at, len(items))
                starts = window * step
                for i, start, end, cosine in zip(
                        items[which].tolist(), (base + starts * GRAIN).tolist(),
                        (base + np.minimum(starts + span, grains) * GRAIN).tolist(),
                        (cosines.ravel()[at] / lengths[window]).tolist(), strict=True):
                    found.setdefault(i, []).append((start, end, cosine))
        return found

    def found(self, texts: Iterable[str | None]) -> Iterator[list[tuple[object, float, float, bool]]]:
        """For each text ``item_id, cosine, common, answer`` of the items that it holds."""
        for text, terms in zip(texts, terms_of(texts), strict=True):
            yield self._matches(text, terms) if len(terms) else []

    def matches(self, text: str | None) -> list[tuple[object, float, float, bool]]:
        return next(self.found([text]))

    def _matches(self, text: str, terms: np.ndarray) -> list[tuple[object, float, float, bool]]:
        out = []
        words = words_of(text) if self.short else []
        for i in self.short:
            if _contains(words, self.index.words[i]):
                out.append((self.index.ids[i], 1.0, 1.0, True))
        possible = self.possible(terms)
        near = self.candidates(terms, possible) if len(possible) else {}
        if not near:
            return out
        words = words or words_of(text)
        known = set(words)
        for i, windows in near.items():
            if self._enough(i, known):
                best = self._verified(words, i, windows)
                if best is not None:
                    out.append((self.index.ids[i], *best))
        return out

    def _enough(self, i: int, words: set[bytes]) -> bool:
        """Whether so many of an item's words are among others that they may be in common."""
        times, needed = self.times[i], MIN_COMMON_WITH_ANSWER * len(self.index.words[i])
        both = times.keys() & words
        # The words that repeat are only added up if they can matter.
        if len(both) + len(self.index.words[i]) - len(times) < needed:
            return False
        return sum(map(times.__getitem__, both)) >= needed

    def _verified(self, words: list[bytes], i: int, near: list[tuple[int, int, float]]):
        item = self.index.words[i]
        answer = item[-max(MIN_WORDS, int(len(item) * ANSWER_SHARE)):]
        best = None
        for start, end in _merged(near, len(item)):
            # Regions are compared in stretches of two item lengths, half overlapping.
            for at in range(start, max(end - len(item), start + 1), len(item)):
                region = words[at:at + 2 * len(item)]
                # No subsequence is longer than the item's words that the region has.
                if not self._enough(i, set(region)):
                    continue
                share = common_length(item, region) / len(item)
                if share >= MIN_COMMON_WITH_ANSWER:
                    answered = _contains(region, answer)
                    if (share >= MIN_COMMON or answered) and (best is None or share > best[1]):
                        best = (max(c for _, _, c in near), share, answered)
        return best


def _merged(near: list[tuple[int, int, float]], margin: int) -> list[tuple[int, int]]:
    """Candidate windows with a margin on both sides, overlapping ones as one."""
    out: list[list[int]] = []
    for start, end, _ in sorted(near):
        start = max(0, start - margin)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end + margin)
        else:
            out.append([start, end + margin])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The benchmark's items in blocks of bounded size."""
    items, at = common.stored(
        benchmark.where("text is not null").select("item_id", "text")
        .groupBy("item_id", "text").agg(F.lit(1).alias("one")), "items")
    blocks = -(-items.count() // BLOCK_ITEMS)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select(
            "item_id", "text").orderBy("item_id", "text").collect()
        if rows:
            yield [(r["item_id"], r["text"]) for r in rows]
    common.discard(benchmark.sparkSession, at)


def indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """A broadcast index for each block of the benchmark, made when it is asked for."""
    spark = docs.sparkSession
    blocks = list(_blocks(benchmark))  # the benchmark is a query set
    if not blocks:
        return
    numbers, numbers_at = common.stored(numbered(docs), "terms")
    counts = term_counts(numbers)
    rank = min(max(map(len, blocks)) + EXTRA_RANK, TERMS)
    product, product_at = common.stored(corpus_product(numbers, counts, rank), "product")
    for items in blocks:
        terms = Terms()
        rows = [terms.of(words_of(text)) for _, text in items]
        yield spark.sparkContext.broadcast(
            index_of(items, term_products(product, rows, counts, rank), counts))
    common.discard(spark, numbers_at, product_at)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, common, answer`` of every document that holds an item."""
    kinds = {k: d.schema[k].dataType.simpleString() for d, k in ((docs, "doc_id"), (benchmark, "item_id"))}
    schema = (f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, cosine double, common double, "
              "answer boolean")
    found = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(docs, benchmark):
        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            searcher = Searcher(index.value)
            for batch in batches:
                rows = [(doc_id, *m)
                        for doc_id, own in zip(batch["doc_id"], searcher.found(batch["text"]), strict=True)
                        for m in own]
                # Plain objects: a null among whole numbers would make them floats.
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "cosine", "common", "answer"],
                                   dtype=object)

        found = found.unionByName(docs.select("doc_id", "text").mapInPandas(search, schema))
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no item, with their own columns.

    The texts that hold one are stored as digests, block by block, so no index outlives its
    search: the driver has one at a time, and none when the result is used.
    """
    name = common.unused(docs, "held")
    digest = F.unhex(F.md5(F.col("text")))
    for index in indexes(docs, benchmark):
        held, _ = common.stored(
            docs.where(_holds(index)(F.col("text"))).select(digest.alias(name)).distinct(), "held")
        index.destroy()
        docs = docs.join(held, digest == F.col(name), "left_anti")
    return docs


def _holds(index):
    """A function that tells whether a text holds an item of a broadcast index."""
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        searcher = Searcher(index.value)
        return pd.Series([bool(own) for own in searcher.found(texts)], dtype=bool)

    return holds
