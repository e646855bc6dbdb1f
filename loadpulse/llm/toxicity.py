"""Toxicity by compression distance: two zstandard dictionaries, one per kind of text.

Words that mark toxic text are found in a bounded sample of labelled documents, near
copies counted once: fragments of words that are far more frequent in toxic documents,
then words that hold such a fragment and are so themselves.  Both dictionaries begin
with the same segments, trained on ordinary text; the toxic one goes on with the toxic
words, the other with as much more ordinary text.  Every window of a document is
compressed with each; how many bytes the toxic dictionary saves says how toxic the
window is.  A logistic function of the savings, fitted on documents that the
dictionaries did not see, is the score.

Bounds of the fit, all parameters: ``TOXIC_DOCS`` and ``ORDINARY_DOCS`` documents,
``FIT_CHARS`` code points of each.  Scoring covers whole texts, window by window.

Edge cases: a null or empty text has one empty window, and a score below the
threshold; a document without a label is scored like any other; several labels of one
document count as toxic if one is, null labels are none; without labels of both kinds
every score is 0; repeated rows have equal scores; an empty table gives no rows; other
columns are kept where rows are filtered, and not read otherwise.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.7
TOXIC_DOCS, ORDINARY_DOCS, FIT_CHARS = 3000, 6000, 20_000
WINDOW_WORDS, STRIDE_WORDS = 8, 2
DICTIONARY_BYTES = 16_384
# Ordinary documents of the sample whose windows the common segments are trained on.
SEGMENT_DOCS = 600
TOXIC_BYTES = 16_384
FRAGMENT = 5
PREFIXES = range(4, 10)
LEVEL = 3
# Every third remainder is held out.
FOLDS, HELD_OUT_FOLD = 3, 1
_FRAGMENT_LIFT, _FRAGMENT_EVIDENCE = 8.0, 20.0
_FRAGMENT_DOCS = 3
_WORD_LIFT, _WORD_DOCS = 10.0, 2
_MARKS = b".,;:!?#$*\"'()-"
_BATCH = 20_000


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]


# --- windows and features -------------------------------------------------------

def windows(words: list[bytes]) -> Iterator[bytes]:
    """Overlapping windows that cover all words; a short text is one window."""
    for at in range(0, max(len(words) - WINDOW_WORDS + STRIDE_WORDS, 1), STRIDE_WORDS):
        yield b" " + b" ".join(words[at:at + WINDOW_WORDS]) + b" "


class Compressors:
    """Compresses windows with both dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = map(self._compress, (toxic, ordinary))

    @staticmethod
    def _compress(content: bytes):
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False,
                                        write_content_size=False, write_dict_id=False).compress

    def features(self, text: str | None) -> list[float]:
        """The largest savings, and how much is saved for the number of windows."""
        toxic, ordinary = self.toxic, self.ordinary
        saved = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(common.lower_words(text))])
        largest = np.zeros(6)
        top = np.sort(saved)[::-1][:6]
        largest[:len(top)] = top
        over = np.maximum(saved - 2, 0).sum()
        n = len(saved)
        return [*largest[[0, 1, 3, 5]], over / math.sqrt(n), (saved >= 3).sum() / math.sqrt(n),
                over / n, math.log1p(over), math.log(n)]


# --- fit ------------------------------------------------------------------------

def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``text, toxic`` of a bounded sample of labelled rows that are not held out, and
    how many rows of each label there are in all."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    known = (
        labels.where(F.col("toxic").isNotNull() & (fold != HELD_OUT_FOLD))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    )
    known, at = common.stored(known, "labelled")
    counts = {int(r["toxic"]): r["count"] for r in known.groupBy("toxic").count().collect()}
    by_hash = F.xxhash64("doc_id")
    chosen = (
        known.where("toxic = 1").orderBy(by_hash, "doc_id").limit(TOXIC_DOCS)
        .unionByName(known.where("toxic = 0").orderBy(by_hash, "doc_id").limit(ORDINARY_DOCS))
    )
    # At most TOXIC_DOCS + ORDINARY_DOCS ids, and then as many texts of bounded length.
    texts = docs.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, FIT_CHARS).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(
        F.min("text").alias("text"))
    sample, _ = common.stored(sample, "toxicity-sample")
    common.discard(docs.sparkSession, at)
    return sample, counts


def _without_copies(texts: Iterable[list[bytes]]) -> list[list[bytes]]:
    """Texts that share none of their smallest shingle hashes with an earlier one."""
    seen, kept = set(), []
    for words in texts:
        hashes = sorted({xxhash.xxh64_intdigest(b" ".join(words[i:i + 5]))
                         for i in range(max(1, len(words) - 4))})[:8]
        if seen.isdisjoint(hashes):
            kept.append(words)
        seen.update(hashes)
    return kept


def _evidence(k1: int, n1: int, k0: int, n0: int) -> float:
    """Log likelihood ratio of two shares against one."""
    def fit(k: int, n: int, p: float) -> float:
        p = min(max(p, 1e-12), 1 - 1e-12)
        return k * math.log(p) + (n - k) * math.log(1 - p)

    together = (k1 + k0) / (n1 + n0)
    return 2 * (fit(k1, n1, k1 / n1) + fit(k0, n0, k0 / n0) - fit(k1, n1, together)
                - fit(k0, n0, together))


def _fragments(words: set[bytes]) -> set[bytes]:
    found = set()
    for word in words:
        padded = b" " + word + b" "
        found.update(padded[i:i + FRAGMENT] for i in range(max(1, len(padded) - FRAGMENT + 1)))
        found.update(padded[:n] for n in PREFIXES if n < len(padded))
    return found


def toxic_words(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Words that mark toxic texts, the most frequent last."""
    words_t, parts_t = Counter(), Counter()
    for text in toxic:
        distinct = {w.strip(_MARKS) for w in text}
        words_t.update(distinct)
        parts_t.update(_fragments(distinct))
    # What is rarer in toxic texts cannot pass below, so it is not counted in others.
    words_t = Counter({w: n for w, n in words_t.items() if n >= _WORD_DOCS})
    parts_t = Counter({p: n for p, n in parts_t.items() if n >= _FRAGMENT_DOCS})
    words_o, parts_o = Counter(), Counter()
    for text in ordinary:
        distinct = {w.strip(_MARKS) for w in text}
        words_o.update(distinct & words_t.keys())
        parts_o.update(_fragments(distinct) & parts_t.keys())
    n1, n0 = max(len(toxic), 1), max(len(ordinary), 1)
    marks = {p for p, n in parts_t.items() if n / n1 > _FRAGMENT_LIFT * (parts_o[p] + 0.5) / n0
             and _evidence(n, n1, parts_o[p], n0) > _FRAGMENT_EVIDENCE}
    found = [w for w, n in words_t.items() if n >= _WORD_DOCS
             and n / n1 > _WORD_LIFT * (words_o[w] + 0.2) / n0 and _fragments({w}) & marks]
    return sorted(found, key=lambda w: (words_t[w], w))


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """The contents of the toxic and the ordinary dictionary, equally long."""
    shuffled = np.random.default_rng(0)
    plain = [w for words in ordinary[:SEGMENT_DOCS] for w in windows(words)]
    plain = [plain[i] for i in shuffled.permutation(len(plain))[:4 * DICTIONARY_BYTES]]
    try:
        base = zstandard.train_dictionary(DICTIONARY_BYTES, plain).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        base = b"".join(plain)[:DICTIONARY_BYTES]
    marks = (b" " + b" ".join(toxic_words(toxic, ordinary)) + b" ")[-TOXIC_BYTES:]
    filler = b"".join(plain)[-len(marks):]
    return base + marks, base + filler


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last column is ones."""
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (p - y)) + ridge * beta
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(sample: pd.DataFrame, counts: dict[int, int]) -> Model | None:
    """The model, or None without rows of both labels.

    Two thirds of the sample make the dictionaries, one third the logistic function,
    each label weighted as often as it occurs among all labelled rows.
    """
    texts = {k: sample["text"][sample["toxic"] == k].tolist() for k in (0, 1)}
    if min(len(texts[0]), len(texts[1])) < 3:
        return None
    toxic, ordinary = dictionaries(*(_without_copies(
        common.lower_words(t) for i, t in enumerate(texts[k]) if i % 3) for k in (1, 0)))
    tool = Compressors(toxic, ordinary)
    rows, truth, weight = [], [], []
    for k, own in texts.items():
        held = own[::3]
        rows += [tool.features(t) for t in held]
        truth += [k] * len(held)
        weight += [counts.get(k, len(own)) / len(held)] * len(held)
    x, w = np.array(rows), np.array(weight)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    beta = _logistic(np.c_[(x - centre) / scale, np.ones(len(x))], np.array(truth),
                     w * len(w) / w.sum())
    return Model(toxic, ordinary, tuple(beta), tuple(centre), tuple(scale))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model, fitted in one task: its input is the bounded sample."""
    sample, counts = training_sample(docs, labels)

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": [], "toxic": [], "text": []}), *batches])
        model = fit(rows.sort_values("doc_id"), counts)
        if model is not None:
            yield pd.DataFrame([[model.toxic, model.ordinary, *map(list, model[2:])]],
                               columns=["toxic", "ordinary", "weights", "centre", "scale"])

    found = sample.repartition(1).mapInPandas(
        fitted, "toxic binary, ordinary binary, weights array<double>, centre array<double>, "
                "scale array<double>").collect()
    return Model(*map(bytes, found[0][:2]), *map(tuple, found[0][2:])) if found else None


# --- scoring --------------------------------------------------------------------

def scores_of(texts: list[str | None], model: Model) -> np.ndarray:
    tool = Compressors(model.toxic, model.ordinary)
    x = np.array([tool.features(t) for t in texts]).reshape(len(texts), -1)
    if not len(texts):
        return np.zeros(0)
    z = (x - np.array(model.centre)) / np.array(model.scale)
    return 1 / (1 + np.exp(-np.clip(np.c_[z, np.ones(len(z))] @ np.array(model.weights), -30, 30)))


def with_score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """Documents with their score, other columns untouched."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scores_of(texts.tolist(), model))

    return docs.withColumn(name, score("text"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    found = with_score(docs.select("doc_id", "text"), train(docs, labels))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    return found.select("doc_id", F.coalesce(fold == HELD_OUT_FOLD, F.lit(False)).alias("held_out"),
                        "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose score is below the threshold, with their own columns."""
    name = common.unused(docs, "toxicity")
    found = with_score(docs, train(docs, labels), name)
    return found.where(F.col(name) < THRESHOLD).select(*map(common.quoted, docs.columns))
