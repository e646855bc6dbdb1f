"""Exact token counts of every prefix of a text, for truncation and budget questions.

The tokenizer is a sentencepiece BPE model with byte fallback.  Pieces are merged by
score, so two facts hold: a sequence of pieces is an encoding exactly if each piece and
the next one, merged alone, stay these two; and each prefix has one encoding.  So the
last piece of a prefix is the one that ends there and stays apart from the last piece of
the prefix before it, and the prefix has one token more than that.  This recurrence is
worked out sign by sign, once for each stretch between spaces: no piece reaches over the
start of a run of spaces, so the counts of stretches add up.

What is stored are the steps from one prefix to the next, one signed byte per code point
(a sign may also lower the count, as pieces join).  Their sum up to a place is the token
count of the prefix that ends there, so no question encodes a text again.

Edge cases: a null or empty text has no steps and no tokens; signs without a piece count
as their UTF-8 bytes; control strings inside a text are plain text, as by the library's
default; repeated rows and null ids are kept as they are; other columns are not read.
A model that rewrites texts, or has pieces across spaces, is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

TOKENIZER = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
SPACE = "▁"
# A task remembers so many stretches of at most so many code points (together some
# 60 MB), a process so many pairs of pieces (some 50 MB).
CACHE_ENTRIES, CACHED_CHARS = 1 << 18, 40
PAIR_ENTRIES = 1 << 19
COLUMNS = "doc_id bigint, n_chars bigint, n_bytes bigint, n_tokens bigint, steps binary"

_STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*")
_PROBE = "  a ﬁ\tÅx "


class _Pieces:
    """The pieces of a model, where they occur in a text, and which stay apart."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._scores = {
            model.id_to_piece(i): model.get_score(i) for i in range(len(model))
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        }
        if model.normalize(_PROBE) != SPACE + _PROBE.replace(" ", SPACE):
            raise ValueError(f"{path} rewrites texts before it encodes them")
        if any(SPACE in p.lstrip(SPACE) or any(c not in self._scores for c in p) for p in self._scores):
            raise ValueError(f"{path} has pieces across spaces or of signs without a piece")
        # Piece 0 stands for no piece: the start of a text, or bytes, which never merge.
        self.texts = ["", *self._scores]
        self._found = ahocorasick.Automaton()
        for number, piece in enumerate(self.texts[1:], 1):
            self._found.add_word(piece, (len(piece), number))
        self._found.make_automaton()
        self._apart: dict[int, bool] = {}

    @classmethod
    def of(cls, path: str) -> _Pieces:
        """The pieces of this process.  It keeps, of a bounded number of pairs, what it
        knows of them between tasks."""
        return common.remembered(("pieces", path), lambda: cls(path))

    def _merged(self, text: str) -> list[str]:
        """The pieces of a text by merging: the best pair first, the left one of equals."""
        pieces, score = list(text), self._scores.get
        none = float("-inf")
        pairs = [score(a + b, none) for a, b in zip(pieces, pieces[1:])]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            at = pairs.index(best)
            pieces[at:at + 2] = [pieces[at] + pieces[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(pieces[at - 1] + pieces[at], none)
            if at < len(pairs):
                pairs[at] = score(pieces[at] + pieces[at + 1], none)
        return pieces

    def _stay(self, before: int, piece: int) -> bool:
        """Whether a piece stays as it is behind another one, or behind none."""
        if len(self._apart) >= PAIR_ENTRIES:
            self._apart.clear()
        left, right = self.texts[before], self.texts[piece]
        stay = self._merged(left + right) == ([left, right] if before else [right])
        self._apart[before * len(self.texts) + piece] = stay
        return stay

    def steps(self, text: str) -> bytes:
        """The steps of a stretch, worked out from its start."""
        counts, last, steps = [0], [0], []
        apart, many, barrier, settled = self._apart, len(self.texts), 0, 0

        def bytes_until(place: int) -> None:
            # Signs without a piece: what follows is encoded as if nothing were before.
            nonlocal barrier, settled
            while settled < place:
                width = len(text[settled].encode())
                counts.append(counts[-1] + width)
                last.append(0)
                steps.append(width)
                settled += 1
                barrier = settled

        # All pieces that end at a place, the longest first: exactly one of them is last.
        for at, (size, piece) in self._found.iter(text):
            if at < settled:
                continue
            if at > settled:
                bytes_until(at)
            start = at + 1 - size
            if start < barrier:
                continue
            before = last[start]
            stay = apart.get(before * many + piece)
            if stay is None:
                stay = self._stay(before, piece)
            if stay:
                count = counts[start] + 1
                steps.append((count - counts[-1]) & 255)
                counts.append(count)
                last.append(piece)
                settled += 1
        bytes_until(len(text))
        return bytes(steps)


class PrefixCounter(dict):
    """Maps a stretch of text to its steps, working them out where they are not known."""

    def __init__(self, path: str):
        super().__init__()
        self._pieces = _Pieces.of(path)

    def __missing__(self, stretch: str) -> bytes:
        steps = self._pieces.steps(stretch)
        if len(stretch) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[stretch] = steps
        return steps

    def steps(self, text: str) -> np.ndarray:
        """The steps of a whole text, one per code point."""
        if not text:
            return np.zeros(0, dtype=np.int8)
        # The library puts one space before a text; its token counts with the first sign.
        stretches = _STRETCH.findall(SPACE + text.replace(" ", SPACE))
        steps = np.frombuffer(b"".join(map(self.__getitem__, stretches)), dtype=np.int8).copy()
        steps[1] += steps[0]
        return steps[1:]


def prefix_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, n_chars, n_bytes, n_tokens, steps`` of every whole text of ``docs``.

    It is one pass without a shuffle.  Store it: the questions below read it.
    """
    path = tokenizer or common.tokenizer_path(TOKENIZER)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = PrefixCounter(path)
        for batch in batches:
            steps = [counter.steps(text) for text in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "n_chars": [len(s) for s in steps],
                "n_bytes": batch["n_bytes"],
                "n_tokens": [int(s.sum(dtype=np.int64)) for s in steps],
                "steps": [s.tobytes() for s in steps],
            })

    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    ).mapInPandas(count, COLUMNS)


def tokens_at(steps: Column, chars: Column) -> Column:
    """The tokens of the prefix of ``chars`` code points (of the whole text if it is
    shorter; none if ``chars`` is negative); null if either is null."""

    @F.pandas_udf("bigint")
    def at(steps: pd.Series, chars: pd.Series) -> pd.Series:
        return pd.Series([
            None if s is None or pd.isna(n)
            else int(np.frombuffer(s, dtype=np.int8)[:max(int(n), 0)].sum(dtype=np.int64))
            for s, n in zip(steps, chars, strict=True)], dtype="Int64")

    return at(steps, chars.cast("bigint"))


def longest_within(steps: Column, budget: int) -> Column:
    """The code points of the longest prefix of at most ``budget`` tokens; null for null."""

    @F.pandas_udf("bigint")
    def longest(steps: pd.Series) -> pd.Series:
        found = []
        for s in steps:
            if s is None:
                found.append(None)
                continue
            counts = np.cumsum(np.frombuffer(s, dtype=np.int8), dtype=np.int64)
            fits = np.flatnonzero(counts <= budget)
            found.append(int(fits[-1]) + 1 if len(fits) else 0)
        return pd.Series(found, dtype="Int64")

    return longest(steps)


def limited(counts: DataFrame, limit: int = TOKEN_LIMIT) -> DataFrame:
    """What a limit of tokens does to each text: whether it is over, and how many code
    points may stay.  Steps are read for texts over the limit only."""
    over = F.col("n_tokens") > limit
    kept = F.coalesce(longest_within(F.when(over, F.col("steps")), limit), F.col("n_chars"))
    return counts.select("doc_id", "n_bytes", "n_tokens", over.alias("over_limit"),
                         kept.alias("kept_chars"))
