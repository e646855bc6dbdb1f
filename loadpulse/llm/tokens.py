"""Token ids as flat binary files.

A corpus in this format is a folder with, for each part, a file of unsigned
little-endian token ids (16 bits if the vocabulary allows, else 32), a file of 64-bit
offsets and a file of document ids, and one ``manifest.json``.  Offsets count the ids
of all documents before, over all parts in order; a part's offsets end with those of
the next part's start.  Files can be memory-mapped as they are.

Documents are put in buckets of ascending id; each bucket is one part, written by one
task in two steps: ids with local lengths first, offsets once the prefix sum over the
parts' totals (one row per part) has given each part its base.  Files are written under
a name of the attempt and then renamed, so a task that runs again does no harm.

Edge cases: a null or empty text is the end id alone; equal ids are ordered by text,
null ids come first and are -2^63 in the file; repeated rows are all written; an empty
table makes a folder without parts; other columns are not read.
"""

from __future__ import annotations

import json
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from ..session import new_location

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
NO_ID = -(1 << 63)
CACHE_ENTRIES = 1 << 19
# Cutting before a space changes nothing unless white space is on both of its sides.
_UNSAFE = re.compile(r"\s \s|\s \Z")
# Of these letters, ASCII marks, digits, blanks and line breaks it is known how the tokenizer
# splits them: as below.  Added tokens have a "<", so that mark is not among them.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_ODD = re.compile(rf"[^\n -;=-~{_LETTER}]")
_PART = re.compile(rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[^\s{_LETTER}0-9]+| ?[0-9]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level tokenizer has for each byte: the byte's own if it
    is printed, else the next one from 256 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printed]
    return {b: chr(256 + n) for n, b in enumerate(others)}


def _packer(kind: str) -> Callable[[list[int]], bytes]:
    """What packs a few ids as numbers of this kind."""
    form = {"<u2": "H", "<u4": "I"}[kind]
    return lambda ids: struct.pack(f"<{len(ids)}{form}", *ids)


class _Recent(dict):
    """A bounded memory of what was used lately.

    What is full becomes the older half and goes when the next one is full, unless it was
    used again by then: pieces that recur are not worked out anew.
    """

    def __init__(self):
        super().__init__()
        self._older: dict = {}

    def bound(self, entries: int) -> None:
        if 2 * len(self) > entries:
            self._older = dict(self)
            self.clear()

    def __missing__(self, key):
        value = self._older.get(key)
        if value is None:
            value = self.made(key)
        self[key] = value
        return value


class _Parts(_Recent):
    """The packed ids of what the tokenizer splits a text into."""

    _LETTERS = _byte_letters()
    _SPACE, _BREAK = _LETTERS[32], _LETTERS[10]

    def __init__(self, tokenizer, kind: str):
        super().__init__()
        self._model, self._packed = tokenizer.model, _packer(kind)

    def made(self, part: str) -> bytes:
        if part.isascii():  # printed bytes are their own letters
            letters = part.replace(" ", self._SPACE).replace("\n", self._BREAK)
        else:
            letters = part.encode().decode("latin-1").translate(self._LETTERS)
        return self._packed([t.id for t in self._model.tokenize(letters)])


class _Odd(_Recent):
    """The packed ids of texts that are left to the tokenizer as they are."""

    def __init__(self, tokenizer, kind: str):
        super().__init__()
        self._tokenizer, self._packed = tokenizer, _packer(kind)

    def made(self, text: str) -> bytes:
        return self._packed(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)


class Encoder:
    """Encodes whole texts, remembering parts.

    A byte-level tokenizer of this kind splits a text before a space that follows
    something else than white space, so the ids of a text are those of its pieces in
    a row.  Pieces with odd characters are left to the tokenizer, the others are split
    here.  Texts for which that does not hold are encoded in one.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        self._parts, self._odd = _Parts(tokenizer, kind), _Odd(tokenizer, kind)

    @classmethod
    def of(cls, path: str, kind: str) -> Encoder:
        """The encoder of this process, which keeps what it knows between tasks."""
        return common.remembered(("encoder", path, kind), lambda: cls(path, kind))

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed."""
        self._parts.bound(CACHE_ENTRIES)
        self._odd.bound(CACHE_ENTRIES // 4)
        if _UNSAFE.search(text):
            return self._odd.made(text)
        out, at, odd = [], 0, _ODD.search(text)
        while odd:
            # From the space before the odd character to the next one behind it.
            begin, end = max(text.rfind(" ", at, odd.start()), at), text.find(" ", odd.end())
            end = len(text) if end < 0 else end
            out += [*self._plain(text[at:begin]), self._odd[text[begin:end]]]
            at, odd = end, _ODD.search(text, end)
        out += self._plain(text[at:])
        return b"".join(out)

    def _plain(self, text: str) -> Iterator[bytes]:
        return map(self._parts.__getitem__, _PART.findall(text))


# --- files ----------------------------------------------------------------------

def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder that all executors share, and its path there."""
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    elif folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(folder)


def _put(store: pyarrow.fs.FileSystem, path: str, chunks: Iterator[bytes]) -> int:
    """Write a file under another name, then give it its own; returns its bytes."""
    attempt, size = f"{path}.{uuid.uuid4().hex}", 0
    with store.open_output_stream(attempt) as out:
        for chunk in chunks:
            size += len(chunk)
            out.write(chunk)
    store.move(attempt, path)
    return size


def _mapped(store: pyarrow.fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where it is a local file, else read."""
    if isinstance(store, pyarrow.fs.LocalFileSystem):
        size = store.get_file_info(path).size
        return np.memmap(path, dtype=kind, mode="r") if size else np.zeros(0, dtype=kind)
    with store.open_input_stream(path) as file:
        return np.frombuffer(file.read(), dtype=kind)


def _name(part: int) -> str:
    return f"part-{part:08d}"


# --- writing --------------------------------------------------------------------

def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None,
                 end_id: int = END_ID, ids_bits: int = 16) -> str:
    """Write the corpus of ``docs`` (``doc_id, text``) and return its folder.

    ``ids_bits`` is the width of an id in the files, 16 or 32.
    """
    spark = docs.sparkSession
    folder = folder or new_location(spark, "tokens")
    path = tokenizer or common.tokenizer_path(TOKENIZER)
    kind = {16: "<u2", 32: "<u4"}[ids_bits]
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    partitions = common.shuffle_partitions(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = (
        docs.withColumn("part", common.ordered_bucket(docs.select("doc_id"), "doc_id", 4 * partitions))
        .repartition(partitions, "part").sortWithinPartitions("part", "doc_id", "text")
    )
    end = np.array([end_id], dtype=kind).tobytes()
    step = np.dtype(kind).itemsize

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(folder)
        encoder, open_part, file, attempt = Encoder.of(path, kind), None, None, None
        lengths, ids = [], []

        def finished() -> pd.DataFrame:
            file.close()
            where = posixpath.join(root, _name(open_part))
            store.move(attempt, f"{where}.bin")
            sizes = np.concatenate(lengths)
            _put(store, f"{where}.len", iter([sizes.astype("<i8").tobytes()]))
            _put(store, f"{where}.ids", iter([np.concatenate(ids).astype("<i8").tobytes()]))
            return pd.DataFrame({"part": [open_part], "n_docs": [len(sizes)], "n_tokens": [sizes.sum()]})

        for batch in batches:
            for part, rows in batch.groupby("part", sort=True):
                if part != open_part:
                    if file is not None:
                        yield finished()
                    open_part, lengths, ids = int(part), [], []
                    attempt = posixpath.join(root, f"{_name(open_part)}.{uuid.uuid4().hex}")
                    file = store.open_output_stream(attempt)
                packed = [encoder.encode(text) + end for text in rows["text"]]
                file.write(b"".join(packed))
                lengths.append(np.fromiter(map(len, packed), dtype=np.int64) // step)
                ids.append(rows["doc_id"].astype("Int64").fillna(NO_ID).to_numpy(dtype=np.int64))
        if file is not None:
            yield finished()

    written = placed.mapInPandas(encode, "part int, n_docs bigint, n_tokens bigint")
    counted, counted_at = common.stored(written, "token-parts")
    # One row per part, of which there are a fixed multiple of the shuffle partitions.
    parts = [r.asDict() for r in counted.orderBy("part").collect()]
    common.discard(spark, counted_at)
    base, first = 0, 0
    for part in parts:
        part |= {"first_token": base, "first_doc": first}
        base, first = base + part["n_tokens"], first + part["n_docs"]

    def offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(folder)
        for batch in batches:
            for part, start in zip(batch["part"], batch["first_token"], strict=True):
                where = posixpath.join(root, _name(part))
                ends = np.cumsum(_mapped(store, f"{where}.len", "<i8"))
                _put(store, f"{where}.idx", iter([(start + np.r_[0, ends]).astype("<i8").tobytes()]))
            yield batch[["part"]]

    if parts:
        bases = spark.createDataFrame(
            [(p["part"], p["first_token"]) for p in parts], "part int, first_token bigint")
        bases.repartition(min(len(parts), partitions)).mapInPandas(offsets, "part int").count()
    manifest = {"ids": kind, "end_id": end_id, "n_docs": first, "n_tokens": base, "parts": parts}
    _put(store, posixpath.join(root, "manifest.json"), iter([json.dumps(manifest).encode()]))
    return folder


# --- reading --------------------------------------------------------------------

def manifest_of(folder: str) -> dict:
    store, root = _open(folder)
    with store.open_input_stream(posixpath.join(root, "manifest.json")) as file:
        return json.loads(file.read())


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files.

    The checksum is that of the ids as little-endian unsigned 32-bit integers.
    """
    manifest = manifest_of(folder)
    kind = manifest["ids"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(folder)
        for batch in batches:
            for part in batch["part"]:
                where = posixpath.join(root, _name(part))
                flat = _mapped(store, f"{where}.bin", kind)
                bounds = _mapped(store, f"{where}.idx", "<i8")
                ids = pd.array(np.array(_mapped(store, f"{where}.ids", "<i8")), dtype="Int64")
                local = bounds - bounds[0]
                sums = [zlib.crc32(flat[a:b].astype("<u4").tobytes())
                        for a, b in zip(local[:-1], local[1:], strict=True)]
                ids[ids == NO_ID] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "start": np.array(bounds[:-1]),
                                    "n_tokens": np.diff(bounds), "ids_crc32": sums})

    parts = [(p["part"],) for p in manifest["parts"]]
    listed = spark.createDataFrame(parts, "part int")
    if parts:
        listed = listed.repartition(min(len(parts), common.shuffle_partitions(spark)))
    return listed.mapInPandas(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
