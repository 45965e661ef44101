"""Byte-level byte-pair encoding with the rank file of a public tokenizer.

Each distinct short word is merged once per Python worker on a contiguous array of part boundaries and
adjacent ranks: the array is scanned for the lowest rank, that boundary is deleted and the two ranks
beside it are refreshed. A word of more than ``SCAN_BYTES`` bytes (a text without blanks may be one
single word) would make these scans quadratic; its boundaries go through a heap with linked neighbours
instead, which chooses the same merges in the same order.

Null and empty texts have the ids ``[]``; a blank text has the ids of its blanks.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

#: Where the vocabulary files of the public tokenizers lie, unless a caller names another folder.
TOKENIZER_DIR = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: The word pattern published with the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCAN_BYTES = 96
#: Words longer than this aren't kept, and the store of kept words is emptied at this many entries.
KEEP_BYTES, KEEP_WORDS = 64, 300_000
#: Characters of text that are turned into one Arrow batch.
BATCH_CHARS = 4_000_000

NONE = 1 << 40


def merge_by_scan(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a short word: repeated scans of one contiguous rank array."""
    n = len(word)
    cut = list(range(n + 1))
    rank = [ranks.get(word[i : i + 2], NONE) for i in range(n - 1)]
    while rank:
        low = min(rank)
        if low == NONE:
            break
        i = rank.index(low)
        del cut[i + 1], rank[i]
        if i < len(rank):
            rank[i] = ranks.get(word[cut[i] : cut[i + 2]], NONE)
        if i:
            rank[i - 1] = ranks.get(word[cut[i - 1] : cut[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(cut, cut[1:])]


def merge_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a word of any length, in n log n steps."""
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        gone = end[i]
        alive[gone] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (q := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (q, i, end[stop]))
        if (p := before[i]) >= 0 and (q := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (q, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class _Words(dict):
    """Word -> ids, filled when a word is first met."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "replace")
        one = self.ranks.get(raw)
        if one is not None:
            ids: tuple[int, ...] = (one,)
        else:
            ids = tuple((merge_by_scan if len(raw) <= SCAN_BYTES else merge_by_heap)(raw, self.ranks))
        if len(raw) <= KEEP_BYTES:
            if len(self) >= KEEP_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Text -> ids of one vocabulary, given as the lines of its rank file."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.words = _Words(self.ranks)
        self.split = regex.compile(PATTERN).findall
        self.pieces = {i: w for w, i in self.ranks.items()}

    def ids(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.words.__getitem__, self.split(text)))) if text else 0

    def decode(self, ids) -> str:
        return b"".join(self.pieces[i] for i in ids).decode("utf-8", "replace")


def _file(folder: str, vocabulary: str) -> bytes:
    with open(os.path.join(folder, vocabulary + ".tiktoken"), "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of a vocabulary file on this machine."""
    return Encoder(_file(folder, vocabulary))


@lru_cache(maxsize=4)
def _parsed(folder: str, vocabulary: str, held: "Sent") -> Encoder:
    return Encoder(held.lines.value)


class Sent:
    """A vocabulary read by the driver and broadcast (a file of fixed size), so that workers need no copy on their disks."""

    def __init__(self, spark: SparkSession, folder: str, vocabulary: str):
        self.name, self.lines = (folder, vocabulary), spark.sparkContext.broadcast(_file(folder, vocabulary))

    def __hash__(self):
        return hash(self.name)

    def __eq__(self, other):
        return self.name == other.name

    def encoder(self) -> Encoder:
        """One encoder per Python worker and vocabulary."""
        return _parsed(*self.name, self)


def _batches(col: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with a bounded number of characters; at least one row each."""
    start, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(col), 0).to_pylist()):
        if size and size + n > BATCH_CHARS:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(col):
        yield start, len(col)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (list of integers) of every row, without special tokens.

    No shuffle: each row is encoded where it is read. Every row of ``df`` comes out exactly once, in the
    number it came in (repeated keys included); null and empty texts give ``[]``; other columns are left out,
    so clashing names can't matter; an empty table gives an empty table.
    """
    kind = df.schema[key].dataType.simpleString()
    sent = Sent(df.sparkSession, folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = sent.encoder()
        look, split = enc.words.__getitem__, enc.split
        for b in batches:
            for lo, hi in _batches(b.column(1)):
                part = b.slice(lo, hi - lo)
                flat, ends = [], [0]
                for t in part.column(1).to_pylist():
                    if t:
                        flat.append(np.fromiter(chain.from_iterable(map(look, split(t))), dtype=np.int32))
                        ends.append(ends[-1] + len(flat[-1]))
                    else:
                        ends.append(ends[-1])
                values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["k", "ids"])

    picked = df.select(df[key].alias("k"), df[text].cast("string").alias("t"))
    return picked.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens of each text instead of the text itself; 0 for null and empty texts."""
    rest = [c for c in df.columns if c != text]
    schema = df.select(*rest).schema.add(out, "long")
    sent = Sent(df.sparkSession, folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = sent.encoder()
        for b in batches:
            n = [enc.count(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*rest, out])

    return df.select(*rest, df[text].cast("string").alias("__text")).mapInArrow(run, schema)
