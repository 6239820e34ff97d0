"""Operator 1: byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved until a part is a leaf; a leaf is encoded by the rank file's own
library. Two neighbours are joined by re-encoding a window around the cut. The window
grows on both sides until each edge is a place where a character that is no white
space meets white space (or the end of the node). No alternative of the pre-token
pattern matches across such a place and none that ends there looks past it, so the
tokens outside the window are those of the whole text: the join is exact, and hence
associative, whatever the cuts were. Any pattern is tried on all short strings of the
kinds of characters that patterns tell apart; for one that fails no place counts as
stable, and a join encodes its node anew. Decoding concatenates the bytes of halves.

Nulls: a null text is the empty text; it has no tokens. Rows are kept one for one,
repeated ids included; other columns pass through only if named in ``keep``.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import common

_WHITE = frozenset(" \t\n\r\x0b\x0c")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@functools.cache
def separable(pattern: str, longest: int = 4) -> bool:
    """Whether a text splits where white space follows another character: matches of both sides are those of the whole."""
    find = regex.compile(pattern).finditer
    parts = lambda x: [m.group() for m in find(x)]
    for n in range(2, longest + 1):
        for letters in itertools.product("aS1'.é日 \n\t", repeat=n):
            text = "".join(letters)
            for i in range(1, n):
                if text[i] in _WHITE and not text[i - 1].isspace() and parts(text) != parts(text[:i]) + parts(text[i:]):
                    return False
    return True


class TreeCodec:
    """Encoder and decoder of single texts; ``leaf`` is the longest part (characters, ids) that isn't halved."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = 8192, window: int = 32):
        import tiktoken

        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf, self.window, self.separable = max(2, leaf), max(1, window), separable(pattern)
        self.sizes = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def _leaf(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode_to_numpy(text, disallowed_special=()), np.int32) if text else np.zeros(0, np.int32)

    def encode(self, text: str) -> np.ndarray:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, start: int, end: int) -> np.ndarray:
        if end - start <= self.leaf:
            return self._leaf(text[start:end])
        cut = (start + end) // 2
        return self.join(text, start, cut, end, self._encode(text, start, cut), self._encode(text, cut, end))

    def stable(self, text: str, at: int) -> bool:
        """Tokens on either side of ``at`` don't depend on the other side."""
        return self.separable and text[at] in _WHITE and not text[at - 1].isspace()

    def join(self, text: str, start: int, cut: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Tokens of text[start:end] from those of text[start:cut] and text[cut:end]."""
        if self.stable(text, cut):
            return np.concatenate([left, right])
        reach, a, b = self.window, None, None
        while a is None or b is None:
            if a is None:
                a = next((p for p in range(cut - 1, max(start, cut - reach), -1) if self.stable(text, p)), start if cut - reach <= start else None)
            if b is None:
                b = next((p for p in range(cut + 1, min(end, cut + reach)) if self.stable(text, p)), end if cut + reach >= end else None)
            reach *= 2
        middle = self._leaf(text[a:b])
        gone = len(text[a:cut].encode())
        ends = np.cumsum(self.sizes[left[::-1]])
        keep_left = len(left) - (int(np.searchsorted(ends, gone)) + 1 if gone else 0)
        gone = len(text[cut:b].encode())
        drop_right = int(np.searchsorted(np.cumsum(self.sizes[right]), gone)) + 1 if gone else 0
        return np.concatenate([left[:keep_left], middle, right[drop_right:]])

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return self.library.decode_bytes(ids.tolist())
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_CODECS: dict[tuple, TreeCodec] = {}


def codec(path: str, pattern: str, leaf: int) -> TreeCodec:
    """One codec for each worker process."""
    key = (path, pattern, leaf)
    if key not in _CODECS:
        _CODECS[key] = TreeCodec(read_ranks(path), pattern, leaf)
    return _CODECS[key]


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), leaf: int = 8192) -> DataFrame:
    """``keep`` columns plus ``ids`` (array<int>, the tokens of the whole text). ``path`` must be readable on every node."""
    source = df.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(path, pattern, leaf)
        for batch in common.slices(batches, "__text"):
            found = [tree.encode(x or "") for x in common.column(batch, "__text").to_pylist()]
            ids = common.list_array(np.concatenate([*found, np.zeros(0, np.int32)]), np.array([len(x) for x in found]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*keep, "ids"])

    return common.arrow_map(source, run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), leaf: int = 8192) -> DataFrame:
    """``encode`` and ``decode`` in one pass: ``keep`` columns plus ``ids`` and ``decoded``."""
    source = df.select(*keep, F.col(text_col).cast("string").alias("__text"))
    added = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.BinaryType(), False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(path, pattern, leaf)
        for batch in common.slices(batches, "__text"):
            found = [tree.encode(x or "") for x in common.column(batch, "__text").to_pylist()]
            ids = common.list_array(np.concatenate([*found, np.zeros(0, np.int32)]), np.array([len(x) for x in found]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, pa.array([tree.decode(x) for x in found], pa.binary())], [*keep, "ids", "decoded"])

    return common.arrow_map(source, run, T.StructType([*source.schema.fields[:-1], *added]))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), leaf: int = 8192) -> DataFrame:
    """``keep`` columns plus ``decoded`` (binary, the bytes of the ids; a null list has none)."""
    source = df.select(*keep, F.col(ids_col).alias("__ids"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("decoded", T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(path, pattern, leaf)
        for whole in batches:
            for row in range(0, whole.num_rows, 1000):
                batch = whole.slice(row, 1000)
                ids = common.column(batch, "__ids")
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum([0, *(n or 0 for n in ids.value_lengths().to_pylist())])
                out = [tree.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*keep, "decoded"])

    return common.arrow_map(source, run, schema)
