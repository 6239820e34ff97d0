"""Operator 6: token counts of whole texts with overlap resynchronisation.

A text of up to ``chunk`` characters is encoded at once. A longer one is encoded in
chunks that overlap; the pieces carry their offsets. Two neighbouring chunks are
spliced at a place in their overlap where both have a piece border and a space follows
a character that is no space. No piece of the vocabulary holds a space after another
character (checked on loading), so no merge crosses such a place, and neither the
chunk's start (with its dummy prefix) nor its end reaches past it. Where no place
aligns, the overlap is doubled and the chunk encoded again, up to the text's end.
A vocabulary with such pieces allows no proof; its texts are encoded whole.

Null text: empty, no tokens. Rows are kept one for one, repeated ids included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import common

_SPACE = "▁"


class Counter:
    def __init__(self, path: str, chunk: int = 16384, overlap: int = 256):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        self.provable = not any(re.search(f"[^{_SPACE}]{_SPACE}|[^ ] ", x) for x in pieces)
        self.chunk, self.overlap = chunk, overlap

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        short = [i for i, x in enumerate(texts) if not self.provable or len(x) <= self.chunk]
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1), strict=True):
            out[i] = len(ids)
        for i in set(range(len(texts))) - set(short):
            out[i] = self.count_huge(texts[i])
        return out

    def borders(self, text: str, start: int, end: int) -> np.ndarray:
        """Which character of the whole text each piece of text[start:end] begins at, one entry a piece."""
        raw = text[start:end].encode()
        begins = [x.begin for x in self.model.encode(text[start:end], return_type="proto").pieces]  # bytes
        character = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        return np.append(character - 1, end - start)[begins] + start

    def count_huge(self, text: str) -> int:
        total, splice, overlap = 0, 0, self.overlap
        start, end = 0, self.chunk
        mine = self.borders(text, start, end)
        while end < len(text):
            begin = max(splice + 1, end - overlap)
            stop = min(len(text), max(begin + self.chunk, end + overlap))
            then = self.borders(text, begin, stop)
            place = self.aligned(text, mine, then, begin + 1, end)
            if place is not None:
                total += int(((mine >= splice) & (mine < place)).sum())
                start, end, mine, splice, overlap = begin, stop, then, place, self.overlap
            elif begin > splice + 1:
                overlap *= 2
            else:  # the overlap is all of the chunk: lengthen the chunk itself
                end = min(len(text), 2 * end - start)
                mine = self.borders(text, start, end)
        return total + int((mine >= splice).sum())

    @staticmethod
    def aligned(text: str, one: np.ndarray, two: np.ndarray, low: int, high: int) -> int | None:
        for p in np.intersect1d(one[(one >= low) & (one < high)], two)[::-1]:
            if text[p] == " " and text[p - 1] not in (" ", _SPACE):
                return int(p)
        return None


_COUNTERS: dict[tuple, Counter] = {}


def token_counts(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk: int = 16384, overlap: int = 256) -> DataFrame:
    """``keep`` columns plus ``n_bytes`` (UTF-8) and ``n_tokens``, both long. ``path`` must be readable on every node."""
    source = df.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, chunk, overlap)
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(*key)
        for batch in common.slices(batches, "__text", 1 << 20):
            texts = common.column(batch, "__text")
            _, at = common.byte_view(texts)
            counts = _COUNTERS[key].count([x or "" for x in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(at), pa.int64()), pa.array(counts, pa.int64())], [*keep, "n_bytes", "n_tokens"])

    return common.arrow_map(source, run, schema)
