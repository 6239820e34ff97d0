"""Operator 3: benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 10 consecutive words of each benchmark item (an item of
fewer words is one window). Patterns of one length are searched together: the shift
table gives, for a block of two words, how far the search may jump because no pattern
can end sooner; blocks that no pattern holds allow the longest jump. Where the shift
is 0, the suffix hash (the last block) selects the patterns to test, and a direct
comparison of the words confirms an occurrence.

The benchmark is a test set and doesn't grow with the corpus, but its size is checked
all the same: its windows are cut into shards of at most ``shard_bytes``; each shard
is broadcast by itself and searched by a stage of its own that adds to the spans found
so far, in one pass over the documents and without a shuffle.

Nulls: a null text has no words; items with a null id or without words match nothing.
Repeated rows are each answered; repeated items count once per distinct id.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import common

WINDOW = 10
#: Lower-cases A-Z and turns every byte outside of 0-9, a-z and 80-FF into a space.
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_TABLE).split()


def windows_of(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    width = min(width, len(words))
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


class WuManber:
    """Search for word patterns that all have ``length`` words."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], tuple[int, ...]]):
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.shift: dict = {}
        self.suffix: dict = defaultdict(list)
        for words, owners in patterns.items():
            for end in range(self.block, length + 1):
                key = self._key(words, end)
                self.shift[key] = min(self.shift.get(key, self.most), length - end)
            self.suffix[self._key(words, length)].append((words, owners))
        self.suffix = dict(self.suffix)

    def _key(self, words, end: int):
        return (words[end - 2], words[end - 1]) if self.block == 2 else words[end - 1]

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(start, items) of every occurrence."""
        at, n, length, most, get, pairs = self.length, len(words), self.length, self.most, self.shift.get, self.block == 2
        while at <= n:
            key = (words[at - 2], words[at - 1]) if pairs else words[at - 1]
            jump = get(key, most)
            if jump:
                at += jump
                continue
            for pattern, owners in self.suffix[key]:
                if all(x == y for x, y in zip(pattern, words[at - length : at], strict=True)):
                    yield at - length, owners
            at += 1


def _shards(benchmark: DataFrame, id_col: str, text_col: str, width: int, shard_bytes: int) -> Iterator[dict]:
    """Patterns by length, {length: {words: ids}}, shard by shard; the driver holds one at a time."""
    shard: dict = defaultdict(lambda: defaultdict(set))
    size = 0
    for item, text in benchmark.select(id_col, text_col).where(F.col(id_col).isNotNull()).toLocalIterator():
        for window in windows_of(words_of(text), width):
            shard[len(window)][window].add(item)
            size += sum(map(len, window)) + 60 * len(window)
        if size >= shard_bytes:
            yield {n: {w: tuple(sorted(ids)) for w, ids in x.items()} for n, x in shard.items()}
            shard.clear()
            size = 0
    if shard:
        yield {n: {w: tuple(sorted(ids)) for w, ids in x.items()} for n, x in shard.items()}


def find(df: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, shard_bytes: int = 64 << 20) -> DataFrame:
    """``keep`` columns plus ``n_words`` long, ``spans`` array<struct<start, end>> (disjoint, sorted word ranges that
    any window covers; end exclusive) and ``items`` array<long> (sorted distinct ids of the items that occur)."""
    spark = df.sparkSession
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False)
    added = [T.StructField("n_words", T.LongType(), False), T.StructField("spans", span, False), T.StructField("items", T.ArrayType(T.LongType(), False), False)]
    flat = df.select(*keep, F.col(text_col).cast("string").alias("__text"))
    out = T.StructType([*flat.schema.fields, *added])
    kinds = [pa.int64(), pa.list_(pa.struct([pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False)])), pa.list_(pa.int64())]

    def stage(shard, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searchers = [WuManber(n, x) for n, x in sorted(shard.value.items())]
            for batch in common.slices(batches, "__text"):
                before = None if first else (common.column(batch, "spans").to_pylist(), common.column(batch, "items").to_pylist())
                counts, spans, items = [], [], []
                for i, text in enumerate(common.column(batch, "__text").cast(pa.binary()).to_pylist()):
                    words = words_of(text)
                    found = [(x["start"], x["end"]) for x in before[0][i]] if before else []
                    owners = set(before[1][i]) if before else set()
                    for s in searchers:
                        for start, ids in s.search(words):
                            found.append((start, start + s.length))
                            owners.update(ids)
                    merged: list[list[int]] = []
                    for a, b in sorted(found):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    counts.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in merged])
                    items.append(sorted(owners))
                arrays = [pa.array(x, kind) for x, kind in zip((counts, spans, items), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], *arrays], [x.name for x in out])

        return run

    first = True
    for patterns in _shards(benchmark, item_id, item_text, width, shard_bytes):
        flat = common.arrow_map(flat, stage(spark.sparkContext.broadcast(patterns), first), out)
        first = False
    if first:
        flat = common.arrow_map(flat, stage(spark.sparkContext.broadcast({}), True), out)
    return flat.drop("__text")
