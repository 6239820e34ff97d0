"""Helpers that several operators of the subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.storage import discard, fresh_path, materialise  # noqa: F401  the operators take them from here

#: Bytes of text that a kernel works on at once; bounds its temporary arrays.
SLICE_BYTES = 1 << 20


#: Bytes of an Arrow batch between the JVM and a worker; bounds both sides' buffers, however long the texts are.
ARROW_BYTES = 8 << 20


def arrow_map(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes; a worker gives freed memory back to the system when a task ends."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and its n+1 offsets into them, without copying a text."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of a piece hold about ``most`` bytes (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = byte_view(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (constants of the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93


class PowerTable:
    """Powers of the rolling-hash base and their inverses, grown on demand and kept by the worker."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLICE_BYTES + 1)
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum over j<i of code(data[j]) * base**j, modulo 2**64."""
    up, _ = PowerTable.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    _, down = PowerTable.get(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes with ``is_word``) and, per text, the index of its first word (n+1).

    A word never crosses the border of two texts.
    """
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, at)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges`` (a long, b long): (id, component), component = smallest id.

    Random-priority contraction: each round every vertex joins its neighbour (or itself)
    with the smallest salted hash, edges are rewritten between the winners, and the
    graph shrinks by a constant factor however its ids are ordered. All steps are
    partial aggregations and key joins; nothing reaches the driver but row counts.
    """
    graph = materialise(edges.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), name)
    names = materialise(graph.selectExpr("a id").union(graph.selectExpr("b id")).distinct().selectExpr("id", "id top"), name)
    turn, steps, written = 0, [], names
    while not graph.isEmpty():
        rank = lambda c, t=turn: F.struct(F.xxhash64(F.col(c), F.lit(t)).alias("h"), F.col(c).alias("v"))
        both = graph.union(graph.select("b", "a")).toDF("a", "b")
        best = both.groupBy(F.col("a").alias("id")).agg(F.min(rank("b")).alias("n"))
        step = materialise(best.select("id", F.when(rank("id") < F.col("n"), F.col("id")).otherwise(F.col("n.v")).alias("to")), name)
        steps.append(step)
        names = names.join(step, names["top"] == step["id"], "left").select(names["id"], F.coalesce("to", "top").alias("top"))
        last, joined = graph, graph.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").where("x <> y")
        graph = materialise(joined.selectExpr("least(x, y) a", "greatest(x, y) b").distinct(), name)
        discard(last)
        turn += 1
        if turn % 3 == 0:
            names = materialise(names, name)
            discard(written, *steps)
            written, steps = names, []
    if steps:
        names = materialise(names, name)
        discard(written, *steps)
    least = names.groupBy("top").agg(F.min("id").alias("component"))
    return names.join(least, "top").select("id", "component")


def labelled_sample(docs: DataFrame, labels: DataFrame, chosen, id_col: str, text_col: str, label_col: str, most_rows: int, most_bytes: int) -> Iterator[tuple[int, bytes, int]]:
    """Training rows (order, text, label): the ``most_rows`` labelled ids of least hash for which ``chosen`` holds, with
    texts of up to ``most_bytes`` bytes. Of rows that share an id the least text counts. Its size is bounded by these
    parameters whatever the tables hold; the driver reads it a partition at a time. ``order`` is unique and doesn't
    depend on partitions: sort by it."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = (known if chosen is None else known.where(chosen)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    known = known.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(most_rows)
    known = known.withColumn("__order", F.xxhash64("__id"))
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("__b"))
    rows = texts.where(F.octet_length("__b") <= most_bytes).join(F.broadcast(known), "__id")
    rows = rows.groupBy("__id", "__order", "__y").agg(F.min("__b").alias("__b")).coalesce(16)
    held = materialise(rows, "labelled-sample")
    for r in held.select("__order", "__b", "__y").toLocalIterator():
        yield r[0], bytes(r[1]), r[2]
    discard(held)
