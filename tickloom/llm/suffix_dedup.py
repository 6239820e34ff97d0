"""Operator 4: removal of repeated substrings by external induced suffix sorting.

Every byte that a string of ``depth`` bytes covers which also starts anywhere else goes;
texts are taken as UTF-8 and matches never cross texts. Steps:

1. Anchors. Each window of ``depth`` bytes is assigned to the place of the smallest hash
   of the ``GRAM``-byte strings in it. Equal windows have their anchor at the same
   offset with the same hash, so a window whose anchor hash occurs once is unique. This
   drops most of the corpus without loss.
2. Shards. For each anchor that occurs again, the text its windows cover goes to the
   shard of its hash: equal windows meet in one shard, and each window is in one only.
3. Each shard is suffix-sorted by external induced sorting with common-prefix values
   (module ``induced``); windows with a common prefix of ``depth`` bytes are repeats.
4. Runs of repeats go back to their texts as spans.

Equal texts are one text with a multiplicity, counted by digest before anything is
shuffled: if it is above one, each of its windows is a repeat. Null text: empty.
Repeated rows count as separate texts. Ids are passed through and never compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import common, induced

DEPTH = 400
GRAM = 32
#: Bytes of text that a task sorts at once; a single anchor's windows may exceed it.
SHARD_BYTES = 2 << 20


def window_anchors(data: np.ndarray, depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, number of windows, repeats) of each run of windows of one text that share an anchor hash.

    Neighbouring runs of the same hash (periodic text) are one run; ``repeats`` tells that the hash occurs more than
    once in what the run covers, so that its windows may repeat each other.
    """
    windows = len(data) - depth + 1
    if windows <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)
    prefix = common.prefix_hash(data)
    _, down = common.PowerTable.get(len(prefix))
    grams = common.mix64((prefix[gram:] - prefix[:-gram]) * down[: len(prefix) - gram])
    least = sliding_min(grams, depth - gram + 1)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    counts, hashes = np.diff(first, append=windows), least[first]
    repeats = [np.count_nonzero(grams[a : a + n + depth - gram] == h) > 1 for a, n, h in zip(first.tolist(), counts.tolist(), hashes, strict=True)]
    return hashes, first.astype(np.int32), counts.astype(np.int32), np.array(repeats, bool)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by minima from the start and from the end of blocks of that width."""
    n = len(x)
    pad = np.full(-n % width, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _anchors(batches: Iterator[pa.RecordBatch], depth: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "bytes"):
        data, at = common.byte_view(common.column(batch, "bytes"))
        found = [window_anchors(data[a:b], depth, gram) for a, b in zip(at[:-1], at[1:], strict=True)]
        row = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
        if not len(row):
            continue
        h, start, n, repeats = (np.concatenate([x[i] for x in found]) for i in range(4))
        keys = [common.column(batch, k).take(pa.array(row)) for k in ("k1", "k2")]
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *keys, pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(repeats, pa.bool_())], ["h", "k1", "k2", "start", "n", "repeats"])


def _contexts(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """The text that the windows of each chosen anchor cover, once an anchor."""
    for batch in common.slices(batches, "bytes"):
        data, at = common.byte_view(common.column(batch, "bytes"))
        out: list[list] = [[], [], [], [], []]
        columns = [common.column(batch, x).to_pylist() for x in ("k1", "k2", "runs")]
        for i, (k1, k2, runs) in enumerate(zip(*columns, strict=True)):
            for run in runs:
                begin = int(at[i]) + run["start"]
                for x, y in zip(out, (run["h"], k1, k2, run["start"], data[begin : begin + run["n"] + depth - 1].tobytes()), strict=True):
                    x.append(y)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["h", "k1", "k2", "start", "context"])


def _sort_shards(batches: Iterator[pa.RecordBatch], depth: int, shard_bytes: int, memory: int) -> Iterator[pa.RecordBatch]:
    """Rows come in order of h; whole anchors are gathered up to ``shard_bytes``, in a scratch file beyond ``memory`` bytes,
    and sorted together."""
    kind = pa.list_(pa.struct([pa.field("a", pa.int32(), False), pa.field("b", pa.int32(), False)]))

    def judged(keys: list[tuple], shard: induced.Gathered) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (h, c, many), size, hit in zip(keys, shard.sizes, induced.repeated(shard, depth, memory), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            runs = [{"a": 0, "b": size}] if many else [{"a": int(a), "b": int(b) + depth - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]
            out += [(h, c, runs)] if runs else []
            if len(out) >= 10_000:
                yield told(out)
                out = []
        yield told(out)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], kind)], ["h", "c", "runs"])

    keys: list[tuple] = []
    shard = induced.Gathered(memory)
    for batch in batches:
        for h, c, text, many in zip(*(common.column(batch, x).to_pylist() for x in ("h", "c", "context", "many")), strict=True):
            if shard.size >= shard_bytes and keys[-1][0] != h:
                yield from judged(keys, shard)
                keys, shard = [], induced.Gathered(memory)
            keys.append((h, c, many))
            shard.add(text)
    if keys:
        yield from judged(keys, shard)


def _merged(runs: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


_SPANS = "array<struct<start: int, end: int>>"


def repeated_spans(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), depth: int = DEPTH, shard_bytes: int = SHARD_BYTES, memory: int = 256 << 20) -> DataFrame:
    """``keep`` columns plus ``bytes`` (binary, the text) and ``spans`` (sorted disjoint byte ranges to remove)."""
    gram = max(1, min(GRAM, depth // 2))
    digest = F.sha2(F.col("bytes"), 256)
    half = lambda i: F.conv(F.substring("digest", i, 15), 16, 10).cast("long")
    texts = df.select(*keep, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("bytes"))
    texts = texts.withColumn("digest", digest).withColumns({"k1": half(1), "k2": half(16)}).drop("digest")
    # One row of each text goes on, the one of the least salted hash of its kept columns: equal texts have equal windows.
    long = texts.where(F.octet_length("bytes") >= depth).withColumn("uid", F.xxhash64(*keep))
    copies = long.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("uid").alias("uid"))
    copies = common.materialise(copies, "suffix-texts")

    anchors = common.arrow_map(long.select("k1", "k2", "bytes"), lambda b: _anchors(b, depth, gram), "h long, k1 long, k2 long, start int, n int, repeats boolean")
    anchors = common.materialise(anchors, "suffix-anchors")
    place = F.struct("k1", "k2", "start")
    ends = (F.min(place).alias("p"), F.max(place).alias("q"))
    again = anchors.groupBy("h").agg(*ends, F.max("repeats").alias("r")).where("p <> q or r").select("h")
    runs = anchors.join(again, "h").groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "start", "n")).alias("runs"))

    chosen = long.select("k1", "k2", "uid", "bytes").join(runs.join(copies, ["k1", "k2"]), ["k1", "k2", "uid"])
    found = common.arrow_map(chosen.select("k1", "k2", "runs", "bytes"), lambda b: _contexts(b, depth), "h long, k1 long, k2 long, start int, context binary")
    contexts = common.materialise(found.withColumn("c", F.xxhash64("context")), "suffix-contexts")
    common.discard(anchors)
    # Equal contexts are sorted once; map-side aggregation merges those of a hot anchor before the shuffle.
    unique = contexts.groupBy("h", "c", "context").agg(*ends).select("h", "c", "context", (F.col("p") != F.col("q")).alias("many"))
    shards = unique.repartition("h").sortWithinPartitions("h")
    verdicts = common.arrow_map(shards, lambda b: _sort_shards(b, depth, shard_bytes, memory), "h long, c long, runs array<struct<a: int, b: int>>")
    told = contexts.select("h", "c", "k1", "k2", "start").join(verdicts, ["h", "c"]).select("k1", "k2", F.expr("transform(runs, r -> struct(r.a + start as a, r.b + start as b))").alias("runs"))
    spans = told.groupBy("k1", "k2").agg(F.flatten(F.collect_set("runs")).alias("runs"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([pa.field("start", pa.int32()), pa.field("end", pa.int32())]))
        for b in batches:
            out = [_merged([(r["a"], r["b"]) for r in x]) for x in common.column(b, "runs").to_pylist()]
            yield pa.RecordBatch.from_arrays([common.column(b, "k1"), common.column(b, "k2"), pa.array(out, kind)], ["k1", "k2", "part"])

    merged = common.arrow_map(spans, merge, f"k1 long, k2 long, part {_SPANS}")
    told = common.materialise(copies.where("copies > 1").join(merged, ["k1", "k2"], "full").select("k1", "k2", F.coalesce(F.col("copies") > 1, F.lit(False)).alias("whole"), "part"), "suffix-spans")
    common.discard(contexts, copies)
    out = texts.join(told, ["k1", "k2"], "left")
    everything = F.array(F.struct(F.lit(0).alias("start"), F.octet_length("bytes").alias("end")))
    none = F.array().cast(_SPANS)
    return out.select(*keep, "bytes", F.when(F.col("whole"), everything).otherwise(F.coalesce("part", none)).alias("spans"))


def kept_bytes(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), whole_characters: bool = False, least_words: int = 0) -> DataFrame:
    """From ``repeated_spans``: ``keep`` columns, ``spans`` and ``kept`` (binary, the bytes outside of the spans).

    With ``whole_characters`` a UTF-8 character goes entirely if a span covers any of its bytes, so that valid text stays
    valid and no character is put together from parts of two. Spans of fewer than ``least_words`` words (runs of bytes
    other than ASCII white space, parts of words at the edges included) stay in the text and are left out of ``spans``.
    """

    def widened(text: bytes, a: int, b: int) -> tuple[int, int]:
        while 0 < a < len(text) and text[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "bytes"):
            out = []
            told = common.column(batch, "spans").to_pylist()
            for i, text in enumerate(common.column(batch, "bytes").to_pylist()):
                if least_words:
                    told[i] = [s for s in told[i] if len(text[s["start"] : s["end"]].split()) >= least_words]
                cuts = [(s["start"], s["end"]) for s in told[i]]
                if whole_characters:
                    cuts = [widened(text, a, b) for a, b in cuts]
                edge = [0, *(x for s in cuts for x in s), len(text)]
                out.append(b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([*(common.column(batch, x) for x in keep), pa.array(told, common.column(batch, "spans").type), pa.array(out, pa.binary())], [*keep, "spans", "kept"])

    source = df.select(*keep, "spans", "bytes")
    return common.arrow_map(source, run, T.StructType([*source.schema.fields[:-1], T.StructField("kept", T.BinaryType())]))
