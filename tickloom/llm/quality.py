"""Operator 7: quality by a byte-level convolutional network in numpy.

Filters of four bytes, all of them learned, slide over every byte of a text; their table
lookups are summed in pairs of bytes. Chunks of 512 bytes that overlap by 128 cover the
whole text, and each filter is max-pooled in each chunk. A text's means and maxima over
its chunks go through one logistic unit. Filters and unit are trained together by Adam;
gradients reach a filter through the bytes at its maxima.

Training takes at most ``most_rows`` labelled texts of at most ``most_bytes`` bytes (the
least id hashes); scoring covers every byte of every text. A null or empty text is one
chunk of padding. Repeated rows are each scored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import common

BLOCK, CHUNK, STEP, TAPS = 128, 4, 3, 4  # bytes in a block; blocks in a chunk, and between chunk starts; bytes in a filter
PAD = TAPS  # zero bytes behind each text, so that no filter reaches another text


def layout(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Padded bytes, and first block, last block (exclusive) of each chunk, and first chunk of each text (n+1)."""
    sizes = np.diff(at)
    blocks = (sizes + PAD + BLOCK - 1) // BLOCK
    begin = np.append(0, np.cumsum(blocks))
    padded = np.zeros(int(begin[-1]) * BLOCK + TAPS, np.uint8)
    for i in range(len(sizes)):
        padded[begin[i] * BLOCK : begin[i] * BLOCK + sizes[i]] = data[at[i] : at[i + 1]]
    chunks = np.maximum(1, -(-(blocks - CHUNK) // STEP) + 1)
    first = np.append(0, np.cumsum(chunks))
    inner = np.arange(first[-1]) - np.repeat(first[:-1], chunks)
    start = np.repeat(begin[:-1], chunks) + inner * STEP
    end = np.minimum(start + CHUNK, np.repeat(begin[1:], chunks))
    return padded, start, end, first


def _reduce(op, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """op over x[start:end] for each pair along the last axis."""
    x = np.concatenate([x, x[..., -1:]], axis=-1)
    return op.reduceat(x, np.stack([start, end], axis=1).ravel(), axis=-1)[..., ::2]


@dataclass
class Network:
    taps: np.ndarray  # TAPS x 256 x filters
    bias: np.ndarray  # filters
    weights: np.ndarray  # 2 * filters: of the means, then of the maxima
    offset: float

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """filters x 65536 lookups for the first and the second pair of bytes (little-endian pairs)."""
        pair = lambda a, b: np.ascontiguousarray((self.taps[b][:, None, :] + self.taps[a][None, :, :]).reshape(65536, -1).T.astype(np.float32))
        return pair(0, 1), pair(2, 3)

    def respond(self, padded: np.ndarray, tables: tuple[np.ndarray, np.ndarray], ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each filter's response at each byte; ``ends`` are the ends of texts in blocks, where filters would see the next text."""
        n = len(padded) - TAPS
        over = (ends[:, None] * BLOCK - np.arange(1, TAPS)).ravel()
        pairs = padded[:-1].astype(np.uint16) | (padded[1:].astype(np.uint16) << 8)
        for f in range(len(self.bias)):
            out = tables[0][f].take(pairs[:n]) + tables[1][f].take(pairs[2 : n + 2])
            out[over] = tables[0][f][0] + tables[1][f][0]
            yield f, out.reshape(-1, BLOCK)

    def pooled(self, data: np.ndarray, at: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """texts x 2 * filters"""
        padded, start, end, first = layout(data, at)
        top = np.empty((len(self.bias), (len(padded) - TAPS) // BLOCK), np.float32)
        for f, out in self.respond(padded, tables, end[first[1:] - 1]):
            top[f] = out.max(axis=1)
        return pool(np.maximum(_reduce(np.maximum, top, start, end) + self.bias[:, None], 0).astype(np.float32), first)

    def score(self, data: np.ndarray, at: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        logits = self.pooled(data, at, tables) @ self.weights + self.offset
        return 1 / (1 + np.exp(-np.clip(logits, -35, 35)))


def pool(chunk: np.ndarray, first: np.ndarray) -> np.ndarray:
    mean = np.add.reduceat(chunk, first[:-1], axis=1) / np.diff(first)
    return np.concatenate([mean, np.maximum.reduceat(chunk, first[:-1], axis=1)]).T.astype(np.float64)


def train(rows: Iterable[tuple[int, bytes, int]], filters: int = 16, epochs: int = 8, batch: int = 64, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> Network:
    sample = sorted(rows, key=lambda x: x[0])
    texts = [x[1] for x in sample]
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (TAPS, 256, filters)), np.zeros(filters), rng.normal(0, 0.1, 2 * filters), 0.0)
    if not texts:
        return net
    y = np.array([x[2] for x in sample], float)
    state = [np.zeros_like(x) for x in (net.taps, net.bias, net.weights, np.zeros(1))]
    power = [np.zeros_like(x) for x in state]
    turn = 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            turn += 1
            data = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
            at = np.append(0, np.cumsum([len(texts[i]) for i in rows]))
            padded, start, end, first = layout(data, at)
            tables = net.tables()
            chunk = np.zeros((filters, len(start)), np.float32)
            where = np.zeros((filters, len(start)), np.int64)
            for f, out in net.respond(padded, tables, end[first[1:] - 1]):
                inner, top = out.argmax(axis=1), out.max(axis=1)
                best = _reduce(np.maximum, top, start, end)
                for k in range(CHUNK):
                    block = np.minimum(start + k, end - 1)
                    hit = top[block] == best
                    where[f, hit] = block[hit] * BLOCK + inner[block[hit]]
                chunk[f] = np.maximum(best + net.bias[f], 0)
            x = pool(chunk, first)
            p = 1 / (1 + np.exp(-np.clip(x @ net.weights + net.offset, -35, 35)))
            g = (p - y[rows]) / len(rows)
            grads = [np.zeros_like(net.taps), np.zeros(filters), x.T @ g + decay * net.weights, np.array([g.sum()])]
            owner = np.repeat(np.arange(len(rows)), np.diff(first))
            counts = np.diff(first)[owner]
            for f in range(filters):
                is_max = chunk[f] == x[owner, filters + f].astype(np.float32)
                d = g[owner] * (net.weights[f] / counts + net.weights[filters + f] * is_max) * (chunk[f] > 0)
                grads[1][f] = d.sum()
                for t in range(TAPS):
                    grads[0][t, :, f] += np.bincount(padded[where[f] + t], d, 256)
            values = [net.taps, net.bias, net.weights, np.array([net.offset])]
            step = rate * (1 - epoch / epochs)
            for v, grad, m, s in zip(values, grads, state, power, strict=True):
                m += 0.1 * (grad - m)
                s += 0.01 * (grad * grad - s)
                v -= step * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.99**turn)) + 1e-8)
            net.offset = float(values[3][0])
    return net


def fit(docs: DataFrame, labels: DataFrame, chosen: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 4000, most_bytes: int = 1 << 16, **options) -> Network:
    """Train on at most ``most_rows`` labelled rows for which ``chosen`` (a condition on the id column) holds."""
    network = train(common.labelled_sample(docs, labels, chosen, id_col, text_col, label_col, most_rows, most_bytes), **options)
    common.release()
    return network


def score(df: DataFrame, network: Network, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``score`` double, over whole texts."""
    source = df.select(*keep, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("__bytes"))
    shared = df.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables()
        for batch in common.slices(batches, "__bytes", 1 << 20):
            p = net.score(*common.byte_view(common.column(batch, "__bytes")), tables)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64())], [*keep, "score"])

    return common.arrow_map(source, run, T.StructType([*source.schema.fields[:-1], T.StructField("score", T.DoubleType(), False)]))
