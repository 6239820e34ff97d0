"""Operator 9: toxicity by FTRL-proximal logistic regression over hashed n-grams.

Features of a text: its words, pairs of neighbouring words and pairs one word apart
(skip-grams), lower-cased (A-Z) and hashed to 2**``bits`` places; a feature is present or
not. FTRL-proximal keeps a rate for each coordinate, and its L1 term leaves few weights
other than 0; those are broadcast (at most ``most_rows`` training texts, each adding at
most its own features, bound their number) and score every word of every text.

Training takes labelled rows only, at most ``most_rows`` of them (those with the least
hashes of their ids) of at most ``most_bytes`` bytes each; scoring covers every text. Null or empty texts have no features and score the bias. Rows with
a null label aren't trained on; repeated rows are each scored.
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

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every n-gram and skip-gram, repeats included."""
    data = _LOWER[data]
    start, end, first = common.word_spans(data, at, _WORD)
    word = common.span_hash(common.prefix_hash(data), start, end)
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    shift, factor = np.uint64(64 - bits), np.uint64(0xC6A4A7935BD1E995)
    places, owners = [common.mix64(word) >> shift], [text]
    for gap, salt in ((1, np.uint64(0x2545F4914F6CDD1D)), (2, np.uint64(0x9FB21C651E98DF25))):
        same = text[:-gap] == text[gap:]
        both = common.mix64(word[:-gap] * factor + word[gap:] + salt) >> shift
        places.append(both[same])
        owners.append(text[:-gap][same])
    return np.concatenate(owners), np.concatenate(places).astype(np.int64)


@dataclass
class Model:
    """Weights other than 0, sorted by place."""

    bits: int
    bias: float
    places: np.ndarray
    weights: np.ndarray

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        total = np.full(n, self.bias)
        if len(data) and len(self.places):
            text, place = features(data, at, self.bits)
            table = self._table()
            hit = np.flatnonzero(table[place] >= 0)
            text, index = text[hit], table[place[hit]]
            once = np.unique(text * len(self.places) + index)
            total += np.bincount(once // len(self.places), self.weights[once % len(self.places)], n)
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))

    def _table(self) -> np.ndarray:
        if not hasattr(self, "_cached"):
            self._cached = np.full(1 << self.bits, -1, np.int32)
            self._cached[self.places] = np.arange(len(self.places), dtype=np.int32)
        return self._cached

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_cached"}


def train(rows: Iterable[tuple[int, bytes, int]], bits: int = 22, epochs: int = 5, alpha: float = 2.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.05, seed: int = 3) -> Model:
    """FTRL-proximal: z and n for each coordinate; the weight follows from them when it is used.

    ``rows`` are (order, text, label); of a text only its places are held.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0
    sets = []
    for order, text, label in rows:
        data = np.frombuffer(text, np.uint8)
        sets.append((order, np.unique(features(data, np.array([0, len(data)]), bits)[1]).astype(np.int32) if len(data) else np.zeros(0, np.int32), label))
    sets.sort(key=lambda x: x[0])

    def weight(z_at, n_at, l1_at):
        return np.where(np.abs(z_at) <= l1_at, 0.0, (np.sign(z_at) * l1_at - z_at) / ((beta + np.sqrt(n_at)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(sets)):
            _, at, label = sets[i]
            w, b = weight(z[at], n[at], l1), float(weight(np.float64(bias_z), np.float64(bias_n), 0.0))
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - label
            new = n[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / alpha * w
            n[at] = new
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * b
            bias_n += g * g
    places = np.flatnonzero(np.abs(z) > l1)
    return Model(bits, float(weight(np.float64(bias_z), np.float64(bias_n), 0.0)), places, weight(z[places], n[places], l1))


def fit(docs: DataFrame, labels: DataFrame, chosen: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 20_000, most_bytes: int = 1 << 16, **options) -> Model:
    """Train on at most ``most_rows`` labelled rows for which ``chosen`` (a condition on the id column) holds."""
    model = train(common.labelled_sample(docs, labels, chosen, id_col, text_col, label_col, most_rows, most_bytes), **options)
    common.release()
    return model


def score(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``score`` double, over whole texts."""
    source = df.select(*keep, F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("__bytes"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "__bytes", 2 << 20):
            p = shared.value.score(*common.byte_view(common.column(batch, "__bytes")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64())], [*keep, "score"])

    return common.arrow_map(source, run, T.StructType([*source.schema.fields[:-1], T.StructField("score", T.DoubleType(), False)]))
