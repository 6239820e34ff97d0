"""Operator 5: near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A shingle is ``words`` consecutive words (a shorter text is one shingle). Two
permutations make the signature: sigma scatters shingles over a universe of 2**20 places
and pi, circularly shifted by k, gives coordinate k as the least pi value of a text's
places. The shifted values of a place are a stretch of the pi table, so a signature is
the element-wise minimum of stretches. ``bands`` bands of ``rows`` coordinates yield
candidates; at the limit similarity of 0.75 a pair escapes 32 bands of 4 rows with
probability 5e-6, and less above it.

Texts with equal shingle sets form one class; only class representatives are compared.
In each bucket all members are first compared with the smallest one.
Members of a bucket that aren't yet in one component are then matched by 768 more
coordinates of the same circulant signature, in blocks: a pair goes on to verification if
at least ``agree`` of them are equal (a pair at the limit has 576 on average, and fewer
than 519 with probability 1e-6) and the bucket is the first one that both share. So every
candidate pair is either in one component, or verified on full sets, or ruled out by
its signature, and no bucket is expanded into all its pairs. Shingle sets are made for
members of shared buckets alone, found by a Bloom filter of fixed size; texts aren't
shuffled.

Null or blank texts have an empty set and link with nothing. Rows that share an id are
one vertex. A null id links with nothing and has a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import common

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
UNIVERSE_BITS = 20
MATCH = 768


def shingle_hashes(data: np.ndarray, at: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    data = _LOWER[data]
    start, end, first = common.word_spans(data, at, _WORD)
    one = common.span_hash(common.prefix_hash(data), start, end)
    factor = np.uint64(0xC6A4A7935BD1E995)
    run = one.copy()
    for j in range(1, words):
        run[:-j] = run[:-j] * factor + one[j:]
    run = common.mix64(run + np.uint64(words))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            x = np.sort(run[a : b - words + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            total = np.uint64(0)
            with np.errstate(over="ignore"):
                for x in one[a:b]:
                    total = total * factor + x
            out.append(common.mix64(np.array([total + np.uint64(b - a)])))
        else:
            out.append(one[:0])
    return out


class CirculantMinHash:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        pi = rng.permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        self.bands, self.rows, self.size = bands, rows, bands * rows
        self.stretch = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: self.size]]), self.size)
        # Coordinates for matching follow those of the bands on the circle; 16 bits of a pi value tell enough.
        short = (np.roll(pi, -self.size) >> np.uint32(UNIVERSE_BITS - 16)).astype(np.uint16)
        self.match = np.lib.stride_tricks.sliding_window_view(np.concatenate([short, short[:MATCH]]), MATCH)
        self.sigma = rng.integers(0, 1 << 63, dtype=np.uint64)
        self.salt = common.mix64(np.arange(1, bands + 1, dtype=np.uint64))

    def match_bytes(self, hashes: np.ndarray) -> bytes:
        out = np.full(MATCH, 0xFFFF, np.uint16)
        places = self.places(hashes)
        for i in range(0, len(places), 1024):
            np.minimum(out, self.match[places[i : i + 1024]].min(axis=0), out=out)
        return (out ^ (out >> 8)).astype(np.uint8).tobytes()

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return (common.mix64(hashes ^ self.sigma) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        places = self.places(hashes)
        out = np.full(self.size, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(places), 2048):
            np.minimum(out, self.stretch[places[i : i + 2048]].min(axis=0), out=out)
        return out

    def band_keys(self, hashes: np.ndarray) -> np.ndarray:
        part = self.signature(hashes).reshape(self.bands, self.rows).astype(np.uint64)
        key = self.salt.copy()
        for j in range(self.rows):
            key = common.mix64(key ^ (part[:, j] + np.uint64(0x9E3779B97F4A7C15)))
        return key.view(np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, s1, s2, bands, sig): size and 128-bit digest of each row's set, its band keys and matching bytes."""
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = CirculantMinHash(bands, rows)
        for batch in common.slices(batches, "bytes"):
            sets = shingle_hashes(*common.byte_view(common.column(batch, "bytes")), words)
            sums = [np.array([common.mix64(x ^ np.uint64(salt)).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            keys = [maker.band_keys(x) if len(x) else np.zeros(0, np.int64) for x in sets]
            lists = common.list_array(np.concatenate(keys), np.array([len(x) for x in keys]), pa.int64())
            yield pa.RecordBatch.from_arrays([common.column(batch, "id"), pa.array([len(x) for x in sets], pa.int64()), *map(pa.array, sums), lists, pa.array([maker.match_bytes(x) if len(x) else b"" for x in sets], pa.binary())], ["id", "n_shingles", "s1", "s2", "bands", "sig"])

    kind = source.schema["id"].dataType
    return common.arrow_map(source, run, T.StructType([T.StructField("id", kind), *T._parse_datatype_string("n_shingles long, s1 long, s2 long, bands array<long>, sig binary").fields]))


#: Bits of the largest Bloom filter (32 MB); beyond 2^25 ids it lets more and more others pass, which costs time only.
MOST_BITS = 1 << 28


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the (long) column ``id``: three hashes, eight to sixteen bits an id up to ``MOST_BITS``."""
    bits = min(MOST_BITS, 1 << max(20, (8 * ids.count()).bit_length()))
    places = F.array(*(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(bits)) for salt in range(3)))
    words = ids.select(F.explode(places).alias("p")).groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("x"))
    table = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[table["w"].to_numpy()] = table["x"].to_numpy()
    return out.view(np.uint64)


def shingle_sets(df: DataFrame, used: DataFrame, words: int) -> DataFrame:
    """(id, shingles array<long>) of the rows of (id, text) whose id is in ``used`` (and a few others)."""
    table = id_filter(used)
    bits = df.sparkSession.sparkContext.broadcast(table)
    places = F.array(*(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(64 * len(table))) for salt in range(3)))
    source = df.where("id is not null").select("id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("bytes"), places.alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "bytes"):
            at = common.column(batch, "places").flatten().to_numpy().reshape(-1, 3)
            hit = ((bits.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
            part = batch.filter(pa.array(hit))
            if not part.num_rows:
                continue
            sets = shingle_hashes(*common.byte_view(common.column(part, "bytes")), words)
            lists = common.list_array(np.concatenate(sets).view(np.int64), np.array([len(x) for x in sets]), pa.int64())
            yield pa.RecordBatch.from_arrays([common.column(part, "id"), lists], ["id", "shingles"])

    return common.arrow_map(source, run, "id long, shingles array<long>")


def _match_blocks(batches: Iterator[pa.RecordBatch], percent: int, agree: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a block pair that may link: rows come sorted by (band, i, j), the rows of one block pair in a row."""

    def groups() -> Iterator[pa.Table]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            keys = np.stack([table[k].to_numpy() for k in ("band", "i", "j")])
            cut = np.append(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, table.num_rows)
            start = 0
            for end in cut[:-1]:
                yield table.slice(start, end - start)
                start = int(end)
            held = table.slice(start)
        if held is not None:
            yield held

    found: list[tuple[np.ndarray, np.ndarray]] = []
    for g in groups():
        side, label, n, rep = (g[k].to_numpy() for k in ("side", "mine", "n_shingles", "rep"))
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1) if (side == 1).any() else a
        differ = label[a][:, None] != label[b][None, :]
        differ &= np.minimum(n[a][:, None], n[b][None, :]) * 100 >= np.maximum(n[a][:, None], n[b][None, :]) * percent
        if b is a:
            differ = np.triu(differ, 1)
        if not differ.any():
            continue
        sig = np.frombuffer(b"".join(g["sig"].to_pylist()), np.uint8).reshape(len(rep), -1)
        bands = g["bands"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        which = bands[0] == g["band"][0].as_py()
        before = int(np.argmax(which))
        i, j = np.nonzero(differ)
        i, j = a[i], b[j]
        for k in range(0, len(i), 8192):
            x, y = i[k : k + 8192], j[k : k + 8192]
            ok = ~(bands[x, :before] == bands[y, :before]).any(axis=1)
            x, y = x[ok], y[ok]
            ok = (sig[x] == sig[y]).sum(axis=1) >= agree
            found.append((rep[x[ok]], rep[y[ok]]))
        if sum(len(x) for x, _ in found) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found]), pa.int64()) for k in (0, 1)], ["a", "b"])
            found = []
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found]), pa.int64()) for k in (0, 1)], ["a", "b"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, agree: int = 519, block: int = 256) -> DataFrame:
    """One row a row of ``df``: ``id_col``, ``n_shingles`` long, ``component_id`` long, ``kept`` boolean."""
    df = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = common.materialise(signatures(df, "id", "text", words, bands, rows), "minhash-signatures")
    full = signed.where("n_shingles > 0 and id is not null")
    classes = common.materialise(full.groupBy("s1", "s2", "n_shingles").agg(F.min("id").alias("rep")), "minhash-classes")
    keys = ["s1", "s2", "n_shingles"]
    reps = full.join(classes, keys).where("id = rep").select("rep", "n_shingles", F.explode("bands").alias("band"))
    shared = reps.groupBy("band").agg(F.min("rep").alias("x"), F.max("rep").alias("y"), F.count("*").alias("size")).where("x < y").select("band", "size")
    crowd = common.materialise(reps.join(shared, "band").distinct(), "minhash-crowd")
    # A bucket is compared with its member of the largest buckets: of variants of one text that is the least changed one.
    degree = crowd.groupBy("rep").agg(F.sum("size").alias("degree"))
    best = F.max(F.struct("degree", F.bitwise_not("rep").alias("x"), "n_shingles")).alias("best")
    leaders = crowd.join(degree, "rep").groupBy("band").agg(best).select("band", F.bitwise_not("best.x").alias("low"), F.col("best.n_shingles").alias("m"))
    members = common.materialise(crowd.drop("size").join(leaders, "band"), "minhash-buckets")
    common.discard(crowd)
    spent = [signed, members]
    sets = common.materialise(shingle_sets(df, members.select(F.col("rep").alias("id")).distinct(), words), "minhash-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        spent.append(common.materialise(pairs, "minhash-pairs"))
        both = spent[-1].join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return both.where(shared * 100 >= (F.size("x") + F.size("y") - shared) * percent).select("a", "b")

    # Rows that share an id are one vertex.
    shared = full.join(classes, keys).where("id <> rep").select("id", "rep")
    same_id = full.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    shared = shared.join(same_id, "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    close = F.least("n_shingles", "m") * 100 >= F.greatest("n_shingles", "m") * percent  # a linked pair's sizes are at least this close
    stars = members.where(close).select(F.col("low").alias("a"), F.col("rep").alias("b"))
    spent.append(sets)
    edges = common.materialise(verified(stars).union(shared), "minhash-links")
    label = common.materialise(common.components(edges), "minhash-labels")
    spent += [edges, label]

    # What is left: members of a bucket that are in different components, without the one all others were compared with.
    mine = members.where("rep <> low").join(label.toDF("rep", "component"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("mine"))
    mine = common.materialise(mine, "minhash-open")
    spent.append(mine)
    many = mine.groupBy("band").agg(F.min("mine").alias("x"), F.max("mine").alias("y"), F.count("*").alias("m")).where("x <> y").select("band", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    about = full.join(classes, keys).where("id = rep").select("rep", "n_shingles", "bands", "sig").dropDuplicates(["rep", "n_shingles"])
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), F.when(F.col("own") > o, 1).otherwise(0).alias("side")))
    dealt = mine.join(many, "band").withColumn("own", own).join(about, "rep").withColumn("p", F.explode(pairs)).select("band", "p.i", "p.j", "p.side", "rep", "mine", "n_shingles", "bands", "sig")
    dealt = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    more = verified(common.arrow_map(dealt, lambda b: _match_blocks(b, percent, agree), "a long, b long"))
    component_of = lambda c: F.coalesce("component", c).alias(c)
    more = more.join(label.toDF("a", "component"), "a", "left").select(component_of("a"), "b").join(label.toDF("b", "component"), "b", "left").select("a", component_of("b"))
    linked = common.materialise(more, "minhash-links")
    merged = common.components(linked)
    everyone = label.union(merged.select("id", F.col("id"))).distinct()
    final = everyone.join(merged.toDF("component", "top"), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    final = common.materialise(final.groupBy("id").agg(F.min("component").alias("component")), "minhash-components")
    named = classes.join(final, classes["rep"] == final["id"], "left").select(*keys, F.coalesce("component", "rep").alias("component_id"))
    slim = common.materialise(signed.select("id", *keys), "minhash-sizes")
    common.discard(*spent, linked)
    answer = slim.join(named, keys, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return answer.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
