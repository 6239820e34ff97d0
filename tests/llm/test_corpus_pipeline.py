"""The chained stages against a plain version of each, and all operators on empty tables and tables with other columns."""

import collections
import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("tickloom.llm")
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tickloom.llm import byte_bpe, chat_format, common, decontaminate, embedding_dedup, minhash_dedup, quality, suffix_dedup, token_count, toxicity, warc  # noqa: E402
from tickloom.llm.queries import token_pattern, tokenizer_path  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnopé", k=rng.randint(2, 8))) for _ in range(n))


def corpus():
    """Toxic, near-duplicate, repeating and leaking documents among clean ones: (rows, labels, benchmark)."""
    passage, test, line, brief = prose(110, 1000), prose(30, 2000), prose(45, 3000), prose(58, 4000)
    texts = {i: prose(150, i) for i in range(40)}
    for i in range(1, 40, 3):
        texts[i] = texts[i].replace(" ", " vile scum ", 3)
    texts[41] = texts[0].rsplit(" ", 2)[0]
    texts[42] = texts[0].split(" ", 2)[2]
    texts[43] = texts[3]
    texts[50], texts[51] = prose(40, 50) + " " + passage + " " + prose(40, 51), prose(50, 52) + " " + passage
    texts[52], texts[53] = passage[3:], "  \t\n" + passage + "\n "
    texts[54], texts[55] = prose(40, 54) + " " + line + " " + prose(40, 55), prose(40, 56) + " " + line
    texts[56], texts[57] = prose(40, 57) + " " + brief + " " + prose(40, 58), prose(40, 59) + " " + brief
    assert 200 < len(line.encode()) and len(brief.encode()) < 400  # a repeat of 45 words stays, one of 58 goes
    texts[60], texts[61] = prose(40, 60) + " " + test.upper(), "you vile scum " + test
    texts |= {70: None, 71: "", 72: " \n\t ", 73: "日本 😀 é", 74: "short one", 75: "日本語😀 " * 60, 76: "語😀本" + "日本語😀 " * 60 + "日"}
    rows = [(i, t, None, None, None) for i, t in texts.items()] + [(None, prose(60, 90), "x", "y", 1), (74, "short one", None, None, None)]
    labels = [(i, None, int(i % 3 == 1)) for i in range(0, 36)] + [(36, 1, None), (None, 1, 1), (999, 1, 1)]
    return rows, labels, [(1, test), (2, None), (3, ""), (4, "not there")]


def plain_toxicity(rows, labels, order):
    """FTRL-proximal with unhashed features in dictionaries; the rows whose score stays below 0.7."""
    alpha, beta, l1, l2 = 2.0, 1.0, 6.0, 0.05

    def parts(text):
        w = []
        for x in (text or "").encode():
            x = x + 32 if 65 <= x <= 90 else x
            w.append(bytes([x]) if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else b" ")
        w = b"".join(w).split(b" ")
        w = [x for x in w if x]
        return {(0, x) for x in w} | {(1, *x) for x in zip(w, w[1:])} | {(2, *x) for x in zip(w, w[2:])}

    known = {i: y for i, _, y in labels if i is not None and y is not None}
    sample = {}
    for i, t, *_ in rows:
        if i in known:
            sample[i] = min(sample.get(i, t or ""), t or "")
    sample = [(parts(sample[i]), known[i]) for i in sorted(sample, key=order.get)]
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        limit = 0 if k is None else l1
        return 0.0 if abs(z[k]) <= limit else (np.sign(z[k]) * limit - z[k]) / ((beta + np.sqrt(n[k])) / alpha + l2)

    def chance(features):
        return 1 / (1 + np.exp(-sum(weight(k) for k in [*features, None])))

    rng = np.random.default_rng(3)
    for _ in range(5):
        for i in rng.permutation(len(sample)):
            features, y = sample[i]
            g = chance(features) - y
            now = {k: weight(k) for k in [*features, None]}
            for k, w in now.items():
                z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / alpha * w
                n[k] += g * g
    return [r for r in rows if chance(parts(r[1])) < 0.7]


def plain_near(rows):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    top = {i: i for i, _ in sets}
    for _ in range(4):
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    top[i] = top[j] = min(top[i], top[j])
    return [r for r in rows if r[0] is None or top[r[0]] == r[0]]


def plain_cut(rows, size=200, words=50):
    texts = [(r[1] or "").encode() for r in rows]
    count = collections.Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for r, t in zip(rows, texts, strict=True):
        gone = {j for i in range(len(t) - size + 1) if count[t[i : i + size]] > 1 for j in range(i, i + size)}
        for i in sorted(gone):
            if i - 1 not in gone:
                end = next(j for j in range(i, len(t) + 1) if j not in gone)
                if len(t[i:end].split()) < words:
                    gone.difference_update(range(i, end))
        kept, at = [], 0
        for c in t.decode():
            wide = len(c.encode())
            if not gone.intersection(range(at, at + wide)):
                kept.append(c)
            at += wide
        if not gone or "".join(kept).strip():
            out.append((r[0], "".join(kept) if gone else r[1]))
    return out


def plain_leaks(rows, benchmark):
    windows = {p for _, t in benchmark for p in decontaminate.windows_of(decontaminate.words_of(t))}

    def leaks(text):
        w = decontaminate.words_of(text)
        return any(tuple(w[i : i + k]) in windows for k in {len(p) for p in windows} for i in range(len(w) - k + 1))

    return [r for r in rows if not leaks(r[1])]


def tables(spark, folder, rows, labels, benchmark):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_run(spark, tmp_path):
    import tiktoken

    rows, labels, benchmark = corpus()
    tables(spark, tmp_path, rows, labels, benchmark)
    ids = spark.createDataFrame([(r[0],) for r in rows if r[0] is not None], "i long").distinct()
    order = {r.i: r.h for r in ids.select("i", F.xxhash64("i").alias("h")).collect()}
    clean = plain_toxicity(rows, labels, order)
    single = plain_near(clean)
    cut = plain_cut(single)
    want = plain_leaks(cut, benchmark)
    assert len(rows) > len(clean) > len(single) > len(cut) > len(want)  # every stage has something to do
    coder = tiktoken.Encoding("plain", pat_str=token_pattern(), mergeable_ranks=byte_bpe.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = collections.Counter((i, tuple(coder.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in want)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_repeated_rows(spark, tmp_path):
    """Of each text that repeats under one id, under null ids or under both one copy stays."""
    once, null, both, near, short = prose(150, 1), prose(150, 2), prose(150, 3), prose(150, 4), prose(20, 5)
    rows = [(1, once), (1, once), (None, null), (None, null), (None, both), (3, both), (4, near), (4, near + " end"), (None, "start " + near)]
    rows += [(5, short), (5, short), (6, short), (None, short), (7, prose(150, 6)), (7, prose(150, 7)), (None, None), (None, None), (8, ""), (8, "")]
    tables(spark, tmp_path, [(*r, None, None, None) for r in rows], [], [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = collections.Counter([rows[0], rows[2], rows[5], (5, short), (5, short), rows[13], rows[14], *rows[15:]])
    single = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    kept = single - want
    assert want <= single and len(kept) == 1 and kept.keys() <= {rows[6], rows[7]}
    got = collections.Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == collections.Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in single.elements())


def test_empty_run(spark, tmp_path):
    tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_whole_characters(spark):
    text = "é".encode()[:1] + "日本".encode()
    rows = spark.createDataFrame([(1, bytearray("aéüb".encode()), [(2, 4)]), (2, bytearray(text[1:]), [(1, 2), (3, 4)]), (3, bytearray(b"abc"), [])], "doc_id long, bytes binary, spans array<struct<start: int, end: int>>")
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.kept_bytes(rows, whole_characters=True).collect()}
    assert got == {1: b"ab", 2: b"", 3: b"abc"}


NAMES = ("id", "bytes", "spans", "h", "k1", "k2", "band", "rep", "kept", "score", "items", "n_words", "component", "n_links", "label_2", "ids", "__id", "__b", "chunk", "digest", "copies", "a", "b", "x", "y", "top")


def crowded(df):
    """Other columns with the names that operators use within."""
    return df.select("*", *(F.lit("other").alias(x) for x in NAMES if x not in df.columns))


@pytest.mark.parametrize("empty", [False, True])
def test_other_columns(spark, empty):
    rows, labels, benchmark = corpus()
    few = lambda df: crowded(df.limit(0) if empty else df)
    docs = few(spark.createDataFrame(rows[:8] + rows[-10:], DOCS))
    labels = few(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    items = few(spark.createDataFrame(benchmark, "item_id long, text string"))
    vectors = few(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (None, None, None)], "vec_id long, embedding array<float>, label int"))
    pages = few(spark.createDataFrame([(1, "http://a", "x" * 2000), (2, None, None)], "page_id long, url string, html string"))
    chats = few(spark.createDataFrame([(1, 1, "user", "a"), (None, None, None, None)], "conv_id long, turn long, role string, text string"))
    n = docs.count()
    ranks, pattern = tokenizer_path("byte_bpe_multi_50k.tiktoken"), token_pattern()
    assert byte_bpe.round_trip(docs, ranks, pattern).count() == n
    assert token_count.token_counts(docs, tokenizer_path("piece_bpe_32k.model")).count() == n
    assert decontaminate.find(docs, items).count() == n
    assert suffix_dedup.kept_bytes(suffix_dedup.repeated_spans(docs)).count() == n
    assert minhash_dedup.near_duplicates(docs).count() == n
    assert embedding_dedup.near_vectors(vectors).count() == vectors.count()
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == n
    assert quality.score(docs, quality.fit(docs, labels, filters=2, epochs=1)).count() == n
    assert chat_format.format_conversations(chats).count() == chats.count()
    folder = common.fresh_path(spark, "warc-test")
    assert warc.read_archive(spark, warc.write_archive(warc.chunk_table(pages), folder), folder).count() == pages.count()
