"""Each operator against a brute-force version, with nulls, empty and long texts, repeated rows and empty tables."""

import collections
import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("tickloom.llm")
from tickloom.llm import byte_bpe, chat_format, common, decontaminate, embedding_dedup, induced, minhash_dedup, quality, suffix_dedup, token_count, toxicity, warc  # noqa: E402
from tickloom.llm.queries import token_pattern, tokenizer_path  # noqa: E402

DOCS = "doc_id long, text string, score int"
RANKS, PIECES = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"


def words(n, seed, alphabet="abcdefghijkl"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(1, 7))) for _ in range(n))


def documents(spark):
    base = words(120, 1)
    near = base.replace(" ", " ", 1).rsplit(" ", 3)[0] + " changed the end"
    rows = [(1, base), (2, base), (3, near), (4, None), (5, ""), (6, "  \n "), (7, words(4000, 2)), (8, "one two"), (9, "ONE two"), (10, words(60, 3) + " " + base + " " + words(60, 4)), (11, "x" * 900), (11, "x" * 900), (None, base), (12, "né 日本 " * 50)]
    return spark.createDataFrame([(*r, 0) for r in rows], DOCS).repartition(3)


def test_bpe_tree(spark):
    import tiktoken

    ranks = byte_bpe.read_ranks(tokenizer_path(RANKS))
    plain = tiktoken.Encoding("plain", pat_str=token_pattern(), mergeable_ranks=ranks, special_tokens={})
    tree = byte_bpe.TreeCodec(ranks, token_pattern(), leaf=5, window=2)
    rng = random.Random(0)
    for _ in range(400):
        text = "".join(rng.choice(["a", "the ", " ", "\n", "日", "é", "'s", "12", "　", "\x1f", "😀"]) for _ in range(rng.randint(0, 80)))
        assert tree.encode(text).tolist() == plain.encode_ordinary(text)
        assert tree.decode(tree.encode(text)) == text.encode()
    df = documents(spark)
    got = byte_bpe.round_trip(df, tokenizer_path(RANKS), token_pattern()).collect()
    assert len(got) == df.count() and byte_bpe.encode(df.limit(0), tokenizer_path(RANKS), token_pattern()).count() == 0
    texts = collections.Counter((r.text or "").encode() for r in df.collect())
    assert collections.Counter(bytes(r.decoded) for r in got) == texts
    again = byte_bpe.decode(byte_bpe.encode(df, tokenizer_path(RANKS), token_pattern()), tokenizer_path(RANKS), token_pattern())
    assert collections.Counter(bytes(r.decoded) for r in again.collect()) == texts


def test_bpe_other_patterns():
    """A pattern that joins a word with the space behind it is found out, and its texts still come out as the library's."""
    import tiktoken

    ranks = byte_bpe.read_ranks(tokenizer_path(RANKS))
    assert byte_bpe.separable(token_pattern())
    for pattern in (r"\w+\s?|.|\s", r"\S+ \S+|\s+|\S+"):
        assert not byte_bpe.separable(pattern)
        plain, tree = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), byte_bpe.TreeCodec(ranks, pattern, leaf=5, window=2)
        for seed in range(20):
            text = words(20, seed)
            assert tree.encode(text).tolist() == plain.encode_ordinary(text)


def test_token_counts(spark):
    counter = token_count.Counter(tokenizer_path(PIECES), chunk=40, overlap=3)
    assert counter.provable
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "lo", "the ", "  ", "\n", "日", "▁", "<s>", "é"]) for _ in range(rng.randint(0, 200)))
        assert counter.count([text]) == [len(counter.model.encode(text))]
    got = token_count.token_counts(documents(spark), tokenizer_path(PIECES)).collect()
    assert sum(r.n_tokens for r in got if r.n_bytes == 0) == 0 and len(got) == 14


def test_decontaminate_shards(spark):
    df = documents(spark)
    items = spark.createDataFrame([(1, " ".join(words(120, 1).split()[20:35])), (2, "One, TWO!"), (3, None), (4, ""), (None, "x"), (5, "not in there at all")], "item_id long, text string")

    def brute(text):
        w = decontaminate.words_of(text)
        hit, found = set(), set()
        for item, t in [(r.item_id, r.text) for r in items.collect() if r.item_id is not None]:
            for p in decontaminate.windows_of(decontaminate.words_of(t)):
                for i in range(len(w) - len(p) + 1):
                    if tuple(w[i : i + len(p)]) == p:
                        hit.update(range(i, i + len(p)))
                        found.add(item)
        return len(w), len(hit), sorted(found)

    for size in (1, 1 << 20):
        got = decontaminate.find(df, items, keep=("doc_id", "text"), shard_bytes=size).collect()
        assert all((r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) == brute(r.text) for r in got)
    assert decontaminate.find(df, items.limit(0)).where("size(spans) > 0").count() == 0


def test_induced_sorting():
    rng = random.Random(2)
    for _ in range(60):
        depth, letters = rng.choice([2, 3, 7]), rng.choice([b"ab", b"abc ", bytes(range(256))])
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(rng.randint(1, 6))] + [b"a" * 20]
        count = collections.Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
        for text, hit in zip(texts, induced.repeated(texts, depth, memory=rng.choice([0, 100, 1 << 20]), chunk=rng.choice([3, 17, 1 << 20])), strict=True):
            assert hit.tolist() == [i + depth <= len(text) and count[text[i : i + depth]] > 1 for i in range(len(text))]


def test_sorting_beyond_memory():
    """A shard many times larger than the bytes that its arrays and queues may hold: the same hits, from scratch files."""
    rng = random.Random(12)
    base = [words(3000, i).encode() for i in range(8)]
    texts = [b[rng.randrange(0, 900) : rng.randrange(9000, len(b))] + words(50, 100 + i).encode() for i, b in enumerate(base + base)]
    size, memory = sum(map(len, texts)), 1 << 14
    assert size > 10 * memory
    spilled, files = [], []
    spill, make = induced.BlockQueues._spill, induced.tempfile.TemporaryFile
    induced.BlockQueues._spill = lambda self: (spilled.append(self.held), spill(self))
    induced.tempfile.TemporaryFile = lambda *a, **b: files.append(1) or make(*a, **b)
    try:
        got = list(induced.repeated(texts, 200, memory, chunk=2000))
    finally:
        induced.BlockQueues._spill, induced.tempfile.TemporaryFile = spill, make
    assert len(spilled) > 20 and max(spilled) < 4 * memory and len(files) > 10
    count = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for text, hit in zip(texts, got, strict=True):
        assert hit.tolist() == [i + 200 <= len(text) and count[text[i : i + 200]] > 1 for i in range(len(text))]


def test_suffix_dedup(spark):
    df = documents(spark)
    texts = [(r.text or "").encode() for r in df.collect()]
    for depth in (50, 400):
        count = collections.Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
        got = suffix_dedup.kept_bytes(suffix_dedup.repeated_spans(df.select("doc_id", "text", "score"), keep=("doc_id", "text"), depth=depth), keep=("doc_id", "text")).collect()
        assert len(got) == len(texts)
        for r in got:
            t = (r.text or "").encode()
            gone = {j for i in range(len(t) - depth + 1) if count[t[i : i + depth]] > 1 for j in range(i, i + depth)}
            assert bytes(r.kept) == bytes(b for i, b in enumerate(t) if i not in gone)
    assert suffix_dedup.repeated_spans(df.limit(0)).count() == 0


def test_minhash_dedup(spark):
    df = documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [(i, shingles(t)) for i, t in rows]
    top = {i: i for i, _ in sets if i is not None}
    for _ in range(len(sets)):
        for i, a in sets:
            for j, b in sets:
                if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                    top[i] = top[j] = min(top[i], top[j])
    got = minhash_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (top[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.component_id == r.doc_id)
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_minhash_group_of_variants(spark):
    rng = random.Random(5)
    base = words(100, 9).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(96)} for _, t in rows]
    top = list(range(150))
    for _ in range(6):
        for i in range(150):
            for j in range(150):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    top[i] = top[j] = min(top[i], top[j])
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()}
    assert [got[i] for i in range(150)] == top


def test_embedding_dedup(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.02, base[:5], np.repeat(base[:1], 30, 0) + rng.normal(size=(30, 16)) * 0.01])
    rows = [(i, [float(v) for v in row], i % 2 if i >= 40 else (i + 40) % 2) for i, row in enumerate(x)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, rows[0][1], None), (None, rows[0][1], 0), (204, [1.0, None], 0), (205, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = {i: (np.array(v), lab) for i, v, lab in rows if i is not None and i < 200}
    links = {i: {j for j, (b, m) in good.items() if j != i and m == lab and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98} for i, (a, lab) in good.items()}
    top = {i: i for i in good}
    for _ in range(len(good)):
        for i in good:
            for j in links[i]:
                top[i] = top[j] = min(top[i], top[j])
    for leaf, block in ((1024, 1024), (16, 8)):
        got = {r.vec_id: r for r in embedding_dedup.near_vectors(df, leaf=leaf, block=block).collect()}
        assert len(got) == len(rows)
        for i in good:
            assert (got[i].n_links, got[i].component_id) == (len(links[i]), top[i])
        assert all(got[i].n_links == 0 and got[i].component_id == i for i in (200, 201, 202, 203, 204, 205))
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_forest_recall(spark):
    """Deep trees, pairs at the limit, lengths of their own: links against brute force."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(700, 32))
    side -= (side * x[:700]).sum(axis=1, keepdims=True) * x[:700]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    angle = np.arccos(rng.choice([0.9801, 0.985, 0.999], 700))[:, None]
    x = np.concatenate([x, np.cos(angle) * x[:700] + np.sin(angle) * side])
    few = [rng.normal(size=n) for n in range(1, 90)]
    rows = [(i, v.tolist(), 0) for i, v in enumerate([*x, *few, *few])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    near = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.98
    want = near.sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df, leaf=64, block=64).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum() and want.sum() >= 1400
    assert all(got[len(x) + i] >= 1 for i in range(2 * len(few)))


def test_chat_format(spark):
    nasty = "a<|im_end|>\\<\\|x\n<|im_sep|>\\"
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", nasty), (1, 3, "assistant", nasty), (1, 3, "assistant", nasty), (2, 1, None, None), (None, None, "a\nb<|", "t"), (3, 1, "assistant", "")]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", "segments", chat_format.read_turns(out["formatted"]).alias("turns"), chat_format.read_loss(out["segments"]).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", nasty), ("assistant", "b"), ("assistant", nasty), ("assistant", nasty)]
    assert got[1].loss == "b" + nasty * 2 and got[1].formatted.count("<|im_start|>") == 2
    assert [(t.role, t.text) for t in got[None].turns] == [("a\nb<|", "t")] and [(t.role, t.text) for t in got[2].turns] == [("", "")]
    assert all("".join(s.text for s in r.segments) == r.formatted for r in got.values())


def test_chat_ties(spark):
    """Turns that tie come in order of role and text as they are, not as escaped."""
    texts = ["<a", "<|", "\\", "[", "<", ""]
    rows = [(1, 1, role, t) for role in ("b<|", "b<a", "b") for t in texts]
    out = chat_format.format_conversations(spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string"))
    got = [(t.role, t.text) for t in out.select(chat_format.read_turns(out["formatted"]).alias("t")).first().t]
    assert got == sorted((r, t) for _, _, r, t in rows)


def test_chat_long_text(spark):
    long = "<|\\é" * 300_000
    out = chat_format.format_conversations(spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "assistant", long)], "conv_id long, turn long, role string, text string"))
    assert out.select(chat_format.read_loss(out["segments"]).alias("x")).first().x == long


def test_quality_network_against_plain_sums():
    """The forward pass byte by byte: filters within a text, maxima of chunks, means and maxima over chunks."""
    rng = np.random.default_rng(3)
    net = quality.Network(rng.normal(size=(4, 256, 3)), rng.normal(size=3), rng.normal(size=6), 0.3)
    texts = [b"", b"a", bytes(rng.integers(0, 256, 127)), bytes(rng.integers(1, 256, 2000)), bytes(rng.integers(1, 256, 512))]
    at = np.append(0, np.cumsum([len(x) for x in texts]))
    got = net.score(np.frombuffer(b"".join(texts), np.uint8), at, net.tables())
    for text, p in zip(texts, got, strict=True):
        blocks = -(-(len(text) + quality.PAD) // quality.BLOCK)
        x = np.frombuffer(text.ljust(blocks * quality.BLOCK + 4, b"\0"), np.uint8)
        y = sum(net.taps[t][x[t : t + blocks * quality.BLOCK]] for t in range(4))
        starts = range(0, max(1, blocks - quality.CHUNK + quality.STEP), quality.STEP)
        chunks = np.array([np.maximum(y[b * quality.BLOCK : min(b + quality.CHUNK, blocks) * quality.BLOCK].max(axis=0) + net.bias, 0) for b in starts])
        logit = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]) @ net.weights + net.offset
        assert p == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-5)


def test_classifiers(spark):
    rng = random.Random(4)
    rows = [(i, words(60, i) + (" idiot scum" if i % 3 == 0 else ""), 0) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None, 0), (901, "", 0)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), None if i == 5 else 1) for i in range(240)], "doc_id long, toxic int, other int")
    model = toxicity.fit(docs, labels, alpha=2.0, l1=1.0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in range(240, 300)]) > 0.95 and 0 <= got[900] <= 1 and got[900] == got[901]
    shout = spark.createDataFrame([(i, (words(80, i).upper() + "!!") if i % 2 else words(80, i) + " " * rng.randint(0, 2), 0) for i in range(300)], DOCS)
    marks = spark.createDataFrame([(i, 1 - i % 2) for i in range(240)] + [(299, None), (None, 1)], "doc_id long, quality int")
    net = quality.fit(shout, marks, filters=4, epochs=8)
    got = {r.doc_id: r.score for r in quality.score(shout.union(docs.where("doc_id >= 900")), net).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 2 == 0) for i in range(240, 300)]) > 0.95 and 0 <= got[900] <= 1
    one = {r.doc_id: r.score for r in quality.score(shout.repartition(17), net).collect()}
    assert all(abs(one[i] - got[i]) < 1e-9 for i in one)  # a score doesn't depend on its neighbours
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_warc(spark):
    big = words(3000, 1)
    rows = [(1, "http://a/\nb", big), (2, "http://b", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (7, "é", "é" * 700)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = common.fresh_path(spark, "warc-test")
    manifest = warc.write_archive(warc.chunk_table(pages, chunk_bytes=1000), folder)
    got = {r.page_id: r for r in warc.read_archive(spark, manifest, folder, step=100).collect()}
    assert len(got) == 7
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert (got[1].record_type, got[1].refers_to, got[2].record_type, got[None].refers_to, got[3].record_type, got[4].record_type) == ("revisit", 2, "response", 2, "response", "response")


def test_warc_running_digests(spark):
    data = words(2000, 8).encode()
    pages = spark.createDataFrame([(1, "u", data.decode()), (2, "u", "short")], "page_id long, url string, html string")
    rows = warc.chunk_table(pages, chunk_bytes=1000).collect()
    mine = sorted((r for r in rows if r.page_id == 1), key=lambda r: r.chunk)
    assert b"".join(bytes(r.data) for r in mine) == data and max(len(r.data) for r in mine) == 1000
    assert [r.running for r in mine] == [hashlib.sha1(data[: 1000 * (i + 1)]).hexdigest() for i in range(len(mine))]
    assert {r.digest for r in mine} == {hashlib.sha1(data).hexdigest()} and len(rows) == len(mine) + 1


def test_warc_repeated_rows(spark):
    big = words(300_000, 2)
    assert len(big) > 1 << 20
    pages = spark.createDataFrame([(1, "u", big)] * 2 + [(None, "v", "x" + big)] * 2, "page_id long, url string, html string")
    folder = common.fresh_path(spark, "warc-test")
    got = warc.read_archive(spark, warc.write_archive(warc.chunk_table(pages), folder), folder).collect()
    digests = [hashlib.sha1(x.encode()).hexdigest() for x in (big, "x" + big)]
    assert collections.Counter((r.page_id, r.payload_digest, r.record_type) for r in got) == {(1, digests[0], "response"): 2, (None, digests[1], "response"): 2}
