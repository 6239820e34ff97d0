"""Corpus pipeline: five stages over ``documents``, each calling one operator of ``tickloom.llm``.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the
last return the columns of ``documents``. Rows with a null or repeated doc_id pass each
stage like any other row; only short rows that repeat id and text stay together in near-dedup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import byte_bpe, common, decontaminate, minhash_dedup, suffix_dedup, toxicity
from tickloom.llm.queries import hex_digest, token_pattern, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: What cut_repeats cuts: runs covered by repeated strings of so many bytes that hold so many words. 50 words of prose take
#: 300 bytes and up in the languages of the corpus; shorter matches are sorted, then judged by their words.
REPEAT_BYTES, REPEAT_WORDS = 200, 50


def _fixed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _with_text(docs: DataFrame, text: Column) -> DataFrame:
    return docs.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more are removed. The model learns from labelled documents of this input."""
    docs = _fixed(docs)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=COLUMNS).where("score < 0.7").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows the one with the smallest id stays, null ids last. Rows that repeat its id and
    its text stay with it if the next stage can't cut them, being shorter than its windows."""
    key, short = F.monotonically_increasing_id(), F.octet_length("text") < REPEAT_BYTES
    docs = common.materialise(_fixed(docs).select(key.alias("row"), *COLUMNS), "pipeline-rows")
    found = minhash_dedup.near_duplicates(docs, "row").select("row", F.col("component_id").alias("component"))
    about = docs.select("row", "doc_id", F.when(short & F.col("doc_id").isNotNull(), F.sha2(F.col("text").cast("binary"), 256)).alias("same"))
    rows = common.materialise(found.join(about, "row"), "pipeline-components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "same")).alias("first")
    kept = common.materialise(rows.groupBy("component").agg(first).select("component", "first.*"), "pipeline-kept")
    again = rows.join(kept.where("same is not null").select("component", "doc_id", "same"), ["component", "doc_id", "same"])
    return docs.join(kept.select("row").union(again.select("row")).distinct(), "row", "left_semi").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand anywhere else too are cut, all their copies: runs covered by repeated
    strings of 200 bytes. A character of which a byte is cut goes entirely. Documents of which nothing but white space is
    left are removed; those that were blank before stay."""
    spans = suffix_dedup.repeated_spans(_fixed(docs), keep=COLUMNS, depth=REPEAT_BYTES)
    cut = suffix_dedup.kept_bytes(spans, keep=COLUMNS, whole_characters=True, least_words=REPEAT_WORDS).withColumn("cut", F.col("kept").cast("string"))
    left = cut.where((F.size("spans") == 0) | F.col("cut").rlike(r"\S"))
    return _with_text(left, F.when(F.size("spans") == 0, F.col("text")).otherwise(F.col("cut")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs are removed."""
    found = decontaminate.find(_fixed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return found.where(F.size("spans") == 0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digest of the bytes they decode to."""
    path, pattern = tokenizer_path("byte_bpe_multi_50k.tiktoken"), token_pattern()
    done = byte_bpe.round_trip(_fixed(docs), path, pattern)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", hex_digest(F.col("decoded")).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("minhash_dedup", drop_near_duplicates), ("suffix_dedup", cut_repeats), ("decontaminate", drop_contaminated), ("byte_bpe", encode)]

#: SQL can't express the trained model of the first stage, so the rows of run() are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.materialise(docs, f"pipeline-{name}")
            if i:
                common.discard(before)
    return docs
