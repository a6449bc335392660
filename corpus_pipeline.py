"""The corpus pipeline: from raw documents to token ids, over the operators of quillgrid.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import fm_dedup, forced_bpe, simhash_pivots, suffix_decontam, weak_quality
from quillgrid.session import work_folder

TOKENIZER = "word_bpe_49k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality scorer accepts."""
    return weak_quality.quality(docs, "text").where("accepted").select("row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near duplicates."""
    return simhash_pivots.representatives(docs, "doc_id", "text", shingle=3, max_bits=3)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the words of windows that stand earlier too.

    A text that loses nothing stays as it is; of another one the words left are joined by one
    space, and n_chars follows. A text that loses all its words stays as an empty one.
    """
    found = fm_dedup.remove_repeated_words(docs, "doc_id", "text", window=20)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return found.select(row.alias("row")).select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated by benchmark items."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = suffix_decontam.contamination(docs, benchmark, "text", "item_id", "text")
    return found.where(~F.col("contaminated")).select("row.*")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Id, number of tokens, token ids and the digests of ids and decoded text of each document."""
    found = forced_bpe.encode_texts(
        docs, "text", public_tokenizers.path(TOKENIZER), keep=["doc_id"], digests=True
    )
    return found.select("row.doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding", bpe_encoding),
]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
