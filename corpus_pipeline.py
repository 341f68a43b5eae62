"""The corpus pipeline: quality rules, SimHash near-dedup, suffix-array dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame; ``run`` writes
each result as Parquet to the shared scratch folder, deletes what the stage wrote on the way, and reads the result again
as the next stage's docs. All but the last return the columns of ``documents``.

In every stage rows with a null doc_id and rows whose doc_id repeats are documents of their own, null texts count as
empty, columns beside those of ``documents`` stay as they are, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyseek.llm import mixing, nearcopies, quality, sentencepieces, suffixes
from polyseek.llm.common import saved
from polyseek.sources.scratch import step


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose content share is too low go, null and empty texts among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept_documents(docs, quality.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash anchors and MinHash bands give candidates. Of each group of near copies (Jaccard similarity of five-word shingles of 0.8 or more) the row of least doc_id stays,
    nulls last. Rows are told apart by a written number: neither null nor repeated doc_ids drop a text of their own."""
    rows = saved(docs.withColumn("_near_row", F.monotonically_increasing_id()))
    return rows.join(nearcopies.kept_rows(rows, "_near_row").hint("merge"), "_near_row", "left_semi").drop("_near_row")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 that occur elsewhere too are cut out; what is left of a text is read as UTF-8, without characters
    that were cut through. No row goes; a null text stays null."""
    return suffixes.cut_documents(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts cut to the blocks that the mix takes, once for each pass; documents of which it takes nothing, such as those
    without a word, go."""
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip and ids of each text."""
    return sentencepieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing", mixed_sources),
    ("sentencepiece", encoding),
]

#: The stages train a random field, compare fingerprints and merge pieces: SQL can't express them. tests/llm checks
#: each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = step(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs
