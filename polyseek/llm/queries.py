"""The queries of this package: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyseek.llm import automata, balltree, embeddings, mixing, negatives, private, quality, sentencepieces, separators, simhash, suffixes, tokenfiles, toxicity, twins


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = toxicity.scores(docs, toxicity.learn(docs, labels.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judge(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(documents(spark, sf_dir), kept=False)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(simhash.fingerprints(documents(spark, sf_dir)))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encoded(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), ids=False)


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, read off flat files; doc_id comes from the order in which they were written."""
    written, folder = separators.write_flat(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 50256)
    found = separators.count(spark, folder, 50256)
    return found.join(written.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")


def op7_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.without_repeats(documents(spark, sf_dir), kept=False)


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.read(*tokenfiles.write(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op11_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = private.found_spans(docs, private.learn(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_quality": op2_quality, "op3_suffix_array": op3_suffix_array, "op4_simhash": op4_simhash, "op5_sentencepiece": op5_sentencepiece, "op6_separator_scan": op6_separator_scan, "op7_suffix_automata": op7_suffix_automata, "op8_embeddings": op8_embeddings, "op9_token_files": op9_token_files, "op10_mixing": op10_mixing, "op11_private": op11_private, "op12_hard_negatives": op12_hard_negatives, "op13_ball_tree": op13_ball_tree}


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_array": twins.OP3, "op7_suffix_automata": twins.OP7, "op8_embeddings": twins.OP8, "op12_hard_negatives": twins.OP12, "op13_ball_tree": twins.OP13}
