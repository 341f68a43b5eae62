"""Ranking evaluation against relevance judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyseek.functions.vectors import tie


def ranked(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """Judged queries' rows with rank (score, then doc_id, both descending, as usual tools break ties) and gain."""
    w = Window.partitionBy("query_id").orderBy(tie(F.col("score")).desc(), F.col("doc_id").desc())
    rows = ranking.join(qrels.where("relevance > 0").select("query_id").distinct(), "query_id", "left_semi").withColumn("rank", F.row_number().over(w))
    return rows.join(qrels.select("query_id", "doc_id", "relevance"), ["query_id", "doc_id"], "left").withColumn("gain", F.coalesce("relevance", F.lit(0)))


def relevant(qrels: DataFrame) -> DataFrame:
    return qrels.where("relevance > 0").groupBy("query_id").agg(F.count("*").alias("n_rel"))


def recall_at(ranking: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10, 50, 100)) -> DataFrame:
    hits = ranked(ranking, qrels).groupBy("query_id").agg(*[F.count_if((F.col("rank") <= k) & (F.col("gain") > 0)).alias(f"h{k}") for k in ks])
    return relevant(qrels).join(hits, "query_id", "left").select("query_id", *[(F.coalesce(f"h{k}", F.lit(0)) / F.col("n_rel")).alias(f"recall_{k}") for k in ks])


def ndcg_at(ranking: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10, 50, 100)) -> DataFrame:
    got = ranked(ranking, qrels)
    w = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "doc_id")
    ideal = qrels.where("relevance > 0").withColumn("rank", F.row_number().over(w)).withColumnRenamed("relevance", "gain")
    dcg = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("gain") / F.log2(F.col("rank") + 1)).otherwise(0.0))
    a = got.groupBy("query_id").agg(*[dcg(k).alias(f"a{k}") for k in ks])
    b = ideal.groupBy("query_id").agg(*[dcg(k).alias(f"b{k}") for k in ks])
    return b.join(a, "query_id", "left").select("query_id", *[(F.coalesce(f"a{k}", F.lit(0.0)) / F.col(f"b{k}")).alias(f"ndcg_{k}") for k in ks])


def map_at(ranking: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10, 50, 100)) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    got = ranked(ranking, qrels).withColumn("seen", F.sum((F.col("gain") > 0).cast("int")).over(w))
    part = lambda k: F.sum(F.when((F.col("rank") <= k) & (F.col("gain") > 0), F.col("seen") / F.col("rank")).otherwise(0.0))
    a = got.groupBy("query_id").agg(*[part(k).alias(f"a{k}") for k in ks])
    return relevant(qrels).join(a, "query_id", "left").select("query_id", *[(F.coalesce(f"a{k}", F.lit(0.0)) / F.col("n_rel")).alias(f"map_{k}") for k in ks])


def success_at(ranking: DataFrame, qas: DataFrame, ks: tuple[int, ...] = (5, 10, 100, 1000)) -> DataFrame:
    """qas(query_id, doc_id): answers. One row: share of all queries with an answer in the first k, and mean recall over
    the queries with at least one answer found anywhere."""
    w = Window.partitionBy("query_id").orderBy(tie(F.col("score")).desc(), "doc_id")
    hit = ranking.withColumn("rank", F.row_number().over(w)).join(qas.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    found = hit.groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks])
    n = qas.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n"))
    rows = n.join(found, "query_id", "left")
    return rows.agg(
        *[F.avg((F.coalesce(f"h{k}", F.lit(0)) > 0).cast("double")).alias(f"success_{k}") for k in ks],
        *[F.avg(F.when(F.col(f"h{ks[-1]}").isNotNull(), F.col(f"h{k}") / F.col("n"))).alias(f"recall_{k}") for k in ks],
    )


def mean_metrics(*per_query: DataFrame) -> DataFrame:
    """One row: each metric's mean over queries, to five digits."""
    out = per_query[0]
    for df in per_query[1:]:
        out = out.join(df, "query_id")
    return out.agg(*[F.round(F.avg(c), 5).alias(c) for c in out.columns if c != "query_id"])
