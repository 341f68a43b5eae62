"""Cluster metrics, from the index alone (A, B5) and from the facts of a search (B, C), and the frames that join them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyseek.functions.quantiles import exact_quantiles
from polyseek.functions.vectors import dot, pick, tie
from polyseek.operators import facts, matrices
from polyseek.sources.scratch import stored


def value_counts(rows: DataFrame, by: list[str], value: str, descending: bool = False) -> DataFrame:
    """Each value of each group with how often it comes (_c), how many come before it (_p) and the group's size. Groups are
    pre-aggregated: windows see distinct values, not rows."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_c"))
    own = Window.partitionBy(*by)
    order = F.col(value).desc() if descending else F.col(value).asc()
    before = F.coalesce(F.sum("_c").over(own.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("_p", before).withColumn("group_size", F.sum("_c").over(own))


def gini(rows: DataFrame, by: list[str], value: str, out: str = "gini") -> DataFrame:
    """Gini coefficient of value within each group: 0 where the sum is 0."""
    ranks = F.col("_c") * F.col("_p") + F.col("_c") * (F.col("_c") + 1) / 2  # sum of the ranks that equal values share
    s = value_counts(rows, by, value).groupBy(*by).agg(F.sum(ranks * F.col(value)).alias("_a"), F.sum(F.col("_c") * F.col(value)).alias("_s"), F.sum("_c").alias("_n"))
    g = 2 * F.col("_a") / (F.col("_n") * F.nullif("_s", F.lit(0))) - (F.col("_n") + 1) / F.col("_n")
    return s.select(*by, F.coalesce(g, F.lit(0.0)).alias(out))


def entropy(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Entropy (nats) of value's shares within each group, and over the logarithm of the number of values."""
    w = Window.partitionBy(*by)
    p = F.col(value) / F.sum(value).over(w)
    s = rows.where(F.col(value) > 0).withColumn("_p", p).groupBy(*by).agg((-F.sum(F.col("_p") * F.ln("_p"))).alias("entropy"), F.count("*").alias("_n"))
    return s.select(*by, "entropy", F.when(F.col("_n") > 1, F.col("entropy") / F.ln(F.greatest(F.col("_n"), F.lit(2)))).otherwise(F.col("entropy")).alias("normalized_entropy"))


def top_share(rows: DataFrame, by: list[str], value: str, shares: dict[str, Column]) -> DataFrame:
    """Shares of the sum that the greatest values hold: how many of them by name (may use group_size)."""
    s = value_counts(rows, by, value, descending=True)
    part = lambda k: F.sum(F.greatest(F.lit(0), F.least(k - F.col("_p"), F.col("_c"))) * F.col(value)) / F.nullif(F.sum(F.col("_c") * F.col(value)), F.lit(0))
    return s.groupBy(*by).agg(*[part(k).alias(name) for name, k in shares.items()])


def size_docs(posts: DataFrame) -> DataFrame:
    return posts.groupBy("centroid_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("doc_id").alias("n_docs"))


def tokens_per_doc(sizes: DataFrame) -> DataFrame:
    """sizes (n_tokens, n_docs) with tokens_per_doc, 0 for cells without documents."""
    return sizes.withColumn("tokens_per_doc", F.when(F.col("n_docs") > 0, F.col("n_tokens") / F.col("n_docs")).otherwise(0.0))


def offline_flags(offline: DataFrame) -> DataFrame:
    """centroid_id, very_dispersed (dispersion above the 95th percentile) and poorly_isolated (isolation below the 5th)."""
    edges = F.broadcast(offline.agg(F.percentile("dispersion", F.lit(0.95)).alias("_d"), F.percentile("isolation", F.lit(0.05)).alias("_i")))  # one row
    return offline.crossJoin(edges).select("centroid_id", (F.col("dispersion") > F.col("_d")).alias("very_dispersed"), (F.col("isolation") < F.col("_i")).alias("poorly_isolated"))


def size_correlations(offline: DataFrame) -> DataFrame:
    """One row: Pearson correlations of cell size with documents, concentration, dispersion and isolation."""
    return offline.agg(*[F.corr("n_tokens", c).alias(f"n_tokens_{c}") for c in ("n_docs", "top_1_doc_share", "gini_coefficient", "dispersion", "isolation")])


def doc_counts(posts: DataFrame) -> DataFrame:
    return posts.groupBy("centroid_id", "doc_id").agg(F.count("*").alias("n"))


def doc_shares(posts: DataFrame) -> DataFrame:
    """Share of a cell's tokens in its top 1, 5 and 10 documents."""
    return top_share(doc_counts(posts), ["centroid_id"], "n", {f"top_{k}_doc_share": F.lit(k) for k in (1, 5, 10)})


def dispersion(posts: DataFrame, weights: list[float]) -> DataFrame:
    """Mean squared length of the quantised residuals."""
    w = pick(weights, F.col("codes"))
    return posts.groupBy("centroid_id").agg(F.avg(dot(w, w)).alias("dispersion"))


def isolation(centroids: DataFrame, k: int = 10) -> DataFrame:
    """Per cell: 1 - mean cosine of its k nearest other centroids, the nearest and the mean. Blocks keep k a row."""
    near = matrices.nearest(centroids, centroids, k).groupBy("a")
    return near.agg((1 - F.avg("s")).alias("isolation"), F.max("s").alias("nearest_neighbor_sim"), F.avg("s").alias("mean_neighbor_sim")).withColumnRenamed("a", "centroid_id")


def selection_frequency(centroids: DataFrame, m1: DataFrame) -> DataFrame:
    """M1 rows of every cell, 0 where there are none."""
    n = m1.groupBy("centroid_id").agg(F.count("*").alias("sel_freq"))
    return centroids.select("centroid_id").join(n, "centroid_id", "left").na.fill(0, ["sel_freq"])


def anti_hubs(freq: DataFrame) -> DataFrame:
    return freq.agg(F.count("*").alias("num_centroids"), F.count_if(F.col("sel_freq") == 0).alias("num_anti_hubs"), F.avg((F.col("sel_freq") == 0).cast("double")).alias("anti_hub_rate"))


def traffic_concentration(freq: DataFrame) -> DataFrame:
    """Gini over all cells and the share of the top 1, 5 and 10 per cent of them."""
    one = freq.withColumn("all", F.lit(0))
    shares = {f"top_{p}pct_share": F.greatest(F.lit(1), F.floor(F.col("group_size") * p / 100)) for p in (1, 5, 10)}
    return gini(one, ["all"], "sel_freq", "traffic_gini").join(top_share(one, ["all"], "sel_freq", shares), "all").drop("all")


def traffic_entropy(freq: DataFrame) -> DataFrame:
    """Entropy (nats) of the cells' shares of traffic, and over its greatest value; one pass, no window over all cells."""
    s = freq.where("sel_freq > 0").agg(F.sum("sel_freq").alias("_t"), F.sum(F.col("sel_freq") * F.ln("sel_freq")).alias("_x"), F.count("*").alias("_n"))
    e = F.ln("_t") - F.col("_x") / F.col("_t")
    return s.select(e.alias("traffic_entropy"), F.when(F.col("_n") > 1, e / F.ln(F.greatest("_n", F.lit(2)))).otherwise(e).alias("normalized_traffic_entropy"))


def query_load(m1: DataFrame) -> DataFrame:
    return m1.groupBy("query_id", "centroid_id").agg(F.count("*").alias("n"))


def query_activation(m1: DataFrame) -> DataFrame:
    """Per query: cells, entropy of their load, its coefficient of variation (population), Gini, share of the top 5 %."""
    load = query_load(m1)
    out = load.groupBy("query_id").agg(F.count("*").alias("unique_centroids"), (F.stddev_pop("n") / F.nullif(F.avg("n"), F.lit(0.0))).alias("load_cv"))
    e = entropy(load, ["query_id"], "n").toDF("query_id", "activation_entropy", "normalized_activation_entropy")
    top = top_share(load, ["query_id"], "n", {"top_5_centroid_share": F.greatest(F.lit(1), F.floor(F.col("group_size") / 20))})
    return out.join(e, "query_id").join(gini(load, ["query_id"], "n", "load_gini"), "query_id").join(top, "query_id")


def yields(m1: DataFrame, m3: DataFrame, posts: DataFrame) -> DataFrame:
    """Per computed cell: similarities, winners among ranked documents, their ratio (null where none was computed)."""
    a = m1.groupBy("centroid_id").agg(F.sum("num_token_token_sims").alias("computed"))
    at = posts.select(F.col("embedding_pos").alias("winner_embedding_pos"), "centroid_id")
    b = m3.join(at, "winner_embedding_pos").groupBy("centroid_id").agg(F.count("*").alias("influential"))
    out = a.join(b, "centroid_id", "full_outer").na.fill(0)
    return out.withColumn("yield", F.col("influential") / F.nullif("computed", F.lit(0)))


def hubs(freq: DataFrame, yielded: DataFrame, low: float = 0.1, high: float = 0.3) -> DataFrame:
    """Cells with more than the 95th percentile of traffic are hubs, bad or good by their yield."""
    s = freq.join(yielded.select("centroid_id", "yield"), "centroid_id", "left")
    total = s.agg(F.sum("sel_freq").alias("_t"))
    s = s.crossJoin(F.broadcast(total)).withColumn("traffic_share", F.col("sel_freq") / F.nullif("_t", F.lit(0))).drop("_t")  # one row
    s = s.crossJoin(F.broadcast(s.agg(F.percentile("traffic_share", F.lit(0.95)).alias("_p"))))
    y = F.coalesce("yield", F.lit(0.0))
    kind = F.when(F.col("traffic_share") <= F.col("_p"), "normal").when(y < low, "bad_hub").when(y > high, "good_hub").otherwise("normal")
    return s.select("centroid_id", "sel_freq", "yield", "traffic_share", (F.col("traffic_share") * (1 - y)).alias("bad_hubness"), (F.col("traffic_share") * y).alias("good_hubness"), kind.alias("hub_type"))


def evidence_recall(m3: DataFrame, m4: DataFrame, ks: tuple[int, ...] = (10, 100, 1000)) -> DataFrame:
    """Per query and k: overlap of the k documents best by observed and by oracle evidence, over the smaller of k and the
    number of oracle documents. Ties go to the lower doc_id. m4: its rows, a row for each query and document (score), or the places of
    M3's documents among all (``pairs.oracle_places``)."""

    def ranked(rows: DataFrame, score: str, name: str) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(tie(F.col("s")).desc(), "doc_id")
        if "n" in rows.columns:
            return rows.where("doc_id is not null").select("query_id", "doc_id", (F.col("n") + 1).alias(name)).where(F.col(name) <= max(ks))
        rows = rows.groupBy("query_id", "doc_id").agg(F.sum(score).alias("s")) if score in rows.columns else rows.withColumnRenamed("score", "s")
        return rows.select("query_id", "doc_id", F.row_number().over(w).alias(name)).where(F.col(name) <= max(ks))

    # Past the greatest k only the number of oracle documents counts: it does not pass the ranking.
    if "n" in m4.columns:
        n = m4.where("doc_id is null and n > 0").select("query_id", "n")
    else:
        n = (m4.select("query_id", "doc_id").distinct() if "oracle_score" in m4.columns else m4).groupBy("query_id").agg(F.count("*").alias("n"))
    both = ranked(m4, "oracle_score", "o").join(ranked(m3, "winner_score", "a"), ["query_id", "doc_id"]).groupBy("query_id")
    hits = both.agg(*[F.count_if((F.col("o") <= k) & (F.col("a") <= k)).alias(f"_{k}") for k in ks])
    return n.join(hits, "query_id", "left").select("query_id", *[(F.coalesce(f"_{k}", F.lit(0)) / F.least(F.lit(k), "n")).alias(f"recall_at_{k}") for k in ks])


def evidence_dispersion(m4: DataFrame) -> DataFrame:
    """Distinct oracle cells per query and document: mean, median, greatest, share with one and with more. m4: its rows, or a row for
    each query and document (cells)."""
    n = m4.select(F.col("cells").alias("n")) if "cells" in m4.columns else m4.groupBy("query_id", "doc_id").agg(F.countDistinct("oracle_centroid_id").alias("n"))
    n = n.groupBy("n").agg(F.count("*").alias("c"))  # a row for each number of cells
    share = lambda cond: F.sum(F.when(cond, F.col("c")).otherwise(0)) / F.sum("c")
    return n.agg((F.sum(F.col("n") * F.col("c")) / F.sum("c")).alias("mean"), F.percentile("n", F.lit(0.5), F.col("c")).alias("median"), F.max("n").alias("max"), share(F.col("n") == 1).alias("single"), share(F.col("n") > 1).alias("several"))


def routing_fidelity(m5: DataFrame) -> DataFrame:
    """m5: its rows, or their counts by query (``pairs.misses``)."""
    if "oracle_win_count" in m5.columns:
        hits = F.col("oracle_win_count") - F.col("miss_count")
        return m5.select("query_id", hits.alias("hits"), F.col("miss_count").alias("misses"), (hits / F.col("oracle_win_count")).alias("fidelity"))
    return m5.groupBy("query_id").agg(F.count_if(~F.col("is_miss")).alias("hits"), F.count_if("is_miss").alias("misses"), F.avg((~F.col("is_miss")).cast("double")).alias("fidelity"))


# Frames: one wide row per cell, query or miss.


def quantile_bin(df: DataFrame, value: str, at: list[float], out: str, fill: bool = False) -> DataFrame:
    """Bin number (from 1) by linear quantiles: right-closed, lowest included, repeated edges dropped. Null stays null, or
    with ``fill`` counts as the median."""
    values = stored(df.select(F.col(value).cast("double").alias("x")))  # counted several times
    if fill:
        median = exact_quantiles(values, "x", [0.5])
        filled = df.withColumn("_v", F.coalesce(F.col(value).cast("double"), F.lit(median[0] if median else None).cast("double")))
        return quantile_bin(filled, "_v", at, out).drop("_v")
    edges = F.array(*[F.lit(float(e)) for e in sorted(set(exact_quantiles(values, "x", at) or []))]).cast("array<double>")
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.greatest(F.lit(1), F.size(F.filter(edges, lambda e: e < F.col(value))))))


def cluster_frame(offline: DataFrame, online: DataFrame, m6: DataFrame, m1: DataFrame) -> DataFrame:
    """offline ⟕ online ⟕ misses ⟕ computed similarities, with redundancy, log sizes, traffic quartile and flags."""
    miss = m6.select(F.col("oracle_centroid_id").alias("centroid_id"), "miss_count", "oracle_win_count", F.col("miss_rate").alias("m6_miss_rate"))
    sims = m1.groupBy("centroid_id").agg(F.sum("num_token_token_sims").alias("m1_sims"))
    out = offline.join(online, "centroid_id", "left").join(miss, "centroid_id", "left").join(sims, "centroid_id", "left")
    out = out.na.fill(0, ["miss_count", "oracle_win_count", "m1_sims", "sel_freq"])
    out = out.withColumn("redundancy", 1 - F.col("yield")).withColumn("log_n_tokens", F.log10(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))).withColumn("is_anti_hub", F.col("sel_freq") == 0)
    return quantile_bin(out, "sel_freq", [0, 0.25, 0.5, 0.75, 1], "traffic_quartile")


def query_frame(m2: DataFrame, activation: DataFrame, m5: DataFrame) -> DataFrame:
    """m5: its rows, or their counts by query (``pairs.misses``)."""
    if "oracle_win_count" in m5.columns:
        rest = F.when(F.col("oracle_win_count") > F.col("observed"), 0.0)  # the gap of what was not observed
        miss = m5.select("query_id", F.col("miss_count").alias("misses"), F.col("oracle_win_count").alias("oracle_wins"), (F.col("miss_count") / F.col("oracle_win_count")).alias("miss_rate"), F.greatest("max_delta", rest).alias("max_score_delta"))
        return m2.join(activation, "query_id", "left").join(miss, "query_id", "left")
    miss = m5.groupBy("query_id").agg(F.count_if("is_miss").alias("misses"), F.count("*").alias("oracle_wins"), F.avg(F.col("is_miss").cast("double")).alias("miss_rate"), F.max("score_delta").alias("max_score_delta"))
    return m2.join(activation, "query_id", "left").join(miss, "query_id", "left")


def miss_attribution(m5: DataFrame, offline: DataFrame) -> DataFrame:
    """Misses with the properties of the cell that holds the oracle winner, which are broadcast while they are small. m5: its rows, or the
    misses among them."""
    props = facts.near(offline.select(*[F.col(c).alias(f"oracle_{c}") for c in offline.columns]))
    return (m5.where("is_miss") if "is_miss" in m5.columns else m5).join(props, "oracle_centroid_id", "left")


def severity(m5: DataFrame) -> DataFrame:
    """Score gaps of misses by cell: count, mean, greatest, population deviation. m5: its rows, or their counts by cell (``pairs.misses``)."""
    if "oracle_win_count" in m5.columns:
        n, mean = F.col("miss_count"), F.col("sum_delta") / F.col("miss_count")
        top = F.greatest("max_missed", F.when(n > F.col("observed_misses"), 0.0))
        std = F.sqrt(F.greatest(F.lit(0.0), F.col("sum_square") / n - mean * mean))
        return m5.where("miss_count > 0").select("oracle_centroid_id", n.alias("n"), mean.alias("mean_score_delta"), top.alias("max_score_delta"), std.alias("std_score_delta"))
    return m5.where("is_miss").groupBy("oracle_centroid_id").agg(F.count("*").alias("n"), F.avg("score_delta").alias("mean_score_delta"), F.max("score_delta").alias("max_score_delta"), F.stddev_pop("score_delta").alias("std_score_delta"))
