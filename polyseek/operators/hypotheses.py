"""The nine reports on how a search missed or wasted work: an aggregate or two each, then a rule on a few numbers.

Reports on cells read their frame's distributed rank correlations; where a rule resamples, it resamples one number a cell
on the driver, at most one for each cell of an index. Fewer than ``LEAST`` rows support nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyseek.functions.distributions import chi2_sf, correlation_p
from polyseek.operators import clusters, facts, statistics

LEAST = 10
SCHEMA = "hypothesis string, supported boolean, effect_size double, p_value double, n long"
#: What the severity of a cell's misses is compared with, and the least correlation that counts there.
SEVERITY_WITH = ("dispersion", "n_tokens", "n_docs", "yield", "gini_coefficient", "top_1_doc_share", "sel_freq")
SEVERITY_LEAST = 0.1
#: Share of a cell's tokens in its top document from which it counts as concentrated; shares that support a report.
CONCENTRATED, NO_FALLBACK, LUCKY = 0.5, 0.7, 0.8


def rank_correlation(df: DataFrame, x: str, y: str) -> tuple[float, float, int]:
    """Spearman's correlation, its two-sided p and the number of pairs; (0, 1) where there is none."""
    r, n = statistics.spearman(df, x, y).first()
    return (0.0, 1.0, n) if r is None or n < 3 else (float(r), correlation_p(r, n), n)


def _row(name: str, supported: bool, effect: float, p: float, n: int) -> tuple:
    return name, bool(supported and n >= LEAST), float(effect), float(p), int(n)


def diversity_yield(frame: DataFrame) -> tuple:
    """H3: cells of many documents a token yield more, or waste less."""
    f = frame.withColumn("diversity", F.col("n_docs") / F.nullif("n_tokens", F.lit(0)))
    r, p, n = rank_correlation(f, "diversity", "yield")
    w, q, _ = rank_correlation(f, "diversity", "redundancy")
    return _row("H3_diversity_yield", (r > 0 and p < 0.05) or (w < 0 and q < 0.05), r, p, n)


def diversity_quartiles(frame: DataFrame) -> DataFrame:
    """Mean yield and redundancy by quartile of diversity, and the yield over that of the first quartile."""
    f = frame.withColumn("diversity", F.col("n_docs") / F.nullif("n_tokens", F.lit(0))).where("yield is not null")
    f = clusters.quantile_bin(f, "diversity", [0, 0.25, 0.5, 0.75, 1], "quartile")
    rows = f.groupBy("quartile").agg(F.count("*").alias("cells"), F.avg("yield").alias("mean_yield"), F.avg("redundancy").alias("mean_redundancy"))
    first = F.broadcast(rows.where("quartile = 1").select(F.col("mean_yield").alias("_f")))  # one row
    return rows.crossJoin(first).withColumn("yield_multiplier", F.col("mean_yield") / F.nullif("_f", F.lit(0.0))).drop("_f")


def concentration_redundancy(frame: DataFrame) -> tuple:
    """H4: cells that one document dominates waste more, and more than their share of all waste."""
    f = frame.where("redundancy is not null and top_1_doc_share is not null")
    r, p, n = rank_correlation(f, "top_1_doc_share", "redundancy")
    on, waste = F.col("top_1_doc_share") > CONCENTRATED, F.col("redundancy") * F.col("m1_sims")
    s = f.agg(F.sum(F.when(on, waste)).alias("a"), F.sum(waste).alias("b"), F.count_if(on).alias("c")).first()
    more = bool(s.b) and bool(n) and (s.a or 0.0) / s.b > s.c / n
    return _row("H4_concentration_redundancy", r > 0 and p < 0.05 and more, r, p, n)


def dispersion_misses(frame: DataFrame) -> tuple:
    """H5: loose cells miss more."""
    r, p, n = rank_correlation(frame, "dispersion", "m6_miss_rate")
    return _row("H5_dispersion_misses", r > 0 and p < 0.05, r, p, n)


def hubness_redundancy(frame: DataFrame) -> tuple:
    """H10: cells that are probed often waste more."""
    r, p, n = rank_correlation(frame, "sel_freq", "redundancy")
    return _row("H10_hubness_redundancy", r > 0 and p < 0.05, r, p, n)


def miss_severity(frame: DataFrame, severity: DataFrame) -> tuple:
    """H15: a property of a cell goes with how bad its misses are; the strongest one is reported. Without misses, whether
    loose cells have more of them."""
    bad = severity.select(F.col("oracle_centroid_id").alias("centroid_id"), "mean_score_delta")
    f = frame.join(bad, "centroid_id")
    n = f.count()
    if not n:
        r, p, n = rank_correlation(frame, "dispersion", "miss_count")
        return _row("H15_miss_severity", r > 0 and p < 0.05, r, p, n)
    found = [x for x in (rank_correlation(f, c, "mean_score_delta") for c in SEVERITY_WITH) if x[2] > LEAST]
    r, p, _ = max(found, key=lambda x: abs(x[0]), default=(0.0, 1.0, 0))
    return _row("H15_miss_severity", any(x[1] < 0.05 and abs(x[0]) > SEVERITY_LEAST for x in found), r, p, n)


def borderline_misses(frame: DataFrame) -> tuple:
    """H17: among probed cells those that are probed least miss more: first against last quartile, resampled, or by rank."""
    f = frame.where("sel_freq > 0 and m6_miss_rate is not null")
    r, p, n = rank_correlation(f, "sel_freq", "m6_miss_rate")
    if n < LEAST:
        return _row("H17_borderline_misses", False, 0.0, 1.0, n)
    binned = clusters.quantile_bin(f, "sel_freq", [0, 0.25, 0.5, 0.75, 1], "quartile").where("quartile in (1, 4)").select("quartile", "m6_miss_rate")
    rates = [(x.quartile, x.m6_miss_rate) for x in binned.orderBy("quartile", "m6_miss_rate").collect()]  # one number for each cell
    low, high = (np.array([v for q, v in rates if q == k]) for k in (1, 4))
    diff, pb, pu = 0.0, 1.0, 1.0
    if len(low) > 1 and len(high) > 1:
        diff, pb = statistics.bootstrap_comparison(low, high)
        pu = statistics.mann_whitney(low, high)[1]
    return _row("H17_borderline_misses", (diff > 0 and pb < 0.05) or (r < 0 and p < 0.05), diff, min(pb, pu), n)


def no_fallback(fallback: DataFrame) -> tuple:
    """H3-coloc: most oracle winners out of reach leave no other embedding of their document in reach. A census: p is 0."""
    s = fallback.agg(F.count("*").alias("n"), F.count_if(F.col("num_fallback") == 0).alias("k")).first()
    share = s.k / s.n if s.n else 0.0
    return "H3_no_fallback", share > NO_FALLBACK, share, 0.0, s.n


def recall_by_routing(status: DataFrame, ranking: DataFrame) -> tuple:
    """H3, second part: fully routed documents are found more often than partly routed ones. With other than two statuses
    and two outcomes there is no test, and p is 1."""
    by = {x.routing_status: x for x in facts.recall_by(status, ranking, "routing_status").collect()}  # three at most
    rate = lambda k: by[k].found / by[k].pairs if k in by else 0.0
    diff, n, p = rate("fully_optimal") - rate("partial"), sum(x.pairs for x in by.values()), 1.0
    found = sum(x.found for x in by.values())
    if len(by) == 2 and 0 < found < n:
        marked = status.join(ranking.select("query_id", "doc_id", F.lit(1).alias("_f")), ["query_id", "doc_id"], "left")
        marked = marked.select("routing_status", F.col("_f").isNotNull().alias("found"))
        chi2, df = statistics.chi_square(marked, "routing_status", "found").first()
        p = chi2_sf(chi2, df)
    return "H3_recall_by_routing", diff > 0.01 and p < 0.05, diff, p, n


def lucky_oracle(status: DataFrame, ranking: DataFrame) -> tuple:
    """Rescue: partly routed documents that are found owe it to an oracle winner in reach."""
    by = {x.mechanism: x.pairs for x in facts.rescue(status, ranking).collect()}  # two at most
    n = sum(by.values())
    share = by.get("lucky_oracle", 0) / n if n else 0.0
    return "H3_lucky_oracle", share > LUCKY, share, 0.0, n


def reports(frame: DataFrame, severity: DataFrame, fallback: DataFrame, status: DataFrame, ranking: DataFrame) -> DataFrame:
    """(hypothesis, supported, effect_size, p_value, n), a row for each of the nine."""
    rows = [
        diversity_yield(frame), concentration_redundancy(frame), dispersion_misses(frame), hubness_redundancy(frame), miss_severity(frame, severity),
        borderline_misses(frame), no_fallback(fallback), recall_by_routing(status, ranking), lucky_oracle(status, ranking),
    ]
    return frame.sparkSession.createDataFrame(rows, SCHEMA)


def report_inputs(frame: DataFrame, fallback: DataFrame, status: DataFrame, ranking: DataFrame) -> DataFrame:
    """(name, value, n): the correlations, shares and differences that the rules of reports() judge, without their p-values."""
    f = frame.withColumn("diversity", F.col("n_docs") / F.nullif("n_tokens", F.lit(0)))
    pairs = [("diversity", "yield"), ("diversity", "redundancy"), ("top_1_doc_share", "redundancy"), ("dispersion", "m6_miss_rate"), ("sel_freq", "redundancy")]
    rows = []
    for x, y in pairs:
        s = statistics.spearman(f, x, y).first()
        rows.append((f"{x} {y}", s.r, s.n))
    lost = fallback.agg(F.count("*").alias("n"), F.count_if(F.col("num_fallback") == 0).alias("k")).first()
    rows.append(("no_fallback", lost.k / lost.n if lost.n else None, lost.n))
    rows += [(f"recall {r.routing_status}", r.recall, r.pairs) for r in facts.recall_by(status, ranking, "routing_status").collect()]  # three at most
    rows += [(f"rescue {r.mechanism}", None, r.pairs) for r in facts.rescue(status, ranking).collect()]  # two at most
    return frame.sparkSession.createDataFrame(rows, "name string, value double, n long")
