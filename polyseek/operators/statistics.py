"""Statistics of frames: grouped aggregates do the work, rules and tail probabilities the rest on a few numbers."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyseek.functions.distributions import chi2_sf, correlation_p, normal_sf, t_two_sided
from polyseek.functions.prefix import running_before
from polyseek.functions.quantiles import exact_quantiles
from polyseek.operators import mergecount
from polyseek.sources.scratch import stored


#: What stratify() can give for a column, by name.
AGGREGATES: dict[str, Callable[[str], Column]] = {
    "mean": F.avg, "std": F.stddev, "median": F.median, "n": F.count, "min": F.min, "max": F.max, "sum": F.sum, "var": F.variance, "nunique": F.countDistinct,
    "q25": lambda c: F.percentile(c, F.lit(0.25)), "q75": lambda c: F.percentile(c, F.lit(0.75)),
}


def stratify(df: DataFrame, by: str | list[str], value: str | list[str], functions: tuple[str, ...] = ("mean", "std", "median", "n")) -> DataFrame:
    """Aggregates (names of ``AGGREGATES``) of one or several columns for each combination of one or several others. Columns are named
    by the function, and with several values by value and function. Null groups stay groups."""
    groups, values = ([x] if isinstance(x, str) else list(x) for x in (by, value))
    name = lambda v, f: f if len(values) == 1 else f"{v}_{f}"
    return df.groupBy(*groups).agg(*[AGGREGATES[f](v).alias(name(v, f)) for v in values for f in functions])


def describe_extended(df: DataFrame, value: str, at: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Moments with sample corrections (skewness and excess kurtosis too), range, quartile distance, percentiles."""
    s = df.agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.skewness(value).alias("_g"), F.kurtosis(value).alias("_k"),
    )
    found = exact_quantiles(df, value, list(at)) or [None] * len(at)
    s = s.select("*", *[F.lit(q).cast("double").alias(f"p{round(100 * p)}") for p, q in zip(at, found, strict=True)])
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("_g") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    kurt = F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col("_k") + 6))
    return s.withColumn("skewness", skew).withColumn("kurtosis", kurt).withColumn("iqr", F.col("p75") - F.col("p25")).drop("_g", "_k")


def average_ranks(df: DataFrame, value: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Ranks with ties averaged, from counts of each distinct value; nulls have none."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    if by:
        before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    else:
        counts = running_before(counts, value, "_n", "_p")
    counts = counts.withColumn(out, F.col("_p") + (F.col("_n") + 1) / 2).drop("_n", "_p")
    return df.join(counts, [*by, value], "left")


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return average_ranks(average_ranks(both, x, "_rx"), y, "_ry").agg(F.corr("_rx", "_ry").alias("r"), F.count("*").alias("n"))


#: Distinct points of one range of kendall(): a task sorts and merges these.
KENDALL_RANGE = 1 << 20


def _squares(points: DataFrame, by: str, *parts: str) -> DataFrame:
    """One row: sum over groups of ``by`` of (pairs of weight in different parts, for all parts named), as exact decimals."""
    square = lambda c: c.cast("decimal(38,0)") * c.cast("decimal(38,0)")
    sums = {(): points.groupBy(by).agg(F.sum("c").alias("w"))}
    for keys in [(p,) for p in parts] + ([parts] if len(parts) > 1 else []):
        sums[keys] = points.groupBy(by, *keys).agg(F.sum("c").alias("w"))
    total = None
    for keys, rows in sums.items():
        one = rows.agg(F.coalesce(F.sum(square(F.col("w"))), F.lit(0)).cast("decimal(38,0)").alias("s")).withColumn("s", F.col("s") * (-1 if len(keys) == 1 else 1))
        total = one if total is None else total.unionByName(one)
    return total.agg(F.sum("s").alias("s"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b of any number of rows, by merge counting.

    Distinct points, with their counts, are cut into ranges by (x, y) and by (y, x). Concordant minus discordant pairs within a
    range of x are counted by merging (mergecount.concordance), as are those within a range of y whose ranges of x differ; pairs
    that differ in both ranges follow from the weights of each pair of ranges. Equal x (or y) that a cut parts would count as
    concordant; what they add is taken off by sums over each value. No task sees more than a range, no pair becomes a row."""
    pts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("c"))
    pts = stored(pts)
    spark = pts.sparkSession
    n, points = pts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ranges = max(1, -(-points // KENDALL_RANGE))
    by_x = stored(pts.repartitionByRange(ranges, "x", "y").withColumn("p", F.spark_partition_id()))
    both = stored(by_x.repartitionByRange(ranges, "y", "x").withColumn("q", F.spark_partition_id()))
    within = mergecount.concordance(by_x, "p", "x", "y") + mergecount.concordance(both, "q", "p", "y")
    # Weights of pairs of ranges: ranges x ranges numbers.
    weights = {(r.p, r.q): r.w for r in both.groupBy("p", "q").agg(F.sum("c").alias("w")).collect()}
    across = mergecount.across(weights)
    same_x = _squares(by_x, "x", "p").first().s or 0
    same_y = _squares(both, "y", "p", "q").first().s or 0
    s = within + across - (int(same_x) + int(same_y)) // 2
    tied = lambda c: int(pts.groupBy(c).agg(F.sum("c").cast("decimal(38,0)").alias("k")).agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1)), F.lit(0)).cast("decimal(38,0)")).first()[0]) // 2
    pairs = n * (n - 1) // 2
    free = (pairs - tied("x")) * (pairs - tied("y"))
    return spark.createDataFrame([(s / math.sqrt(free) if free > 0 else None, n)], "tau double, n long")


def correlation_matrix(df: DataFrame, columns: list[str], method: str = "spearman") -> DataFrame:
    """(x, y, r, p, n) of each pair of columns over the rows where both are there; method: pearson, spearman, kendall. p is
    two-sided, by the t distribution (Kendall: by the normal one)."""
    of = {"pearson": pearson, "spearman": spearman, "kendall": kendall}[method]
    rows = []
    for i, x in enumerate(columns):
        for y in columns[i + 1 :]:
            r, n = of(df, x, y).first()
            if r is None or n < 3:
                p = None
            elif method == "kendall":
                p = 2 * normal_sf(abs(r) / math.sqrt(2 * (2 * n + 5) / (9 * n * (n - 1))))
            else:
                p = correlation_p(r, n)
            rows.append((x, y, r, p, n))
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double, p double, n long")


def gram(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """Covariances (sample) of all pairs of columns over the rows where all are there, in one pass, and the number of rows."""
    d = df.dropna(subset=columns).select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    k = len(columns)
    row = d.agg(F.count("*").alias("n"), *[F.covar_samp(f"_{i}", f"_{j}").alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    out = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] if row[f"c{min(i, j)}_{max(i, j)}"] is not None else np.nan for j in range(k)] for i in range(k)], dtype=float)
    return out, row.n


def partial_correlation(df: DataFrame, x: str, y: str, control: str | list[str] | tuple[str, ...], method: str = "pearson") -> DataFrame:
    """(r, p, n): correlation of x and y without what any list of controls explains, and its two-sided p by the t distribution. One pass
    gathers the covariances; what the controls explain is taken off by a Cholesky factor of theirs, controls that others explain
    (or that do not vary) left out. method spearman works on ranks over the rows where all are there. Null where x or y
    does not vary beyond the controls."""
    controls = [control] if isinstance(control, str) else list(control)
    columns = [x, y, *controls]
    if method == "spearman":
        df = df.dropna(subset=columns).select(*columns)
        for c in dict.fromkeys(columns):
            df = average_ranks(df, c, f"_rank_{c}")
        columns = [f"_rank_{c}" for c in columns]
    g, n = gram(df, columns)
    r, used = None, 0
    if n > 1 and np.isfinite(g).all():
        scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
        g = g / scale / scale[:, None]
        rest, todo = g.copy(), list(range(2, len(columns)))
        for c in todo:  # a row of the Cholesky factor for each control
            if rest[c, c] > 1e-10:
                rest = rest - np.outer(rest[:, c], rest[c]) / rest[c, c]
                used += 1
        if rest[0, 0] > 1e-10 and rest[1, 1] > 1e-10:
            r = float(max(-1.0, min(1.0, rest[0, 1] / math.sqrt(rest[0, 0] * rest[1, 1]))))
    p = correlation_p(r, n - used) if r is not None and n - used > 2 else None
    return df.sparkSession.createDataFrame([(r, p, n)], "r double, p double, n long")


def effect_sizes(df: DataFrame, by: str, value: str) -> DataFrame:
    """Cohen's d (pooled deviation) of each pair of groups, the first minus the second."""
    g = df.groupBy(by).agg(F.avg(value).alias("m"), F.variance(value).alias("v"), F.count(value).alias("n"))
    a, b = g.toDF("group_1", "m1", "v1", "n1"), g.toDF("group_2", "m2", "v2", "n2")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / F.nullif(F.col("n1") + F.col("n2") - 2, F.lit(0)))
    return a.join(b, F.col("group_1") < F.col("group_2")).select("group_1", "group_2", ((F.col("m1") - F.col("m2")) / F.nullif(pooled, F.lit(0.0))).alias("cohens_d"))


def group_comparison(df: DataFrame, by: str, value: str, baseline: object) -> DataFrame:
    """Each group against the baseline: means, relative difference, Welch's t with its degrees of freedom, Cohen's d and
    the Mann-Whitney U of the group."""
    g = df.groupBy(by).agg(F.avg(value).alias("m"), F.variance(value).alias("v"), F.count(value).alias("n"))
    base = g.where(F.col(by) == F.lit(baseline)).select(F.col("m").alias("bm"), F.col("v").alias("bv"), F.col("n").alias("bn"))
    rows = g.where(F.col(by) != F.lit(baseline)).crossJoin(F.broadcast(base))  # one row
    others = [r[0] for r in df.select(by).distinct().where(F.col(by) != F.lit(baseline)).orderBy(by).collect()]
    us = None
    for o in others:  # groups are labels of a report: few
        two = average_ranks(df.where(F.col(by).isin(o, baseline)), value, "_r").where(F.col(by) == F.lit(o))
        u = two.agg((F.sum("_r") - F.count(value) * (F.count(value) + 1) / 2).alias("mann_whitney_u")).withColumn(by, F.lit(o))
        us = u if us is None else us.unionByName(u)
    se = F.col("v") / F.col("n") + F.col("bv") / F.col("bn")
    dof = se**2 / F.nullif((F.col("v") / F.col("n")) ** 2 / (F.col("n") - 1) + (F.col("bv") / F.col("bn")) ** 2 / (F.col("bn") - 1), F.lit(0.0))
    pooled = F.sqrt(((F.col("n") - 1) * F.col("v") + (F.col("bn") - 1) * F.col("bv")) / F.nullif(F.col("n") + F.col("bn") - 2, F.lit(0)))
    return rows.join(us, by).select(
        by, F.col("m").alias("mean"), F.col("bm").alias("baseline_mean"), ((F.col("m") - F.col("bm")) / F.nullif("bm", F.lit(0.0))).alias("rel_diff"),
        ((F.col("m") - F.col("bm")) / F.nullif(F.sqrt(se), F.lit(0.0))).alias("t"), dof.alias("df"), ((F.col("m") - F.col("bm")) / F.nullif(pooled, F.lit(0.0))).alias("cohens_d"), "mann_whitney_u",
    )


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square statistic of the cross table and its degrees of freedom; Yates' correction for 2 x 2."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    ra, rb = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("rb"))
    full = ra.crossJoin(rb).join(cells, ["a", "b"], "left").withColumn("o", F.coalesce("o", F.lit(0)))  # labels of a report
    w = Window.partitionBy()
    full = full.withColumn("n", F.sum("o").over(w)).withColumn("e", F.col("ra") * F.col("rb") / F.col("n"))
    shape = full.withColumn("na", F.size(F.collect_set("a").over(w))).withColumn("nb", F.size(F.collect_set("b").over(w)))
    gap = F.abs(F.col("o") - F.col("e"))
    gap = F.when((F.col("na") == 2) & (F.col("nb") == 2), F.greatest(gap - F.least(gap, F.lit(0.5)), F.lit(0.0))).otherwise(gap)
    return shape.agg(F.sum(gap * gap / F.col("e")).alias("chi2"), ((F.max("na") - 1) * (F.max("nb") - 1)).alias("df"))


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """Simple regression with r2 and the HC3 standard error of the slope."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    fit = d.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.avg("x").alias("_m"), F.regr_sxx("y", "x").alias("_s"), F.count("*").alias("n"))
    e = d.crossJoin(F.broadcast(fit))  # one row
    u = F.col("x") - F.col("_m")
    leverage = 1 / F.col("n") + u * u / F.col("_s")
    part = (u * (F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")) / (1 - leverage)) ** 2
    one = lambda c: F.any_value(c).alias(c)
    return e.agg(one("slope"), one("intercept"), one("r2"), one("n"), (F.sqrt(F.sum(part)) / F.any_value("_s")).alias("slope_se_hc3"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """Each distinct non-null value with the share of values up to it."""
    c = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    total = F.broadcast(c.agg(F.sum("_n").alias("_t")))  # one row
    return running_before(c, value, "_n", "_p").crossJoin(total).select(value, ((F.col("_p") + F.col("_n")) / F.col("_t")).alias("cdf"))


def pareto(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows from the greatest value down with the share of rows and of the sum that they make up so far."""
    w = Window.orderBy(F.col(value).desc(), key)
    every = Window.partitionBy()
    run = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.select(key, value, (F.row_number().over(w) / F.count("*").over(every)).alias("rank_share"), (run / F.nullif(F.sum(value).over(every), F.lit(0))).alias("cum_share"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows of each of ``bins`` equal bins of [low, high); the last one holds high."""
    b = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1))
    return df.where(F.col(value).between(low, high)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


# Rules on a few numbers, on the driver.


def bootstrap_ci(values: list[float], statistic: Callable = np.mean, n: int = 1000, level: float = 0.95, seed: int = 42) -> tuple[float, float, float]:
    x = np.asarray(values, dtype=float)
    rng = np.random.default_rng(seed)
    draws = np.array([statistic(x[rng.integers(0, len(x), len(x))]) for _ in range(n)])
    return float(statistic(x)), float(np.quantile(draws, (1 - level) / 2)), float(np.quantile(draws, (1 + level) / 2))


def poisson_bootstrap(rows: DataFrame, by: str, value: str, name: Column, level: float = 0.95) -> DataFrame:
    """Per group: the mean over resamples of the weighted mean of value, and its interval. rows hold each row once for each
    resample ``b``; ``name`` tells them apart, and its hash is how often (Poisson, 1) the row is in the resample."""
    u = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    times, cum = F.lit(0), 0.0
    for i in range(8):
        cum += math.exp(-1) / math.factorial(i)
        times = times + F.when(F.col("_u") >= cum, 1).otherwise(0)
    m = rows.withColumn("_u", u).withColumn("_w", times).groupBy(by, "b").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("m"))
    tails = ((1 - level) / 2, (1 + level) / 2)
    return m.groupBy(by).agg(F.avg("m").alias("mean"), *[F.percentile("m", F.lit(q)).alias(n) for q, n in zip(tails, ("lo", "hi"), strict=True)])


def proportion_z(df: DataFrame, success: Column, null: float) -> DataFrame:
    """One row: rows, successes and the z of their share against ``null`` (null without rows)."""
    s = df.agg(F.count(success).alias("n"), F.count_if(success).alias("k"))
    return s.select("n", "k", ((F.col("k") / F.nullif("n", F.lit(0)) - null) / F.sqrt(F.lit(null * (1 - null)) / F.nullif("n", F.lit(0)))).alias("z"))


def bootstrap_comparison(a: list[float], b: list[float], statistic: Callable = np.mean, n: int = 1000, seed: int = 42) -> tuple[float, float]:
    """Difference of the statistic and its two-sided p: twice the smaller share of resampled differences past 0."""
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    rng = np.random.default_rng(seed)
    d = np.array([statistic(a[rng.integers(0, len(a), len(a))]) - statistic(b[rng.integers(0, len(b), len(b))]) for _ in range(n)])
    return float(statistic(a) - statistic(b)), float(min(1.0, 2 * min((d <= 0).mean(), (d >= 0).mean())))


def bootstrap_spearman(x: list[float], y: list[float], n: int = 1000, level: float = 0.95, seed: int = 42) -> tuple[float, float]:
    """Interval of the rank correlation over resampled pairs."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)

    def ranks(v: np.ndarray) -> np.ndarray:
        _, inv, c = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(c) - (c - 1) / 2)[inv]

    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        i = rng.integers(0, len(x), len(x))
        a, b = ranks(x[i]), ranks(y[i])
        if a.std() and b.std():
            out.append(np.corrcoef(a, b)[0, 1])
    # Correlations are at most 1 but for rounding.
    return tuple(float(min(1.0, max(-1.0, round(np.quantile(out, q), 12)))) for q in ((1 - level) / 2, (1 + level) / 2)) if out else (float("nan"), float("nan"))


def proportion_test(successes: int, n: int, null: float = 0.5, alternative: str = "two-sided") -> tuple[float, float]:
    z = (successes / n - null) / math.sqrt(null * (1 - null) / n)
    return z, {"two-sided": 2 * normal_sf(abs(z)), "greater": normal_sf(z), "less": normal_sf(-z)}[alternative]


def mann_whitney_p(u: float, n1: int, n2: int, ties: float = 0.0) -> float:
    """Two-sided p by the normal approximation, with continuity correction; ties is the sum of t**3 - t."""
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    return min(1.0, 2 * normal_sf((abs(u - n1 * n2 / 2) - 0.5) / sd)) if sd else 1.0


def mann_whitney(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """U of a, and the p that a is no greater than b, by the normal approximation with ties and continuity."""
    both = np.concatenate([a, b])
    _, back, counts = np.unique(both, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[back]
    u, n = float(ranks[: len(a)].sum() - len(a) * (len(a) + 1) / 2), len(both)
    sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - float((counts.astype(float) ** 3 - counts).sum()) / (n * (n - 1))))
    return u, normal_sf((u - len(a) * len(b) / 2 - 0.5) / sd) if sd else 1.0


def welch_p(t: float, df: float) -> float:
    return t_two_sided(t, df)


def chi_square_p(chi2: float, df: int) -> float:
    return chi2_sf(chi2, df)
