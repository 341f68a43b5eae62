"""What figures are drawn from: marks, boxes, two-dimensional bins, densities, fitted lines. Tables of a few rows from any number."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyseek.functions.quantiles import exact_quantiles
from polyseek.operators.statistics import ols
from polyseek.sources.scratch import stored


def percentile_marks(df: DataFrame, value: str, at: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(p, value): the marks of a distribution, exact."""
    found = exact_quantiles(df, value, list(at))
    return df.sparkSession.createDataFrame([(p, None if found is None else q) for p, q in zip(at, found or at, strict=True)], "p double, value double")


def box_figures(df: DataFrame, by: str, value: str, reach: float = 1.5) -> DataFrame:
    """Per group: n, q1, median, q3, the whiskers (the farthest values within reach x the quartile distance of the box) and how many
    values lie beyond. Groups are the labels of a figure; quartiles come from counting passes, the rest from one grouping."""
    rows = stored(df.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("double").alias("x")))
    groups = [r.g for r in rows.select("g").distinct().collect()]
    quartiles = [(g, *exact_quantiles(rows.where(F.col("g").eqNullSafe(F.lit(g))), "x", [0.25, 0.5, 0.75])) for g in groups]
    if not groups:
        return df.sparkSession.createDataFrame([], f"{by} {dict(df.dtypes)[by]}, n long, q1 double, median double, q3 double, low double, high double, outliers long")
    q = df.sparkSession.createDataFrame(quartiles, f"g {dict(df.dtypes)[by]}, q1 double, median double, q3 double")
    both = rows.join(F.broadcast(q), rows["g"].eqNullSafe(q["g"])).select(rows["g"], "x", "q1", "median", "q3")  # a row for each group
    gap = reach * (F.col("q3") - F.col("q1"))
    inside = (F.col("x") >= F.col("q1") - gap) & (F.col("x") <= F.col("q3") + gap)
    out = both.groupBy("g", "q1", "median", "q3").agg(F.count("*").alias("n"), F.min(F.when(inside, F.col("x"))).alias("low"), F.max(F.when(inside, F.col("x"))).alias("high"), F.count_if(~inside).alias("outliers"))
    return out.select(F.col("g").alias(by), "n", "q1", "median", "q3", "low", "high", "outliers")


def _bin(value: str, low: float, high: float, bins: int) -> Column:
    """Equal bins of [low, high], the last one closed."""
    return F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")


def histogram2d(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], bins: tuple[int, int]) -> DataFrame:
    """(bx, by, n) of the pairs of bins with any rows."""
    rows = df.where(F.col(x).between(*x_range) & F.col(y).between(*y_range))
    return rows.groupBy(_bin(x, *x_range, bins[0]).alias("bx"), _bin(y, *y_range, bins[1]).alias("by")).agg(F.count("*").alias("n"))


def density(df: DataFrame, value: str, by: str | None = None, bins: int = 128, bandwidth: float | None = None) -> DataFrame:
    """(group, at, density): a Gaussian kernel estimate per group, at the middles of equal bins from the least to the greatest value of
    all. Rows become counts of bins; the kernel is laid over these by a convolution. Bandwidth: Scott's rule for each group,
    the deviation times n ** (-1/5). Groups whose values do not vary have no density."""
    rows = df.where(F.col(value).isNotNull()).select((F.col(by).cast("string") if by else F.lit("all")).alias("g"), F.col(value).cast("double").alias("x"))
    spark = df.sparkSession
    low, high = rows.agg(F.min("x"), F.max("x")).first()
    schema = "group string, at double, density double"
    if low is None or low == high:
        return spark.createDataFrame([], schema)
    counts = rows.groupBy("g", _bin("x", low, high, bins).alias("b")).agg(F.count("*").alias("n")).collect()  # groups x bins rows
    spread = {r.g: (r.s, r.n) for r in rows.groupBy("g").agg(F.stddev("x").alias("s"), F.count("*").alias("n")).collect()}
    step = (high - low) / bins
    out = []
    for g, (s, n) in sorted(spread.items(), key=lambda kv: repr(kv[0])):
        h = bandwidth or (s or 0.0) * n ** -0.2
        if h <= 0:
            continue
        c = np.zeros(bins)
        for r in counts:
            if r.g == g:
                c[r.b] = r.n
        kernel = np.exp(-0.5 * (np.arange(-bins + 1, bins) * step / h) ** 2) / (h * np.sqrt(2 * np.pi))
        d = np.convolve(c, kernel)[bins - 1 : 2 * bins - 1] / n
        out += [(g, low + (i + 0.5) * step, float(d[i])) for i in range(bins)]
    return spark.createDataFrame(out, schema)


def fit_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y): both ends of the fitted line over the range of x."""
    ends = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.min(F.col(x).cast("double")).alias("a"), F.max(F.col(x).cast("double")).alias("b"))
    line = ols(df, x, y).crossJoin(F.broadcast(ends))  # one row each
    return line.select(F.explode(F.array("a", "b")).alias("x"), "slope", "intercept").select("x", (F.col("intercept") + F.col("slope") * F.col("x")).alias("y"))
