"""Running totals in the order of a number, without one window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets, at least: with more shuffle partitions there are as many as these.
BUCKETS = 64


def running_before(df: DataFrame, order: str, weight: str, out: str) -> DataFrame:
    """df with ``out``, the sum of weight over rows of smaller ``order`` (distinct values). Approximate quantiles cut the
    rows into buckets; totals run within buckets and, over one row for each bucket, between them."""
    n = max(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    edges = df.agg(F.percentile_approx(order, F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(16 * n))).first()[0] or []
    cuts = F.array(*[F.lit(e) for e in sorted(set(edges))]) if edges else F.array().cast("array<double>")
    df = df.withColumn("_b", F.size(F.filter(cuts, lambda e: e < F.col(order))))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("_b").agg(F.sum(weight).alias("_t"))
    totals = totals.select("_b", F.coalesce(F.sum("_t").over(before(Window.orderBy("_b"))), F.lit(0)).alias("_o"))
    own = F.coalesce(F.sum(weight).over(before(Window.partitionBy("_b").orderBy(order))), F.lit(0))
    return df.withColumn("_i", own).join(F.broadcast(totals), "_b").withColumn(out, F.col("_o") + F.col("_i")).drop("_b", "_o", "_i")  # a row for each bucket
