"""Timing of the steps of a run: rows as they come, and their sums."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tracker:
    """Records how long named steps of iterations take, on the driver."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, str, float, int]] = []
        self.iteration = 0

    @contextmanager
    def step(self, name: str) -> Iterator[list[int]]:
        """Times what runs inside; numbers of rows put into the list that it gives are summed up with it."""
        rows: list[int] = []
        began = time.perf_counter()
        try:
            yield rows
        finally:
            self.rows.append((self.iteration, name, time.perf_counter() - began, sum(rows)))

    def next(self) -> None:
        self.iteration += 1

    def steps(self, spark: SparkSession) -> DataFrame:
        """(iteration, step, seconds, rows) of everything recorded."""
        return spark.createDataFrame(self.rows, "iteration int, step string, seconds double, rows long")

    def summary(self, spark: SparkSession) -> DataFrame:
        """(step, iterations, total, mean, rows) over all iterations."""
        return self.steps(spark).groupBy("step").agg(F.countDistinct("iteration").alias("iterations"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"), F.sum("rows").alias("rows"))
