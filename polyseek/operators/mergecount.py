"""Concordant less discordant pairs by merging sorted runs, for each range of a cut table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Sum over pairs with x_i < x_j of w_i w_j sign(y_j - y_i); any order of rows.

    Runs of x are merged from pairs up: at each level one sorted search of all right halves in all left ones counts, by
    running weights, what lies below and above. Pairs of equal x count in no level that parts them: they are taken off by
    the same sum over each value of x, whose rows come in ascending y."""
    n = len(x)
    if n < 2:
        return 0
    order = np.lexsort((y, x))
    x, w = x[order], w[order].astype(np.int64)
    y = np.unique(y[order], return_inverse=True)[1].astype(np.int64)
    exact = int(w.sum()) ** 2 < 1 << 62
    product = (lambda a, b: int(a @ b)) if exact else (lambda a, b: int(a.astype(object) @ b.astype(object)))
    span, total, half = n + 1, 0, 1
    index = np.arange(n)
    while half < n:
        block, right = index // (2 * half), (index // half) % 2 == 1
        key = block * span + y
        left = np.sort(key[~right], kind="stable")
        by = np.argsort(key[~right], kind="stable")
        run = np.concatenate([[0], np.cumsum(w[~right][by])])
        k, b = key[right], block[right] * span
        low, high = np.searchsorted(left, b), np.searchsorted(left, b + span)
        below = run[np.searchsorted(left, k, side="left")] - run[low]
        above = run[high] - run[np.searchsorted(left, k, side="right")]
        total += product(w[right], below - above)
        half *= 2
    # Equal x: rows in ascending y, so that every pair of unequal y counted as concordant.
    same = np.concatenate([[True], x[1:] != x[:-1]])
    group = np.cumsum(same) - 1
    cell = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    of = lambda g: np.bincount(g, weights=w).astype(np.int64) if exact else np.array([int(w[g == i].sum()) for i in range(g[-1] + 1)], dtype=object)
    a, c = of(group), of(np.cumsum(cell) - 1)
    return total - (product(a, a) - product(c, c)) // 2


def concordance(points: DataFrame, part: str, x: str, y: str) -> int:
    """The sum of merged() over the ranges of points(part, x, y, c), each of which lies in one task."""
    rows = points.select(F.col(part).cast("long").alias("p"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col("c").cast("long").alias("c"))
    ranges = max(1, points.select(part).distinct().count())
    rows = rows.repartition(ranges, "p").sortWithinPartitions("p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"s": [str(merged(*(np.concatenate(c) for c in zip(*held, strict=True))))]})

        for batch in batches:
            p = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]])) if len(p) else np.zeros(1, int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if p[a] != now:
                    if held:
                        yield done()
                    now, held = p[a], []
                held.append(tuple(batch.column(i).to_numpy()[a:b] for i in (1, 2, 3)))
        if held:
            yield done()

    return int(rows.mapInArrow(run, "s string").agg(F.sum(F.col("s").cast("decimal(38,0)"))).first()[0] or 0)


def across(weights: dict[tuple[int, int], int]) -> int:
    """Concordant less discordant pairs of points that differ in both ranges, from the weight of each pair of ranges."""
    if not weights:
        return 0
    ps, qs = sorted({p for p, _ in weights}), sorted({q for _, q in weights})
    w = np.zeros((len(ps), len(qs)), dtype=object)
    for (p, q), c in weights.items():
        w[ps.index(p), qs.index(q)] = c
    before = np.cumsum(w, axis=0) - w  # of smaller ranges of x
    left = np.cumsum(before, axis=1) - before
    right = before.sum(axis=1)[:, None] - np.cumsum(before, axis=1)
    return int((w * (left - right)).sum())
