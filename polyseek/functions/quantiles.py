"""Exact quantiles of a distributed column, by counting passes that narrow the interval of each wanted rank.

Doubles are seen as 64-bit numbers of the same order. A pass counts the next ``BITS`` bits of the values whose leading bits are
those of a wanted rank; tasks count on their own, and only counts (of at most ranks x 2**BITS intervals) are summed and reach
the driver. Once few values are left in the intervals they are fetched; six passes settle any column. No task sorts and none
sees more than its own rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, FETCHED = 12, 4096


def keys(x: np.ndarray) -> np.ndarray:
    """Numbers in the order of doubles; NaN comes last, -0 is 0."""
    x = np.where(np.isnan(x), np.nan, x) + 0.0
    k = x.view(np.int64)
    return (k ^ ((k >> 63) & np.int64((1 << 63) - 1))).view(np.uint64) ^ np.uint64(1 << 63)


def values(k: np.ndarray) -> np.ndarray:
    s = (k ^ np.uint64(1 << 63)).view(np.int64)
    return (s ^ ((s >> 63) & np.int64((1 << 63) - 1))).view(float)


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    col = batch.column(0)
    if pa.types.is_list(col.type):
        col = col.flatten()
    return col.drop_null().to_numpy(zero_copy_only=False).astype(float)


def _counted(rows: DataFrame, known: list[int], done: int, bits: int) -> dict[int, dict[int, int]]:
    """By leading ``done`` bits (of those in ``known``) the count of each value of the next ``bits``."""
    wanted = np.array(sorted(known), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            k = keys(_numbers(batch))
            if done:
                head = k >> np.uint64(64 - done)
                k = k[np.isin(head, wanted)]
            both, n = np.unique(k >> np.uint64(64 - done - bits), return_counts=True)
            for b, c in zip(both.tolist(), n.tolist(), strict=True):
                total[b] = total.get(b, 0) + c
        part = list(total)
        yield pa.RecordBatch.from_pydict({"head": pa.array([b >> bits for b in part], pa.int64()), "digit": pa.array([b & ((1 << bits) - 1) for b in part], pa.int32()), "n": pa.array([total[b] for b in part], pa.int64())})

    out: dict[int, dict[int, int]] = {}
    for r in rows.mapInArrow(run, "head long, digit int, n long").groupBy("head", "digit").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["head"], {})[r["digit"]] = r["n"]
    return out


def _fetched(rows: DataFrame, known: list[int], done: int) -> np.ndarray:
    wanted = np.array(sorted(known), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _numbers(batch)
            yield pa.RecordBatch.from_pydict({"x": pa.array(x[np.isin(keys(x) >> np.uint64(64 - done), wanted)])})

    got = rows.mapInArrow(run, "x double").collect()  # at most FETCHED for each rank
    return np.sort(keys(np.array([r.x for r in got], dtype=float)))


def order_statistics(rows: DataFrame, ranks: list[int], n: int | None = None) -> dict[int, float]:
    """The value of each rank (from 0) among the numbers of rows' only column (numbers or arrays of them, nulls left out)."""
    at = {r: (0, r) for r in ranks}  # leading bits, rank among the values that have them
    done = 0
    while done < 64:
        bits = min(BITS, 64 - done)
        counts = _counted(rows, sorted({h for h, _ in at.values()}), done, bits)
        left = {}
        for r, (head, rank) in at.items():
            for digit in sorted(counts[head]):
                c = counts[head][digit]
                if rank < c:
                    at[r], left[(head << bits) | digit] = ((head << bits) | digit, rank), c
                    break
                rank -= c
        done += bits
        if done < 64 and sum(left.values()) <= FETCHED * len(left) and sum(left.values()) <= 1 << 20:
            found = _fetched(rows, list(left), done)
            head = (found >> np.uint64(64 - done)).tolist()
            first = {h: int(i) for h, i in zip(*np.unique(np.array(head, dtype=np.uint64), return_index=True), strict=True)}
            return {r: float(values(found[first[h] + rank : first[h] + rank + 1])[0]) for r, (h, rank) in at.items()}
    return {r: float(values(np.array([h], dtype=np.uint64))[0]) for r, (h, _) in at.items()}


def exact_quantiles(df: DataFrame, column: str, at: list[float]) -> list[float] | None:
    """Quantiles with linear interpolation of a column of numbers, or of all numbers in a column of arrays; None if it has
    none. Nulls are left out."""
    rows = df.select(F.col(column))
    is_list = df.schema[column].dataType.typeName() == "array"
    rows = df.select(F.col(column).cast("array<double>" if is_list else "double").alias("x"))
    n = rows.agg(F.sum(F.size(F.array_compact("x"))) if is_list else F.count("x")).first()[0]
    if not n:
        return None
    spots = [p * (n - 1) for p in at]
    found = order_statistics(rows, sorted({f(s) for s in spots for f in (math.floor, math.ceil)}))
    return [found[math.floor(s)] + (found[math.ceil(s)] - found[math.floor(s)]) * (s - math.floor(s)) for s in spots]
