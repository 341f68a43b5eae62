"""Hard negatives: for anchors and their positives, the best rows of other labels inside a window of scores.

Norm-bucketed search. Candidates are range-partitioned by their length, sorted, and cut into buckets, each one row with its
greatest length; anchors are dealt to blocks of about equal size. A block meets stripes of buckets, longest first, one
matrix product for each bucket. By Cauchy-Schwarz no score of a bucket exceeds anchor length x bucket length: a
bucket whose bound lies below an anchor's running k-th score, or below the lower limits of all of its windows, is not
multiplied for that anchor, and where that holds for a whole block the bucket is not even sent to it. The first pass
finds each anchor's positives, the second, with the windows that these give, the negatives. What stripes find (k rows for
each anchor or window) is merged by rank.

Rows of equal vectors and labels have equal scores everywhere, so of each such group only the ``POSITIVES + 1`` of least
vec_id can be among the first: that many stay candidates, which changes no result and leaves no hot group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyseek.llm.common import parts, ranges, saved, small_batches

POSITIVES, NEGATIVES, EVERY, SCALE = 5, 3, 50, 256
#: Rows of a bucket and of a block of anchors, buckets of a stripe.
BUCKET, BLOCK, STRIPE = 2048, 512, 64
#: Squared length of a vector up to which every product of two fits a long.
LENGTH = 2.0**62
#: Products below this are exact in floating point.
EXACT = 2.0**52
#: Orders a null vec_id after all others.
LAST = (1 << 63) - 1

PACK = "part int, seq int, n int, width int, top double, uid binary, vec_id binary, none binary, label binary, q binary"
FOUND = "anchor long, slot int, vec_id long, score long"


def eligible(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """uid, vec_id, label (shifted where vec_id is divisible by 7), q = floor(scale * x) and its length, written out.

    Rows with a null label or vector or a null or non-finite component take no part, nor do those whose products could leave
    the range of a long (squared length beyond 2**62 after scaling)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v")).where("label is not null and v is not null")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale <= 2.0**31)))
    shifted = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = v.select("vec_id", shifted.alias("label"), F.transform("v", lambda x: F.floor(x * scale)).alias("q"))
    v = v.withColumn("length", F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))
    return saved(v.where(F.col("length") * F.col("length") <= LENGTH).withColumn("uid", F.monotonically_increasing_id()))


def packed(rows: DataFrame, size: int, blocks: int = 0) -> DataFrame:
    """``PACK``: at most ``size`` rows of one width each, longest first. Candidates (``blocks`` 0) are range-partitioned by length, so
    that packs are buckets of it; anchors are dealt to ``blocks`` by hash. Columns lo and hi (arrays) come along."""
    spark = rows.sparkSession
    windows = "lo" in rows.columns
    columns = ["length", "uid", "vec_id", "label", "q", *(("lo", "hi") if windows else ())]
    rows = rows.withColumn("_w", F.size("q")).withColumn("_b", F.pmod(F.xxhash64("uid"), F.lit(max(1, blocks))))
    if blocks:
        rows = rows.repartition(parts(spark), "_w", "_b")
    else:
        n, width = rows.agg(F.count("*"), F.max("_w")).first()
        rows = rows.withColumn("_b", F.lit(0).cast("long")).repartitionByRange(ranges(spark, n * 8 * (width or 1)), "_w", F.desc("length"), F.xxhash64("uid"))
    ranged = rows.sortWithinPartitions("_w", "_b", F.desc("length"), F.xxhash64("uid")).select(F.spark_partition_id().alias("part"), "_w", "_b", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seq = None, 0

        def row(t: pa.Table, seq: int) -> pa.RecordBatch:
            get = lambda n: t.column(n).combine_chunks()
            ids = get("vec_id")
            none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(LAST).to_numpy()
            out = {"part": t.column("part")[:1].combine_chunks(), "seq": pa.array([seq], pa.int32()), "n": pa.array([t.num_rows], pa.int32()), "width": t.column("_w")[:1].combine_chunks(), "top": pa.array([t.column("length")[0].as_py()])}
            out |= {"uid": [get("uid").to_numpy().tobytes()], "vec_id": [ids.tobytes()], "none": [none.tobytes()], "label": [get("label").to_numpy().tobytes()], "q": [get("q").flatten().to_numpy().astype("<i8").tobytes()]}
            if windows:
                out |= {n: [b"".join(np.array(w, dtype="<i8").tobytes() for w in get(n).to_pylist())] for n in ("lo", "hi")}
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows:
                w, b = held.column("_w").to_numpy(), held.column("_b").to_numpy()
                other = (w != w[0]) | (b != b[0])
                same = int(other.argmax()) if other.any() else len(w)
                if same < size and same == held.num_rows:
                    break
                take = min(same, size)
                yield row(held.slice(0, take), seq)
                held, seq = held.slice(take), seq + 1
        if held is not None and held.num_rows:
            yield row(held, seq)

    return saved(ranged.mapInArrow(run, PACK + (", lo binary, hi binary" if windows else "")))


class Pack:
    """A row of packed() as arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        get = lambda n: batch.column(batch.schema.get_field_index(n))[i].as_py()
        self.width, self.n = get("width"), get("n")
        self.uid, self.vec_id, self.label = (np.frombuffer(get(n), dtype="<i8") for n in ("uid", "vec_id", "label"))
        self.none = np.frombuffer(get("none"), dtype=bool)
        self.q = np.frombuffer(get("q"), dtype="<i8").reshape(self.n, self.width)
        self.length = np.sqrt((self.q.astype(float) ** 2).sum(axis=1))
        if get("lo") is not None:
            self.lo, self.hi = (np.frombuffer(get(n), dtype="<i8").reshape(self.n, -1) for n in ("lo", "hi"))


class Best:
    """The k best (score, then least vec_id) for each of n keys, merged as more come."""

    def __init__(self, n: int, k: int):
        self.k, self.size = k, np.zeros(n, np.int64)
        self.score, self.vec_id, self.none = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), bool)

    def floor(self) -> np.ndarray:
        """The k-th score of each key as a float, or minus infinity."""
        return np.where(self.size == self.k, self.score[:, -1].astype(float), -np.inf)

    def add(self, key: np.ndarray, score: np.ndarray, vec_id: np.ndarray, none: np.ndarray) -> None:
        if not len(key):
            return
        old = np.unique(key)
        at = np.arange(self.k) < self.size[old][:, None]
        key = np.concatenate([np.repeat(old, self.size[old]), key])
        score, vec_id, none = (np.concatenate([kept[old][at], new]) for kept, new in ((self.score, score), (self.vec_id, vec_id), (self.none, none)))
        order = np.lexsort((vec_id, none, -score, key))
        key, score, vec_id, none = key[order], score[order], vec_id[order], none[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        keep = rank < self.k
        key, rank = key[keep], rank[keep]
        self.score[key, rank], self.vec_id[key, rank], self.none[key, rank] = score[keep], vec_id[keep], none[keep]
        self.size[old] = np.bincount(np.searchsorted(old, key), minlength=len(old))


def _products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact products of whole vectors, in floating point where that is exact."""
    return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64) if bound < EXACT else a @ b.T


def _met(blocks: DataFrame, buckets: DataFrame, limit: bool) -> DataFrame:
    """Each block with the buckets of each stripe after it, longest first; with ``limit`` only buckets whose length reaches
    the block's least limit (column least, a lower limit over its anchor's length)."""
    spark = blocks.sparkSession
    count = buckets.groupBy("width").agg(F.count("*").alias("k")).collect()  # a row for each vector length
    if not count:
        return None
    stripes = saved(spark.createDataFrame([(r.width, s) for r in count for s in range(-(-r.k // STRIPE))], "width int, stripe int"))
    dealt = F.pmod(F.xxhash64("part", "seq"), F.col("_s")).cast("int")  # long and short ones in every stripe
    sizes = stripes.groupBy("width").agg(F.count("*").alias("_s"))
    right = buckets.join(F.broadcast(sizes), "width").withColumn("stripe", dealt).drop("_s")  # a row for each length
    meta = right.select("width", "stripe", "part", "seq", "top")
    left = blocks.join(stripes.hint("merge"), "width")
    asked = left.select(F.col("part").alias("_p"), F.col("seq").alias("_q"), "width", "stripe", *(["least"] if limit else []))
    pairs = asked.join(meta, ["width", "stripe"]).where("top >= least" if limit else "true").select("_p", "_q", "width", "stripe", "part", "seq")
    extra = [c for c in ("lo", "hi") if c in blocks.columns]
    body = ["n", "width", "top", "uid", "vec_id", "none", "label", "q"]
    sent = pairs.join(right.drop("width", "stripe"), ["part", "seq"]).select("_p", "_q", "stripe", F.lit(1).alias("role"), *body, *[F.lit(None).cast("binary").alias(c) for c in ("lo", "hi")])
    own = left.select(F.col("part").alias("_p"), F.col("seq").alias("_q"), "stripe", F.lit(0).alias("role"), *body, *[F.col(c) if c in extra else F.lit(None).cast("binary").alias(c) for c in ("lo", "hi")])
    both = own.unionByName(sent).repartition(parts(spark), "_p", "_q", "stripe")
    return both.sortWithinPartitions("_p", "_q", "stripe", "role", F.desc("top"))


def _searched(met: DataFrame | None, spark, slots: int, k: int, wanted: Callable) -> DataFrame:  # noqa: ANN001
    """``FOUND``: the k best of each anchor and slot in each stripe. wanted(block, bucket, rows, products, slot) marks them."""
    if met is None:
        return spark.createDataFrame([], FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, None

        def done() -> pa.RecordBatch:
            at = np.arange(k) < best.size[:, None]
            key = np.repeat(np.arange(len(best.size)), best.size)
            none = best.none[at]
            return pa.RecordBatch.from_pydict({"anchor": pa.array(block.uid[key // slots]), "slot": pa.array((key % slots).astype(np.int32)), "vec_id": pa.array(best.vec_id[at], mask=none), "score": pa.array(best.score[at])})

        for batch in batches:
            role = batch.column(batch.schema.get_field_index("role")).to_numpy()
            for i in range(batch.num_rows):
                now = Pack(batch, i)
                if role[i] == 0:
                    if block is not None:
                        yield done()
                    block, best = now, Best(now.n * slots, k)
                    continue
                bound = block.length * now.length[0] * (1 + 1e-9) + 1  # the bucket's first row is its longest
                floor = best.floor().reshape(-1, slots)
                lower = np.maximum(floor, block.lo.astype(float)) if hasattr(block, "lo") else floor
                rows = np.flatnonzero(bound >= lower.min(axis=1))
                for s in range(0, len(rows), 256):
                    some = rows[s : s + 256]
                    score = _products(block.q[some], now.q, float(bound[some].max()))
                    for slot in range(slots):
                        here = wanted(block, now, some, score, slot) & (score >= np.maximum(floor[some, slot], -(2.0**62))[:, None].astype(np.int64))
                        a, b = np.nonzero(here)
                        if len(a):
                            best.add(some[a] * slots + slot, score[a, b], now.vec_id[b], now.none[b])
        if block is not None:
            yield done()

    return saved(met.mapInArrow(run, FOUND))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for anchors (vec_id divisible by ``every``).

    Positives are an anchor's first other rows of its label, negatives of a positive the first rows of other labels with 50 *
    positive score <= 100 * negative score <= 95 * positive score. What takes part says eligible(); vectors of different
    lengths are not compared. Repeated rows are rows of their own; a null vec_id is no anchor and comes last among equal
    scores. Columns other than vec_id, embedding and label are not read; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = eligible(vectors)
    same = Window.partitionBy("label", "q").orderBy(F.asc_nulls_last("vec_id"), "uid")
    kept = rows.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= max(positives + 1, negatives)).drop("_r")
    buckets = packed(kept, BUCKET)
    asked = rows.where(F.col("vec_id") % every == 0)
    n_blocks = max(1, -(-asked.count() // (BLOCK * 3 // 4)))

    def like(block: Pack, bucket: Pack, some: np.ndarray, score: np.ndarray, slot: int) -> np.ndarray:
        return (block.label[some][:, None] == bucket.label) & (block.uid[some][:, None] != bucket.uid)

    near = _ranked(_searched(_met(packed(asked, BLOCK, n_blocks), buckets, False), spark, 1, positives, like), positives)
    # 2 * negative >= positive, 20 * negative <= 19 * positive, rounded to whole scores.
    p = F.col("score").cast("decimal(38,0)")
    lo, hi = F.ceil(p / 2).cast("long"), F.floor(p * 19 / 20).cast("long")
    near = saved(near.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), lo.alias("lo"), hi.alias("hi")))
    none = F.struct(F.lit(1 << 62).cast("long").alias("lo"), F.lit(-(1 << 62)).cast("long").alias("hi"))  # a window that holds nothing
    slots = near.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("lo", "hi")))).alias("m"))  # at most ``positives`` each
    slots = slots.select(F.col("anchor").alias("uid"), F.array(*[F.coalesce(F.col("m")[i], none) for i in range(positives)]).alias("w"))
    windows = asked.join(slots, "uid").withColumn("lo", F.col("w.lo")).withColumn("hi", F.col("w.hi")).drop("w")
    blocks = packed(windows, BLOCK, n_blocks)

    def other(block: Pack, bucket: Pack, some: np.ndarray, score: np.ndarray, slot: int) -> np.ndarray:
        return (block.label[some][:, None] != bucket.label) & (score >= block.lo[some, slot][:, None]) & (score <= block.hi[some, slot][:, None])

    @F.pandas_udf("double")
    def reach(n, lo, q):  # noqa: ANN001, ANN202
        """The length below which no row comes into any window of a block."""
        out = []
        for rows_, low, flat in zip(n, lo, q, strict=True):
            length = np.sqrt((np.frombuffer(flat, dtype="<i8").reshape(rows_, -1).astype(float) ** 2).sum(axis=1))
            limit = np.frombuffer(low, dtype="<i8").reshape(rows_, -1).min(axis=1).astype(float)
            out.append(float(np.where(limit > 0, limit / np.maximum(length, 1e-9), 0).min()) * (1 - 1e-9) - 1e-9)
        return type(n)(out, dtype=float)

    found = _searched(_met(blocks.withColumn("least", reach("n", "lo", "q")), buckets, True), spark, positives, negatives, other)
    out = _ranked(found, negatives).join(near, ["anchor", "slot"]).join(asked.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
