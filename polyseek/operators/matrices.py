"""All-pairs products as products of matrix blocks: what a pair of blocks yields is reduced before it becomes rows.

Both sides are packed into rows that hold up to ``ROWS`` vectors each, without a shuffle. Blocks meet by an equi-join on the
number of the right block's group, which is broadcast if its size allows it; each pair of blocks is one matrix product in a
task, of which only the reduced result leaves it: the k best of each left row, or a maximum for each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyseek.functions.arrow import matrix

#: Vectors of a block, bytes of a side up to which it is broadcast, groups that a larger right side is met in.
ROWS, BROADCAST_BYTES, GROUPS = 1024, 64 << 20, 64


def packed(rows: DataFrame, ids: list[str], vector: str, name: str, sort: bool = False) -> DataFrame:
    """Blocks of rows: {name}_{id} (binaries of longs), {name}_v (binary), {name}_n. With ``sort`` rows of a task come by the first id."""
    chosen = rows.select(*[F.col(c).cast("long").alias(c) for c in ids], F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    if sort:
        chosen = chosen.sortWithinPartitions(ids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= ROWS:
                yield row(held.slice(0, ROWS))
                held = held.slice(ROWS)
        if held is not None and held.num_rows:
            yield row(held)

    def row(t: pa.Table) -> pa.RecordBatch:
        v = t.column("v").combine_chunks()
        out = {f"{name}_{c}": [t.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype("<i8").tobytes()] for c in ids}
        return pa.RecordBatch.from_pydict({**out, f"{name}_v": [matrix(v, len(v[0])).tobytes()], f"{name}_n": pa.array([len(v)], pa.int32())})

    return chosen.mapInArrow(run, ", ".join([*(f"{name}_{c} binary" for c in ids), f"{name}_v binary, {name}_n int"]))


def met(left: DataFrame, right: DataFrame, right_rows: int, width: int) -> DataFrame:
    """Every block of left with every block of right."""
    small = right_rows * width * 8 <= BROADCAST_BYTES
    groups = 1 if small else GROUPS
    own = next(c for c in right.columns if c.endswith("_v"))
    right = right.withColumn("_g", F.pmod(F.xxhash64(own), F.lit(groups)))
    left = left.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")))
    return left.join(F.broadcast(right) if small else right, "_g").drop("_g")


def sizes(rows: DataFrame, vector: str) -> tuple[int, int]:
    n, width = rows.agg(F.count(vector), F.max(F.size(vector))).first()
    return n, max(width or 1, 1)


def reduced(pairs: DataFrame, f: Callable[[dict[str, np.ndarray], np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """f(ids of both blocks, their products) for each pair of blocks, as rows of schema."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {n: batch.column(j)[i] for j, n in enumerate(names)}
                get = lambda n: np.frombuffer(cell[n].as_buffer(), dtype="<i8")  # noqa: E731, B023
                ids = {n: get(n) for n in names if not n.endswith(("_v", "_n"))}
                a, b = (np.frombuffer(cell[f"{s}_v"].as_buffer(), dtype=float).reshape(cell[f"{s}_n"].as_py(), -1) for s in ("a", "b"))
                if a.shape[1] == b.shape[1]:
                    out = f(ids, a, b)
                    if out is not None:
                        yield out

    return pairs.mapInArrow(run, schema)


def nearest(left: DataFrame, right: DataFrame, k: int, key: str = "centroid_id", vector: str = "cv", other_only: bool = True) -> DataFrame:
    """a, b, s, rank: the k rows of right with the greatest products (to nine digits; ties: least key) for each row of left. With
    ``other_only`` not the one of the same key. Blocks give k rows for each left row, a last ranking merges them."""
    n, width = sizes(right, vector)

    def best(ids: dict, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        score = a @ b.T
        shown = np.round(score, 9)
        if other_only:
            shown[ids[f"a_{key}"][:, None] == ids[f"b_{key}"]] = -np.inf
        by = np.argsort(ids[f"b_{key}"], kind="stable")
        order = by[np.argsort(-shown[:, by], axis=1, kind="stable")[:, :k]]
        here = np.isfinite(np.take_along_axis(shown, order, axis=1))
        row = np.repeat(np.arange(len(a)), order.shape[1])[here.ravel()]
        col = order.ravel()[here.ravel()]
        return pa.RecordBatch.from_arrays([pa.array(ids[f"a_{key}"][row]), pa.array(ids[f"b_{key}"][col]), pa.array(score[row, col])], names=["a", "b", "s"])

    found = reduced(met(packed(left, [key], vector, "a"), packed(right, [key], vector, "b"), n, width), best, "a long, b long, s double")
    w = Window.partitionBy("a").orderBy(F.round("s", 9).desc(), "b")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def token_maxima(qtok: DataFrame, tokens: DataFrame, form: str = "dot") -> DataFrame:
    """query_id, q_token_id, doc_id, score: the greatest product of each query token with any token of each document. form l2: the least
    squared distance, negative. A block of a document's tokens gives one row for each query token and document."""
    n, width = sizes(qtok, "qv")

    def best(ids: dict, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        score = a @ b.T
        if form == "l2":
            score = 2 * score - (a * a).sum(axis=1)[:, None] - (b * b).sum(axis=1)
        docs = ids["a_doc_id"]
        order = np.argsort(docs, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], docs[order][1:] != docs[order][:-1]]))
        top = np.maximum.reduceat(score[order], starts, axis=0)  # documents x query tokens
        m = len(starts)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.tile(ids["b_query_id"], m)), pa.array(np.tile(ids["b_q_token_id"], m)), pa.array(np.repeat(docs[order][starts], score.shape[1])), pa.array(top.ravel())], names=["query_id", "q_token_id", "doc_id", "score"]
        )

    pairs = met(packed(tokens, ["doc_id"], "v", "a", sort=True), packed(qtok, ["query_id", "q_token_id"], "qv", "b"), n, width)
    out = reduced(pairs, best, "query_id long, q_token_id long, doc_id long, score double")
    return out.groupBy("query_id", "q_token_id", "doc_id").agg(F.max("score").alias("score"))


def all_scores(qtok: DataFrame, centroids: DataFrame) -> DataFrame:
    """query_id, q_token_id, centroid_id, score of every query token and cell: rows for each pair, where the pairs are the answer."""
    n, width = sizes(centroids, "cv")

    def every(ids: dict, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        m = len(b)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids["a_query_id"], m)), pa.array(np.repeat(ids["a_q_token_id"], m)), pa.array(np.tile(ids["b_centroid_id"], len(a))), pa.array((a @ b.T).ravel())], names=["query_id", "q_token_id", "centroid_id", "score"]
        )

    pairs = met(packed(qtok, ["query_id", "q_token_id"], "qv", "a"), packed(centroids, ["centroid_id"], "cv", "b"), n, width)
    return reduced(pairs, every, "query_id long, q_token_id long, centroid_id long, score double")
