"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one vector kept of each group.

Centroids are fitted on at most ``SAMPLE`` distinct vectors (least hash first); every vector is indexed. Its home is the
cell of its best centroid; it also visits each cell c of lower number where its score falls short of the best by at most
spread * sin(t) * |c - best|, t being the angle of two vectors at the threshold. With spread 1 that finds every link: of
a linked pair with different homes, the vector of the higher home visits the lower one, and there the link is counted
for both. Homes of a cell are split into blocks
of bounded size and visitors stream past them, so that no cell has to fit anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyseek.llm.common import parts, pieces, saved, small_batches
from polyseek.llm.components import connected_components

THRESHOLD = 0.9
SPREAD = 1.0
SAMPLE = 20_000
SAMPLE_BYTES = 16 << 20
#: Distinct vectors for each cell, cells of one level at most, and homes of a block at most (about; fewer for long vectors).
CELL, CELLS, BLOCK = 4096, 4096, 4096
#: Homes of a cell beyond which it is divided: fewer are met in a few blocks.
CROWDED = 16 * CELL
BLOCK_BYTES = 32 << 20
#: Sampled homes for each centroid of a cell's own, and rows of a cell that one task deals out (about).
SUB_SAMPLE, DEAL = 8, 100_000
DEALT = "cell long, role int, rep long, mult long, v array<double>"
#: Visitors compared with a block at once.
GUESTS = 250
ROUNDS = 8


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """Unit rows in double precision, shorter vectors filled up with zeros."""
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(sizes) and (sizes == width).all():
        out = flat.reshape(-1, width)
    else:
        out = np.zeros((len(sizes), width))
        out[np.arange(width) < sizes[:, None]] = flat
    largest = np.abs(out).max(axis=1, keepdims=True) if width else np.ones((len(out), 1))
    out = out / np.where(largest > 0, largest, 1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centroids; an empty cell restarts at the vector that its centroid serves worst."""
    k = max(1, min(k, len(x)))
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        score = x @ c.T
        home = score.argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        empty = np.flatnonzero(np.bincount(home, minlength=k) == 0)
        if len(empty):
            total[empty] = x[np.argsort(score.max(axis=1), kind="stable")[: len(empty)]]
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-300), c)
    return c


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct vectors with a direction: v, least (vec_id, null if all are), mult (how many), written with a number of
    each vector's own, rep."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return saved(v.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult")).withColumn("rep", F.monotonically_increasing_id()))


def _near(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that join what ``linked`` (a x b) joins: each row and column with the least id of its component."""
    low_a, low_b = a.copy(), b.copy()
    big = np.iinfo(np.int64).max
    i, j = np.nonzero(linked)
    if not len(i):
        return [], []
    while True:
        new_a = np.full(len(a), big)
        np.minimum.at(new_a, i, low_b[j])
        new_a = np.minimum(low_a, new_a)
        new_b = np.full(len(b), big)
        np.minimum.at(new_b, j, new_a[i])
        new_b = np.minimum(low_b, new_b)
        if (new_a == low_a).all() and (new_b == low_b).all():
            break
        low_a, low_b = new_a, new_b
    rows, cols = np.unique(i), np.unique(j)
    return [*a[rows].tolist(), *b[cols].tolist()], [*low_a[rows].tolist(), *low_b[cols].tolist()]


def _visits(score: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best cell of each row, and which cells a vector that links with it may have as its best."""
    best = score.argmax(axis=1)
    return best, score >= score[np.arange(len(score)), best][:, None] - apart[best] - 1e-9


def _gaps(cells: np.ndarray, factor: float) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cells @ cells.T)) * factor


def _out(batch: pa.RecordBatch, row: np.ndarray, cell: np.ndarray, role: np.ndarray, at: int) -> pa.RecordBatch:
    """Rows of DEALT from those of batch, whose rep, mult and v are columns at, at + 1 and at + 2."""
    keep = pa.array(row)
    return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(role.astype(np.int32)), *(batch.column(at + i).take(keep) for i in range(3))], names=["cell", "role", "rep", "mult", "v"])


def divided(dealt: DataFrame, width: int, factor: float) -> DataFrame:
    """Homes and visitors of crowded cells (more than ``CROWDED`` homes) dealt to cells within each, by centroids of the
    cell's own, about one for ``CELL`` homes. Other cells stay; every cell's number becomes cell * CELLS + that within it."""
    spark = dealt.sparkSession
    sizes = saved(dealt.groupBy("cell").agg(F.count_if(F.col("role") == 0).alias("homes"), F.ceil(F.count("*") / DEAL).cast("int").alias("salts")))
    crowded = sizes.where(F.col("homes") > CROWDED).withColumn("n", F.least(F.ceil(F.col("homes") / CELL), F.lit(CELLS)).cast("int"))
    if crowded.isEmpty():
        return dealt
    other = dealt.join(F.broadcast(crowded.select("cell")), "cell", "left_anti").withColumn("cell", F.col("cell") * CELLS)
    sizes = crowded
    rows = dealt.join(F.broadcast(sizes), "cell")  # a row for each cell of the first level
    sample = rows.where("role = 0").where(F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("homes")) < SUB_SAMPLE * F.col("n")).select("cell", "v", "n")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = None, [], 1

        def done() -> pa.RecordBatch:
            c = spherical_kmeans(np.concatenate(held), n)
            return pa.RecordBatch.from_pydict({"cell": np.full(len(c), now), "sub": np.arange(len(c)), "v": pa.array(c.tolist(), pa.list_(pa.float64()))})

        for batch in batches:
            cell, v, wanted = batch.column(0).to_numpy(), matrix(batch.column(1), width), batch.column(2).to_numpy()
            for c in np.unique(cell):
                if c != now:
                    if held:
                        yield done()
                    now, held, n = c, [], int(wanted[cell == c][0])
                held.append(v[cell == c])
        if held:
            yield done()

    subs = saved(sample.repartition(parts(spark), "cell").sortWithinPartitions("cell").mapInArrow(fit, "cell long, sub long, v array<double>"))
    centres = subs.join(F.broadcast(sizes), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(-1).alias("role"), F.col("sub").alias("rep"), F.lit(0).cast("long").alias("mult"), "v")
    todo = rows.select("cell", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"), "role", "rep", "mult", "v").union(centres)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, cells, apart = None, [], None, None
        for batch in batches:
            cell, salt, role, rep = (batch.column(i).to_numpy() for i in range(4))
            bounds = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (salt[1:] != salt[:-1]) | ((role[1:] < 0) != (role[:-1] < 0)), [True]]))
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = batch.slice(s, e - s)
                if key != (cell[s], salt[s]):
                    key, held, cells = (cell[s], salt[s]), [], None
                if role[s] < 0:
                    held.append((rep[s:e], matrix(part.column(5), width)))
                    continue
                if cells is None:
                    order = np.argsort(np.concatenate([r for r, _ in held])) if held else np.zeros(0, dtype=int)
                    cells = np.concatenate([m for _, m in held])[order] if held else np.zeros((1, width))
                    apart = _gaps(cells, factor)
                best, near = _visits(matrix(part.column(5), width) @ cells.T, apart)
                r = role[s:e]
                near &= (r == 2)[:, None] | ((r == 1)[:, None] & (np.arange(len(cells)) < best[:, None]))
                own = np.flatnonzero(r < 2)  # homes, and the same vectors as visitors of their own cell
                row, sub = np.nonzero(near)
                row, sub, kind = np.concatenate([own, row]), np.concatenate([best[own], sub]), np.concatenate([r[own], np.full(len(row), 2)])
                yield _out(part, row, cell[s] * CELLS + sub, kind, 3)

    todo = todo.repartition(parts(spark), "cell", "salt").sortWithinPartitions("cell", "salt", "role")
    return saved(todo.mapInArrow(deal, DEALT).union(other))


def near_groups(vectors: DataFrame, threshold: float = THRESHOLD, spread: float = SPREAD) -> DataFrame:
    """Per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of
    different lengths. Equal vectors count as one with a multiplicity before anything is compared. Rows are told apart by
    their vectors, not their ids: rows with a null vec_id or one that repeats are vectors of their own, a component of
    null ids alone has a null component_id (and its rows are kept, as equal to it). Columns other than vec_id and embedding
    are not read; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    distinct = usable(vectors)
    n, width = distinct.agg(F.count("*"), F.max(F.size("v"))).first()
    width = width or 0
    picked = distinct.select("v", F.xxhash64("v").alias("o")).orderBy("o").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(width, 1)))))
    rows = [r.v for r in picked.select("v").collect()]
    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    wanted = -(-n // CELL)
    cells = spherical_kmeans(x, min(CELLS, wanted)) if len(x) else np.zeros((1, width))
    factor = spread * np.sqrt(max(0.0, 1 - threshold * threshold))
    apart = _gaps(cells, factor)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1 << 20):
                home, visits = _visits(matrix(batch.column(0), width) @ cells.T, apart)
                row, cell = np.nonzero(visits & (np.arange(len(cells)) < home[:, None]))
                every = np.arange(len(home))
                order = [1, 2, 0]  # rep, mult, v
                flat = pa.RecordBatch.from_arrays([batch.column(i) for i in order], names=["rep", "mult", "v"])
                yield _out(flat, np.concatenate([every, every, row]), np.concatenate([home, home, cell]), np.repeat([0, 1, 2], [len(every), len(every), len(row)]), 0)

    dealt = saved(distinct.select("v", "rep", "mult").mapInArrow(assign, DEALT))
    dealt = divided(dealt, width, factor)
    block = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(width, 1))))
    blocks = dealt.where("role = 0").groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    homes = dealt.where("role = 0").join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    guests = dealt.where("role > 0").join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = homes.unionByName(guests).select("cell", "block", "role", "rep", "mult", "v")
    pairs = pairs.repartition(parts(spark), "cell", "block").sortWithinPartitions("cell", "block", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, here, ids, mult, length, count = None, None, None, None, None, None
        for batch in batches:
            cell, block, role, rep, m = (batch.column(i).to_numpy() for i in range(5))
            size = np.diff(batch.column(5).offsets.to_numpy())
            v = matrix(batch.column(5), width)
            bounds = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (role[1:] != role[:-1]), [True]]))
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if role[s] == 0:
                    if key == (cell[s], block[s]):
                        here, ids, mult, length = np.concatenate([here, v[s:e]]), np.concatenate([ids, rep[s:e]]), np.concatenate([mult, m[s:e]]), np.concatenate([length, size[s:e]])
                    else:
                        key, here, ids, mult, length = (cell[s], block[s]), v[s:e], rep[s:e], m[s:e], size[s:e]
                    continue
                if key != (cell[s], block[s]):
                    continue
                count, back, edges = np.zeros(len(ids), np.int64), np.zeros(e - s, np.int64), []
                for t in range(s, e, GUESTS):
                    g = slice(t, min(t + GUESTS, e))
                    linked = (here @ v[g].T >= threshold) & (ids[:, None] != rep[g]) & (length[:, None] == size[g])
                    count += linked @ m[g]
                    if role[s] == 2:  # from another cell, where ``here`` does not visit
                        back[t - s : g.stop - s] = mult @ linked
                    edges.append(np.array(_near(linked, ids, rep[g]), dtype=np.int64).reshape(2, -1))
                a, b = np.unique(np.concatenate(edges, axis=1), axis=1).tolist()
                who, n_ = np.concatenate([ids[count > 0], rep[s:e][back > 0]]).tolist(), np.concatenate([count[count > 0], back[back > 0]]).tolist()
                yield pa.RecordBatch.from_pydict({"a": pa.array([*who, *a], pa.int64()), "b": pa.array([None] * len(who) + b, pa.int64()), "n": pa.array([*n_, *[0] * len(a)], pa.int64())})

    found = saved(pairs.mapInArrow(compare, "a long, b long, n long"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    roots = roots.toDF("_v", "root")
    classes = distinct.join(counts, F.col("rep") == F.col("a"), "left").join(roots, F.col("rep") == F.col("_v"), "left")
    classes = saved(classes.select(F.col("v").alias("_e"), "least", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")))
    lows = classes.groupBy("root").agg(F.min("least").alias("component"))
    rows_ = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("_e"))
    out = rows_.join(classes.join(lows, "root").drop("least"), "_e", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("root").isNotNull(), F.col("component")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
