"""Centroid clustering: Lloyd's rounds in whole numbers over partition-local metric trees.

Vectors become whole numbers once; each task builds metric trees over at most ``TREE`` vectors of its own partition (no
shuffle, so copies that fill a partition do not matter) and writes them: of every ball its centre, radius, count and integer
sum. A round compares balls with the centroids from the top: where the triangle inequality puts a whole ball nearer to
one centroid than to all others its count and sum are added at once, else its halves are looked at, and at a leaf
the vectors themselves, by exact distances. Each task returns one row for each centroid; only their sums reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyseek.llm.common import saved, small_batches

WIDTH, SCALE, CLUSTERS, ROUNDS = 64, 1024, 8, 10
#: Vectors of one tree and of one leaf, at most.
TREE, LEAF = 4096, 32
#: Squared length of a vector up to which every squared distance of two fits a long.
LENGTH = 2.0**60
#: Relative slack of a radius.
SLACK = 1e-9

TREES = "ids array<long>, points binary, start array<int>, stop array<int>, left array<int>, radius array<double>, centre binary, total binary"


def whole_vectors(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the whole numbers floor(scale * x), of vectors(vec_id, embedding) of ``width`` components.

    Null vectors, those of other lengths or with null or non-finite components are left out, as are those so long that a
    squared distance could leave the range of a long (more than 2**30 after scaling)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") == width))
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale <= 2.0**30)))
    v = v.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("q"))
    return v.where(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x) <= LENGTH)


def grow(q: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of vectors (rows of q) in a metric tree, and its balls: start, stop (in that order), left (the first of
    two halves that follow one another; -1 at a leaf), radius, centre, total."""
    x = q.astype(float)
    order = np.arange(len(q))
    start, stop, left, radius, centre, total = [0], [len(q)], [-1], [], [], []
    at = 0
    while at < len(start):
        a, b = start[at], stop[at]
        rows = order[a:b]
        here = x[rows]
        mid = here.mean(axis=0)
        away = ((here - mid) ** 2).sum(axis=1)
        centre.append(mid), total.append(q[rows].sum(axis=0)), radius.append(float(np.sqrt(away.max())) * (1 + SLACK) + SLACK)
        if b - a > LEAF and away.max() > 0:
            p = here[away.argmax()]
            from_p = ((here - p) ** 2).sum(axis=1)
            o = here[from_p.argmax()]
            lean = from_p - ((here - o) ** 2).sum(axis=1)
            by = np.argsort(lean, kind="stable")
            cut = int((lean[by] < 0).sum())
            if not 0 < cut < b - a:  # halves by number, where rounding leaves one empty
                cut = (b - a) // 2
            order[a:b] = rows[by]
            left[at] = len(start)
            start += [a, a + cut]
            stop += [a + cut, b]
            left += [-1, -1]
        at += 1
    return order, {"start": np.array(start, np.int32), "stop": np.array(stop, np.int32), "left": np.array(left, np.int32), "radius": np.array(radius), "centre": np.array(centre), "total": np.array(total)}


def squared(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors, rows by centroids."""
    out = np.empty((len(q), len(centroids)), dtype=np.int64)
    for j, c in enumerate(centroids):
        d = q - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def owners(tree: dict[str, np.ndarray], q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(balls, the centroid that owns each whole ball, the nearest centroid of each vector that no such ball holds or -1)."""
    alone = np.full(len(q), -1, dtype=np.int64)
    balls, owner = [], []
    c = centroids.astype(float)
    front = np.zeros(1, dtype=np.int64)
    while len(front):
        m = tree["centre"][front]
        lengths = (m * m).sum(axis=1)[:, None] + (c * c).sum(axis=1)
        apart = np.maximum(0, lengths - 2 * m @ c.T)
        lost = 1e-13 * (lengths + 1)  # what rounding may lose of an expanded square
        apart_low, apart_high = np.sqrt(np.maximum(0, apart - lost)), np.sqrt(apart + lost)
        best = apart.argmin(axis=1)
        r = tree["radius"][front]
        upper = apart_high[np.arange(len(front)), best] + r
        others = apart_low - r[:, None]
        others[np.arange(len(front)), best] = np.inf
        sure = upper < others.min(axis=1)
        balls.append(front[sure]), owner.append(best[sure])
        rest = front[~sure]
        leaf = tree["left"][rest] < 0
        for ball in rest[leaf].tolist():
            a, b = tree["start"][ball], tree["stop"][ball]
            alone[a:b] = squared(q[a:b], centroids).argmin(axis=1)
        halves = tree["left"][rest[~leaf]].astype(np.int64)
        front = np.concatenate([halves, halves + 1])
    return np.concatenate(balls), np.concatenate(owner), alone


def trees(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """One row for each tree (``TREES``), written to the shared folder. Vectors are in tree order."""
    small_batches(vectors.sparkSession)

    def row(ids: list, q: np.ndarray) -> pa.RecordBatch:
        order, t = grow(q)
        data = {
            "ids": pa.array([[ids[i] for i in order.tolist()]], pa.list_(pa.int64())), "points": [q[order].tobytes()],
            **{n: pa.array([t[n].tolist()], pa.list_(pa.int32())) for n in ("start", "stop", "left")}, "radius": pa.array([t["radius"].tolist()], pa.list_(pa.float64())),
            "centre": [t["centre"].tobytes()], "total": [t["total"].tobytes()],
        }
        return pa.RecordBatch.from_pydict(data)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], np.zeros((0, width), np.int64)
        for batch in batches:
            ids += batch.column(0).to_pylist()
            held = np.concatenate([held, batch.column(1).flatten().to_numpy().reshape(-1, width)])
            while len(held) >= TREE:
                yield row(ids[:TREE], held[:TREE])
                ids, held = ids[TREE:], held[TREE:]
        if len(held):
            yield row(ids, held)

    return saved(whole_vectors(vectors, width, scale).mapInArrow(build, TREES))


def _read(batch: pa.RecordBatch, i: int, width: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    get = lambda n: batch.column(batch.schema.get_field_index(n))[i]
    tree = {n: get(n).values.to_numpy() for n in ("start", "stop", "left", "radius")}
    tree["centre"] = np.frombuffer(get("centre").as_py(), dtype=float).reshape(-1, width)
    tree["total"] = np.frombuffer(get("total").as_py(), dtype=np.int64).reshape(-1, width)
    return np.frombuffer(get("points").as_py(), dtype=np.int64).reshape(-1, width), tree


def sums(grown: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(cluster, count, sums of components) of each cluster with vectors."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * k, np.zeros((k, width), dtype=object)  # whole numbers of any size
        for batch in batches:
            for i in range(batch.num_rows):
                q, tree = _read(batch, i, width)
                balls, owner, alone = owners(tree, q, centroids)
                for j in range(k):
                    mine, rows = balls[owner == j], alone == j
                    count[j] += int((tree["stop"][mine] - tree["start"][mine]).sum()) + int(rows.sum())
                    total[j] += tree["total"][mine].sum(axis=0).astype(object) + q[rows].sum(axis=0).astype(object)
        there = [j for j in range(k) if count[j]]
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(there, pa.int32()), "n": pa.array([count[j] for j in there], pa.int64()), "s": pa.array([list(map(str, total[j])) for j in there], pa.list_(pa.string()))})

    parts = grown.select("points", "start", "stop", "left", "radius", "centre", "total").mapInArrow(run, "cluster int, n long, s array<string>")
    each = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect()  # a row for each centroid
    return [(r.cluster, r.n, [int(r[f"s{i}"]) for i in range(width)]) for r in rows]


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, width: int = WIDTH, scale: int = SCALE, salt: str = "3:") -> np.ndarray:
    """The vectors of least sha256 of ``salt`` and vec_id. Equal hashes (a repeated vec_id) go by the vectors, rows with a null
    vec_id come last."""
    q = whole_vectors(vectors, width, scale).withColumn("h", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256))
    rows = q.orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()
    return np.array([r.q for r in rows], dtype=np.int64).reshape(-1, width)


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """Per usable vector: vec_id, cluster, distance (squared, to its centroid), cluster_inertia, inertia, centroid_sha256.

    What is usable says whole_vectors(); of fewer vectors than ``k`` each is a centroid, an empty table gives an empty one.
    Repeated rows and null vec_ids are vectors of their own. Inertias beyond a long are null. Other columns are not read.
    """
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, k, width, scale)
    grown = trees(vectors, width, scale)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for j, n, s in sums(grown, centroids):
            moved[j] = [x // n for x in s]  # floors
        if (moved == centroids).all():
            break  # every further round would give the same
        centroids = moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, tree = _read(batch, i, width)
                balls, owner, near = owners(tree, q, centroids)
                for ball, j in zip(balls.tolist(), owner.tolist(), strict=True):
                    near[tree["start"][ball] : tree["stop"][ball]] = j
                d = q - centroids[near]
                ids = batch.column(batch.schema.get_field_index("ids"))[i].values
                yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": pa.array(near.astype(np.int32)), "distance": pa.array(np.einsum("ij,ij->i", d, d))})

    out = saved(grown.mapInArrow(run, "vec_id long, cluster int, distance long"))
    inertia = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("i")).collect()  # a row for each centroid
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    fits = lambda x: int(x) if x < 1 << 63 else None
    every = sum(int(r.i) for r in inertia)
    table = spark.createDataFrame([(r.cluster, fits(int(r.i)), fits(every), names[r.cluster]) for r in inertia], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # table: a row for each centroid
