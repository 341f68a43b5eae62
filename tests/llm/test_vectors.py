"""Hard negatives and clustering over metric trees against plain versions, on vectors of odd kinds."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyseek.llm import balltree, negatives


def plain_negatives(rows):
    ok = [(v, (y + 1) % 10 if v is not None and v % 7 == 0 else y, [int(np.floor(256 * float(x))) for x in e]) for v, y, e in rows if y is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    order = lambda s, v: (-s, v is None, v or 0)
    out = []
    for i, (v, y, q) in enumerate(ok):
        if v is None or v % 50:
            continue
        scored = [(sum(a * b for a, b in zip(q, o[2], strict=True)), j) for j, o in enumerate(ok) if j != i and len(o[2]) == len(q)]
        scored.sort(key=lambda x: order(x[0], ok[x[1]][0]))
        for p, j in [x for x in scored if ok[x[1]][1] == y][:5]:
            fit = [(s, k) for s, k in scored if ok[k][1] != y and 50 * p <= 100 * s <= 95 * p][:3]
            out += [(v, ok[j][0], n, ok[k][0], p, s) for n, (s, k) in enumerate(fit, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(2048, 512), (40, 3)])
def test_negatives(spark, monkeypatch, sizes):
    monkeypatch.setattr(negatives, "BUCKET", sizes[0])
    monkeypatch.setattr(negatives, "BLOCK", sizes[1])
    monkeypatch.setattr(negatives, "STRIPE", 4)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(500, 6)) * rng.choice([0.1, 1, 5], size=(500, 1)) + 0.7
    rows = [(i, int(y), x.tolist()) for i, (x, y) in enumerate(zip(v, rng.integers(0, 4, 500), strict=True))]
    rows += [(1000 + i, 2, v[50].tolist()) for i in range(60)]  # copies of an anchor
    rows += [(50, 1, v[3].tolist()), (50, 1, v[3].tolist()), (None, 1, v[0].tolist()), (None, 2, v[0].tolist()), (1100, None, v[1].tolist()), (1150, 1, None), (1200, 1, [float("nan")] * 6), (1250, 1, [None, *[1.0] * 5])]
    rows += [(1300, 1, [1.0, 2.0]), (1301, 1, [1.0, 2.0]), (1302, 2, [0.5, 1.7]), (1350, 3, []), (1351, 3, [0.0] * 6), (1400, 1, [0.0] * 6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, uid string").repartition(3)
    got = sorted(map(tuple, negatives.mine(df).collect()), key=repr)
    assert got == plain_negatives(rows) and len(got) > 60
    assert negatives.mine(df.limit(0)).count() == 0


def test_pruned_buckets_are_not_sent(spark):
    """Windows of long anchors leave out the buckets of short rows before the join."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)) * np.where(np.arange(400) < 40, 10.0, 0.01)[:, None]
    rows = negatives.eligible(spark.createDataFrame([(i, i % 2, v) for i, v in enumerate(x.tolist())], "vec_id long, label int, embedding array<double>"))
    buckets = negatives.packed(rows, 20)
    blocks = negatives.packed(rows.where("vec_id < 5").withColumn("lo", F.array(F.lit(400_000))).withColumn("hi", F.array(F.lit(1 << 60))), 10, 1)
    sent = lambda least: negatives._met(blocks.withColumn("least", F.lit(least)), buckets, True).where("role = 1").count()
    assert 0 < sent(100.0) < sent(0.0) == buckets.count()


def plain_clusters(rows, k=8, rounds=10, width=64):
    ok = [(v, [int(np.floor(1024 * float(x))) for x in e]) for v, e in rows if e is not None and len(e) == width and all(x is not None and np.isfinite(x) for x in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cents = [r[1] for r in sorted(ok, key=key)[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        at = [near(q)[1] for _, q in ok]
        cents = [[sum(col) // at.count(j) for col in zip(*(q for (_, q), a in zip(ok, at, strict=True) if a == j), strict=True)] if j in at else c for j, c in enumerate(cents)]
    last = [near(q) for _, q in ok]
    inertia = {j: sum(d for d, a in last if a == j) for j in range(len(cents))}
    return sorted(((v, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for (v, _), (d, j) in zip(ok, last, strict=True)), key=repr)


@pytest.mark.parametrize("tree", [(4096, 32), (50, 4)])
def test_clusters(spark, monkeypatch, tree):
    monkeypatch.setattr(balltree, "TREE", tree[0])
    monkeypatch.setattr(balltree, "LEAF", tree[1])
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(5, 64)) * 3
    x = centres[rng.integers(0, 5, 300)] + 0.05 * rng.normal(size=(300, 64))
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(400 + i, x[0].tolist()) for i in range(90)]  # copies
    rows += [(7, x[8].tolist()), (None, x[9].tolist()), (None, x[9].tolist()), (500, None), (501, [float("inf")] * 64), (502, [None, *[0.0] * 63]), (503, [1.0] * 63), (504, [-0.0001] * 64)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    got = sorted(map(tuple, balltree.cluster(df).collect()), key=repr)
    assert got == plain_clusters(rows)
    few = df.where("vec_id < 3 or vec_id = 504")
    assert sorted(map(tuple, balltree.cluster(few).collect()), key=repr) == plain_clusters([r for r in rows if r[0] is not None and (r[0] < 3 or r[0] == 504)])
    assert balltree.cluster(df.limit(0)).count() == 0


def test_whole_balls_are_assigned():
    """Far clusters: most vectors are assigned by balls, and the assignment is the exact one."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-3000, 3000, size=(8, 64))
    q = centres[rng.integers(0, 8, 2000)] + rng.integers(-20, 20, size=(2000, 64))
    order, tree = balltree.grow(q)
    assert sorted(order.tolist()) == list(range(2000)) and all((tree["total"][i] == q[order[a:b]].sum(axis=0)).all() for i, (a, b) in enumerate(zip(tree["start"], tree["stop"], strict=True)))
    balls, owner, alone = balltree.owners(tree, q[order], centres)
    near = alone.copy()
    for ball, j in zip(balls, owner, strict=True):
        near[tree["start"][ball] : tree["stop"][ball]] = j
    assert (near == balltree.squared(q[order], centres).argmin(axis=1)).all() and (alone < 0).mean() > 0.9
