"""Links of correlated vectors against brute force."""

from __future__ import annotations

import numpy as np

from polyseek.llm import embeddings


def test_links_of_correlated_vectors(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(4200, 4)) @ rng.normal(size=(4, 64))).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = ((u @ u.T) >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embeddings.near_groups(df).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist() and want.sum() > 100_000
