"""The encoder stand-in takes documents up to their own limit, not that of queries."""

from __future__ import annotations

import numpy as np

from polyseek.operators import encode, text
from polyseek.plans import catalog


def test_documents_are_encoded_to_their_limit(spark):
    docs = spark.createDataFrame([(1, "word " * 100), (2, "word " * 600)], "doc_id long, text string")

    class Tables:
        def table(self, name):
            return docs

    got = {r.doc_id: r["count"] for r in catalog._encode(Tables()).groupBy("doc_id").count().collect()}
    assert got == {1: 100, 2: text.DOC_TOKENS}


def test_a_layer_goes_through_distinct_tokens(monkeypatch):
    """Vectors projected token by token equal the projection of hidden ones, also where kept tokens are dropped between batches."""
    layer = encode.projection(48, 8)
    plain = encode.hashed_encoder(48)
    fused = plain.through(layer)
    assert fused.own.shape[1] == 8  # no hidden vector is kept
    batches = [[["a", "bee", "a"], [], ["cat"]], [["dog", "bee", "egg", "fox"]], [["a"]]]
    for most in (encode.KEPT_BYTES, 1):
        monkeypatch.setattr(encode, "KEPT_BYTES", most)
        for texts in batches:
            for h, v in zip(plain(texts), fused(texts), strict=True):
                assert v.shape == (len(h), 8) and np.allclose(h @ layer, v, atol=1e-12)
