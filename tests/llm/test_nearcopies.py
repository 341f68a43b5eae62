"""The pipeline's near-dedup stage against brute-force Jaccard similarity, on edited copies."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from polyseek.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string"


def _shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _kept(rows):
    """Indices of the rows that stay."""
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (True, 0, 0)), (d is None, d or 0, i)) if find(i) in best else (d is None, d or 0, i)
    return sorted(b[2] for b in best.values())


def _edited():
    rng = random.Random(12)
    say = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    out = []
    for _ in range(60):
        base = say(rng.randint(60, 300))
        out.append(" ".join(base))
        for _ in range(3):
            words = list(base)
            for _ in range(rng.randint(1, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = say(1)[0]
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("hot", [512, 3])
def test_edited_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(nearcopies, "HOT", hot)  # 3: every group is a large bucket, in chunks of two with one pivot or so
    if hot == 3:
        monkeypatch.setattr(nearcopies, "CHUNK", 2)
        monkeypatch.setattr(nearcopies, "PIVOTS", 1)
    rows = list(enumerate(_edited()))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA).repartition(5)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    want = sorted(rows[i][0] for i in _kept(rows))
    assert sorted(r.doc_id for r in got.collect()) == want and len(want) < 150
    assert corpus_pipeline.near_dedup(spark, docs.where(F.lit(False)), "").count() == 0


def test_null_and_repeated_ids(spark):
    rng = random.Random(5)
    say = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(90))
    a, b, c, d, e, f = (say() for _ in range(6))
    rows = [
        (None, a), (None, b), (None, b + " x"),  # null ids: two texts, one of them twice
        (3, c), (None, c + " y"),  # a null id beside an id
        (7, d), (7, e), (7, e),  # one id with two texts
        (1, f), (7, f + " z"),  # a near copy under a repeated id
    ]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], SCHEMA).repartition(4)
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 3, 7, 7]
    texts = {r.text for r in got}
    assert len(got) == 6 and {a, c, d, e, f} < texts and len(texts & {b, b + " x"}) == 1


@pytest.mark.parametrize("hot", [512, 3])
def test_exact_candidates(spark, monkeypatch, hot):
    """Every pair of brute force shares a key, whatever is frequent; and the rows that stay are those of brute force."""
    monkeypatch.setattr(nearcopies, "HOT", hot)
    if hot == 3:
        monkeypatch.setattr(nearcopies, "CHUNK", 2)
        monkeypatch.setattr(nearcopies, "PIVOTS", 1)
        monkeypatch.setattr(nearcopies, "EVERY", 1)  # the shared passage is frequent
        monkeypatch.setattr(nearcopies, "WHOLE", 0)
    rng = random.Random(3)
    shared = " ".join("".join(rng.choice("xyz") for _ in range(5)) for _ in range(40))
    texts = [t if i % 3 else f"{shared} {t}" for i, t in enumerate(_edited())] + [shared, f"{shared} a", "one", "one two three four", "", None]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(rows)], "row long, doc_id long, text string").repartition(4)
    keys: dict = {}
    for r in nearcopies.prefix_buckets(docs.select("row", "text"), docs.select("row")).collect():
        keys.setdefault(r.row, set()).add(r.key)
    sets = [_shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert len(pairs) > 100 and all(keys[i] & keys[j] for i, j in pairs)
    got = sorted(r.row for r in nearcopies.kept_rows(docs, "row", exact=True).collect())
    assert got == sorted(_kept(rows))
    assert nearcopies.kept_rows(docs.limit(0), "row", exact=True).count() == 0


def test_prefix_sizes():
    for n in range(1, 300):
        k = nearcopies.prefix_size(n)
        assert n - k + 1 == -(-4 * n // 5) and 1 <= k <= n


def test_keys_of_several_rows():
    import pyarrow as pa

    rng = random.Random(8)
    keys = sorted(rng.randrange(40) for _ in range(90))
    want = sorted((k, i) for i, k in enumerate(keys) if keys.count(k) > 1)
    for size in (1, 2, 7, 100):
        batches = [pa.RecordBatch.from_pydict({"key": keys[i : i + size], "row": list(range(i, min(90, i + size)))}) for i in range(0, 90, size)]
        got = [(k, r) for b in nearcopies._several(iter(batches)) for k, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert sorted(got) == want
