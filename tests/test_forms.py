"""Stored forms and block arithmetic against plain versions: packed codes, pruned scans, quantiles, merge counting, runs, ragged vectors."""

from __future__ import annotations

import itertools
import math
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyseek.functions import quantiles
from polyseek.operators import blocks, facts, index, matrices, mergecount, plots, ragged, search, statistics, text
from polyseek.plans.config import SearchConfig
from polyseek.plans.fixture import CONFIG, Fixture
from polyseek.sources import readers
from polyseek.sources.runs import Measures, Run

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
there = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def vectors(spark, n=300, width=12, seed=3):
    v = np.random.default_rng(seed).normal(size=(n, width))
    return spark.createDataFrame([(i, i // 4, i % 4, x) for i, x in enumerate(v.tolist())], "vec_id long, doc_id long, pos long, v array<double>")


@pytest.mark.parametrize(("nbits", "width"), [(1, 11), (2, 9), (2, 12), (4, 7), (4, 12), (8, 5)])
def test_byte_tables(nbits, width):
    rng = np.random.default_rng(nbits)
    codes = rng.integers(0, 1 << nbits, (50, width))
    packed = blocks.pack_bytes(codes, nbits)
    assert packed.shape == (50, -(-width * nbits // 8)) and (blocks.unpack_bytes(packed, nbits, width) == codes).all()
    weights, q = rng.normal(size=1 << nbits), rng.normal(size=(3, width))
    tables = blocks.byte_tables(q, weights, nbits)
    got = sum(tables[:, b, :][:, packed[:, b]] for b in range(packed.shape[1]))
    assert np.allclose(got, q @ weights[codes].T)


def small_index(spark, nbits=4):
    tokens = vectors(spark)
    seeds = tokens.where("vec_id < 20").select(F.col("vec_id").alias("centroid_id"), F.col("v").alias("cv"))
    return tokens, index.build(tokens, seeds, nbits, heldout=F.lit(True))


@pytest.mark.parametrize("nbits", [2, 4])
def test_search_of_blocks(spark, tmp_path, monkeypatch, nbits):
    """Blocks, of one cell in several and with several groups of tokens each, give what the join of rows gives."""
    monkeypatch.setattr(blocks, "BLOCK", 3)
    monkeypatch.setattr(blocks, "TOKENS", 2)
    monkeypatch.setattr(blocks, "FOLDERS", 5)
    tokens, built = small_index(spark, nbits)
    q = tokens.where("vec_id % 7 = 0").select((F.col("vec_id") % 5).alias("query_id"), F.col("vec_id").alias("q_token_id"), F.col("v").alias("qv"))
    config = SearchConfig.of(nprobe=3, k=30, t_prime=20)
    columns = ("query_id", "doc_id", "rank", F.round("score", 9), "influential")
    want = rows_of(search.search(q, built, config), *columns)
    built.save(str(tmp_path / "x"))
    loaded = index.Index.load(spark, str(tmp_path / "x"))
    assert len(want) > 50 and rows_of(search.search(q, loaded, config), *columns) == want
    monkeypatch.setattr(blocks, "PROBE_BYTES", 0)  # both sides shuffled
    assert rows_of(search.search(q, loaded, config), *columns) == want
    some = tokens.where("doc_id % 3 = 0").select("doc_id")
    assert rows_of(search.search(q, loaded, config, some), *columns) == rows_of(search.search(q, built, config, some), *columns)
    assert search.search(q.limit(0), loaded, config).count() == 0


def test_a_search_reads_only_probed_folders(spark, tmp_path, monkeypatch):
    """Folders of cells that are not probed are broken: a search that read them would fail."""
    monkeypatch.setattr(blocks, "FOLDERS", 20)
    tokens, built = small_index(spark)
    built.save(str(tmp_path / "x"))
    loaded = index.Index.load(spark, str(tmp_path / "x"))
    q = tokens.where("vec_id = 3").select(F.lit(0).cast("long").alias("query_id"), F.lit(0).cast("long").alias("q_token_id"), F.col("v").alias("qv"))
    config = SearchConfig.of(nprobe=2, k=10, t_prime=0)
    want = rows_of(search.search(q, built, config), "doc_id", F.round("score", 9))
    probed = {r.centroid_id for r in search.routes(q, search.centroid_matrix(built.centroids), 2, 0).select(F.inline("probes")).collect()}
    assert len(probed) == 2 and loaded.per_folder == 1
    broken = 0
    for part in (tmp_path / "x/cells").glob("cell_folder=*/*.parquet"):
        if int(part.parent.name.split("=")[1]) not in probed:
            part.write_bytes(b"not parquet" * 20)
            (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
            broken += 1
    assert broken > 5 and rows_of(search.search(q, loaded, config), "doc_id", F.round("score", 9)) == want
    plan = blocks.of_cells(loaded.blocks, sorted(probed), 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell_folder" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_documents_of_a_saved_index(spark, tmp_path, monkeypatch):
    tokens, built = small_index(spark)
    built.save(str(tmp_path / "x"))
    loaded = index.Index.load(spark, str(tmp_path / "x"))
    asked = spark.createDataFrame([(3,), (40,), (3,), (None,), (999,)], "doc_id long")
    want = rows_of(built.of_documents(asked), "embedding_pos", "doc_id", "codes")
    assert len(want) == 8
    found = loaded.of_documents(asked)
    assert rows_of(found, "embedding_pos", "doc_id", "codes") == want
    assert "GreaterThanOrEqual(doc_id,3)" in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(index, "FEW", 1)
    assert rows_of(loaded.of_documents(asked), "embedding_pos", "doc_id", "codes") == want
    assert loaded.of_documents(asked.limit(0)).count() == 0


def test_quantiles(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=3000), rng.integers(0, 3, 2000), [0.0, -0.0, 1e300, -1e300, 5e-324]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 5, "x double").repartition(3)
    at = [0, 0.001, 0.25, 0.5, 0.77, 0.999, 1]
    want = np.quantile(x, at).tolist()
    assert quantiles.exact_quantiles(df, "x", at) == pytest.approx(want, rel=1e-12)
    monkeypatch.setattr(quantiles, "FETCHED", 0)  # all passes, down to the last bit
    assert quantiles.exact_quantiles(df, "x", at) == pytest.approx(want, rel=1e-12)
    lists = spark.createDataFrame([([1.0, None, 3.0],), (None,), ([],), ([2.0],)], "x array<double>")
    assert quantiles.exact_quantiles(lists, "x", [0, 0.5, 1]) == [1.0, 2.0, 3.0]
    assert quantiles.exact_quantiles(df.limit(0), "x", [0.5]) is None
    k = quantiles.keys(np.array([-np.inf, -1.0, -0.0, 0.0, 2.0, np.inf, np.nan]))
    assert (np.diff(k.astype(object)) >= 0).all() and np.isnan(quantiles.values(k)[-1]) and quantiles.values(k)[:2].tolist() == [-np.inf, -1.0]


def test_kendall_in_ranges(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for top in (4, 30, 1000):
        x, y = rng.integers(0, top, 200), rng.integers(0, top, 200)
        x[:80] = 1  # one value in many ranges
        sign = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
        pairs = lambda v: (v[:, None] != v).sum() / 2
        want = sign.sum() / 2 / math.sqrt(pairs(x) * pairs(y))
        df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y, strict=True)] + [(None, 1), (1, None)], "x int, y int")
        for size in (1 << 20, 7):
            monkeypatch.setattr(statistics, "KENDALL_RANGE", size)
            r = statistics.kendall(df, "x", "y").first()
            assert r.n == 200 and abs(r.tau - want) < 1e-12
    assert statistics.kendall(df.limit(0), "x", "y").first().tau is None
    assert statistics.kendall(df.where("x = 1"), "x", "y").first().tau is None
    big = np.array([1 << 33, 1 << 33])
    assert mergecount.merged(np.array([0.0, 1.0]), np.array([1.0, 2.0]), big) == 1 << 66


def test_kmeans_sums_inside_tasks(spark):
    tokens = vectors(spark).repartition(5)
    seeds = tokens.where("vec_id < 9").select(F.col("vec_id").alias("centroid_id"), F.col("v").alias("cv")).unionByName(spark.createDataFrame([(99, [0.0] * 12)], "centroid_id long, cv array<double>"))
    a, b = ({r.centroid_id: np.array(r.cv) for r in index.lloyd(tokens, seeds, 2, rows=k).collect()} for k in (None, 0))
    assert a.keys() == b.keys() and all(np.allclose(a[c], b[c]) for c in a) and not a[99].any()
    sums = index.cell_sums(tokens, index.centroid_matrix(seeds))
    assert sums.agg(F.sum("n")).first()[0] == 300 and sums.groupBy("centroid_id").count().where("count > 1").count() == 0


@pytest.mark.parametrize("size", [64 << 20, 0])
def test_block_products(spark, monkeypatch, size):
    monkeypatch.setattr(matrices, "BROADCAST_BYTES", size)
    monkeypatch.setattr(matrices, "ROWS", 16)
    monkeypatch.setattr(matrices, "GROUPS", 3)
    t = vectors(spark, 90)
    x = np.array([r.v for r in t.orderBy("vec_id").collect()])
    score = np.round(x @ x.T, 9)
    np.fill_diagonal(score, -np.inf)
    got = matrices.nearest(t, t, 4, "vec_id", "v")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = [(i, int(j), r + 1) for i in range(90) for r, j in enumerate(np.argsort(-score[i], kind="stable")[:4])]
    assert rows_of(got, "a", "b", "rank") == sorted(want, key=repr)
    q = t.where("vec_id < 20").select((F.col("vec_id") % 3).alias("query_id"), F.col("vec_id").alias("q_token_id"), F.col("v").alias("qv"))
    best = {(r.q_token_id, r.doc_id): r.score for r in matrices.token_maxima(q, t).collect()}
    full = x[:20] @ x.T
    assert len(best) == 20 * 23 and all(abs(s - full[i, 4 * d : 4 * d + 4].max()) < 1e-12 for (i, d), s in best.items())
    assert matrices.nearest(t.limit(0), t, 4, "vec_id", "v").count() == 0 == matrices.nearest(t, t.limit(0), 4, "vec_id", "v").count()


@there
def test_stages_in_arrays_equal_stages_in_rows(spark, monkeypatch):
    t = Fixture(spark, DATA)
    found = search.stage_candidates(t.qtok, t.index, 2)
    run = lambda: (rows_of(search.stage_filter(found, t.qtok, t.index, 30, 0.2), "query_id", "doc_id", F.round("score", 8)), rows_of(search.stage_scores(found, t.qtok, t.index), "query_id", "doc_id", F.round("score", 8)))
    want = run()
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    assert run() == want and all(want)


def test_partial_correlation(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(400, 3))
    x, y = z @ [1, 2, 0] + rng.normal(size=400), z @ [1, -1, 3] + 0.5 * rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b), *map(float, c), 1.0, float(c[0] * 2 + 1)) for a, b, c in zip(x, y, z, strict=True)] + [(1.0, None, 0.0, 0.0, 0.0, 1.0, 0.0)], "x double, y double, z0 double, z1 double, z2 double, one double, twice double")

    def left(v, controls):
        m = np.column_stack([np.ones(400), *controls])
        return v - m @ np.linalg.lstsq(m, v, rcond=None)[0]

    for names, cols in ((["z0"], [z[:, 0]]), (["z0", "z1", "z2"], list(z.T)), (["z0", "twice", "one"], [z[:, 0]]), ([], [])):
        r = statistics.partial_correlation(df, "x", "y", names).first()
        want = np.corrcoef(left(x, cols), left(y, cols))[0, 1]
        assert abs(r.r - want) < 1e-9 and 0 <= r.p <= 1 and r.n == 400
    rank = lambda v: np.argsort(np.argsort(v)).astype(float)
    r = statistics.partial_correlation(df, "x", "y", ["z0", "z1"], "spearman").first()
    assert abs(r.r - np.corrcoef(left(rank(x), [rank(z[:, 0]), rank(z[:, 1])]), left(rank(y), [rank(z[:, 0]), rank(z[:, 1])]))[0, 1]) < 1e-9
    assert statistics.partial_correlation(df, "x", "one", ["z0"]).first().r is None
    assert statistics.partial_correlation(df, "twice", "y", ["z0"]).first().r is None
    assert statistics.partial_correlation(df.limit(0), "x", "y", ["z0"]).first().n == 0


def test_runs(spark, tmp_path, monkeypatch):
    run = Run(spark, str(tmp_path / "run"))
    part = lambda i: spark.range(10 * i, 10 * i + 10).select((F.col("id") % 7).alias("query_id"), "id")
    assert run.version() == 0 and run.tables() == []
    for i in range(6):
        assert run.add({"a": part(i), "b": part(i).limit(2)}, batch=f"n{i}")
    assert not run.add({"a": part(0)}, batch="n0")
    want = rows_of(run.read("a"), "id")
    assert len(want) == 60 and run.read("b").count() == 12 and rows_of(run.read("a", 2), "id") == [(i,) for i in sorted(range(20), key=lambda x: repr((x,)))]

    # A compaction, and a chunk, that break off before their commit leave the old state.
    commit = Run._commit
    monkeypatch.setattr(Run, "_commit", lambda self, change: (_ for _ in ()).throw(RuntimeError("lost")))
    for broken in (lambda: run.compact("a"), lambda: run.add({"a": part(9), "b": part(9)})):
        with pytest.raises(RuntimeError, match="lost"):
            broken()
    monkeypatch.setattr(Run, "_commit", commit)
    assert rows_of(run.read("a"), "id") == want and run.read("b").count() == 12

    # A chunk that comes while a compaction writes stays.
    write = Run._write
    monkeypatch.setattr(Run, "_write", lambda self, name, rows: (monkeypatch.setattr(Run, "_write", write), self.add({"a": part(6)}, "n6"), write(self, name, rows))[2])
    assert run.compact("a", target=1 << 10) > 1
    assert run.read("a").count() == 70 and len(run.manifest()["tables"]["a"]) == 2
    assert run.compact("a") == 1 and len(run.manifest()["tables"]["a"]) == 1 and run.read("a").count() == 70
    assert run.vacuum() > 6 and run.vacuum() == 0 and run.read("a").count() == 70 and run.read("b").count() == 12
    assert run.pending(spark.createDataFrame([(3,), (99,)], "query_id long"), "a").collect()[0].query_id == 99
    with pytest.raises(FileNotFoundError):
        run.read("c")

    # A second writer that took the number first is noticed.
    seen = run.version()
    monkeypatch.setattr(Run, "version", lambda self: seen - 1)
    with pytest.raises(RuntimeError, match="another writer"):
        run.add({"a": part(7)})


@there
def test_measured_stream_that_dies_half_way(spark, tmp_path, monkeypatch):
    from polyseek.streaming.measured import measured_stream

    t = Fixture(spark, DATA)
    t.qtok.select("query_id", "q_token_id", "qv").repartition(3, "query_id").write.parquet(str(tmp_path / "in"))
    whole = facts.measure(t.qtok, t.index, CONFIG)
    want = {name: rows_of(df, *df.columns) for name, df in whole.items()}
    real, calls = facts.measure, []

    def fails(batch, *rest):
        calls.append(1)
        out = real(batch, *rest)
        if len(calls) == 2:  # three tables are written, the fourth is not
            out["m4"] = out["m4"].select(F.raise_error(F.lit("lost executor")).alias("query_id"))
        return out

    monkeypatch.setattr(facts, "measure", fails)
    start = lambda: measured_stream(spark, str(tmp_path / "in"), t.index, CONFIG, str(tmp_path / "run"), str(tmp_path / "ck")).awaitTermination()
    with pytest.raises(Exception, match="lost executor"):
        start()
    run = Run(spark, str(tmp_path / "run"))
    seen = {name: {r.query_id for r in run.read(name).select("query_id").distinct().collect()} for name in ("m1", "r0", "ranking")}
    assert len(run.manifest()["batches"]) == 1 and len({frozenset(s) for s in seen.values()}) == 1
    start()
    for name, rows in want.items():
        assert rows_of(run.read(name), *whole[name].columns) == rows


@there
def test_loader(spark, tmp_path):
    t = Fixture(spark, DATA)
    run = Run(spark, str(tmp_path / "run"))
    run.add({"m1": t.m1, "r0": t.r0, "m3": t.m3, "m4": t.m4})
    m = Measures(run, t.index.postings, t.index.centroids, t.index.weights)
    assert m["cells"].count() == m["offline"].count() and set(run.tables()) >= {"m5", "m6", "offline", "online_cells", "cells"}
    again = Measures(run, t.index.postings.limit(0), t.index.centroids, t.index.weights)
    assert rows_of(again["cells"], "centroid_id", "sel_freq") == rows_of(m["cells"], "centroid_id", "sel_freq")
    one = m.of_queries("m5", [0])
    assert "PushedFilters: [IsNotNull(query_id), EqualTo(query_id,0)]" in one._jdf.queryExecution().executedPlan().toString() and one.count() > 0
    many = m.of_queries("m5", m["m2"].select("query_id"))
    m.FEW = 0
    assert m.of_queries("m5", m["m2"].select("query_id")).count() == many.count() == m["m5"].count()
    with pytest.raises(KeyError):
        m["m9"]


def test_golden_scan(spark, monkeypatch):
    rows = spark.range(5000).select((F.col("id") % 50).alias("query_id"), (F.col("id") % 97).alias("doc_id"), "id")
    qrels = spark.createDataFrame([(q, d) for q in range(0, 50, 3) for d in (1, 5, 96)] + [(1000, 1), (3, 1), (None, 4)], "query_id long, doc_id long")
    want = rows_of(rows.join(qrels, ["query_id", "doc_id"], "left_semi"), "id")
    assert want and rows_of(facts.golden_scan(rows, qrels), "id") == want
    assert facts.golden_scan(rows, qrels).columns == rows.columns and facts.golden_scan(rows, qrels.limit(0)).count() == 0
    monkeypatch.setattr(facts, "GOLDEN_MOST", 0)
    assert rows_of(facts.golden_scan(rows, qrels), "id") == want


def test_ragged(spark):
    sizes = [3, 0, 1, 5, 2, 0, 4]
    rng = np.random.default_rng(1)
    lists = [(k, rng.normal(size=(n, 3)).tolist()) for k, n in enumerate(sizes)] + [(50, None)]
    df = spark.createDataFrame(lists, "key long, vectors array<array<double>>").coalesce(1)
    want = [(k, v or []) for k, v in lists]
    plain = lambda d: sorted((r.key, r.vectors) for r in d.collect())
    packs = ragged.packed(df, 3)
    assert packs.count() == 3 and plain(ragged.unpacked(packs)) == want and plain(ragged.from_padded(ragged.padded(packs))) == want
    cut = ragged.padded(packs, 2)
    assert sorted((r.key, r.n, sum(r.mask), len(r.mask)) for r in cut.collect()) == [(k, min(2, len(v)), min(2, len(v)), 2) for k, v in want]
    asked = spark.createDataFrame([(3,), (0,), (3,), (1,), (77,)], "key long")
    assert plain(ragged.gathered(packs, asked)) == sorted((k, dict(want)[k]) for k in (3, 0, 3, 1))
    with pytest.raises(Exception, match="one length"):
        ragged.packed(spark.createDataFrame([(1, [[1.0], [1.0, 2.0]])], "key long, vectors array<array<double>>")).count()
    assert ragged.unpacked(ragged.packed(df.limit(0))).count() == 0


def test_figures_of_odd_columns(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 5.0), ("b", 100.0), ("b", 3.0), ("b", 4.0), (None, 7.0), ("c", None)], "g string, x double")
    got = {r.g: tuple(r)[1:] for r in plots.box_figures(df, "g", "x").collect()}
    assert got == {"a": (2, 1.0, 1.0, 1.0, 1.0, 1.0, 0), "b": (5, 3.0, 4.0, 5.0, 2.0, 5.0, 1), None: (1, 7.0, 7.0, 7.0, 7.0, 7.0, 0)}
    assert plots.box_figures(df.limit(0), "g", "x").count() == 0
    d = plots.density(df, "x", "g", 64, 3.0)
    assert {r.group for r in d.select("group").distinct().collect()} == {"a", "b", None}
    assert plots.density(df.where("g = 'a'"), "x").count() == 0 == plots.density(df.limit(0), "x").count()
    whole = plots.density(df.where("g = 'b'"), "x", bins=400).agg(F.sum("density") * (98.0 / 400)).first()[0]
    assert 0.4 < whole <= 1.0  # the kernel reaches beyond the range
    assert [r.value for r in plots.percentile_marks(df, "x", (0.0, 1.0)).collect()] == [1.0, 100.0]
    assert plots.percentile_marks(df.limit(0), "x", (0.5,)).first().value is None


def test_corpus_scan(spark, tmp_path):
    lines = ['{"_id": "10", "title": "T", "text": "x"}', '{"_id": "9", "text": "only"}', '{"_id": "b", "title": "", "text": "y"}', '{"_id": "b", "title": "z", "text": "y"}', '{"title": "no id"}', "not json"]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    rows, ids = readers.benchmark_corpus(spark, str(tmp_path / "c.jsonl"))
    assert rows_of(ids, "doc_id", "external_id") == [(0, "9"), (1, "10"), (2, "b")]
    assert rows_of(rows, "pid", "text") == [(0, " only"), (1, "T x"), (2, " y")]
    many = spark.range(1000).select(F.concat(F.when(F.col("id") % 3 == 0, F.lit("k")).otherwise(F.lit("")), "id").alias("external_id"))
    got = [r.external_id for r in readers.ordered_ids(many).orderBy("doc_id").collect()]
    assert got == sorted(got, key=lambda e: (not e.isdigit(), int(e) if e.isdigit() else 0, e)) and len(got) == 1000


def test_distinct_in_order(spark):
    df = spark.createDataFrame([(5, "b"), (1, "c"), (3, "b"), (2, "a"), (4, "c"), (6, None)], "o int, x string")
    assert rows_of(text.distinct_in_order(df, "x", "o"), "place", "x") == [(0, "c"), (1, "a"), (2, "b"), (3, None)]
    assert list(itertools.islice(statistics.AGGREGATES, 4)) == ["mean", "std", "median", "n"]


def test_functions_of_the_users_own(spark):
    from polyseek.functions import user

    spark.udtf.register("windows_under_test", user.passages(4, 2))
    spark.createDataFrame([(1, "a B c d e f"), (2, ""), (3, None), (4, "x")], "k int, text string").createOrReplaceTempView("texts_under_test")
    got = rows_of(spark.sql("SELECT k, p.* FROM texts_under_test t, LATERAL windows_under_test(t.text) p"), "k", "start", "n", "passage")
    assert got == [(1, 0, 4, "a b c d"), (1, 2, 4, "c d e f"), (1, 4, 2, "e f"), (4, 0, 1, "x")]
    df = spark.createDataFrame([(1, float(v)) for v in (100, 1, 2, 3, -50)] + [(2, None), (3, 5.0)], "g int, x double")
    means = {r.g: r.m for r in df.groupBy("g").agg(user.trimmed_mean(0.2)("x").alias("m")).collect()}
    assert means[1] == 2.0 and means[3] == 5.0 and (means[2] is None or math.isnan(means[2]))
    z = statistics.proportion_z(df, F.col("x") > 0, 0.5).first()
    assert (z.n, z.k) == (6, 5) and abs(z.z - (5 / 6 - 0.5) / math.sqrt(0.25 / 6)) < 1e-12
    assert statistics.proportion_z(df.limit(0), F.col("x") > 0, 0.5).first().z is None
