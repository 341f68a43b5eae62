"""Operators and pipeline stages against brute force, on a small table with nulls, empty and long texts, ties, repeated
rows and extra columns that clash with names used inside."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from polyseek.llm import automata, embeddings, mixing, quality, queries, sentencepieces, separators, simhash, suffixes, tokenfiles, toxicity
from polyseek.llm.components import connected_components
from test_nearcopies import _kept as near_copies_kept

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, spans int, h string, rep int, kept string, size string, text_ string"


def _texts() -> list:
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    common = say(70)
    out = [say(rng.randint(60, 200)) for _ in range(14)]
    out += [f"{say(30)}\n{common} {say(25)}" for _ in range(6)]  # one passage in many surroundings
    out += [out[0], out[0], out[1].replace(" ", "  "), out[2] + " x", out[3][:400] + " y " + out[3][400:]]
    out += [None, "", " \n\t ", "one", "Ünï cödé 你好 " * 60, "z" * 1500, "la la la " * 300, say(4000), out[5] + " " + out[5], common, "# $ % " * 40, "Ä" + common, "x <|endoftext|> y"]
    return out


@pytest.fixture(scope="module")
def rows():
    t = _texts()
    rng = random.Random(9)
    out = [(i, x, "en", rng.choice(["s0", "s0", "s1", "s2", None]), None if x is None else len(x), "u", 1, "h", 2, "k", "s", "t") for i, x in enumerate(t)]
    return out + [out[7], out[7]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _sorted(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {v: got.get(v, v) for v in root} == {v: find(v) for v in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_array(docs, empty, rows):
    count, want = Counter(), []
    for r in rows:
        b = (r[1] or "").encode()
        count.update(b[p : p + 200] for p in range(len(b) - 199))
    for r in rows:
        b = (r[1] or "").encode()
        m = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                m[p : p + 200] = True
        left = np.frombuffer(b, np.uint8)[~m].tobytes()
        want.append((r[0], len(b), int(m.sum()), int((np.diff(m.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    got = suffixes.without_repeats(docs)
    assert _sorted(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert suffixes.without_repeats(empty).count() == 0


def test_suffix_array_over_many_buckets(spark):
    rng = random.Random(21)
    say = lambda n: "".join(rng.choice("abc") for _ in range(n))
    common = [say(rng.randint(10, 90)) for _ in range(5)]
    texts = ["".join(rng.choice([say(rng.randint(0, 30)), *common, common[0][3:40]]) for _ in range(rng.randint(0, 7))) for _ in range(60)]
    texts += ["z" * 400, "xy" * 90, texts[0], "é" * 50]
    raw = [t.encode() for t in texts]
    count = Counter(b[p : p + 20] for b in raw for p in range(len(b) - 19))
    want = []
    for i, b in enumerate(raw):
        m = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 19):
            if count[b[p : p + 20]] > 1:
                m[p : p + 20] = True
        want.append((i, int(m.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        got = suffixes.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6), 20, 5)
        assert _sorted(got, "doc_id", "n_removed", "kept_sha256") == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(("hot", "broadcast"), [(256, 1 << 20), (256, 0), (1, 0)])
def test_suffix_automata(docs, empty, rows, monkeypatch, hot, broadcast):
    monkeypatch.setattr(automata, "HOT", hot)
    monkeypatch.setattr(automata, "BROADCAST", broadcast)
    first: dict = {}
    words = [(r[0], (r[1] or "").encode().split()) for r in rows]
    for d, w in sorted(words, key=lambda x: x[0]):
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), d)
    want = []
    for d, w in words:
        m = np.zeros(len(w), dtype=bool)
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < d:
                m[p : p + 50] = True
        want.append((d, len(w), int(m.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, m, strict=True) if not g)).hexdigest()))
    assert sum(x[2] for x in want) > 0
    assert _sorted(automata.without_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    if hot == 1:
        assert automata.without_repeats(empty).count() == 0


def _fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty, rows):
    fps = {r[0]: _fingerprint(r[1]) for r in rows}
    root = {d: d for d in fps}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in fps:
        for b in fps:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = simhash.near_groups(simhash.fingerprints(docs))
    assert {(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got.collect()} == {(d, f, find(d)) for d, f in fps.items()}
    assert got.count() == len(rows) and simhash.near_groups(simhash.fingerprints(empty)).count() == 0


def test_quality(spark, docs, empty, rows):
    labels = spark.createDataFrame([(r[0], 0 if i % 3 == 0 else 1) for i, r in enumerate(rows)], "doc_id long, quality int")
    field = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.judge(docs, field).collect()}
    for r in rows:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        m = [any(c[tuple(w[k : k + 3])] > 1 for k in range(max(0, i - 2), min(i, len(w) - 3) + 1)) for i in range(len(w))]
        seen, doubled = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                doubled += line in seen
                seen.add(line)
        q = got[r[0]]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), doubled, sum(m))
        assert q.base_failed == (len(w) < 50 or 100 * sum(m) > 50 * len(w)) and not (q.base_failed and q.kept)
    kept = quality.kept_documents(docs, field)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, q in got.items() if q.kept}
    none = quality.train(docs, labels.limit(0))
    assert all(r.kept != r.base_failed for r in quality.judge(docs, none).collect())
    assert quality.judge(empty, none).count() == 0


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["zorgle", "blanfex"]
    say = lambda n: " ".join("".join(rng.choice("acdeilmnorstu") for _ in range(5)) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        toxic = i % 4 == 0
        words = say(rng.randint(20, 80)).split()
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad if i < 200 else ["z0rgle", "blаnfex"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "x " * 5000)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, marks.where("doc_id < 200"))
    got = {r.doc_id: r.score for r in toxicity.scores(docs, lexicon).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.5) == bool(t) for i, t in labels) and max(got[1000], got[1001], got[1002]) < 0.5
    assert toxicity.learn(docs, marks.limit(0)).weights == {}


def test_mixing(docs, empty, rows):
    got = mixing.mix(docs).collect()
    size = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert all(r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"] for r in got)
    by: dict = {}
    source = {r[0]: r[3] for r in rows}
    for r in got:
        by.setdefault(source[r.doc_id], []).append(r)
    order = sorted((s for s in by if s is not None)) + [None]
    total = 1.5 * sum(r["size"] for r in got)
    sizes = {s: sum(r["size"] for r in by[s]) for s in order}
    weight, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set()
    while True:
        level = (total - sum(2 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in order if s not in full))
        over = {s for s in order if s not in full and level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    for s in order:
        want = 2 * sizes[s] if s in full else level * weight[s]
        assert all(abs(r.target - want) < 1e-6 and r.source_size == sizes[s] for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - want) <= max(3 * mixing.BLOCK, 0.05 * want)
    assert _sorted(mixing.mix(docs), "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in got), key=repr)
    assert mixing.mix(empty).count() == 0


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3))).collect()]
        assert sorted(got) == list(range(n))


def test_mixed_documents(docs, empty):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words: Counter = Counter()
    for r in out.collect():
        words[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    want: Counter = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.taken
    assert words == +want and mixing.mixed_documents(empty).count() == 0


def test_token_files(docs, empty, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    at, want = 0, []
    for r in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    files, folder, dictionary = tokenfiles.write(docs, path)
    assert _sorted(tokenfiles.read(files, folder, dictionary), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    name = files.orderBy("pid").first().name
    one = tokenfiles.TokenFile(folder, name, dictionary)
    assert one.ids(len(one.counts) - 1)[-1] == 2
    with pytest.raises(ValueError, match="another dictionary"):
        tokenfiles.TokenFile(folder, name, dictionary + b"x")
    assert tokenfiles.read(*tokenfiles.write(empty, path)).count() == 0


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_separator_scan(spark, docs, empty, rows, block):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    written, folder = separators.write_flat(docs, path, 50256)
    found = separators.count(spark, folder, 50256, block=block)
    got = found.join(written, ["file", "ordinal"])
    assert _sorted(got, "doc_id", "n_tokens") == sorted(((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows), key=repr)
    assert found.count() == len(rows) and found.where("not ended").count() == 0
    if block == 64:
        _, folder = separators.write_flat(empty, path, 50256)
        assert separators.count(spark, folder, 50256).count() == 0
        tokenfiles.put(folder, "open.bin", iter([np.array([5, 9, 5, 5], "<u2").tobytes()]))
        assert _sorted(separators.count(spark, folder, 9, block=2), "ordinal", "n_tokens", "ended") == [(0, 1, True), (1, 2, False)]


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 16))
    near = base[:25] + 0.12 * rng.normal(size=(25, 16))
    vecs = [*base.tolist(), *near.tolist(), *base[:5].tolist(), (3 * base[7]).tolist(), [0.0] * 16, None, [], [float("nan")] * 16, [None] * 16, [1.0, 2.0], [2.0, 4.0]]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vecs)], "vec_id long, embedding array<float>, least string")
    good = {i: np.array(v, np.float32).astype(float) for i, v in enumerate(vecs) if v and None not in v and np.isfinite(v).all() and any(v)}
    link = {i: set() for i in range(len(vecs))}
    for a, x in good.items():
        for b, y in good.items():
            if a != b and len(x) == len(y) and x @ y >= 0.9 * np.linalg.norm(x) * np.linalg.norm(y):
                link[a].add(b)

    def least(v):
        seen, todo = {v}, [v]
        while todo:
            for w in link[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        return min(seen)

    got = embeddings.near_groups(df, spread=1.0)
    assert _sorted(got, "vec_id", "n_links", "component_id", "kept") == sorted(((i, len(link[i]), least(i), least(i) == i) for i in link), key=repr)
    assert embeddings.near_groups(df.limit(0)).count() == 0


def test_embeddings_of_divided_cells(spark, monkeypatch):
    """Many cells of two levels and small blocks: every link of correlated vectors is found and counted at both ends."""
    monkeypatch.setattr(embeddings, "CELL", 20)
    monkeypatch.setattr(embeddings, "CELLS", 5)
    monkeypatch.setattr(embeddings, "CROWDED", 30)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(700, 4)) @ rng.normal(size=(4, 24))).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embeddings.near_groups(df).collect()}
    assert want.sum() > 5000 and [got[i] for i in range(700)] == want.tolist()


def test_embedding_recall(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(1500, 32))
    x = np.concatenate([base, base[:700] + 0.075 * rng.normal(size=(700, 32)) * np.linalg.norm(base[:700], axis=1, keepdims=True)]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = int(((u @ u.T >= 0.9).sum() - len(u)))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    found = embeddings.near_groups(df).agg(F.sum("n_links")).first()[0]
    assert true > 500 and 0.97 * true <= found <= true


def test_sentencepiece(docs, empty, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepieces.encoded(docs, path).collect()
    want = {r[0]: lib.encode(r[1] or "") for r in rows}
    assert len(got) == len(rows) and all(list(r.ids) == want[r.doc_id] and r.n_tokens == len(r.ids) and r.round_trip for r in got)
    assert sentencepieces.encoded(empty, path).count() == 0


def test_pipeline_stages(spark, docs, rows, tmp_path):
    labels = [(r[0], 0 if i % 5 == 0 else 1, 0) for i, r in enumerate(rows)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    kept = None
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = out
        out = stage(spark, before, str(tmp_path)).cache()
        assert out.columns == docs.columns
        if name == "simhash near-dedup":
            left = before.select("doc_id", "text").collect()
            kept = sorted(left[i].doc_id for i in near_copies_kept([(r.doc_id, r.text) for r in left]))
            assert sorted(r.doc_id for r in out.collect()) == kept
        if name == "suffix-array dedup":
            assert sorted(r.doc_id for r in out.collect()) == kept
            want = {r.doc_id: bytes(r.kept).decode("utf-8", "ignore") for r in suffixes.without_repeats(before).collect()}
            assert {r.doc_id: r.text for r in out.collect()} == want and all(r.n_chars == len(r.text) for r in out.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).where("not round_trip").count() == 0


def test_queries_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
