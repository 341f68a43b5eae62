"""The registered queries on small tables with null doc_ids and texts, repeated rows, ties and clashing columns: their
columns and rules, those that SQL can express against DuckDB, the others against plain versions."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from polyseek.llm import quality, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents, labels and embeddings; and the documents' rows."""
    root = tmp_path_factory.mktemp("sf")
    rng = random.Random(13)
    say = lambda n: " ".join("".join(rng.choice("acdeilmnorstu") for _ in range(rng.randint(2, 7))) for _ in range(n))
    common, rows, labels = say(60), [], []
    for i in range(90):
        t = "\n".join(say(rng.randint(4, 20)) + rng.choice([".", "!", "", "?"]) for _ in range(rng.randint(1, 9)))
        if i % 5 == 0:
            t = t.replace(" ", " zorgle ", 3)
        if i % 7 == 0:
            t = f"{say(5)} {common} {say(5)}"
        if i % 6 == 0:
            t = "MENU | HOME | LOGIN\n" * 30 + t
        rows.append((i, t, "en", f"s{i % 4}"))
        labels.append((i, int(i % 6 != 0), int(i % 5 == 0)))
    rows += [(None, rows[3][1], "en", "s0"), (None, say(70), "en", None), (None, None, None, None), (95, None, "en", "s1"), (96, "", "en", "s1"), (97, " ".join(say(60).split()), "en", "s1"), rows[4], rows[4], (4, say(80), "en", "s2")]
    labels += [(3, 0, 1), (None, 1, 1)]  # labels of both kinds; one without a document
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, uid int, key string")
    df.repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    gen = np.random.default_rng(2)
    base = gen.normal(size=(80, 3)) @ gen.normal(size=(3, 64)) / 8
    vec = [*base.tolist(), base[3].tolist(), None, [0.0] * 64, [float("nan")] * 64, [None] + [0.5] * 63, [1.0, 2.0], [2.0, 4.0], []]
    ids = list(range(len(vec)))
    vec += [base[5].tolist(), (base[5] * 2).tolist(), (-base[5]).tolist(), base[9].tolist(), base[9].tolist(), gen.normal(size=64).tolist(), base[11].tolist(), None]
    ids += [7, 7, 7, None, None, None, 50, None]  # one id on several vectors, null ids
    table = [(i, v, None if k % 17 == 3 else int(k % 3), "x", k) for k, (i, v) in enumerate(zip(ids, vec, strict=True))]
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int, rep string, uid int").repartition(3).write.parquet(f"{root}/embeddings.parquet")
    return str(root), rows, labels


@pytest.fixture(scope="module")
def got(spark, tables):
    return {n: [r.asDict() for r in q(spark, tables[0]).collect()] for n, q in queries.queries().items()}


def test_rows_and_columns(got, tables):
    want = {
        "op1_toxicity": "doc_id held_out score predicted", "op2_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op3_suffix_array": "doc_id n_bytes n_removed n_spans kept_sha256", "op4_simhash": "doc_id fingerprint component_id", "op5_sentencepiece": "doc_id n_tokens ids_crc32 round_trip best_tokens",
        "op6_separator_scan": "doc_id n_tokens", "op7_suffix_automata": "doc_id n_words n_removed kept_sha256", "op9_token_files": "doc_id start n_tokens ids_crc32",
        "op10_mixing": "doc_id size source_size target taken", "op11_private": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    }
    for name, columns in want.items():
        assert list(got[name][0])[: len(columns.split())] == columns.split()
        assert sorted((r["doc_id"] for r in got[name]), key=repr) == sorted((r[0] for r in tables[1]), key=repr), name
    assert len(got["op8_embeddings"]) == 96


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twins(got, tables, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{tables[0]}/{t}.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df().to_dict("records")
    plain = lambda rows: sorted((tuple((k, None if isinstance(v, float) and math.isnan(v) else int(v) if isinstance(v, (int, float, np.integer)) and not isinstance(v, bool) else v) for k, v in sorted(r.items())) for r in rows), key=repr)
    assert plain(got[name]) == plain(want)
    assert any(r.get("n_removed", r.get("n_links", r.get("rank", r.get("distance")))) for r in got[name])


def test_toxicity_by_a_plain_scorer(spark, got, tables):
    root, rows, labels = tables
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got["op1_toxicity"])
    known = spark.createDataFrame([x for x in labels if x[0] is not None and not held(x[0])], "doc_id long, quality int, toxic int")
    lex = toxicity.learn(queries.documents(spark, root), known)
    assert lex.weights

    def score(text):
        line, n = toxicity.folded(text or "")
        words = line.split()
        spared = set()
        for phrase in lex.exceptions:
            p = toxicity.folded(phrase)[0].split()
            spared.update(i + k for i in range(len(words)) if words[i : i + len(p)] == p for k in range(len(p)))
        total = sum(max((w for t, w in lex.weights.items() if (word + " ").startswith(t)), default=0.0) for i, word in enumerate(words) if i not in spared)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, lex.slope * total / math.sqrt(n) + lex.offset))))

    want = sorted((repr(d), round(score(t), 9)) for d, t, *_ in rows)
    assert sorted((repr(r["doc_id"]), round(r["score"], 9)) for r in got["op1_toxicity"]) == want


def test_learned_exceptions(spark):
    rng = random.Random(3)
    say = lambda n: ["".join(rng.choice("acdeilmnorstu") for _ in range(5)) for _ in range(n)]
    rows = []
    for i in range(300):
        w = say(40)
        if i % 3 == 0:
            w[10:12] = [say(1)[0], "blanfex"]
            w[30] = "blanfex"
        elif i % 50 == 1:
            w[10:12] = ["harmless", "blanfex"]
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lex = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert "harmless blanfex" in lex.exceptions
    a = lex.automaton()
    assert lex.hits(a, "a harmless blanfex here") == 0 < lex.hits(a, "a blanfex here")


def test_quality_by_all_labelings(spark, got, tables):
    root, rows, _ = tables
    weights, move = quality.train(queries.documents(spark, root), spark.read.parquet(f"{root}/labels.parquet"))
    assert weights.any()
    by: dict = {}
    for r in got["op2_quality"]:
        by.setdefault((r["doc_id"], r["n_words"]), []).append(r)
    seen = 0
    for d, t, *_ in rows:
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        if not lines or len(lines) > 10:
            continue
        f, n = quality.line_features(t)
        assert n.tolist() == [len(WORD.findall(x)) for x in lines]
        emit = f @ weights
        best = max(itertools.product((0, 1), repeat=len(lines)), key=lambda y: sum(e for e, v in zip(emit, y, strict=True) if v) + sum(move[a, b] for a, b in itertools.pairwise(y)))
        share = float(sum(k for k, v in zip(n, best, strict=True) if v) / n.sum())
        words = int(n.sum())
        for r in by[d, words]:
            assert abs(r["content_share"] - share) < 1e-9 and r["kept"] == (not r["base_failed"] and share >= quality.MIN_SHARE)
        seen += 1
    assert seen > 40


def test_fingerprints_and_tokens(got, tables):
    from tokenizers import Tokenizer

    assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in got["op4_simhash"])
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = sorted((repr(d), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x, *_ in tables[1])
    assert sorted((repr(r["doc_id"]), r["n_tokens"]) for r in got["op6_separator_scan"]) == sizes
    assert sorted((repr(r["doc_id"]), r["n_tokens"] - 1) for r in got["op9_token_files"]) == sizes
    order = sorted(got["op9_token_files"], key=lambda r: r["start"])
    assert [r["start"] for r in order] == np.cumsum([0, *[r["n_tokens"] for r in order]])[:-1].tolist()
    ids = [r["doc_id"] for r in order]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))


def test_best_paths(got, tables):
    """The number of pieces on the best path (of equal ones that with the shorter last piece), by a plain recursion."""
    from polyseek.llm import sentencepieces

    m = sentencepieces.model(public_tokenizers.path("piece_bpe_32k.model"))
    floor = float(m.scores.min()) - 10

    def path(word):
        best = [(0.0, 0)]
        for j in range(1, len(word) + 1):
            options = []
            for i in range(j - 1, max(0, j - m.longest) - 1, -1):
                p = m.index.get(word[i:j])
                if p is not None or j - i == 1:
                    options.append((best[i][0] + (m.scores[p] if p is not None else floor), best[i][1] + 1))
            best.append(max(options, key=lambda x: x[0]))
        return best[-1]

    by = {r["doc_id"]: r["best_tokens"] for r in got["op5_sentencepiece"]}
    for d, x, *_ in [r for r in tables[1] if r[0] not in (None, 4) and r[1]][:12]:
        assert by[d] == sum(path(w)[1] for w in sentencepieces.UNIT.findall("▁" + x.replace(" ", "▁")))


def test_mixing_comes_near_its_targets(got, tables):
    sources = {(d, t): s for d, t, _, s in tables[1]}
    assert len(sources) and all(0 <= r["taken"] <= 2 * r["size"] for r in got["op10_mixing"])
    total = sum(r["size"] for r in got["op10_mixing"])
    by: dict = {}
    for r in got["op10_mixing"]:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert sum(t for _, t in by) <= 1.5 * total + 1e-6
    assert all(abs(sum(x) - t) <= max(200, 0.1 * t) for (_, t), x in by.items())


def test_empty_tables(spark, tables, tmp_path):
    for t in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{tables[0]}/{t}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, q in queries.queries().items():
        assert q(spark, str(tmp_path)).count() == 0, name
