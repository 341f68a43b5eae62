"""Pieces of the operators against brute force, without Spark."""

from __future__ import annotations

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from polyseek.llm import anchors, automata, embeddings, quality, sentencepieces, simhash, suffixes, tokenfiles, tokens, toxicity


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=120), st.integers(1, 9))
def test_leftmost(values, w):
    h = anchors.mixed(np.array(values, dtype=np.uint64) + np.uint64(1)) if values else np.zeros(0, dtype=np.uint64)
    got = anchors.leftmost(h, w)
    top = h >> np.uint64(24)
    assert got.tolist() == [i + int(np.argmin(top[i : i + w])) for i in range(max(len(h) - w + 1, 0))]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, 700).astype(np.uint8)
    b = np.concatenate([rng.integers(0, 256, 90).astype(np.uint8), a[100:600]])
    data, offsets = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    x = anchors.anchored(anchors.BYTES[data], offsets, 200, 50)
    at = {p: int(k) for k, f, z in zip(x["anchor"], x["first"], x["last"], strict=True) for p in range(f, z + 1)}
    assert sorted(at) == [*range(501), *range(700, 700 + len(b) - 199)]
    shift = len(a) + 90 - 100
    assert all(at[p + shift] - at[p] == shift for p in range(100, 401))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(0, 2)), max_size=60))
def test_multikey_sort(rows):
    keys = [np.array([r[i] for r in rows], dtype=np.int64) for i in range(3)]
    order = suffixes.multikey_sort(keys)
    assert [rows[i] for i in order] == sorted(rows) and sorted(order.tolist()) == list(range(len(rows)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=3, max_size=14), min_size=1, max_size=5))
def test_suffix_automaton(seqs):
    passages = [(s, 10 * i) for i, s in enumerate(seqs)]
    first: dict = {}
    for s, d in passages:
        for p in range(len(s) - 2):
            first.setdefault(tuple(s[p : p + 3]), d)
    assert automata.least_documents(passages, 3) == [[first[tuple(s[p : p + 3])] for p in range(len(s) - 2)] for s, _ in passages]


def test_fingerprint_pairs_share_an_anchor():
    rng = np.random.default_rng(3)
    for bits in range(4):
        x = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, bits, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        (rx, kx), (ry, ky) = simhash.anchors_of(x), simhash.anchors_of(y)
        for i in range(len(x)):
            assert set(kx[rx == i].tolist()) & set(ky[ry == i].tolist())


def test_finer_parts_meet():
    rng = np.random.default_rng(4)
    for bits in range(4):
        x = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(32, bits, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b + 32)
        anchors = rng.integers(0, 1 << 31, 100, dtype=np.uint64)  # of the lower half: bit 31 is not set
        for masks in simhash.FINER:
            (rx, kx), (ry, ky) = simhash.finer(anchors, x, masks), simhash.finer(anchors, y, masks)
            assert all(set(kx[rx == i].tolist()) & set(ky[ry == i].tolist()) for i in range(len(x)))
            assert not ((kx >> np.uint64(31)) & np.uint64(1)).any()


def test_group_links_connect():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = np.array([b ^ (np.uint64(1) << np.uint64(i)) for b in base for i in range(40)], dtype=np.uint64)
    keys, ids = np.zeros(len(fps), dtype=np.int64), np.arange(len(fps))
    a, b = simhash.links(keys, fps, ids, 3)
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        assert bin(int(fps[i] ^ fps[j])).count("1") <= 3
        root[find(i)] = find(j)
    assert len({find(i) for i in range(len(fps))}) == 3 and len(a) < 3 * 40


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=1, max_size=6), st.lists(st.floats(-2, 2), min_size=4, max_size=4))
def test_crf_viterbi(emit, move):
    m = np.array(move).reshape(2, 2)

    def total(y):
        return sum(e for e, v in zip(emit, y, strict=True) if v) + sum(m[a, b] for a, b in itertools.pairwise(y))

    assert abs(total(quality.viterbi(np.array(emit), m).tolist()) - max(map(total, itertools.product((0, 1), repeat=len(emit))))) < 1e-9


def test_crf_learns():
    rng = np.random.default_rng(1)
    docs = []
    for y in (0, 1) * 20:
        f = np.zeros((6, len(quality.FEATURES)))
        f[:, 0], f[:, 1] = 1, (1 - y) + 0.1 * rng.random(6)
        docs.append((f, np.full(6, y)))
    w, move = quality.fit(docs)
    assert all((quality.viterbi(f @ w, move) == y).all() for f, y in docs)


def test_base_counts():
    assert quality.base_counts("") == (0, 0, 0, 0, 0)
    assert quality.base_counts("a b c a b c x\n\na b\na b\n\t\n#") == (12, 12, 1, 1, 6)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    fixed = ["", " ", "  a  b\n\n c ", "don't it's we'll ' 'twas x'yz,'ab", "foo_bar __init__ 3.14", "naïve Ωmega 你好,世界 ½²", "a\tb\r\n  c", "<|endoftext|> x", "\x1c a", "x" * 500]
    return fixed + ["".join(rng.choice(" ab'sté1_.,!\n\t你") for _ in range(rng.choice((5, 60)))) for _ in range(800)]


def test_byte_bpe(odd_texts):
    e = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    got = e.encode(odd_texts)
    assert all(np.frombuffer(a, e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids for a, t in zip(got, odd_texts, strict=True))


def test_distinct_words_are_looked_up_once(monkeypatch):
    """A word is looked up once in a batch, and one that ends in signs is not cut by a pattern; before, each occurrence was looked up."""

    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

    class Pattern:
        cut = 0

        def findall(self, w, f=tokens.STRETCH.findall):
            Pattern.cut += 1
            return f(w)

    e = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    e.words = Counted()
    monkeypatch.setattr(tokens, "STRETCH", Pattern())
    texts = ["the cat, sat... " * 300 + "Ωmega!? \"end\"", "", "sat... the  cat, ", "\n the", "cat,", "naïve{} end_ end* x'y,"]
    got = e.encode(texts)
    assert all(np.frombuffer(a, e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids for a, t in zip(got, texts, strict=True))
    assert Counted.asked < 60 and Pattern.cut < 12


def test_piece_bpe(odd_texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m, lib = sentencepieces.model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    long = odd_texts + ["the" * 400, " " * 30 + "x", "▁a ▁▁"]
    got = m.encode(long)
    assert all(np.frombuffer(a, m.dtype).tolist() == lib.encode(t) for a, t in zip(got, long, strict=True))
    assert all(m.decode(a) == t for a, t in zip(got, long, strict=True) if "▁" not in t)


def test_piece_viterbi():
    pieces = ["<unk>", "▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab"]
    scores = [0.0, -2.0, -1.5, -1.6, -2.2, -2.4, -3.3, -1.9, -2.9]
    m = sentencepieces.Pieces(pieces, scores, [2] + [1] * 8, bpe=False)
    index = {p: s for p, s in zip(pieces[1:], scores[1:], strict=True)}

    def best(t: str) -> float:
        out = [0.0] + [-1e9] * len(t)
        for j in range(1, len(t) + 1):
            out[j] = max((out[i] + index[t[i:j]] for i in range(j) if t[i:j] in index), default=-1e9)
        return out[-1]

    for n in range(1, 7):
        words = ["▁" + "".join(x) for x in itertools.product("ab", repeat=n)]
        m.learn(words)
        for w in words:
            ids = np.frombuffer(m.known[w], m.dtype)
            assert "".join(pieces[i] for i in ids) == w and abs(sum(scores[i] for i in ids) - best(w)) < 1e-9
    assert np.frombuffer(m.encode(["a?"])[0], m.dtype).tolist()[-1] == 0


def test_toxic_folding():
    lex = toxicity.Lexicon({"idiot": 5.0}, ("village idiot",), 1.0, -2.0)
    a = lex.automaton()
    assert all(lex.hits(a, t) > 0 for t in ("you idiot", "1d10t!", "іdiоt", "ïdïot", "id1ot&&& x", "IDIOTS"))
    assert lex.hits(a, "a village idiot here") == 0 and lex.hits(a, "") == 0 and lex.hits(a, "periodiot") == 0
    assert lex.score(a, None) == lex.score(a, "") < 0.5 < lex.score(a, "you idiot idiot")


def test_kmeans_and_edges():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = embeddings.spherical_kmeans(x, 5)
    assert c.shape == (5, 8) and np.allclose(np.linalg.norm(c, axis=1), 1)
    a, b = embeddings._near(np.array([[True, True, False], [False, True, False]]), np.array([5, 6]), np.array([7, 8, 9]))
    assert set(zip(a, b, strict=True)) == {(5, 5), (6, 5), (7, 5), (8, 5)}


def test_dictionary_of_nothing():
    assert tokenfiles.train([]) == b"" and tokenfiles.train([b"x"] * 100) == b""


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=8, max_size=8), st.text("ab", min_size=6, max_size=6)), min_size=2, max_size=9, unique=True))
def test_shared_windows(suffixes_):
    rows = sorted((a.encode(), b.encode()) for a, b in suffixes_)
    same = lambda x, y: next((i for i in range(len(x)) if x[i] != y[i]), len(x))
    want = [{p for j, (c, d) in enumerate(rows) if j != i for p in range(8 - same(a, c), same(b, d) + 1)} for i, (a, b) in enumerate(rows)]
    got = [set() for _ in rows]
    for i, r, left in suffixes.shared_windows([b for _, b in rows], [same(x[0], y[0]) for x, y in itertools.pairwise(rows)], 8):
        got[i].update(range(8 - r, left + 1))
    assert got == want


def test_toxicity_of_long_texts_is_linear():
    import time

    from polyseek.llm import toxicity

    lex = toxicity.Lexicon({"blan": 2.0, "zorg ": 1.0}, ("harmless blanfex", "blanfex indeed zorg"), 1.0, -3.0)
    a = lex.automaton()
    text = "harmless blanfex indeed zorg blanfex zorg clean " * 110_000  # more than 5 MB
    assert len(text) > 5_000_000
    began = time.perf_counter()
    value = lex.hits(a, text)
    assert time.perf_counter() - began < 20
    # Each time of four hits one stands in no phrase of its own: the second "blanfex" with "zorg" after it.
    assert abs(value - 110_000 * 3.0 / (7 * 110_000) ** 0.5) < 1e-6
    began = time.perf_counter()
    assert "harmless blanfex" in lex.phrases(a, text) and time.perf_counter() - began < 30


def test_documents_of_a_token_file_in_stretches(spark):
    import numpy as np
    import public_tokenizers

    from polyseek.llm import tokenfiles

    docs = spark.createDataFrame([(i, "word " * (i % 7) + "x" * i) for i in range(60)], "doc_id long, text string").coalesce(1)
    files, uri, dictionary = tokenfiles.write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    for r in files.collect():
        f = tokenfiles.TokenFile(uri, r.name, dictionary)
        one = [f.ids(i) for i in range(len(f.counts))]
        for block in (1, 40, 8 << 20):
            got = list(f.all_ids(block))
            assert len(got) == len(one) and all(np.array_equal(a, b) for a, b in zip(got, one, strict=True))
