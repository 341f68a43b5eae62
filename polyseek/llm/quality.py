"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate, by Viterbi decoding.

The field is trained here, on the lines of at most ``SAMPLE`` labelled documents of each class (those with the least hash
of doc_id and text), of each at most ``CHAINS`` chains of ``CHAIN`` lines, evenly spaced: lines carry their document's
label at first, then, within rejected documents, the label that the field itself decodes. Decoding takes whole texts.
Content share is the share of words that stand in content lines.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyseek.llm.common import WORD, arrow, column, texts

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Labelled documents of each class that the field is fitted on, at most.
SAMPLE = 300
#: Lines of a chain, and chains of one document, that the field is fitted on, at most.
CHAIN, CHAINS = 64, 32
MIN_SHARE = 0.5
STEPS, RATE, PENALTY = 120, 0.1, 1e-3
FEATURES = ("bias", "upper", "symbols", "bars", "repeats", "seen", "short", "stop", "bangs", "digits")


def _digits(line: str) -> int:
    """Characters of a line, of any length, that are digits."""
    return sum(map(line.count, "0123456789")) if line.isascii() else sum(map(str.isdigit, line))


#: White space to Python but not to the contract's words; what else separates words there.
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
WORDS = re.compile(WORD)


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, words of each line) for the lines that hold a word."""
    rows, sizes, seen = [], [], set()
    cut = WORDS.findall if ODD.search(text) else str.split
    for line in text.split("\n"):
        words = cut(line)
        if not words:
            continue
        n, chars = len(words), len(line)
        rows.append((
            1.0, sum(map(str.isupper, words)) / n, min(2.0, sum(map(line.count, "#*$%&<>")) / n), min(2.0, line.count("|") / n),
            1 - len(set(words)) / n if n > 9 else 0.0, float(line in seen and n > 2), float(n < 4), float(words[-1][-1] in ".!?"),
            min(2.0, line.count("!") / n), _digits(line) / chars,
        ))
        sizes.append(n)
        seen.add(line)
    return np.array(rows, dtype=float).reshape(-1, len(FEATURES)), np.array(sizes, dtype=float)


def viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best label sequence; emit: score of label 1 over label 0 by line, move[i, j]: score of j after i."""
    (m00, m01), (m10, m11) = move.tolist()
    a, b, back = 0.0, 0.0, []
    for i, e in enumerate(emit.tolist()):
        if i:
            to0, to1 = b + m10 > a + m00, b + m11 > a + m01
            back.append((to0, to1))
            a, b = (b + m10 if to0 else a + m00), (b + m11 if to1 else a + m01)
        b += e
    at = int(b > a)
    out = [at]
    for step in reversed(back):
        at = int(step[at])
        out.append(at)
    return np.array(out[::-1][: len(emit)], dtype=np.int64)


def fit(docs: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, move) of most penalised likelihood for (features, labels) of lines, by gradient steps with momentum."""
    docs = [d for d in docs if len(d[1])]
    width = len(FEATURES)
    w, move = np.zeros(width), np.zeros((2, 2))
    if not docs:
        return w, move
    longest = max(len(y) for _, y in docs)
    x = np.zeros((len(docs), longest, width))
    y = np.zeros((len(docs), longest), dtype=np.int64)
    for i, (f, labels) in enumerate(docs):
        x[i, : len(labels)], y[i, : len(labels)] = f, labels
    there = np.arange(longest) < np.array([len(d[1]) for d in docs])[:, None]
    total = there.sum()
    v, u = np.zeros(width), np.zeros((2, 2))
    for _ in range(steps):
        e = np.zeros((len(docs), longest, 2))
        e[:, :, 1] = x @ w
        ahead = np.zeros_like(e)
        ahead[:, 0] = e[:, 0]
        for t in range(1, longest):
            step = np.logaddexp(ahead[:, t - 1, 0, None] + move[0], ahead[:, t - 1, 1, None] + move[1]) + e[:, t]
            ahead[:, t] = np.where(there[:, t, None], step, ahead[:, t - 1])
        z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        behind = np.zeros_like(e)
        pairs = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            nxt = e[:, t + 1] + behind[:, t + 1]
            both = ahead[:, t, :, None] + move + nxt[:, None, :] - z[:, None, None]
            pairs += np.exp(both[there[:, t + 1]]).sum(axis=0)
            step = np.logaddexp(move[:, 0] + nxt[:, 0, None], move[:, 1] + nxt[:, 1, None])
            behind[:, t] = np.where(there[:, t + 1, None], step, 0)
        p = np.exp(ahead[:, :, 1] + behind[:, :, 1] - z[:, None])
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][there[:, 1:]], y[:, 1:][there[:, 1:]]), 1)
        gw = np.einsum("dt,dtf->f", (y - p) * there, x) / total - PENALTY * w
        gm = (seen - pairs) / total - PENALTY * move
        v, u = 0.9 * v + gw, 0.9 * u + gm
        w, move = w + 10 * RATE * v, move + 10 * RATE * u
    return w, move


def chains(features: np.ndarray) -> list[np.ndarray]:
    """The lines of a document in chains, of more than ``CHAINS`` those that are evenly spaced."""
    out = [features[i : i + CHAIN] for i in range(0, len(features), CHAIN)]
    return out if len(out) <= CHAINS else [out[i * len(out) // CHAINS] for i in range(CHAINS)]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The field for docs (doc_id, text) and labels (doc_id, quality); without labels of both classes all is content.

    A doc_id with labels of both classes is left out, as are null texts and null doc_ids; repeated rows count once each.
    """
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_q")).where("quality = _q")
    picked = [known.where(F.col("quality") == q).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    picked = F.broadcast(picked[0].union(picked[1]))  # two numbers for each of 2 x sample rows
    rows = texts(docs).where("text is not null").join(picked, "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))

    def lines(batch: pa.RecordBatch) -> dict:
        out = {"o": [], "quality": [], "chain": []}
        for d, t, q in zip(*(column(batch, n) for n in ("doc_id", "text", "quality")), strict=True):
            order = int.from_bytes(hashlib.sha256(f"{d} {t}".encode()).digest()[:7], "big")
            for c in chains(line_features(t)[0]):
                out["o"].append(order), out["quality"].append(q), out["chain"].append(c.ravel().tolist())
        return {"o": pa.array(out["o"], pa.int64()), "quality": pa.array(out["quality"], pa.int32()), "chain": pa.array(out["chain"], pa.list_(pa.float64()))}

    # A doc_id may have several texts: the least of all rows stay, at most CHAINS rows of CHAIN lines for each.
    found = arrow(rows.dropDuplicates(["doc_id", "text"]), lines, "o long, quality int, chain array<double>", most=1 << 20)
    ranked = found.withColumn("r", F.dense_rank().over(Window.partitionBy("quality").orderBy("o"))).where(F.col("r") <= sample)
    got = sorted((r.o, r.quality, list(r.chain)) for r in ranked.collect())
    if len({q for _, q, _ in got}) < 2:
        return np.zeros(len(FEATURES)), np.zeros((2, 2))
    cut = [(np.array(c).reshape(-1, len(FEATURES)), q) for _, q, c in got]
    field = fit([(f, np.full(len(f), q)) for f, q in cut])
    return fit([(f, np.ones(len(f), dtype=np.int64) if q else viterbi(f @ field[0], field[1])) for f, q in cut])


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, "\x20\x09\x0a\x0b\x0c\x0d"))
    seen: set[str] = set()
    doubled = 0
    for line in text.split("\n"):
        if line.strip("\x20\x09\x0b\x0c\x0d"):
            doubled += line in seen
            seen.add(line)
    repeated = 0
    triples = list(zip(words, words[1:], words[2:], strict=False))
    count = Counter(triples)
    if len(count) < len(triples):
        upto = 0
        for i, t in enumerate(triples):
            if count[t] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return n, chars, sum(map(text.count, SYMBOLS)), doubled, repeated


def judge(docs: DataFrame, field: tuple[np.ndarray, np.ndarray], min_share: float = MIN_SHARE) -> DataFrame:
    """Per row of docs: doc_id, the base counts, base_failed, kept and content_share (null without a word).

    Null and empty texts have no words and fail the base rules. Symbols are those of ``SYMBOLS``. Repeated rows and null
    doc_ids stay rows of their own; columns other than doc_id and text are not read; an empty table gives an empty one.
    """
    weights, move = field

    def run(batch: pa.RecordBatch) -> dict:
        base, share = [], []
        for t in column(batch, "text"):
            t = t or ""
            base.append(base_counts(t))
            f, n = line_features(t)
            share.append(float(n[viterbi(f @ weights, move) == 1].sum() / n.sum()) if len(n) and weights.any() else 1.0 if len(n) else None)
        n, chars, symbols, doubled, repeated = map(list, zip(*base, strict=True)) if base else ([],) * 5
        failed = [a < MIN_WORDS or 100 * r > 50 * a for a, r in zip(n, repeated, strict=True)]
        return {
            "doc_id": batch.column(0), "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": doubled, "n_repeat_words": repeated, "base_failed": failed,
            "kept": [not b and s is not None and s >= min_share for b, s in zip(failed, share, strict=True)], "content_share": pa.array(share, pa.float64()),
        }

    return arrow(texts(docs), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")


def kept_documents(docs: DataFrame, field: tuple[np.ndarray, np.ndarray], min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of docs that pass judge()'s rules, with all their columns; null and empty texts fail, repeated rows and null
    doc_ids are judged by their text like any other."""
    weights, move = field

    @F.pandas_udf("boolean")
    def passes(text):  # noqa: ANN001, ANN202
        out = []
        for t in text:
            t = t or ""
            n, _, _, _, repeated = base_counts(t)
            if n < MIN_WORDS or 100 * repeated > 50 * n:
                out.append(False)
                continue
            f, size = line_features(t)
            out.append(bool(len(size)) and (not weights.any() or bool(size[viterbi(f @ weights, move) == 1].sum() >= min_share * size.sum())))
        return type(text)(out, dtype=bool)

    return docs.where(passes("text"))
