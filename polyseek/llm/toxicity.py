"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding lower-cases, maps homoglyphs of other scripts to Latin letters and digits or signs inside words to the letters
they stand for, and adds each word with accents once more without them. Lexicon terms are word beginnings (whole words are
the longest of them), each with the log ratio of its document rates in toxic and other labelled documents. Exception
phrases are a term's word with the word before or after it, where that pair is usual in other documents and never stands
in a toxic one; a term inside one has no weight. All this is learned, with a logistic curve over the normalised weight,
from at most ``SAMPLE`` labelled rows (those with the least hash of doc_id and text).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyseek.llm.common import arrow, column, saved, texts

SAMPLE = 20_000
#: Terms that are fitted (those in the most toxic rows), terms of the lexicon and exception phrases, at most. Like SAMPLE
#: these bound what is learned on the driver; the scoring sees every term and phrase.
CANDIDATES, TERMS, EXCEPTIONS = 100_000, 2_000, 2_000
#: Other documents that an exception phrase stands in, at least.
USUAL = 3
MIN_DOCS, MIN_RATIO = 4, 2.5
PREFIX = (3, 9)

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans(
    "аеорсухіјѕһԁѵԛԝкмтнвгпАВЕКМНОРСТУХІЈЅαβεικνορτυχγΑΒΕΖΗΙΚΜΝΟΡΤΥΧı",
    "aeopcyxijshdvqwkmthbrnabekmhopctyxijsabeikvoptuxyabezhikmnoptyxi",
)
BARE = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe"})
# Digits and signs that stand for letters inside words.
SUBSTITUTES = str.maketrans("0134578@$!|+", "oieastbasiit")
_INSIDE = re.compile(r"(?<=[^\W\d_])[0134578@$!|+]+(?=[^\W\d_])|(?<!\w)[0134578@$]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578@$]+")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_NON_WORD = re.compile(r"[\W_]+")


def _bare(word: str) -> str:
    return unicodedata.normalize("NFKD", word).translate(BARE).encode("ascii", "ignore").decode()


def folded(text: str) -> tuple[str, int]:
    """The folded words of text, a space around each, and their number; words with accents come again without them."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).translate(HOMOGLYPHS)
    text = _INSIDE.sub(lambda m: m[0].translate(SUBSTITUTES), text)
    text = _NON_WORD.sub(" ", text).strip()
    n = text.count(" ") + 1
    if not text.isascii():
        text = " ".join([text, *(b for w in text.split(" ") if not w.isascii() and (b := _bare(w)))])
    return f" {text} ", n


@dataclass(frozen=True)
class Lexicon:
    """weights by term, exception phrases (in which terms do not count) and the curve's slope and offset."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    offset: float = -3.0

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(" " + term, (len(term) + 1, weight))
        for phrase in self.exceptions:
            found.add_word(folded(phrase)[0], (len(folded(phrase)[0]), None))
        if not len(found):
            return None
        found.make_automaton()
        return found

    def hits(self, automaton: ahocorasick.Automaton | None, text: str) -> float:
        """The weight matched in text, over the square root of its words. Of terms that begin together only the
        strongest counts; none counts inside an exception phrase."""
        if automaton is None:
            return 0.0
        line, words = folded(text)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in automaton.iter(line):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            else:
                best[start] = max(weight, best.get(start, 0.0))
        if spared:  # one sweep over both, by their starts
            spared.sort()
            total, at, reach = 0.0, 0, -1
            for s in sorted(best):
                while at < len(spared) and spared[at][0] <= s:
                    reach = max(reach, spared[at][1])
                    at += 1
                total += best[s] if s >= reach else 0.0
        else:
            total = sum(best.values())
        return total / math.sqrt(words)

    def phrases(self, automaton: ahocorasick.Automaton | None, text: str) -> set[str]:
        """The pairs of words in text of which one holds a term."""
        if automaton is None:
            return set()
        line, _ = folded(text)
        starts = {end - size + 1 for end, (size, weight) in automaton.iter(line) if weight is not None}
        out = set()
        for s in starts:  # the space before a word
            stop = line.index(" ", s + 1)
            word, before = line[s + 1 : stop], line[line.rfind(" ", 0, s) + 1 : s] if s else ""
            after = line[stop + 1 : line.find(" ", stop + 1)] if stop + 1 < len(line) else ""
            out.update(p for p in (before and f"{before} {word}", after and f"{word} {after}") if p)
        return out

    def score(self, automaton: ahocorasick.Automaton | None, text: str | None) -> float:
        z = self.slope * self.hits(automaton, text or "") + self.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _terms(text: str) -> set[str]:
    """The words of a text, and their beginnings."""
    out = set()
    for w in set(folded(text)[0].split()):
        out.add(w + " ")
        out.update(w[:n] for n in range(PREFIX[0], min(PREFIX[1], len(w)) + 1))
    return out


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps on the penalised likelihood."""
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - ridge * beta
        beta = beta + np.linalg.solve(design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(2), gradient)
    return float(beta[0]), float(beta[1])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from docs (doc_id, text) and labels (doc_id, toxic); give only the rows that may be learned from.

    ``exceptions`` are phrases beside those that are learned. A doc_id with labels of both kinds is left out, as are null
    texts and null doc_ids; repeated rows count once each. Without labelled rows of both kinds the lexicon is empty and
    every score is low.
    """
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_t")).where("toxic = _t")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "toxic").limit(sample)
    rows = texts(docs).where("text is not null").join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic")  # known: two numbers a row
    rows = saved(rows.withColumn("_o", F.xxhash64("doc_id", "text")))
    least = rows.select("doc_id", "_o").orderBy("_o", "doc_id").limit(sample)  # a doc_id may have several texts
    rows = saved(rows.join(F.broadcast(least.distinct()), ["doc_id", "_o"], "left_semi").select("doc_id", "text", "toxic"))

    def count(batch: pa.RecordBatch) -> dict:
        seen: Counter = Counter()
        for t in column(batch, "text"):
            seen.update(_terms(t))
            seen[""] += 1
        return {"term": list(seen), "n": list(seen.values())}

    bad = arrow(rows.where("toxic = 1"), count, "term string, n long").groupBy("term").agg(F.sum("n").alias("bad"))
    bad = bad.where((F.col("bad") >= MIN_DOCS) | (F.col("term") == ""))
    wanted = {r.term: r.bad for r in bad.orderBy(F.desc("bad"), "term").limit(CANDIDATES).collect()}
    toxic_rows = wanted.pop("", 0)

    def recount(batch: pa.RecordBatch) -> dict:
        seen: Counter = Counter()
        for t in column(batch, "text"):
            seen.update(_terms(t) & wanted.keys())
            seen[""] += 1
        return {"term": list(seen), "n": list(seen.values())}

    if not wanted:
        return Lexicon({}, exceptions)
    good = {r.term: r.n for r in arrow(rows.where("toxic = 0"), recount, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    clean_rows = good.pop("", 0)
    ratio = {t: math.log((b + 0.5) / (toxic_rows + 1)) - math.log((good.get(t, 0) + 0.5) / (clean_rows + 1)) for t, b in wanted.items()}
    strong = sorted((t for t, r in ratio.items() if r >= MIN_RATIO and wanted[t] >= 10 * good.get(t, 0)), key=lambda t: (-wanted[t], len(t), t))
    weights: dict[str, float] = {}
    for t in strong:  # the most frequent first: a longer term adds nothing to a beginning that is there already
        if len(weights) < TERMS and not any(t[:n] in weights for n in range(1, len(t))):
            weights[t] = ratio[t]
    draft = Lexicon(weights, exceptions)

    def pairs(batch: pa.RecordBatch) -> dict:
        automaton, seen = draft.automaton(), Counter()
        for t, toxic in zip(column(batch, "text"), column(batch, "toxic"), strict=True):
            seen.update((p, toxic) for p in draft.phrases(automaton, t))
        return {"phrase": [p for p, _ in seen], "toxic": pa.array([t for _, t in seen], pa.int32()), "n": pa.array(list(seen.values()), pa.int64())}

    both = arrow(rows, pairs, "phrase string, toxic int, n long").groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n"))).alias("good"), F.max("toxic").alias("bad"))
    usual = both.where((F.col("bad") == 0) & (F.col("good") >= USUAL)).orderBy(F.desc("good"), "phrase").limit(EXCEPTIONS)
    exceptions = (*exceptions, *(r.phrase for r in usual.collect()))
    draft = Lexicon(weights, exceptions)

    def measure(batch: pa.RecordBatch) -> dict:
        automaton = draft.automaton()
        return {"x": [draft.hits(automaton, t) for t in column(batch, "text")], "toxic": batch.column(2)}

    points = arrow(rows, measure, "x double, toxic int").collect()  # two numbers for each row of the sample
    slope, offset = _curve(np.array([p.x for p in points]), np.array([float(p.toxic) for p in points]))
    return Lexicon(weights, exceptions, max(slope, 0.0), offset)


def scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of each row, repeated ones and those with a null doc_id too; null and empty texts get the score of no
    match. Columns other than doc_id and text are not read; an empty table gives an empty one."""
    held: list = []

    def run(batch: pa.RecordBatch) -> dict:
        if not held:
            held.append(lexicon.automaton())
        return {"doc_id": batch.column(0), "score": [lexicon.score(held[0], t) for t in column(batch, "text")]}

    return arrow(texts(docs), run, "doc_id long, score double")
