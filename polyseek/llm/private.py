"""Personal data: a semi-Markov conditional random field over candidate segments, beside four base patterns.

The base patterns (email, ip, card, phone) are taken as they are. What they miss - addresses with spelled-out signs, phone
numbers without a plus, numbers that run into each other so that a greedy match fails as a whole - is decided by the
field: tokens around digits and "at" signs are cut into segments; an entity segment has at most ``LONGEST`` tokens and
carries features of the whole span (groups of digits, checksum, separators, what touches it, words before it), all
other tokens are segments of one. Dynamic programming over (end, type) chooses boundaries and types at once; tokens of a
base span cannot be part of another. Outside the regions that hold candidates every segment is "other", so leaving them out
changes nothing.

The field is fitted here, by gradient steps on the penalised likelihood, on at most ``SAMPLE`` stretches of text that hold
digits or addresses (those with the least hash; base spans are the labels, stretches with a base match that failed its test
are left out, as their label is unknown), with variants of the spans in them, and on ``WRITTEN`` stretches made from
patterns, so that it does not depend on what a corpus happens to hold.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyseek.llm.common import arrow, column, texts

KINDS = ("email", "ip", "card", "phone")
#: Stretches of text that the field is fitted on, at most, of one text, and made from patterns.
SAMPLE, EACH, WRITTEN = 600, 4, 600
#: Tokens of an entity, digits and groups of digits of one, and characters of text kept around a stretch's middle part.
LONGEST, DIGITS, GROUPS, AROUND = 24, 19, 7, 48
#: Tokens after which a decoder writes out what all paths share.
SETTLE = 2000
STEPS, RATE, PENALTY = 100, 0.5, 1e-3
#: What an entity's type must score over "other" for a span to be added: in doubt a text stays as it is.
MARGIN = 1.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NO_DIGIT = re.compile(r"[^0-9]+")

#: A stretch of digits and what may separate them, and signs or words that may stand for the sign of an address.
_NUMBER = re.compile(r"[+(]{0,2}[0-9][0-9 ().+/\[\] ‐-–-]{5,}")
_AT = re.compile(r"[(\[{<] ?(?:at|@) ?[)\]}>]|(?<![^\W_])at(?![^\W_])| ?@", re.IGNORECASE)
_DOT = r"(?:\.| ?[(\[{<] ?(?:dot|\.) ?[)\]}>] ?| dot )"
_AFTER = re.compile(rf" ?[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}", re.IGNORECASE)
_BEFORE = re.compile(rf"(?:[A-Za-z0-9_%+-]{{1,64}}{_DOT}){{0,4}}[A-Za-z0-9_%+-]{{1,64}} ?$", re.IGNORECASE)
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
_BETWEEN = frozenset(".-()/+[]‐‑‒–")
_HINTS = tuple(re.compile(p, re.IGNORECASE) for p in (r"e-?mail|contact|correo|write", r"\bip\b|host|server|\bfrom\b", r"card|visa|karte|tarjeta|carte|pay", r"phone|tel|call|fax|mobile|cell|ruf|llam"))
#: Endings of addresses that are spelled out most often.
_ENDINGS = frozenset("com org net edu gov info de fr es uk io eu".split())
_NEVER = re.compile(r"version|isbn|page|seite|art\b|\bno\b|order|year|date|\bid\b|invoice", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, found from each "@" to both sides: a run of its letters is read once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        last = m.end() if m else at + 1
        if m:
            out.append((start, last))
        at = text.find("@", last)
    return out


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) of the base patterns by kind and start, and the matches that failed their test."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    failed = []
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            out.append((1, *m.span()))
        else:
            failed.append(m.span())
    for m in _CARD.finditer(text):
        a, b = m.span()
        if b - a >= 13:
            digits = _NO_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, a, b))
            elif len(digits) >= 13:
                failed.append((a, b))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            out.append((3, *m.span()))
        else:
            failed.append(m.span())
    return out, failed


def regions(text: str) -> list[tuple[int, int]]:
    """Where candidates may stand: stretches of digits and their separators, and around signs of an address."""
    found = []
    for m in _NUMBER.finditer(text):
        found.append((m.start(), m.end()))
    for m in _AT.finditer(text):
        after = _AFTER.match(text, m.end())
        low = max(0, m.start() - 200)
        before = _BEFORE.search(text[low : m.start()]) if after else None
        if before:
            found.append((low + before.start(), after.end()))
    found.sort()
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@dataclass(frozen=True)
class Candidate:
    """A segment from token ``first`` to before ``stop``, the types it may have and its features."""

    first: int
    stop: int
    kinds: tuple[int, ...]
    features: tuple[float, ...]


FEATURES = 42


def candidates(text: str, tokens: list[tuple[int, int]]) -> Iterator[Candidate]:
    """The segments of one region's tokens that may be an entity, by first token: digits with separators, or an address."""
    words = [text[a:b] for a, b in tokens]
    n = len(words)
    digit = [w[0].isdigit() and w.isascii() for w in words]
    lower = [w.lower() for w in words]
    for i in range(n):
        if digit[i] or words[i] in "+(":
            count, groups, j, near = 0, 0, i, None
            while j < n and j - i < LONGEST:
                if j > i and not (tokens[j][0] - tokens[j - 1][1] <= 1 and "\n" not in text[tokens[j - 1][1] : tokens[j][0]]):
                    break
                if digit[j]:
                    count += len(words[j])
                    groups += 1
                    if count > DIGITS or groups > GROUPS:
                        break
                    if count >= 7 or groups == 4:
                        near = near or _hints(text, tokens[i][0])
                        yield Candidate(i, j + 1, (1, 2, 3), _number_features(text, tokens, words, digit, i, j + 1, near))
                elif words[j] not in _BETWEEN:
                    break
                j += 1
        if words[i][0].isalnum() and words[i].isascii():
            at = dots = 0
            for j in range(i, min(n, i + LONGEST)):
                w = lower[j]
                if j > i and not tokens[j][0] - tokens[j - 1][1] <= 1:
                    break
                if w == "@" or (w == "at" and j > i):
                    if at:
                        break
                    at = j
                elif w in (".", "dot"):
                    dots += bool(at)
                elif at and dots and j > at + 1 and words[j][0].isalnum() and words[j].isascii():
                    yield Candidate(i, j + 1, (0,), _address_features(text, tokens, lower, i, j + 1, at))
                elif not (words[j].isascii() and words[j][0].isalnum()) and w not in "._%+-()[]{}<>":
                    break


def _touching(text: str, a: int, b: int) -> tuple[float, float]:
    """Whether a letter, digit or sign of an address stands right before or after."""
    before, after = text[a - 1 : a], text[b : b + 2]
    return float(before.isalnum() or before in ("_", "@", "=", '"') if before else False), float(bool(after) and (after[0].isalnum() or after[0] in "_@" or (after[0] in ".-/" and after[1:].isalnum())))


def _hints(text: str, a: int) -> list[float]:
    near = text[max(0, a - 24) : a]
    return [*(float(bool(p.search(near))) for p in _HINTS), float(bool(_NEVER.search(near)))]


def _number_features(text: str, tokens: list, words: list, digit: list, i: int, stop: int, near: list[float]) -> tuple[float, ...]:
    a, b = tokens[i][0], tokens[stop - 1][1]
    groups = [words[t] for t in range(i, stop) if digit[t]]
    sizes = [len(g) for g in groups]
    digits = "".join(groups)
    n = len(digits)
    signs = {words[t] for t in range(i, stop) if not digit[t]}
    gaps = any(tokens[t][0] > tokens[t - 1][1] for t in range(i + 1, stop))
    full_card = 13 <= n <= 19 and luhn(digits)
    fours = sizes in ([4, 4, 4, 4], [4, 6, 5]) or (len(sizes) == 1 and n >= 13)
    octets = len(groups) == 4 and all(map(_octet, groups)) and max(sizes) <= 3
    dotted = octets and sum(words[t] == "." for t in range(i, stop)) == 3 and signs <= {".", "[", "]", "(", ")"}
    tail = sizes[-2:] == [3, 4]
    left = i > 0 and digit[i - 1]
    right = stop < len(words) and digit[stop]
    joined = left or (i > 1 and words[i - 1] in ".-/" and digit[i - 2] and tokens[i][0] == tokens[i - 2][1] + 1)
    open_, close = words[i:stop].count("("), words[i:stop].count(")")
    f = [
        1.0, float(words[i] == "+"), float("(" in signs), float(full_card), float(fours), float(full_card and fours), float(13 <= n <= 19), float(octets), float(dotted),
        float(9 <= n <= 15), float(n < 9), float(tail), float(tail and n == 10), float(tail and words[i] == "+"), float(sizes in ([4, 2, 2], [2, 2, 4])), float(digits.startswith("00")),
        float(signs <= {"."} and bool(signs)), float(signs <= {"-"} and bool(signs)), float(not signs and gaps), float(not signs and not gaps), float("/" in signs),
        float(left), float(right), *_touching(text, a, b), float(open_ != close), float(words[i] == "+" and 9 <= n <= 15), float(len(groups) == 4 and max(sizes) > 3), float(digits[:3] in ("978", "979") and n == 13),
        float(words[i] == "(" and tail and n == 10), float("[" in signs), float(len(groups) > 5), float(joined), float(tail and n == 11 and digits[0] == "1"), *near,
    ]
    return tuple(f + [0.0] * (FEATURES - len(f)))


def _address_features(text: str, tokens: list, lower: list, i: int, stop: int, at: int) -> tuple[float, ...]:
    a, b = tokens[i][0], tokens[stop - 1][1]
    domain = lower[at + 1 : stop]
    spelled = "dot" in domain
    dotted = sum(w == "." for w in domain)
    bracket = lower[at - 1] in "([{<" and at + 1 < stop and lower[at + 1] in ")]}>"
    sign = lower[at] == "@"
    apart = tokens[at][0] > tokens[at - 1][1]
    last = lower[stop - 1]
    loose = any(w == "." and (tokens[t][0] > tokens[t - 1][1] or (t + 1 < stop and tokens[t + 1][0] > tokens[t][1])) and lower[t - 1] not in "([{<" for t, w in enumerate(lower[i:stop], i))
    cut = (i > 1 and lower[i - 1] in ("dot", ".", "-", "_", "+", "%") and tokens[i][0] == tokens[i - 1][1]) or (i > 1 and lower[i - 1] == "dot")
    more = stop + 1 < len(lower) and (lower[stop] == "dot" or (lower[stop] == "." and tokens[stop][0] == tokens[stop - 1][1] and tokens[stop + 1][0] == tokens[stop][1] and lower[stop + 1].isalnum()) or (lower[stop] in "([{<" and lower[stop + 1] in ("dot", ".")) or lower[stop] == "-")
    words_before = sum(1 for t in range(i + 1, at) if lower[t].isalnum() and lower[t - 1].isalnum())
    f = [
        1.0, float(sign), float(sign and apart), float(not sign and not bracket), float(bracket), float(spelled), float(not sign and not bracket and spelled), float(not sign and not bracket and not spelled),
        float(dotted > 0), float(last.isalpha() and 2 <= len(last) <= 6), float(not last.isalpha()), float(len(last) > 6), float(loose), float(cut), float(more), float(words_before > 0), float(words_before > 1), float(last in _ENDINGS), float(last in _ENDINGS and spelled), float(any(not w.isalpha() for w in lower[i : at - bracket])), *_touching(text, a, b), *_hints(text, a),
    ]
    return tuple(f + [0.0] * (FEATURES - len(f)))


@dataclass(frozen=True)
class Field:
    """weights (kind x feature) and move[p, q]: score of a segment of label q after one of p; label 0 is "other"."""

    weights: np.ndarray
    move: np.ndarray

    def scored(self, segments: Iterable[Candidate], most: int = 1024) -> Iterator[tuple[int, int, list[tuple[int, float]]]]:
        """(first, stop, (label, score) of each type that it may have) of each segment."""
        segments = iter(segments)
        while held := list(islice(segments, most)):
            scores = (np.array([s.features for s in held]) @ self.weights.T - MARGIN).tolist()
            yield from ((s.first, s.stop, [(k + 1, row[k]) for k in s.kinds]) for s, row in zip(held, scores, strict=True))

    def decode(self, count: int, segments: Iterable[Candidate]) -> list[tuple[int, int, int]]:
        """(kind, first, stop) of the best segmentation of ``count`` tokens; segments come by their first token.

        best[t][y] is the best score of the first t tokens with y as the last label. Only the last ``LONGEST`` ends stay;
        every ``SETTLE`` tokens what all their paths share is written out and the pointers before it go.
        """
        move = self.move.tolist()
        labels = range(len(move))
        scored = self.scored(segments)
        ahead = next(scored, None)
        if ahead is None:
            return []
        best: dict[int, dict[int, float]] = {0: {0: 0.0}}
        back: dict[tuple[int, int], tuple[int, int]] = {}
        out: list[tuple[int, int, int]] = []

        def path(node: tuple[int, int]) -> None:
            found = []
            while node in back:
                before = back[node]
                if node[1]:
                    found.append((node[1] - 1, before[0], node[0]))
                node = before
            out.extend(reversed(found))

        for t in range(count):
            row = best[t]
            reach = [max((row[q] + move[q][y], q) for q in row) for y in labels]
            while ahead is not None and ahead[0] == t:
                for y, score in ahead[2]:
                    value = reach[y][0] + score
                    end = best.setdefault(ahead[1], {})
                    if y not in end or value > end[y]:
                        end[y] = value
                        back[ahead[1], y] = (t, reach[y][1])
                ahead = next(scored, None)
            best.setdefault(t + 1, {})[0] = reach[0][0]
            back[t + 1, 0] = (t, reach[0][1])
            del best[t]
            if t % SETTLE == SETTLE - 1:
                live = {(s, y) for s, row in best.items() for y in row}
                while len(live) > 1:
                    last = max(live)
                    live.remove(last)
                    live.add(back.get(last, (0, 0)))
                shared = live.pop()
                path(shared)
                back = {node: before for node, before in back.items() if before[0] >= shared[0] and before != node and node[0] > shared[0]}
        row = best[count]
        path((count, max(row, key=lambda q: row[q] + move[q][0])))
        return out


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Spans that the field finds outside the base spans."""
    out = []
    fixed = sorted((a, b) for _, a, b in base)
    at = 0
    for a, b in regions(text):
        tokens = [m.span() for m in _TOKEN.finditer(text, a, b)]
        while at < len(fixed) and fixed[at][1] <= a:
            at += 1
        # What a base span does not cover falls into parts; each is decoded by itself.
        parts, now, i = [], [], at
        for s, e in tokens:
            while i < len(fixed) and fixed[i][1] <= s:
                i += 1
            if i < len(fixed) and fixed[i][0] < e:
                if now:
                    parts.append(now)
                now = []
            else:
                now.append((s, e))
        if now:
            parts.append(now)
        for part in parts:
            for kind, first, stop in field.decode(len(part), candidates(text, part)):
                out.append((kind, part[first][0], part[stop - 1][1]))
    return out


# Fitting.


def stretches(text: str) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Up to ``EACH`` stretches of text around digits or addresses, with their base spans; none with an unknown label."""
    base, failed = base_spans(text)
    out, last = [], -1
    marks = sorted([(a, b) for _, a, b in base] + regions(text))
    for a, b in marks:
        if a < last or b - a > 200 or len(out) == EACH:
            continue
        low, high = max(0, a - AROUND), min(len(text), b + AROUND)
        if any(s < high and e > low for s, e in failed):
            continue
        out.append((text[low:high], [(k, s - low, e - low) for k, s, e in base if low <= s and e <= high]))
        last = high
    return out


def _varied(rng: random.Random, kind: int, value: str) -> str:
    """A value of a kind as people also write it."""
    if kind == 0:
        local, _, domain = value.partition("@")
        at, dot = rng.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" @ ", "."), (" AT ", " DOT "), ("@", " dot "), ("[at]", ".")])
        return local.replace(".", dot if rng.random() < 0.4 and dot != "." else ".") + at + domain.replace(".", dot)
    digits = _NO_DIGIT.sub("", value)
    if kind == 1:
        return value.replace(".", rng.choice(["[.]", "(.)", " . ", "."]))
    if kind == 2:
        sep = rng.choice([".", "/", " ", "-", "", ""])
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    d = digits[-10:]
    return rng.choice(["({0}) {1}-{2}", "({0}){1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "{0} {1} {2}", "001 {0} {1} {2}", "1-{0}-{1}-{2}", "+1 {0} {1} {2}", "+1 ({0}) {1}-{2}", "+1.{0}.{1}.{2}"]).format(d[:3], d[3:6], d[6:])


def _card(rng: random.Random) -> str:
    head = str(rng.randrange(10**15)).zfill(15)
    return next(head + c for c in "0123456789" if luhn(head + c))


def _value(rng: random.Random, kind: int) -> str:
    name = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    if kind == 0:
        return f"{name()}{rng.choice(['', '.', '_', '.'])}{rng.choice([name(), str(rng.randrange(100))])}@{name()}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'example.com', 'co.uk'])}"
    if kind == 1:
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    return _card(rng) if kind == 2 else f"+1 ({rng.randrange(1000):03d}) {rng.randrange(1000):03d}-{rng.randrange(10000):04d}"


def _nothing(rng: random.Random) -> str:
    """Digits and signs that are no personal data."""
    r = rng.randrange
    head = str(r(10**15)).zfill(15)
    return rng.choice([
        f"{r(1900, 2100)}-{r(1, 13):02d}-{r(1, 29):02d}", f"{r(1, 29):02d}.{r(1, 13):02d}.{r(1900, 2100)}", f"{r(1, 13):02d}/{r(1, 29):02d}/{r(1900, 2100)}", f"{r(1900, 2100)}-{r(1900, 2100)}",
        f"version {r(9)}.{r(20)}.{r(20)}", f"{r(1, 999)},{r(1000):03d},{r(1000):03d}.{r(100):02d}", f"pages {r(100, 999)}-{r(1000, 9999)}", f"ISBN 978-{r(10)}-{r(10, 99)}-{r(100000, 999999)}-{r(10)}", str(r(10**7, 10**12)),
        next(head + c for c in "0123456789" if not luhn(head + c)), f"{r(10)} {r(10)} {r(10)} {r(10)} {r(10)} {r(10)} {r(10)} {r(10)}", f"{r(10, 99)} {r(10, 99)} {r(10, 99)} {r(10, 99)} {r(10, 99)}",
        f"{r(1000)}.{r(10**6, 10**8)}", f"{r(10**5, 10**6)} {r(10**5, 10**6)}", f"look at site{r(99)}.com", f"at {r(1, 12)}.{r(10, 60)} noon", "arrived at the dot of noon", f"we met at home. Then {r(100)}", f"{r(10)}.{r(10)}.{r(10)}.{r(10)}.{r(10)}.{r(10)}",
        f"{r(1900, 2100)}-{r(1, 13):02d}-{r(1, 29):02d} {r(24):02d}{r(60):02d}", f"{r(256, 999)}.{r(256, 999)}.{r(256, 999)}.{r(256, 999)}", f"{r(10, 100)}/{r(100, 1000)}/{r(1000, 10000)}", f"{r(1900, 2100)} {r(1900, 2100)} {r(1900, 2100)} {r(1900, 2100)}",
    ])


def written(count: int = WRITTEN, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Stretches made from patterns: values and their variants, also one right after another, and what is none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrstdmpc") for _ in range(rng.randint(1, 9)))
    hints = (("mail", "contact"), ("from", "host"), ("card",), ("call", "phone", "tel"))
    out = []
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(rng.randint(0, 3))), []
        for _ in range(rng.choice([1, 1, 1, 2, 3])):
            text += " " if text else ""
            if rng.random() < 0.35:
                text += _nothing(rng)
            else:
                kind = rng.randrange(4)
                if rng.random() < 0.2:
                    text += rng.choice(hints[kind]) + rng.choice([" ", ": "])
                value = _value(rng, kind)
                value = value if rng.random() < 0.3 else _varied(rng, kind, value)
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            if rng.random() < 0.5:
                text += rng.choice(["", ",", ".", "!!", "%%%"]) + " " + word()
        text += rng.choice(["", ".", " " + word(), "\n" + word(), ", " + word()])
        out.append((text, spans))
    return out


def varied(found: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Stretches with one of their spans written otherwise."""
    out = []
    for text, spans in found:
        flat = [s for s in spans if not any(o != s and o[1] < s[2] and o[2] > s[1] for o in spans)]
        if flat:
            rng = random.Random(f"{seed} {text}")
            kind, a, b = rng.choice(flat)
            new = _varied(rng, kind, text[a:b])
            move = len(new) - (b - a)
            out.append((text[:a] + new + text[b:], [(kind, a, a + len(new)), *((k, s + move * (s >= b), e + move * (s >= b)) for k, s, e in spans if (k, s, e) != (kind, a, b))]))
    return out


def _lsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def fit(examples: list[tuple[str, list[tuple[int, int, int]]]], steps: int = STEPS) -> Field:
    """The field of most penalised likelihood. Regions of an example are sequences of their own; one whose spans are not
    all among its candidates is left out."""
    rows = []
    for text, spans in examples:
        for a, b in regions(text):
            tokens = [m.span() for m in _TOKEN.finditer(text, a, b)]
            if not tokens or len(tokens) > 60:
                continue
            segments = list(candidates(text, tokens))
            at = {(tokens[s.first][0], tokens[s.stop - 1][1]): k for k, s in enumerate(segments)}
            gold = [(at.get((s, e)), kind) for kind, s, e in spans if s < b and e > a]
            if segments and all(k is not None and kind in segments[k].kinds for k, kind in gold) and not _overlap([segments[k] for k, _ in gold]):
                rows.append((len(tokens), segments, gold))
    labels = len(KINDS) + 1
    weights, move = np.zeros((len(KINDS), FEATURES)), np.zeros((labels, labels))
    if not rows:
        return Field(weights, move)
    n, longest = len(rows), max(r[0] for r in rows) + 1
    x = np.array([s.features for r in rows for s in r[1]])
    who = np.repeat(np.arange(n), [len(r[1]) for r in rows])
    first, stop = (np.array([getattr(s, name) for r in rows for s in r[1]]) for name in ("first", "stop"))
    may = np.array([[k in s.kinds for k in range(len(KINDS))] for r in rows for s in r[1]])
    gold, seen = np.zeros((len(x), len(KINDS))), np.zeros((labels, labels))
    offset = np.cumsum([0, *(len(r[1]) for r in rows)])
    for i, (count, segments, spans) in enumerate(rows):
        covered, before, t = {segments[k].first: (k, kind) for k, kind in spans}, 0, 0
        while t < longest:
            k, kind = covered.get(t, (None, None)) if t < count else (None, None)
            now, t = (0, t + 1) if k is None else (kind + 1, segments[k].stop)
            seen[before, now] += 1
            before = now
            if k is not None:
                gold[offset[i] + k, kind] = 1
    at_stop = [np.flatnonzero(stop == t) for t in range(longest + 1)]
    at_first = [np.flatnonzero(first == t) for t in range(longest + 1)]
    square_w, square_m = np.full_like(weights, 1e-6), np.full_like(move, 1e-6)
    low = -1e9
    for _ in range(steps):
        score = np.where(may, x @ weights.T, low)
        ahead, reach = np.full((longest + 1, n, labels), low), np.full((longest + 1, n, labels), low)
        ahead[0, :, 0] = 0.0
        for t in range(longest + 1):
            if t:
                ahead[t, :, 0] = reach[t - 1, :, 0]
                k = at_stop[t]
                if len(k):
                    value = np.exp(np.maximum(reach[first[k], who[k], 1:] + score[k] - 30, -700))
                    total = np.zeros((n, labels - 1))
                    np.add.at(total, who[k], value)
                    ahead[t, :, 1:] = np.where(total > 1e-300, np.log(np.maximum(total, 1e-300)) + 30, low)
            reach[t] = _lsum(ahead[t][:, :, None] + move, 1)
        z = reach[longest - 1, :, 0]
        behind = np.full((longest + 1, n, labels), low)
        behind[longest, :, 0] = 0.0
        expected, moves = np.zeros_like(score), np.zeros_like(move)
        for t in range(longest - 1, -1, -1):
            ways = np.full((n, labels), low)
            ways[:, 0] = behind[t + 1, :, 0]
            k = at_first[t]
            if len(k):
                value = score[k] + behind[stop[k], who[k], 1:]
                expected[k] = np.exp(np.minimum(reach[t, who[k], 1:] + value - z[who[k], None], 0))
                total = np.zeros((n, labels - 1))
                np.add.at(total, who[k], np.exp(np.maximum(value - 30, -700)))
                ways[:, 1:] = np.where(total > 1e-300, np.log(np.maximum(total, 1e-300)) + 30, low)
            behind[t] = _lsum(move + ways[:, None, :], 2)
            moves += np.exp(np.minimum(ahead[t][:, :, None] + move + ways[:, None, :] - z[:, None, None], 0)).sum(axis=0)
        gw = (gold - expected).T @ x / n - PENALTY * weights
        gm = (seen - moves) / n - PENALTY * move
        gm[0, 0] = 0.0
        square_w, square_m = square_w + gw * gw, square_m + gm * gm
        weights, move = weights + RATE * gw / np.sqrt(square_w), move + RATE * gm / np.sqrt(square_m)
    return Field(weights, move)


def _overlap(segments: list[Candidate]) -> bool:
    spans = sorted((s.first, s.stop) for s in segments)
    return any(b[0] < a[1] for a, b in zip(spans, spans[1:], strict=False))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """The field, from stretches of docs (text) of least hash and those made from patterns. Null and empty texts and an
    empty table give none; then the patterns alone are learned from."""

    def run(batch: pa.RecordBatch) -> dict:
        out = {"o": [], "text": [], "spans": []}
        for t in column(batch, "text"):
            for piece, spans in stretches(t):
                flat = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
                out["o"].append(int.from_bytes(hashlib.sha256(piece.encode()).digest()[:7], "big")), out["text"].append(piece), out["spans"].append(flat)
        return {"o": pa.array(out["o"], pa.int64()), "text": pa.array(out["text"], pa.string()), "spans": pa.array(out["spans"], pa.string())}

    marked = texts(docs).select("text").where(F.col("text").rlike(r"@|[0-9][0-9 ().+/-]{5}|[(\[{<] ?[aA][tT] ?[)\]}>]"))
    found = arrow(marked, run, "o long, text string, spans string").dropDuplicates(["text"]).orderBy("o", "text").limit(sample).collect()
    real = [(r.text, [tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s]) for r in found]
    return fit([*real, *varied(real), *written()])


def found_spans(docs: DataFrame, field: Field) -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base and spans (kind:start:end by kind and start).

    Null and empty texts hold none; repeated rows and null doc_ids are rows of their own; columns other than doc_id and
    text are not read; an empty table gives an empty one. A text is read in time linear in its length.
    """

    def line(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {name: [] for name in ("n_email", "n_ip", "n_card", "n_phone", "base", "spans")}
        for t in column(batch, "text"):
            t = t or ""
            base, _ = base_spans(t)
            for k, name in enumerate(("n_email", "n_ip", "n_card", "n_phone")):
                out[name].append(sum(s[0] == k for s in base))
            out["base"].append(line(base))
            out["spans"].append(line(base + added_spans(t, base, field)))
        return {"doc_id": batch.column(0), **out}

    return arrow(texts(docs), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets; of overlapping ones the first, the longer at a tie."""
    out, last = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out.append(text[last:a] + f"<{KINDS[k]}>")
            last = b
    return "".join(out) + text[last:]
