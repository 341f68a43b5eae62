"""Content-defined anchors: positions that equal stretches of text choose alike.

A window is ``length`` consecutive symbols. Of its first ``w`` strings of ``k`` symbols (w = length - k + 1 at most) the
leftmost one of least hash is the window's *anchor*. Equal windows have it at the same offset, so to find equal windows
it is enough to compare those that share an anchor; there are about 2 / (w + 1) anchors a symbol. Hashes are
polynomials modulo 2**64 over random symbol values.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_LOW = _U((1 << 24) - 1)
_STEP = 1 << 22
_powers: dict[tuple[int, bool], np.ndarray] = {}

#: Random odd values of the 256 bytes.
BYTES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _power(seed: int, inverse: bool, n: int) -> np.ndarray:
    """Powers 0..n of the base that belongs to seed, or of its inverse."""
    have = _powers.get((seed, inverse))
    if have is None or len(have) <= n:
        base = int(np.random.default_rng(seed).integers(1 << 40, 1 << 63, dtype=np.uint64)) | 1
        size = 1 << max(16, int(n + 1).bit_length())
        have = np.full(size, pow(base, -1, 1 << 64) if inverse else base, dtype=_U)
        have[0] = 1
        have = np.cumprod(have)
        if size <= 1 << 21:
            _powers[seed, inverse] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which an order by value is a random one."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Rolling:
    """Hashes of any substrings of one sequence, from prefix sums of value[i] * base**i."""

    def __init__(self, values: np.ndarray, seed: int):
        n = len(values)
        self.inverse = _power(seed, True, n)
        self.sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(values * _power(seed, False, n)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:n]) * self.inverse[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i+w] for each i, by doubling."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = w - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All integers of the half-open ranges, one after another."""
    n = np.maximum(stop - start, 0)
    at = np.cumsum(n) - n
    return np.arange(int(n.sum()), dtype=np.int64) + np.repeat(start - at, n)


def leftmost(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each i the position of the least hash (its upper 40 bits, leftmost of ties) in hashes[i:i+w]."""
    out = []
    for at in range(0, max(len(hashes) - w + 1, 0), _STEP):
        part = hashes[at : at + _STEP + w - 1]
        key = (part & ~_LOW) | np.arange(len(part), dtype=_U)
        out.append((sliding_min(key, w) & _LOW).astype(np.int64) + at)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def anchored(values: np.ndarray, offsets: np.ndarray, length: int, k: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor in sequences laid end to end (offsets has their bounds).

    seq: which sequence; anchor, first, last: positions in ``values`` of the anchor and of the run's first and last
    window; h: hash of the anchor's k symbols; c: hash of all symbols of the run's windows and of where the anchor is.
    """
    w = length - k + 1
    starts, stops = offsets[:-1], offsets[1:] - length + 1
    long = np.flatnonzero(stops > starts)
    names = ("seq", "anchor", "first", "last", "h", "c")
    if not len(long):
        return {x: np.zeros(0, dtype=np.int64) for x in names[:4]} | {x: np.zeros(0, dtype=_U) for x in names[4:]}
    one = Rolling(values, 1)
    hashes = one.every(k)
    at = leftmost(hashes, w)
    p = ranges(starts[long], stops[long])
    a = at[p]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)])
    first = p[new]
    last = p[np.append(np.flatnonzero(new)[1:], len(p)) - 1]
    anchor = a[new]
    c = Rolling(values, 2).of(first, last + length) ^ mixed(((anchor - first) * length + (last - first)).astype(_U))
    return {"seq": np.searchsorted(offsets, first, side="right") - 1, "anchor": anchor, "first": first, "last": last, "h": hashes[anchor], "c": c}
