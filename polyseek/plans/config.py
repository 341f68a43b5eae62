"""Search settings, their defaults and how sources of settings merge."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class SearchConfig:
    """nprobe: cells for each query token; t_prime: cumulated cell size at which the imputed score is read (None: by
    index size); bound: last rank considered for that; k: results; centroid_only: leave residuals out."""

    nprobe: int = 32
    t_prime: int | None = None
    k: int = 100
    bound: int | None = None
    centroid_only: bool = False
    nbits: int = 4
    given: frozenset = field(default=frozenset(), compare=False)

    @classmethod
    def of(cls, **settings: object) -> SearchConfig:
        return cls(**settings, given=frozenset(settings))

    def merged(self, later: SearchConfig) -> SearchConfig:
        """Explicit settings of ``later`` win over those of self; its defaults do not."""
        return replace(self, **{n: getattr(later, n) for n in later.given}, given=self.given | later.given)


def t_prime(centroids: int, embeddings: int, k: int) -> int:
    """Default cumulated size: grows with the root of the index up to 2**16 cells, then depends on k."""
    if centroids <= 1 << 16:
        return int(math.sqrt(8 * embeddings) / 1000) * 1000
    return 100_000 if k > 100 else 50_000


def partitions(embeddings: float) -> int:
    """Number of cells: a power of two near 16 roots of the number of embeddings."""
    return 1 << max(0, int(math.floor(math.log2(max(1.0, 16 * math.sqrt(embeddings))))))


def sample_size(passages: int) -> int:
    return min(1 + int(16 * math.sqrt(120 * passages)), passages)


def stage_defaults(k: int) -> tuple[int, float, int]:
    """(cells, centroid score threshold, candidates) of the staged scorer."""
    if k <= 10:
        return 1, 0.5, 256
    return (2, 0.45, 1024) if k <= 100 else (4, 0.4, max(4 * k, 4096))


def grid(**values: list) -> list[dict]:
    """Every combination of the listed settings, in the order given."""
    return [dict(zip(values, x, strict=True)) for x in itertools.product(*values.values())]


SETTINGS = tuple(f.name for f in fields(SearchConfig) if f.name != "given")
