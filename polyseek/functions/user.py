"""Functions that built-in ones do not give: a table function over texts, an aggregate over a bounded group."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def passages(size: int, step: int):  # noqa: ANN201
    """A table function text -> (start, n, passage): windows of ``size`` words (lower case, between white space), ``step`` apart; the last
    one begins where more than half a step is left. Null and empty texts give none."""

    class Passages:
        def eval(self, text: str) -> Iterator[tuple[int, int, str]]:
            words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w] if text else []
            for start in range(0, max(0, len(words) - step // 2 - 1) + 1, step) if words else ():
                part = words[start : start + size]
                yield start, len(part), " ".join(part)

    return F.udtf(Passages, returnType="start int, n int, passage string")


def trimmed_mean(share: float) -> Callable:
    """An aggregate: the mean without the ``share`` least and greatest values (whole numbers of them). A group must fit a task:
    group by parts and combine where groups grow with the data."""

    @F.pandas_udf("double")
    def mean(x: pd.Series) -> float:
        v = np.sort(x.dropna().to_numpy())
        k = int(len(v) * share)
        return float(v[k : len(v) - k].mean()) if len(v) > 2 * k else float("nan")

    return mean
