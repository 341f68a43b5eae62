"""Components that are not settled raise."""

from __future__ import annotations

import pytest

from polyseek.llm.components import connected_components


def test_unsettled_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="not settled"):
        connected_components(edges, most_rounds=1).count()
    assert {r.root for r in connected_components(edges).collect()} == {0}
