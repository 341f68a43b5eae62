"""Digit shares of lines of any length."""

from __future__ import annotations

import pytest

from polyseek.llm import quality


@pytest.mark.parametrize("line", ["12345 6789 " * 89, "12345 6789 " * 95, "١٢٣ 456 é " * 120])
def test_digits_of_long_lines(line):
    share = sum(map(str.isdigit, line)) / len(line)
    assert share > 0.5 and quality.line_features(line)[0][0, quality.FEATURES.index("digits")] == share
