"""Edit distances and similarities of short texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F


def damerau(a: str, b: str) -> int:
    """Damerau-Levenshtein distance in which swapped letters may be edited again."""
    last: dict[str, int] = {}
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        above, row, column = rows[-1], [i], 0
        for j, y in enumerate(b, 1):
            best = min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y))
            k = last.get(y, 0)
            if k and column:  # the pair was met in the other order at (k, column)
                best = min(best, rows[k - 1][column - 1] + (i - k - 1) + 1 + (j - column - 1))
            if x == y:
                column = j
            row.append(best)
        last[x] = i
        rows.append(row)
    return rows[-1][-1]


def aligned(a: str, b: str) -> int:
    """Optimal string alignment: each letter takes part in one edit at most."""
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            new.append(best)
        older, old = old, new
    return old[-1]


def plain(value: str | None) -> str:
    """Upper case with punctuation and repeated spaces removed."""
    return " ".join(re.sub(r"[^\w$<>=≤%]+", " ", (value or "").upper()).split())


def similarity(a: str | None, b: str | None) -> float:
    """1 for equal plain texts, less by the share of letters to edit, 0 if only one is empty."""
    x, y = plain(a), plain(b)
    if not x or not y:
        return float(x == y)
    return 1.0 - aligned(x, y) / max(len(x), len(y))


def _pairwise(function, kind: str):
    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        memo: dict[tuple, object] = {}
        for left, right in batches:
            out = []
            for pair in zip(left, right, strict=True):
                if pair not in memo:
                    if len(memo) > 200_000:
                        memo.clear()
                    memo[pair] = function(*pair)
                out.append(memo[pair])
            yield pd.Series(out, dtype=object)

    return run


def damerau_column(a, b):
    """damerau() of two text columns, NULL if either is."""
    return _pairwise(lambda x, y: None if x is None or y is None else damerau(x, y), "int")(a, b)


def similarity_column(a, b):
    """similarity() of two text columns."""
    return _pairwise(similarity, "double")(a, b)
