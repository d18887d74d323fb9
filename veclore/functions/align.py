"""Global alignment distance with affine gaps, as an Arrow UDF on pairs of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The scoring that the distance is defined by.
MATCH, MISMATCH, OPEN, EXTEND = 1.0, 0.0, -2.0, -0.5


def _band(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Scores of the three layers (pair, gap in y, gap in x), rows of ``x`` by diagonals, and the lowest diagonal: those from the
    start's to the end's and ``k`` more on either side.

    In these coordinates a pair stays in its column, a gap in y comes from the column to the right, and a gap in x runs along
    the row, where it is a running maximum. Cells right of y's end lead nowhere, so they need no mask. float32 is exact here:
    scores are halves.
    """
    n, m = len(x), len(y)
    low, width = min(0, m - n) - k, abs(m - n) + 2 * k + 1
    steps = np.arange(width, dtype=np.float32) * np.float32(EXTEND)
    beside = np.zeros(n + width, y.dtype)  # the letter of each cell's column, row by row a window of it
    first = max(0, low)
    beside[first - low : first - low + min(m - first, n + width - (first - low))] = y[first : first + n + width - (first - low)]
    s = np.full((n + 1, 3, width), -np.inf, np.float32)
    s[0, 0, -low] = 0.0
    s[0, 2, 1 - low :] = OPEN + steps[: width + low - 1]
    best = s[0].max(axis=0)
    for i in range(1, n + 1):
        pair, down, right = s[i]
        old = s[i - 1]
        np.add(best, beside[i - 1 : i - 1 + width] == x[i - 1], out=pair)
        np.maximum(np.maximum(old[0, 1:], old[2, 1:]) + np.float32(OPEN), old[1, 1:] + np.float32(EXTEND), out=down[:-1])
        source = np.maximum(pair, down)
        right[1:] = (np.maximum.accumulate(source - steps) + steps)[:-1] + np.float32(OPEN)
        best = np.maximum(source, right)
    return s, low


def alignment_counts(a: str, b: str, band: int = 24) -> tuple[int, int, int]:
    """(mismatches, gap letters, aligned letter pairs) of one best alignment. Ties prefer pairs, then gaps in b.

    Only a band of diagonals is filled. A path that leaves a band of ``k`` has at least k + 1 gap letters in one text and the
    difference of lengths more in the other, so its score is bounded; once the band's score is above that, no best path is
    outside. The first score tells how wide a band is wide enough, so there are two at most, and the result is that of the
    whole table. Memory is 12 bytes a cell of the band.
    """
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    n, m = len(x), len(y)
    if not n or not m:
        return 0, n + m, 0
    outside = min(n, m) + 2 * OPEN - 1 + EXTEND * abs(m - n)  # best score of a path that leaves a band of 0
    s, low = _band(x, y, band)
    score = float(s[n, :, m - n - low].max())
    loss = MATCH - 2 * EXTEND  # what a wider detour costs per diagonal
    if score <= outside - loss * band:
        s, low = _band(x, y, min(max(n, m), int((outside - score) / loss) + 1))
    i, j, wrong, gaps, aligned = n, m, 0, 0, 0

    def at(i: int, j: int) -> list[float]:
        c = j - i - low
        return s[i, :, c].tolist() if 0 <= c < s.shape[2] else [-np.inf] * 3

    def first(p: float, d: float, r: float) -> int:
        return 0 if p >= d and p >= r else 1 if d >= r else 2

    layer = first(*at(n, m))
    while i or j:
        if layer == 0:
            i, j, aligned = i - 1, j - 1, aligned + 1
            wrong += int(x[i] != y[j])
            layer = first(*at(i, j))
            continue
        gaps += 1
        i, j = (i - 1, j) if layer == 1 else (i, j - 1)
        p, d, r = at(i, j)
        kept, other = (d, r) if layer == 1 else (r, d)
        if not kept + EXTEND > max(p, other) + OPEN:
            layer = 0 if p >= other else 3 - layer
    return wrong, gaps, aligned


@F.pandas_udf(T.DoubleType())
def alignment_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """(mismatches + gap letters) / (aligned pairs + gap letters); NULL for NULL or two empty texts."""

    def one(s, t):
        if not isinstance(s, str) or not isinstance(t, str) or not (s or t):
            return None
        wrong, gaps, aligned = alignment_counts(s.upper(), t.upper())
        return (wrong + gaps) / (aligned + gaps)

    return pd.Series([one(s, t) for s, t in zip(a, b)], dtype="float64")
