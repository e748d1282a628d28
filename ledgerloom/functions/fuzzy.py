"""Edit-based similarities as Arrow-batched functions; Spark has no built-in for them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one machine-word-like integer per step."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """100 for equal strings, 0 for nothing in common."""
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * common_subsequence(a, b) / n


def token_set(a: str, b: str) -> float:
    """Best of the shared words against each side, and of both sides with them first."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left = " ".join([both, *sorted(x - y)]).strip()
    right = " ".join([both, *sorted(y - x)]).strip()
    if both and (x <= y or y <= x):
        return 100.0
    return max(indel(left, right), indel(both, left) if both else 0.0, indel(both, right) if both else 0.0)


def partial(a: str, b: str) -> float:
    """Best similarity of the shorter string with a window of the longer."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    if short in long:
        return 100.0
    n, total = len(short), len(long)
    begin, end = strands(short, long)
    # Window i (clipped at both ends) has all of its characters in common but one for each strand within it.
    inside = end - begin < n
    change = np.bincount(end[inside], minlength=total + n) - np.bincount(begin[inside] + n, minlength=total + n)
    i = np.arange(1 - n, total)
    size = np.minimum(total, i + n) - np.maximum(0, i)
    return float((200.0 * (size - np.cumsum(change)[: total + n - 1]) / (n + size)).max())


def strands(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the strands of a's and b's sticky braid that go through b from top to bottom begin and end.

    The longest common subsequence of a with any part of b is the part's length less the strands that stay within it.
    Cells of an antidiagonal don't depend on each other, so each is one step over arrays.
    """
    rows, columns = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") for x in (a[::-1], b))
    m, n = len(rows), len(columns)
    left, top = np.arange(m), np.arange(m, m + n)
    for d in range(m + n - 1):
        low, high = max(0, d - m + 1), min(n, d + 1)
        at = m - 1 - d + low
        h, v = left[at : at + high - low], top[low:high]
        swap = (rows[at : at + high - low] == columns[low:high]) | (h > v)
        h[:], v[:] = np.where(swap, v, h), np.where(swap, h, v)
    end = np.flatnonzero(top >= m)
    return top[end] - m, end


def _vectorised(f):
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = np.empty(len(a))
        for i, pair in enumerate(zip(a.fillna(""), b.fillna(""), strict=True)):
            if pair not in known:
                known[pair] = f(*pair)
            out[i] = known[pair]
        return pd.Series(out)

    over.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(over, "double")


def partial_ratio(a, b):
    return _vectorised(partial)(a, b)
