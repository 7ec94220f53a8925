"""String similarity kernels that no built-in function expresses, for Arrow UDFs.

All compare code points.  Fixed conventions: two empty strings have a Jaro similarity of 0 and no edit similarity.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    reach = max(reach, 0)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    m = len(left)
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised by the common prefix (at most 4) where it exceeds 0.7."""
    value = jaro(a, b)
    if value <= 0.7:
        return value
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return value + prefix * 0.1 * (1 - value)


def damerau_levenshtein(a: str, b: str) -> int:
    """Edit distance with unrestricted swaps of neighbours."""
    top = len(a) + len(b)
    last: dict[str, int] = {}
    rows = [[top] * (len(b) + 2), [top, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        match, row = 0, [top, i]
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            same = x == y
            if same:
                match = j
            row.append(min(rows[i][j] + (not same), row[j] + 1, rows[i][j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        rows.append(row)
        last[x] = i
    return rows[-1][-1]


def damerau_levenshtein_similarity(a: str, b: str) -> float:
    size = max(len(a), len(b))
    return math.nan if size == 0 else 1 - damerau_levenshtein(a, b) / size


def smith_waterman(a: str, b: str, match: float = 5, mismatch: float = -5, gap_start: float = -5, gap_continue: float = -1, norm: str = "mean") -> float:
    """Best local alignment; a gap goes on being cheap where the neighbour's best score came from that gap too."""
    if match < max(mismatch, gap_start, gap_continue):
        raise ValueError("match must not be below the other scores")
    if not a or not b:
        return 0.0
    width = len(b) + 1
    score, over, best = [0.0] * width, [False] * width, 0.0
    for x in a:
        new, new_over, down = [0.0] * width, [False] * width, False
        for j in range(1, width):
            diagonal = score[j - 1] + (match if x == b[j - 1] else mismatch)
            across = score[j] + (gap_continue if over[j] else gap_start)
            below = new[j - 1] + (gap_continue if down else gap_start)
            s = max(diagonal, across, below)
            if s > 0:
                new[j], new_over[j], down = s, s == across, s == below
                best = max(best, s)
            else:
                down = False
        score, over = new, new_over
    size = {"min": min(len(a), len(b)), "max": max(len(a), len(b))}.get(norm, (len(a) + len(b)) / 2)
    return best / (size * match)


def _common_length(a: str, b: str, shortest: int) -> int:
    """Total length of the longest common substrings, taken out one after the other."""
    total = 0
    while min(len(a), len(b)) >= shortest:
        row, longest, at = [0] * (len(b) + 1), 0, (0, 0)
        for i, x in enumerate(a, 1):
            new = [0] * (len(b) + 1)
            for j, y in enumerate(b, 1):
                if x == y:
                    new[j] = row[j - 1] + 1
                    if new[j] > longest:
                        longest, at = new[j], (i, j)
            row = new
        if longest < shortest:
            break
        total += longest
        a, b = a[: at[0] - longest] + a[at[0] :], b[: at[1] - longest] + b[at[1] :]
    return total


def longest_common_substring(a: str, b: str, norm: str = "dice", shortest: int = 2) -> float:
    """Share of the text in common substrings, averaged over both orders of the arguments."""
    if not a or not b:
        return 0.0

    def scaled(n: int) -> float:
        if norm == "overlap":
            return n / min(len(a), len(b))
        if norm == "jaccard":
            return n / (len(a) + len(b) - n)
        return 2 * n / (len(a) + len(b))

    return (scaled(_common_length(a, b, shortest)) + scaled(_common_length(b, a, shortest))) / 2


# --- many pairs at once -----------------------------------------------------------------------------------------------
# The same results as the functions above, by array operations over the code points of many pairs.  Pairs are
# dealt into chunks of similar length; where a chunk holds only a few long pairs, they go one by one.

_FEW, _CELLS = 16, 1 << 21


def _points(texts: Sequence[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points with one row per text, lengths)."""
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    out = np.full((len(texts), int(size.max(initial=0))), pad, dtype=np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out, size


def _both(a: Sequence[str], b: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x, la = _points(a, 0xFFFFFFFF)
    y, lb = _points(b, 0xFFFFFFFE)  # what fills up one side equals nothing on the other
    return x, la, y, lb


def _jaro_many(a: Sequence[str], b: Sequence[str], winkler: bool = False) -> np.ndarray:
    x, la, y, lb = _both(a, b)
    n, at = len(a), np.arange(y.shape[1])
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
    taken, found = np.zeros(y.shape, dtype=bool), np.zeros(x.shape, dtype=bool)
    for i in range(x.shape[1] if y.shape[1] else 0):
        able = (y == x[:, i, None]) & ~taken & (np.abs(at - i) <= reach)
        hit = able.any(axis=1)
        rows = np.flatnonzero(hit)
        taken[rows, able[rows].argmax(axis=1)] = True
        found[:, i] = hit
    m = found.sum(axis=1)
    swaps = np.bincount(np.repeat(np.arange(n), m), x[found] != y[taken], minlength=n) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(m > 0, (m / la + m / lb + (m - swaps) / m) / 3, 0.0)
    value[(la == lb) & (m == la) & (swaps == 0) & (la > 0)] = 1.0
    if winkler:
        k = min(4, x.shape[1], y.shape[1])
        prefix = np.cumprod(x[:, :k] == y[:, :k], axis=1).sum(axis=1)
        value = np.where(value > 0.7, value + prefix * 0.1 * (1 - value), value)
    return value


def _damerau_many(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    x, la, y, lb = _both(a, b)
    n, rows = len(a), np.arange(len(a))
    h = np.empty((n, x.shape[1] + 2, y.shape[1] + 2), dtype=np.int32)
    h[:, 0, :] = h[:, :, 0] = (la + lb)[:, None]
    h[:, 1, 1:], h[:, 1:, 1] = np.arange(y.shape[1] + 1), np.arange(x.shape[1] + 1)
    last = np.zeros(y.shape, dtype=np.int64)  # the last row with the letter of each column
    for i in range(1, x.shape[1] + 1):
        same = y == x[:, i - 1, None]
        match = np.zeros(n, dtype=np.int64)
        for j in range(1, y.shape[1] + 1):
            k = last[:, j - 1]
            swap = h[rows, k, match] + (i - k) + (j - match - 1)
            s = same[:, j - 1]
            h[:, i + 1, j + 1] = np.minimum(np.minimum(h[:, i, j] + ~s, swap), np.minimum(h[:, i + 1, j], h[:, i, j + 1]) + 1)
            match[s] = j
        last[same] = i
    size = np.maximum(la, lb)
    with np.errstate(invalid="ignore"):
        return np.where(size > 0, 1 - h[rows, la + 1, lb + 1] / np.maximum(size, 1), np.nan)


def _smith_waterman_many(a: Sequence[str], b: Sequence[str], match: float = 5, mismatch: float = -5, gap_start: float = -5, gap_continue: float = -1) -> np.ndarray:
    x, la, y, lb = _both(a, b)
    n = len(a)
    score, over, best = np.zeros((y.shape[1] + 1, n)), np.zeros((y.shape[1] + 1, n), dtype=bool), np.zeros(n)
    for i in range(x.shape[1]):
        gain = np.where((y == x[:, i, None]).T, match, mismatch)
        new, new_over, down = np.zeros_like(score), np.zeros_like(over), np.zeros(n, dtype=bool)
        inside = i < la
        for j in range(1, y.shape[1] + 1):
            diagonal = score[j - 1] + gain[j - 1]
            across = score[j] + np.where(over[j], gap_continue, gap_start)
            below = new[j - 1] + np.where(down, gap_continue, gap_start)
            s = np.maximum(np.maximum(diagonal, across), below)
            up = s > 0
            new[j], new_over[j], down = np.where(up, s, 0.0), up & (s == across), up & (s == below)
            best = np.where(inside & (j <= lb), np.maximum(best, new[j]), best)
        score, over = new, new_over
    return np.where((la > 0) & (lb > 0), best / (np.maximum((la + lb) / 2, 1) * match), 0.0)


def _common_many(a: Sequence[str], b: Sequence[str], shortest: int) -> np.ndarray:
    total, left = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    a, b = list(a), list(b)
    while len(left):
        left = np.array([k for k in left if min(len(a[k]), len(b[k])) >= shortest], dtype=np.int64)
        if not len(left):
            break
        x, la, y, lb = _both([a[k] for k in left], [b[k] for k in left])
        run, longest, end_a, end_b = np.zeros(y.shape, dtype=np.int32), np.zeros(len(left), dtype=np.int64), np.zeros(len(left), dtype=np.int64), np.zeros(len(left), dtype=np.int64)
        for i in range(x.shape[1]):
            run[:, 1:] = run[:, :-1].copy()
            run[:, 0] = 0
            run = np.where(y == x[:, i, None], run + 1, 0)
            j = run.argmax(axis=1)
            top = run[np.arange(len(left)), j]
            more = top > longest
            longest[more], end_a[more], end_b[more] = top[more], i + 1, j[more] + 1
        going = longest >= shortest
        for k, n, i, j in zip(left[going], longest[going], end_a[going], end_b[going]):
            total[k] += n
            a[k], b[k] = a[k][: i - n] + a[k][i:], b[k][: j - n] + b[k][j:]
        left = left[going]
    return total


def _lcs_many(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    size = np.array([len(x) + len(y) for x, y in zip(a, b)])
    some = np.array([bool(x) and bool(y) for x, y in zip(a, b)])
    one, two = _common_many(a, b, 2), _common_many(b, a, 2)
    return np.where(some, (2 * one / np.maximum(size, 1) + 2 * two / np.maximum(size, 1)) / 2, 0.0)


_MANY: dict[Callable, Callable] = {
    jaro: _jaro_many, jaro_winkler: lambda a, b: _jaro_many(a, b, winkler=True), damerau_levenshtein_similarity: _damerau_many, smith_waterman: _smith_waterman_many, longest_common_substring: _lcs_many,
}


def many(kernel: Callable[[str, str], float], pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """The values of a kernel for many pairs."""
    out = np.empty(len(pairs))
    longer = np.array([max(len(a), len(b), 1) for a, b in pairs], dtype=np.int64)
    order = np.argsort(longer, kind="stable")
    batch, start = _MANY.get(kernel), 0
    while start < len(order):
        # at least the next pair, then as many as keep the arrays small and the lengths alike
        room = np.flatnonzero((np.arange(1, len(order) - start + 1) * longer[order[start:]] ** 2 > _CELLS) | (longer[order[start:]] > 2 * longer[order[start]] + 4))
        end = start + max(1, int(room[0]) if len(room) else len(order) - start)
        chosen = order[start:end]
        if batch is None or len(chosen) < _FEW:
            out[chosen] = [kernel(*pairs[k]) for k in chosen]
        else:
            out[chosen] = batch([pairs[k][0] for k in chosen], [pairs[k][1] for k in chosen])
        start = end
    return out


def vectorised(kernel: Callable[[str, str], float]) -> Callable[[pd.Series, pd.Series], pd.Series]:
    """Series of pairs -> Series of values; null where a side is null.  Repeated pairs are computed once per batch."""

    def apply(left: pd.Series, right: pd.Series) -> pd.Series:
        known = (left.notna() & right.notna()).to_numpy()
        out = np.full(len(left), np.nan)
        if known.any():
            codes: dict[tuple[str, str], int] = {}
            at = [codes.setdefault(pair, len(codes)) for pair in zip(left[known], right[known])]
            out[known] = many(kernel, list(codes))[at]
        return pd.Series(out)

    return apply
