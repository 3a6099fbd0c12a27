"""Suffix arrays of many short sequences at once, in numpy."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def dense(values: np.ndarray) -> np.ndarray:
    """Order-preserving ranks from 0 without gaps."""
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def _order(key: np.ndarray) -> np.ndarray:
    """Stable argsort of non-negative keys; a packed sort where key and position fit one word."""
    n = len(key)
    low = max(1, int(n - 1).bit_length())
    if n and int(key.max()).bit_length() + low <= 64:
        packed = (key.astype(U64) << U64(low)) | np.arange(n, dtype=U64)
        packed.sort()
        return (packed & U64((1 << low) - 1)).astype(np.int64)
    return np.argsort(key, kind="stable")


def suffix_array(symbols: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP array of each row's symbols, by prefix doubling.

    symbols: ranks from 0; rows: ascending row number of each symbol. Suffixes of one row stand together and never look
    past its end. lcp[r] is the longest common prefix of the suffixes at r-1 and r; it is 0 across rows.
    """
    n = len(symbols)
    if not n:
        e = np.empty(0, np.int64)
        return e, e
    last = np.searchsorted(rows, rows, "right")
    width = int(symbols.max()) + 1
    levels = []
    key = rows.astype(np.int64) * width + symbols
    span = 1
    while True:
        order = _order(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], (ordered[1:] != ordered[:-1]).astype(np.int64))))
        levels.append(rank)
        if rank[order[-1]] == n - 1:
            break
        reach = np.arange(n) + span
        inside = reach < last
        key = rank * (n + 1)
        key[inside] += rank[reach[inside]] + 1
        span *= 2
    lcp = np.zeros(n, np.int64)
    a, b, live = order[:-1].copy(), order[1:].copy(), np.arange(n - 1)
    level = len(levels) - 2
    # two equal ranks at a level mean equal symbols over its span, or two row ends within it, which distinct suffixes of one row exclude
    while level >= 0:
        ok = (a < last[order[:-1]][live]) & (b < last[order[1:]][live])
        ok[ok] = levels[level][a[ok]] == levels[level][b[ok]]
        step = 1 << level
        lcp[live[ok] + 1] += step
        a[ok] += step
        b[ok] += step
        level -= 1
    return order, lcp


def repeat_lengths(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each position the length of its innermost LCP interval: the longest substring from there that occurs again."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(lcp, np.concatenate((lcp[1:], [0])))
    return out


def maximal_repeats(symbols: np.ndarray, least: int) -> list[tuple[int, list[int]]]:
    """(length, starts) of every maximal repeated substring of one sequence: an LCP interval that is left-diverse."""
    order, lcp = suffix_array(dense(symbols), np.zeros(len(symbols), np.int64))
    found: list[tuple[int, list[int]]] = []
    stack: list[list[int]] = []  # lcp, left bound
    for i in range(1, len(order) + 1):
        now, left = (int(lcp[i]) if i < len(order) else 0), i - 1
        while stack and stack[-1][0] > now:
            length, left = stack.pop()
            if length >= least:
                starts = sorted(int(p) for p in order[left:i])
                before = {int(symbols[p - 1]) if p else None for p in starts}
                if len(before) > 1 or None in before:
                    found.append((length, starts))
        if now and (not stack or stack[-1][0] < now):
            stack.append([now, left])
    return sorted(found, key=lambda x: (-x[0], x[1]))


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """True where the union of [start, start + length) lies."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:n]) > 0
