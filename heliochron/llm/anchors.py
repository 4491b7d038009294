"""Content-defined anchors of byte windows, for texts of a slice at once.

Every window of ``width`` bytes has one anchor: the place of the smallest hash among its runs of ``K``
bytes, the leftmost of equals.  Equal windows have their anchor at the same place and with the same
hash, wherever they stand.  The windows of one anchor start side by side, so a text is a row of spans:
(first start, number of starts, anchor).  About one byte in 35 is an anchor of windows of 100.
"""

from __future__ import annotations

import numpy as np

K = 32
_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_TABLE2 = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE, _BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return v ^ (v >> np.uint64(29))


def run_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the K bytes from each place on (at the last K - 1 places: of no use)."""
    g, m, power = _TABLE[data], 1, int(_BASE)
    while m < K:
        if len(g) > m:
            g[:-m] = g[:-m] * np.uint64(power) + g[m:]
        power, m = power * power % (1 << 64), 2 * m
    return _mix(g)


def leftmost_smallest(h: np.ndarray, width: int) -> np.ndarray:
    """For each place i the distance to the leftmost smallest of h[i : i + width]."""
    at, low, m = np.zeros(len(h), np.uint8), h.copy(), 1

    def fold(low, at, step):
        if step >= len(low):
            return low, at
        later = low[step:] < low[:-step]
        low2, at2 = low.copy(), at.copy()
        np.copyto(low2[:-step], low[step:], where=later)
        np.copyto(at2[:-step], at[step:] + np.uint8(step), where=later)
        return low2, at2
    while 2 * m <= width:
        low, at = fold(low, at, m)
        m *= 2
    if m < width:
        # two overlapping halves; an equal value in the second is not further left than in the first
        low, at = fold(low, at, width - m)
    return at


def spans(data: np.ndarray, ends: np.ndarray, width: int):
    """(text, start, count, anchor hash, content hash) of all spans of the texts that end at ``ends``.

    ``start`` is relative to the text.  The content hash covers all bytes of the span's windows, their
    number and the anchor's place: spans with equal hashes hold the same windows.
    """
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    counts = np.maximum(0, ends - begins - width + 1)
    if not counts.sum():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    h = run_hashes(data)
    at = leftmost_smallest(h, width - K + 1)
    some = np.flatnonzero(counts)
    total = np.cumsum(counts[some])
    starts = np.arange(total[-1]) + np.repeat(begins[some] - (total - counts[some]), counts[some])
    text = np.repeat(some, counts[some])
    anchor = starts + at[starts]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    n = np.diff(np.append(first, len(starts)))
    lo, p, text = starts[first], anchor[first], text[first]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(data) + 1, _BASE2)) * np.uint64(pow(int(_BASE2), -1, 1 << 64))  # BASE2 ** i
        inverse = np.uint64(pow(int(_BASE2), -1, 1 << 64))
        back = np.cumprod(np.full(len(data) + 1, inverse)) * _BASE2
        upto = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE2[data] * powers[:-1])])
        content = (upto[lo + n + width - 1] - upto[lo]) * back[lo]
        content = _mix(content + _mix((n * 1000003 + (p - lo)).astype(np.uint64)))
    return text, lo - begins[text], n, h[p], content
