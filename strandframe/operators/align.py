"""Local alignment of many pairs at once: all cells of an antidiagonal, of all pairs of a batch, in one numpy step.

No traceback is kept. Each cell carries the identities and columns of the way that a traceback from it would take: a match or
mismatch before a gap in b, that before a gap in a, and a gap opened before one extended. Memory is that of a few antidiagonals.
"""

from __future__ import annotations

import numpy as np

#: Match and mismatch scores of the usual DNA matrix. Fixed values.
MATCH, MISMATCH = 5.0, -4.0
#: Scores are whole numbers of this part of one.
UNIT = 1000
#: Cells of an antidiagonal of a batch, about.
CELLS = 1 << 14
#: Two sequences' paddings, which match nothing.
PAD_A, PAD_B = np.uint32(2**32 - 1), np.uint32(2**32 - 2)
#: Scores beyond this are held in 64 bits, and ways of sequences that have as many letters as NEAR or more together.
SMALL, NEAR = 2**30, 2**15


def padded(texts: list[str], pad: np.uint32) -> np.ndarray:
    rows = [np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) for t in texts]
    out = np.full((len(rows), max(1, *map(len, rows))), pad)
    for row, x in zip(out, rows):
        row[: len(x)] = x
    return out


def align(a: list[str], b: list[str], gap_open: float = 10.0, gap_extend: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identities, columns and score of each pair's best local alignment with affine gaps; of best cells the first by row, then by column, ends it."""
    out = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.zeros(len(a))
    order = sorted(range(len(a)), key=lambda i: (int(4 * np.log2(len(b[i]) + 1)), len(a[i]), len(b[i])))  # rounds of a batch are as many as its longest texts ask for
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(b[order[end]]) <= 2 * len(b[order[at]]) + 64 and (end - at + 1) * (max(len(a[order[end]]), len(a[order[at]])) + 1) <= CELLS:
            end += 1
        own = order[at:end]
        for o, x in zip(out, _batch(padded([a[i] for i in own], PAD_A), padded([b[i] for i in own], PAD_B), gap_open, gap_extend)):
            o[own] = x
        at = end
    return out


def _batch(x: np.ndarray, y: np.ndarray, gap_open: float, gap_extend: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (p, n), m = x.shape, y.shape[1]
    costs = [round(v * UNIT) for v in (MATCH, MISMATCH, gap_open, gap_extend)]
    kind = np.int32 if max(map(abs, costs)) * (min(n, m) + 2) < SMALL else np.int64
    match, mismatch, opened, extended = map(kind, costs)
    low = kind(-SMALL if kind is np.int32 else -(2**62))
    # a way is its identities and, below them, its columns, which are no more than both sequences' letters
    bits, packed = (16, np.int32) if n + m < NEAR else (32, np.int64)
    one, both = packed(1), packed((1 << bits) + 1)
    # cells of one place of an antidiagonal, of all pairs, lie together
    x, back = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T[::-1])
    score = lambda fill: np.full((n + 1, p), fill, kind)
    way = lambda: np.zeros((n + 1, p), packed)
    # best cells of this antidiagonal and the two before, and gaps in a and in b, each with its way; rows that aren't reached yet keep what stands before a sequence
    h, h1, h2, e, f = score(0), score(0), score(0), score(low), score(low)
    hw, hw1, hw2, ew, fw = way(), way(), way(), way(), way()
    top, top_way = score(0), way()
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        own, above = slice(lo, hi + 1), slice(lo - 1, hi)
        new, old = h1[own] - opened, e[own] - extended
        ew[own] = np.where(new >= old, hw1[own], ew[own])
        ew[own] += 1
        np.maximum(new, old, out=e[own])
        new, old = h1[above] - opened, f[above] - extended
        fw[own] = np.where(new >= old, hw1[above], fw[above])
        fw[own] += 1
        np.maximum(new, old, out=f[own])
        same = x[lo - 1 : hi] == back[m - d + lo : m - d + hi + 1]
        straight = h2[above] + np.where(same, match, mismatch)
        best = np.maximum(np.maximum(straight, f[own]), np.maximum(e[own], 0))
        h[own] = best
        via = np.where(straight == best, hw2[above] + np.where(same, both, one), np.where(f[own] == best, fw[own], ew[own]))
        via *= best > 0
        hw[own] = via
        better = best > top[own]
        np.copyto(top[own], best, where=better)
        np.copyto(top_way[own], via, where=better)
        h, h1, h2, hw, hw1, hw2 = h2, h, h1, hw2, hw, hw1
    row = top.argmax(axis=0)
    ends = top_way[row, np.arange(p)]
    return (ends >> bits).astype(np.int64), (ends & ((1 << bits) - 1)).astype(np.int64), top[row, np.arange(p)] / UNIT
