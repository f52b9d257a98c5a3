"""Order-dependent kernels for two rows, run in batches on stated pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

GAP_OPEN, GAP_EXTEND, MATCH, MISMATCH = 1.53, 0.123, 1.0, -0.5


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


def global_score(a: str, b: str, match: float = MATCH, mismatch: float = MISMATCH, gap_open: float = GAP_OPEN, gap_extend: float = GAP_EXTEND, local: bool = False) -> float:
    """Best alignment score with affine gaps, terminal gaps included; with ``local`` the best of any two substrings.

    A gap of n residues costs ``gap_open + n * gap_extend``. Rows are swept by
    anti-diagonals, so memory is linear in the shorter text.
    """
    x, y = _codes(a), _codes(b)
    if len(x) > len(y):
        x, y = y, x
    n, m = len(x), len(y)
    if not n:
        return 0.0 if local or not m else -(gap_open + m * gap_extend)
    low = -np.inf
    edge = lambda k: 0.0 if local or not k else -(gap_open + k * gap_extend)
    # by row i of x on the anti-diagonal i + j = d; h: best, e and f: ending in a gap
    h2 = np.full(n + 1, low)
    h1 = np.full(n + 1, low)
    e1, f1 = np.full(n + 1, low), np.full(n + 1, low)
    h1[0], best = 0.0, 0.0
    for d in range(1, n + m + 1):
        i = np.arange(max(0, d - m), min(n, d) + 1)
        e, f, h = np.full(n + 1, low), np.full(n + 1, low), np.full(n + 1, low)
        e[i] = np.maximum(h1[i] - gap_open, e1[i]) - gap_extend  # from (i, j - 1)
        up = i[i > 0]
        f[up] = np.maximum(h1[up - 1] - gap_open, f1[up - 1]) - gap_extend
        inner = i[(i > 0) & (i < d)]
        h[i] = np.maximum(e[i], f[i])
        if len(inner):
            s = np.where(x[inner - 1] == y[d - inner - 1], match, mismatch)
            h[inner] = np.maximum(h[inner], h2[inner - 1] + s)
        if i[0] == 0:
            h[0] = edge(d)
        if i[-1] == d:
            h[d] = edge(d)
        if local:
            h[i] = np.maximum(h[i], 0.0)
            best = max(best, float(h[i].max()))
        h2, h1, e1, f1 = h1, h, e, f
    return best if local else float(h1[n])


def chain_distance(a: str, b: str, k: int = 1, signif: int = 5, window: int = 5, gap: int = 3) -> float:
    """k-tuple distance: matches on the densest diagonals, chained into the best path; 0 (alike) to 1.

    Chaining adds k for a match (or the part that does not overlap on its diagonal);
    a change of diagonal costs ``gap``.
    """
    least = min(len(a), len(b))
    if least < k or not least:
        return 1.0
    places: dict[str, list[int]] = {}
    for j in range(len(b) - k + 1):
        places.setdefault(b[j : j + k], []).append(j)
    hits = [(i, j) for i in range(len(a) - k + 1) for j in places.get(a[i : i + k], ())]
    if not hits:
        return 1.0
    pairs = np.array(hits)
    diagonal = pairs[:, 0] - pairs[:, 1]
    values, counts = np.unique(diagonal, return_counts=True)
    top = values[np.lexsort((values, -counts))[:signif]]
    near = (np.abs(diagonal[:, None] - top) <= window).any(axis=1)
    best_at: list[tuple[int, int, int, float]] = []
    best = 0.0
    for i, j in pairs[near].tolist():
        score = float(k)
        for i0, j0, d0, s0 in best_at:
            if d0 == i - j:
                if i0 < i:
                    score = max(score, s0 + min(k, i - i0))
            elif i0 + k <= i and j0 + k <= j:
                score = max(score, s0 - gap + k)
        best_at.append((i, j, i - j, score))
        best = max(best, score)
    return (100 - best / least * 100) / 100


def soft_dtw(x: np.ndarray, y: np.ndarray, gamma: float = 1.0, band: int = 0) -> float:
    """Soft dynamic time warping of two point rows under squared distances, within a band around the diagonal."""
    d = ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)
    n, m = d.shape
    r = np.full((n + 1, m + 1), np.inf)
    r[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if band and abs(i - j) > band:
                continue
            before = -np.array([r[i - 1, j - 1], r[i - 1, j], r[i, j - 1]]) / gamma
            top = before.max()
            if np.isfinite(top):
                r[i, j] = d[i - 1, j - 1] - gamma * (top + np.log(np.exp(before - top).sum()))
    return float(r[n, m])


def soft_symmetric_similarity(x: np.ndarray, y: np.ndarray) -> float:
    """The mean of -L1 over position pairs, weighted by both rows' softmax: a + b - ab."""
    s = -np.abs(x[:, None, :] - y[None, :, :]).sum(axis=2)
    a = np.exp(s - s.max(axis=1, keepdims=True))
    a /= a.sum(axis=1, keepdims=True)
    b = np.exp(s - s.max(axis=0, keepdims=True))
    b /= b.sum(axis=0, keepdims=True)
    w = a + b - a * b
    return float((w * s).sum() / w.sum())


def score_pairs(pairs: DataFrame, kernel, a: str = "seq_a", b: str = "seq_b", out: str = "score") -> DataFrame:
    """``pairs`` plus ``kernel(a, b)``; pairs are dealt over tasks as the table is. A null is an empty row."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name != out), f"`{out}` double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.drop(columns=[out], errors="ignore")
            batch[out] = [kernel("" if x is None else x, "" if y is None else y) for x, y in zip(batch[a], batch[b], strict=True)]
            yield batch

    return pairs.mapInPandas(run, schema)
