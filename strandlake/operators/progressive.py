"""Progressive alignment of families, merge by merge along their trees.

A family is one group, so its rows are bounded by ``MAX_ROWS``: larger ones are cut
by clustering first. Inside a group the kernel is a profile against profile
alignment with affine gaps; what is distributed is the set of families.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strandlake.operators.trees import agglomerate

MAX_ROWS = 400
GAP_OPEN, GAP_EXTEND, MATCH, MISMATCH = 1.53, 0.123, 1.0, -0.5
GAP = "-"


def kmer_distances(rows: list[str], k: int = 3) -> np.ndarray:
    """1 - shared k-mers / the smaller number of k-mers, for all pairs of a bounded family."""
    counts = [Counter(s[i : i + k] for i in range(len(s) - k + 1)) for s in rows]
    d = np.zeros((len(rows), len(rows)))
    for i, a in enumerate(counts):
        for j in range(i):
            least = min(a.total(), counts[j].total())
            d[i, j] = d[j, i] = 1 - (a & counts[j]).total() / least if least else 1.0
    return d


class Profile:
    """Aligned rows of one subtree with the composition of their columns."""

    def __init__(self, rows: list[list[str]], alphabet: dict[str, int]):
        self.rows, self.alphabet = rows, alphabet
        n = len(rows[0]) if rows else 0
        self.share = np.zeros((n, len(alphabet)))
        for row in rows:
            for pos, c in enumerate(row):
                if c != GAP:
                    self.share[pos, alphabet[c]] += 1 / len(rows)

    def with_gaps(self, columns: list[int]) -> list[list[str]]:
        """Rows with column ``c`` for each entry, or a gap where it is -1."""
        return [[row[c] if c >= 0 else GAP for c in columns] for row in self.rows]


def merge(a: Profile, b: Profile) -> Profile:
    """The best global alignment of two profiles; on ties columns are matched, then gaps stand in ``b``."""
    n, m = len(a.share), len(b.share)
    fill_a, fill_b = a.share.sum(axis=1), b.share.sum(axis=1)
    score = MISMATCH * np.outer(fill_a, fill_b) + (MATCH - MISMATCH) * (a.share @ b.share.T)
    low = -np.inf
    h = np.full((n + 1, m + 1), low)
    e, f = h.copy(), h.copy()  # a gap in a, a gap in b
    h[0, 0] = 0
    back = np.zeros((3, n + 1, m + 1), np.int8)
    for j in range(1, m + 1):
        e[0, j] = -(GAP_OPEN + j * GAP_EXTEND)
        h[0, j], back[0, 0, j], back[1, 0, j] = e[0, j], 1, j > 1
    for i in range(1, n + 1):
        f[i] = np.maximum(h[i - 1] - GAP_OPEN, f[i - 1]) - GAP_EXTEND
        back[2, i] = f[i - 1] > h[i - 1] - GAP_OPEN
        h[i, 0], back[0, i, 0] = f[i, 0], 2
        for j in range(1, m + 1):
            open_, more = h[i, j - 1] - GAP_OPEN, e[i, j - 1]
            e[i, j] = max(open_, more) - GAP_EXTEND
            back[1, i, j] = more > open_
            best, way = h[i - 1, j - 1] + score[i - 1, j - 1], 0
            if f[i, j] > best:
                best, way = f[i, j], 2
            if e[i, j] > best:
                best, way = e[i, j], 1
            h[i, j], back[0, i, j] = best, way
    i, j, state, from_a, from_b = n, m, 0, [], []
    while i or j:
        if state == 0:
            state = int(back[0, i, j])
            if state == 0:
                i, j = i - 1, j - 1
                from_a.append(i)
                from_b.append(j)
        elif state == 1:
            state = 1 if back[1, i, j] else 0
            j -= 1
            from_a.append(-1)
            from_b.append(j)
        else:
            state = 2 if back[2, i, j] else 0
            i -= 1
            from_a.append(i)
            from_b.append(-1)
    rows = a.with_gaps(from_a[::-1]) + b.with_gaps(from_b[::-1])
    return Profile(rows, a.alphabet)


def align_rows(rows: list[str]) -> list[str]:
    """The rows of one family, aligned along the average-linkage tree of their k-mer distances."""
    if len(rows) < 2:
        return list(rows)
    alphabet = {c: k for k, c in enumerate(sorted(set("".join(rows))))}
    at = {i: (Profile([list(s)], alphabet), [i]) for i, s in enumerate(rows)}
    for a, b, node, *_ in agglomerate(kmer_distances(rows)):
        (pa, ia), (pb, ib) = at.pop(a), at.pop(b)
        at[node] = merge(pa, pb), ia + ib
    ((profile, order),) = at.values()
    return ["".join(profile.rows[order.index(i)]) for i in range(len(rows))]


def align_families(rows: DataFrame) -> DataFrame:
    """(family, name, aseq) from (family, name, seq). Null rows are empty; gaps in the input are residues to nobody and dropped."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) > MAX_ROWS:
            raise ValueError(f"a family of {len(group)} rows; cut it below {MAX_ROWS} by clustering first")
        group = group.sort_values(["name", "seq"])
        aligned = align_rows([(s or "").replace(GAP, "") for s in group["seq"]])
        return pd.DataFrame({"family": group["family"].to_numpy(), "name": group["name"].to_numpy(), "aseq": aligned})

    schema = ", ".join(f"{n} {rows.schema[c].dataType.simpleString()}" for n, c in (("family", "family"), ("name", "name"))) + ", aseq string"
    return rows.groupBy("family").applyInPandas(run, schema)
