"""Trees as edge tables: agglomeration per family, weights, leaves and Newick text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A family's distances are one group; families beyond this are refused, to be cut by clustering first.
MAX_LEAVES = 3000
_EDGES = "family string, step int, a int, b int, node int, len_a double, len_b double, height double"


def agglomerate(d: np.ndarray, linkage: str = "average") -> list[tuple[int, int, int, float, float, float]]:
    """(a, b, node, len_a, len_b, height) of each merge; the closest pair first, ties by the smallest indexes."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, name, height, out = np.ones(n), np.arange(n), np.zeros(n), []
    for step in range(n - 1):
        at = int(np.argmin(d))
        i, j = sorted(divmod(at, n))
        h = d[i, j] / 2
        out.append((int(name[i]), int(name[j]), n + step, h - height[i], h - height[j], h))
        if linkage == "average":
            row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        else:
            row = (np.minimum if linkage == "single" else np.maximum)(d[i], d[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        name[i], height[i] = n + step, h
    return out


def neighbour_join(d: np.ndarray) -> list[tuple[int, int, int, float, float, float]]:
    """Merges of neighbour joining; the last joins the two that are left, at half their distance each."""
    n = len(d)
    d, name, out = d.astype(float).copy(), list(range(n)), []
    for step in range(n - 1):
        m = len(name)
        if m == 2:
            out.append((name[0], name[1], n + step, d[0, 1] / 2, d[0, 1] / 2, 0.0))
            break
        r = d.sum(axis=1)
        q = d - (r[:, None] + r[None, :]) / (m - 2)
        np.fill_diagonal(q, np.inf)
        i, j = sorted(divmod(int(np.argmin(q)), m))
        la = d[i, j] / 2 + (r[i] - r[j]) / (2 * (m - 2))
        out.append((name[i], name[j], n + step, la, d[i, j] - la, 0.0))
        row = (d[i] + d[j] - d[i, j]) / 2
        d[i], d[:, i] = row, row
        d[i, i] = 0
        d = np.delete(np.delete(d, j, 0), j, 1)
        name[i] = n + step
        del name[j]
    return out


def build(distances: DataFrame, method: str = "average") -> DataFrame:
    """Edge table of each family's tree from (family, i, j, dist), leaves numbered from 0.

    Missing pairs count as the family's largest distance.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        n = int(max(group["i"].max(), group["j"].max())) + 1
        if n > MAX_LEAVES:
            raise ValueError(f"a family of {n} leaves; cut it below {MAX_LEAVES} by clustering first")
        d = np.full((n, n), group["dist"].max())
        d[group["i"], group["j"]] = d[group["j"], group["i"]] = group["dist"]
        np.fill_diagonal(d, 0)
        merges = neighbour_join(d) if method == "nj" else agglomerate(d, method)
        out = pd.DataFrame(merges, columns=["a", "b", "node", "len_a", "len_b", "height"])
        out.insert(0, "step", np.arange(len(out)))
        out.insert(0, "family", group["family"].iloc[0])
        return out

    return distances.groupBy("family").applyInPandas(run, _EDGES)


def leaf_weights(edges: DataFrame) -> DataFrame:
    """(family, leaf, weight): along the path to the root, the sum of edge length / leaves below; below 1e-4 it is 1."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("step")
        below: dict[int, list[int]] = {}
        weight: dict[int, float] = {}
        for a, b, node, la, lb in group[["a", "b", "node", "len_a", "len_b"]].itertuples(index=False):
            for child, length in ((a, la), (b, lb)):
                leaves = below.setdefault(child, [child])
                for leaf in leaves:
                    weight[leaf] = weight.get(leaf, 0.0) + length / len(leaves)
            below[node] = below[a] + below[b]
        leaves = sorted(weight)
        return pd.DataFrame({"family": group["family"].iloc[0], "leaf": leaves, "weight": [1.0 if weight[x] < 1e-4 else weight[x] for x in leaves]})

    return edges.groupBy("family").applyInPandas(run, "family string, leaf int, weight double")


def path_lengths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(family, i, j, path, shared): for stated pairs of leaves (family, i, j), the length of the path between them and the height of their join."""

    def run(group: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        up: dict[int, tuple[int, float]] = {}
        height: dict[int, float] = {}
        for a, b, node, la, lb, h in group[["a", "b", "node", "len_a", "len_b", "height"]].itertuples(index=False):
            up[a], up[b], height[node] = (node, la), (node, lb), h

        def above(leaf: int) -> dict[int, float]:
            out, far = {leaf: 0.0}, 0.0
            while leaf in up:
                leaf, length = up[leaf]
                far += length
                out[leaf] = far
            return out

        rows = []
        for family, i, j in asked[["family", "i", "j"]].itertuples(index=False):
            one, other = above(i), above(j)
            meet = next(x for x in one if x in other)  # dicts keep the order of the path
            rows.append((family, i, j, one[meet] + other[meet], height.get(meet, 0.0)))
        return pd.DataFrame(rows, columns=["family", "i", "j", "path", "shared"])

    return edges.groupBy("family").cogroup(pairs.groupBy("family")).applyInPandas(run, "family string, i int, j int, path double, shared double")


def newick(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(family, newick) from an edge table and (family, leaf, name)."""

    def run(key, group: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        text = dict(zip(own["leaf"], own["name"], strict=True))
        root = None
        for a, b, node, la, lb in group.sort_values("step")[["a", "b", "node", "len_a", "len_b"]].itertuples(index=False):
            text[node] = f"({text.pop(a)}:{la:.6f},{text.pop(b)}:{lb:.6f})"
            root = node
        return pd.DataFrame({"family": [key[0]], "newick": [f"{text[root]};" if root is not None else ";".join(text.values()) + ";"]})

    return edges.groupBy("family").cogroup(names.groupBy("family")).applyInPandas(run, "family string, newick string")


def parse_newick(text: str) -> list[tuple[int, int | None, str, float]]:
    """(node, parent, name, length) of each node in the order they open; the root's parent is None."""
    nodes: list[list] = [[None, "", 0.0]]
    here, at, label, in_length = 0, 0, "", False

    def close(k: int) -> None:
        if in_length:
            nodes[k][2] = float(label or 0)
        elif label.strip():
            nodes[k][1] = label.strip()

    while at < len(text):
        c = text[at]
        if c == "(":
            nodes.append([here, "", 0.0])
            here, label = len(nodes) - 1, ""
        elif c in ",);":
            close(here)
            label, in_length = "", False
            if c == ",":
                nodes.append([nodes[here][0], "", 0.0])
                here = len(nodes) - 1
            elif c == ")":
                here = nodes[here][0]
            else:
                break
        elif c == ":":
            close(here)
            label, in_length = "", True
        elif c not in "\r\n\t":
            label += c
        at += 1
    return [(k, up, name, length) for k, (up, name, length) in enumerate(nodes)]


def merge_schedule(edges: DataFrame) -> DataFrame:
    """(family, step, m1, m2): the smallest leaf under each side, 1-based, the smaller first."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        low: dict[int, int] = {}
        rows = []
        for step, a, b, node in group.sort_values("step")[["step", "a", "b", "node"]].itertuples(index=False):
            x, y = sorted((low.get(a, a), low.get(b, b)))
            rows.append((group["family"].iloc[0], step, x + 1, y + 1))
            low[node] = x
        return pd.DataFrame(rows, columns=["family", "step", "m1", "m2"])

    return edges.groupBy("family").applyInPandas(run, "family string, step int, m1 int, m2 int")


def depth_order(edges: DataFrame) -> DataFrame:
    """``edges`` plus the rank of each merge by height within its family."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy("family").orderBy("height", "step")))
