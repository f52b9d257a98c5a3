"""Connected components of an edge table, as rounds of joins and partial minima.

Each round every label with a lower neighbour is hooked to the least one, hooks are
followed to their ends by pointer jumping, and links are redrawn between the labels
that are left, until no link is left. A label that outlives two rounds has taken in
all its neighbours of the first, so two rounds halve the labels of a component at
least, and jumps double: both are logarithmic and need no cap. Minima are
pre-aggregated before each shuffle. Labels then meet links in joins, where the label
of a giant component is one key: adaptive execution splits such a join side, as the
table of labels has one row for each. Each
round is written to the shared folder; nothing is collected but whether it moved.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.storage import materialize


class Forest:
    """Union-find over positions; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def _roots(self, x: np.ndarray) -> np.ndarray:
        up = self.up
        while True:
            y = up[x]
            if (y == x).all():
                return x
            x = y

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hook the larger root of each link under the smaller, round by round."""
        while len(a):
            ra, rb = self._roots(a), self._roots(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            _, one = np.unique(high, return_index=True)
            self.up[high[one]] = low[one]
            self.links += zip(a[one].tolist(), b[one].tolist(), strict=True)
            self.up[high[one]] = self._roots(low[one])


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct (low, high) of links (a, b), without loops."""
    return links.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()


def _rooted(hooks: DataFrame) -> DataFrame:
    """(label, root) of hooks (label, root): each followed to its end. Roots are lower than labels, so it has one."""
    while True:
        above = hooks.select(F.col("label").alias("root"), F.col("root").alias("above"))
        after = materialize(
            hooks.join(above, "root", "left").select("label", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        )
        hooks = after.select("label", "root")
        if after.where("moved").isEmpty():
            return hooks


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); component is the least node reachable.

    Repeated edges, loops and both directions are fine; null ends are ignored. An
    empty table gives an empty table.
    """
    links = materialize(_ordered(edges.select("a", "b").dropna()))
    nodes = links.select(F.explode(F.array("low", "high")).alias("node")).distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("label")))
    while not links.isEmpty():
        up = _rooted(materialize(links.groupBy(F.col("high").alias("label")).agg(F.min("low").alias("root"))))
        labels = materialize(labels.join(up, "label", "left").select("node", F.coalesce("root", "label").alias("label")))
        low, high = up.toDF("low", "low_root"), up.toDF("high", "high_root")
        moved = links.join(high, "high").join(low, "low", "left")  # every high has a lower neighbour, so a root
        links = materialize(_ordered(moved.select(F.coalesce("low_root", "low").alias("a"), F.col("high_root").alias("b"))))
    return labels.withColumnRenamed("label", "component")
