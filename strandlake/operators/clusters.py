"""Centers, assignment, Lloyd steps and bisecting k-means over vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.vectors import squared_distance
from strandlake.operators.components import Forest
from strandlake.storage import materialize

#: Centers are sent to every task, so their number is bounded (a few MB at most).
MAX_CENTERS = 4096
_ROWS_AT_ONCE = 1024


def centers(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, center): component means, summed before the shuffle."""
    each = df.where(F.col(group).isNotNull()).select(group, F.posexplode(F.col(vector)).alias("i", "x"))
    means = each.groupBy(group, "i").agg((F.sum("x") / F.count("x")).alias("m"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("center"))


def collected(table: DataFrame, key: str, vector: str) -> list[tuple[int, list[float]]]:
    """(key, vector) rows of a table of centers on the driver; more than ``MAX_CENTERS`` are refused before they get there."""
    rows = table.limit(MAX_CENTERS + 1).collect()
    if len(rows) > MAX_CENTERS:
        raise ValueError(f"more than {MAX_CENTERS} centers")
    return sorted((r[key], list(r[vector])) for r in rows)


class _Centers:
    def __init__(self, rows: list[tuple[int, list[float]]], digits: int):
        self.keys, self.c, self.digits = np.array([k for k, _ in rows], np.int64), np.array([c for _, c in rows], np.float64), digits
        self.square = (self.c * self.c).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and squared distances: a matrix product finds the candidates, differences decide."""
        rough = (x * x).sum(axis=1)[:, None] - 2 * (x @ self.c.T) + self.square
        i, k = np.nonzero(rough <= rough.min(axis=1, keepdims=True) + 1e-6 * (1 + np.abs(rough).max(axis=1, keepdims=True)))
        d = np.round(((x[i] - self.c[k]) ** 2).sum(axis=1), self.digits)
        order = np.lexsort((self.keys[k], d, i))
        _, first = np.unique(i[order], return_index=True)
        best = order[first]
        return self.keys[k[best]], d[best]


def nearest(df: DataFrame, vector: str, rows: list[tuple[int, list[float]]], digits: int = 9) -> DataFrame:
    """``df`` plus ``cluster`` and ``distance`` of the nearest center by squared distance; ties at ``digits`` go to the least key.

    A null vector, or one of another length, has neither. Columns of those names are replaced.
    """
    if len(rows) > MAX_CENTERS:
        raise ValueError(f"{len(rows)} centers; at most {MAX_CENTERS}")
    shared = df.sparkSession.sparkContext.broadcast(_Centers(rows, digits))
    df = df.drop("cluster", "distance")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS_AT_ONCE):
                batch = whole.slice(at, _ROWS_AT_ONCE)
                vectors = [np.array(v, np.float64) if v is not None else np.empty(0) for v in batch.column(vector).to_pylist()]
                usable = [i for i, v in enumerate(vectors) if len(centers.c) and len(v) == centers.c.shape[1]]
                key, d = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
                if usable:
                    key[usable], d[usable] = centers.nearest(np.stack([vectors[i] for i in usable]))
                absent = np.ones(len(vectors), bool)
                absent[usable] = False
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, mask=absent), pa.array(d, mask=absent)], [*batch.schema.names, "cluster", "distance"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "cluster long, distance double"])
    return df.mapInArrow(run, schema)


def lloyd(df: DataFrame, id_col: str, vector: str, start: list[tuple[int, list[float]]], steps: int = 10, tolerance: float = 1e-4):
    """Assignments (id, cluster, distance) after Lloyd steps from given centers, and the centers.

    An empty cluster keeps its center. Steps end when the sum of shifts, squared, is below ``tolerance``.
    """
    at = sorted(start)
    for _ in range(steps):
        told = nearest(df.select(id_col, vector), vector, at)
        new = {r["cluster"]: list(r["center"]) for r in centers(told, "cluster", vector).collect()}  # one row a center
        moved = [(k, new.get(k, c)) for k, c in at]
        shift = sum(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5 for (_, a), (_, b) in zip(at, moved, strict=True))
        at = moved
        if shift * shift < tolerance:
            break
    return nearest(df.select(id_col, vector), vector, at).drop(vector), at


def _chance(id_col: str, seed: int, start: int, draw: int):
    """A number in (0, 1) that id, seed, start and draw fix: the first 32 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(f"{seed}:{start}:{draw}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def plus_plus(df: DataFrame, id_col: str, vector: str, clusters: int, starts: int = 1, seed: int = 1) -> tuple[list[list[tuple[int, list[float]]]], list[list[float]]]:
    """For each start ``clusters`` rows (id, vector) drawn in proportion to squared distance from those before, and the cost after each draw.

    Each draw is a race of exponential clocks, the least -ln(chance) / weight, so it is one
    aggregate, and all starts share each pass. Null vectors and ids are not drawn, nor are
    rows at distance zero: with fewer distinct vectors there are fewer centers.
    """
    state = materialize(df.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.array(*[F.lit(1.0)] * starts).alias("w")))
    drawn: list[list[tuple[int, list[float]]]] = [[] for _ in range(starts)]
    costs: list[list[float]] = [[] for _ in range(starts)]
    for draw in range(clusters):
        race = [
            F.min(F.when(F.get("w", F.lit(s)) > 0, F.struct((-F.ln(_chance("id", seed, s, draw)) / F.get("w", F.lit(s))).alias("key"), "id", "v"))).alias(f"s{s}")
            for s in range(starts)
        ]
        first = state.agg(*race).first()
        won = [first[f"s{s}"] for s in range(starts)]
        if not any(won):
            break
        for s, one in enumerate(won):
            if one is not None:
                drawn[s].append((one["id"], list(one["v"])))
        near = [
            F.get("w", F.lit(s)) if one is None else (lambda d, s: d if draw == 0 else F.least(d, F.get("w", F.lit(s))))(squared_distance(F.col("v"), F.array(*map(F.lit, one["v"]))), s)
            for s, one in enumerate(won)
        ]
        state = materialize(state.select("id", "v", F.array(*near).alias("w")))
        total = state.agg(*[F.sum(F.get("w", F.lit(s))).alias(f"s{s}") for s in range(starts)]).first()
        for s, one in enumerate(won):
            if one is not None:
                costs[s].append(total[f"s{s}"])
    return drawn, costs


def best_of_starts(df: DataFrame, id_col: str, vector: str, clusters: int, starts: int = 3, seed: int = 1, steps: int = 10, given: list[list[tuple[int, list[float]]]] = ()):
    """As :func:`lloyd`, from the start of least cost after its steps among ``starts`` drawn ones and ``given`` ones; and that cost."""
    drawn, _ = plus_plus(df, id_col, vector, clusters, starts, seed)
    best = None
    for start in [*given, *([(k, v) for k, (_, v) in enumerate(one)] for one in drawn if one)]:
        told, at = lloyd(df, id_col, vector, start, steps)
        cost = told.agg(F.sum("distance")).first()[0]
        if best is None or (cost is not None and cost < best[2]):
            best = told, at, cost
    return best if best is not None else (nearest(df.select(id_col, vector), vector, []).drop(vector), [], None)


def bisecting(df: DataFrame, id_col: str, vector: str, clusters: int, steps: int = 8) -> DataFrame:
    """(id, cluster) by always splitting the largest cluster in two; halves start at its extreme members along a coordinate."""
    told = materialize(df.select(id_col, vector, F.lit(0).cast("long").alias("cluster")))
    for new in range(1, clusters):
        sizes = told.groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").first()
        if sizes is None or sizes["n"] < 2:
            break
        own = told.where(F.col("cluster") == sizes["cluster"])
        spread = own.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.variance("x").alias("v")).orderBy(F.desc(F.round("v", 9)), "i").first()["i"]
        value = F.get(F.col(vector), F.lit(spread))
        ends = own.agg(F.min(F.struct(value, id_col, vector)).alias("a"), F.max(F.struct(value, id_col, vector)).alias("b")).first()
        halves, _ = lloyd(own, id_col, vector, [(0, list(ends["a"][vector])), (1, list(ends["b"][vector]))], steps)
        moved = halves.where("cluster = 1").select(F.col(id_col).alias("__id"))
        told = materialize(
            told.join(moved, told[id_col] == F.col("__id"), "left")
            .select(id_col, vector, F.when(F.col("__id").isNotNull(), F.lit(new).cast("long")).otherwise(F.col("cluster")).alias("cluster"))
        )
    return told.select(id_col, "cluster")


#: Vectors and seeds of a block: a task compares this many of each at once and sends as many rows.
VECTORS_AT_ONCE, SEEDS_AT_ONCE = 1024, 1024
_PAIRS_AT_ONCE = 100_000
#: Blocks of seeds that are broadcast (half a MB each with 64 components); more are joined without.
_BROADCAST_BLOCKS = 64


def block_distances(vectors: DataFrame, seeds: DataFrame, most: float | None = None, joins: bool = False) -> DataFrame:
    """(vec_id, seed, distance): squared distances of all ``vectors`` (vec_id, v) and ``seeds`` (seed, c), up to ``most`` if given.

    All pairs are compared: vectors are cut into blocks and meet each block of seeds in one
    group, so memory is bounded by two blocks whatever the table, and pairs beyond ``most``
    never leave a task. Components are summed in their order. A null vector, a null
    component and vectors of two lengths give a null distance, which is left out under ``most``.
    With ``joins`` and ``most``, each two blocks send only pairs that join what the others of
    them left apart (a spanning forest): enough for components, and no more than they have rows.
    """
    blocks = lambda df, size: max(1, -(-df.count() // size))
    n, k = blocks(vectors, VECTORS_AT_ONCE), blocks(seeds, SEEDS_AT_ONCE)
    packed = lambda df, name, key, x, size: df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(size)).cast("int")).repartition(size, name).groupBy(name).agg(
        F.collect_list(F.struct(F.col(key).alias("id"), F.col(x).alias("x"))).alias(f"held_{name}")  # one block
    )
    asked_blocks = packed(seeds, "sb", "seed", "c", k)
    both = packed(vectors, "vb", "vec_id", "v", n).crossJoin(F.broadcast(asked_blocks) if k <= _BROADCAST_BLOCKS else asked_blocks)

    def side(held: list[dict]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        by: dict[int, tuple[list, list]] = {}
        for h in held:
            x = h["x"]
            size = -1 if x is None or any(c is None for c in x) else len(x)
            ids, xs = by.setdefault(size, ([], []))
            ids.append(h["id"])
            xs.append(x if size >= 0 else [])
        return {size: (np.array(ids, np.int64), np.array(xs, float).reshape(len(ids), max(size, 0))) for size, (ids, xs) in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                own, asked = side(batch.column(0)[r].as_py()), side(batch.column(1)[r].as_py())
                for m, (ids, x) in own.items():
                    for q, (names, c) in asked.items():
                        step = max(1, _PAIRS_AT_ONCE // len(names))
                        tree = Forest(len(ids) + len(names)) if joins else None
                        for at in range(0, len(ids), step):
                            part, some = ids[at : at + step], x[at : at + step]
                            near = np.ones((len(part), len(names)), bool)
                            if m == q and m >= 0:
                                d = np.zeros(near.shape)
                                for i in range(m):
                                    d += (some[:, i, None] - c[None, :, i]) ** 2
                                if most is not None:
                                    near = d <= most
                                told = pa.array(d[near])
                            elif most is not None:
                                continue
                            else:
                                told = pa.nulls(near.size, pa.float64())
                            i, j = np.nonzero(near)
                            if tree is not None:
                                tree.links.clear()
                                tree.add(at + i, len(ids) + j)
                                i, j = (np.array([link[e] for link in tree.links], np.int64) for e in (0, 1))
                                i, j = i - at, j - len(ids)
                                told = pa.array(d[i, j])
                            yield pa.RecordBatch.from_arrays([pa.array(part[i]), pa.array(names[j]), told], ["vec_id", "seed", "distance"])

    return both.select("held_vb", "held_sb").mapInArrow(run, "vec_id long, seed long, distance double")
