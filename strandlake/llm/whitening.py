"""Embedding whitening from an exact integer scatter.

Each entry c becomes the integer floor(64 c) + 1000000. The fit list holds each distinct
integer vector once: vectors are packed into bytes, so equal ones meet as equal keys and
repeats go before the shuffle. Over it, with the constant shift taken off,

* tasks add up sums S and cross-products XtX as integers of any size (blocks whose products
  fit 53 bits go through one matrix product, larger ones through Python integers) and send
  them in limbs of ``LIMB`` bits, which Spark adds as longs after a map-side sum;
* the driver puts the limbs together and forms n XtX - S St exactly; only its quotient by
  n squared is rounded, and ``eigh`` decomposes that covariance. What reaches the driver is
  one number of a few limbs for each two dimensions, whatever the number of rows.

Rows are then projected: n x - S is exact, its quotient by n the centred vector. A last
pass over the fit list measures what is left between the covariance of the whitened
vectors and the identity.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped;
an empty vector gives no rows; vectors of different lengths are whitened apart, each length
with its own fit list; entries with 64 c beyond ``FARTHEST`` end there; repeated rows each
give their rows, a null id stays null; a component without variance (one vector, repeated
columns) has ``whitened`` null and is left out of ``identity_error``; with no variance at
all ``explained`` is null, and so is ``identity_error`` without any component; a
``deviation`` beyond the long range is null; an empty table gives an empty table. Columns
beside id and vector don't pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.textblocks import lean
from strandlake.storage import materialize, spread

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
LIMB = 30
#: Vectors are worked on in blocks of about this many entries.
_ENTRIES = 1 << 18
FARTHEST = 1 << 62


def quantized(c: np.ndarray) -> np.ndarray:
    """floor(64 c) of finite doubles, the shift left out."""
    return np.clip(np.floor(c * SCALE), -FARTHEST, FARTHEST).astype(np.int64)


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their quantized vectors), a pair for each length, of the rows whose entries are all finite."""
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten()
    entries = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    first = np.cumsum(lengths) - lengths
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        for at in range(0, len(rows), max(1, _ENTRIES // d)):
            some = rows[at : at + max(1, _ENTRIES // d)]
            block = entries[first[some][:, None] + np.arange(d)]
            fine = np.isfinite(block).all(axis=1)
            if fine.any():
                yield some[fine], quantized(block[fine])


def packed(y: np.ndarray) -> list[bytes]:
    """Each vector in the narrowest integers that hold it; equal vectors alone have equal bytes (and lengths)."""
    top = np.maximum(y.max(axis=1), ~y.min(axis=1))
    out = []
    for row, most in zip(y, top.tolist(), strict=True):
        width = 1 if most < 1 << 7 else 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
        out.append(row.astype(f"<i{width}").tobytes())
    return out


def unpacked(d: int, blobs: list[bytes]) -> np.ndarray:
    """The vectors of d entries that :func:`packed` packed, the widths in any order."""
    parts = [np.frombuffer(b"".join(some), f"<i{w}").astype(np.int64) for w in (1, 2, 4, 8) if (some := [b for b in blobs if len(b) == w * d])]
    return np.concatenate(parts).reshape(-1, d) if parts else np.empty((0, d), np.int64)


def fit_list(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(d, x): each distinct quantized vector once, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, y in _vectors(batch.column(0)):
                yield pa.RecordBatch.from_pydict({"d": pa.array(np.full(len(y), y.shape[1], np.int32)), "x": pa.array(packed(y), pa.binary())})

    return vectors.select(F.col(vec_col)).mapInArrow(lean(run), "d int, x binary").distinct()


class Scatter:
    """Sums and cross-products of integer vectors, as integers of any size."""

    def __init__(self, d: int):
        self.n = 0
        self.sums = np.zeros(d, object)
        self.cross = np.zeros((d, d), object)

    def add(self, y: np.ndarray) -> None:
        self.n += len(y)
        most = max(int(y.max()), -int(y.min()), 1)
        rows = (1 << 53) // (most * most)  # so many products have an exact sum in doubles
        if not rows:
            big = y.astype(object)
            self.sums = self.sums + big.sum(axis=0)
            self.cross = self.cross + big.T.dot(big)
            return
        for at in range(0, len(y), rows):
            part = y[at : at + rows].astype(np.float64)
            self.sums = self.sums + part.sum(axis=0).astype(np.int64).astype(object)
            self.cross = self.cross + (part.T @ part).astype(np.int64).astype(object)

    def limbs(self) -> Iterator[tuple[int, int, int, int]]:
        """(i, j, limb, part): n at (-1, -1), sums at (i, -1), products at (i, j) for i <= j."""
        values = [(-1, -1, self.n), *((i, -1, s) for i, s in enumerate(self.sums))]
        values += [(i, j, self.cross[i, j]) for i in range(len(self.sums)) for j in range(i, len(self.sums))]
        for i, j, value in values:
            sign, value, k = (-1 if value < 0 else 1), abs(int(value)), 0
            while value:
                yield i, j, k, sign * (value & ((1 << LIMB) - 1))
                value, k = value >> LIMB, k + 1


def scatter(fitted: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """(n, S, n XtX - S St) for each length, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Scatter] = {}
        for batch in batches:
            lengths = batch.column("d").to_numpy()
            for d in np.unique(lengths).tolist():
                blobs = batch.column("x").filter(pa.array(lengths == d)).to_pylist()
                for at in range(0, len(blobs), max(1, _ENTRIES // d)):
                    found.setdefault(d, Scatter(d)).add(unpacked(d, blobs[at : at + max(1, _ENTRIES // d)]))
        for d, one in found.items():
            rows = [(d, *x) for x in one.limbs()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int32()] * 4 + [pa.int64()], strict=True)], ["d", "i", "j", "k", "part"])

    limbs = fitted.mapInArrow(lean(run), "d int, i int, j int, k int, part long").groupBy("d", "i", "j", "k").agg(F.sum("part").alias("part"))
    totals: dict[int, dict[tuple[int, int], int]] = {}
    for d, i, j, k, part in limbs.toLocalIterator():
        of_d = totals.setdefault(d, {})
        of_d[i, j] = of_d.get((i, j), 0) + (part << (LIMB * k))
    out = {}
    for d, v in totals.items():
        n, sums = v[-1, -1], np.array([v.get((i, -1), 0) for i in range(d)], object)
        cross = np.array([[v.get((min(i, j), max(i, j)), 0) for j in range(d)] for i in range(d)], object).reshape(d, d)
        out[d] = n, sums, n * cross - np.outer(sums, sums)
    return out


class Model:
    """Means and components of one length. ``axes`` has a column for each component, already over its square root of variance."""

    def __init__(self, n: int, sums: np.ndarray, centred: np.ndarray, components: int = COMPONENTS):
        self.n, self.sums = n, sums
        exact = np.vectorize(lambda a: a / (n * n), otypes=[float])(centred)  # integer quotients are rounded once
        e, u = np.linalg.eigh(exact)
        e, u = e[::-1][:components], u[:, ::-1][:, :components]
        trace = sum(centred[i, i] for i in range(len(sums))) / (n * n)
        self.varies = e > max(e.max(initial=0), 0) * len(sums) * np.finfo(float).eps
        self.axes = np.divide(u, np.sqrt(np.where(self.varies, e, 1)), where=self.varies, out=np.zeros_like(u))
        self.explained = np.where(self.varies, e, 0) / trace if trace else np.full(len(e), np.nan)
        self.identity_error = np.nan

    def project(self, y: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Whitened vectors and deviations of quantized ones."""
        most = max(int(y.max()), -int(y.min()), *(abs(int(s)) // self.n + 1 for s in self.sums))
        if 4 * self.n * self.n * most * most * y.shape[1] < 1 << 63:
            off = self.n * y - self.sums.astype(np.int64)
            deviation = (off * off).sum(axis=1).tolist()
            centred = off / self.n
        else:
            off = self.n * y.astype(object) - self.sums
            deviation = [x if x < 1 << 63 else None for x in (off * off).sum(axis=1).tolist()]
            centred = np.vectorize(lambda a: a / self.n, otypes=[float])(off)
        return centred @ self.axes, deviation


def _measured(fitted: DataFrame, models: dict[int, Model]) -> None:
    """Fill in how far the covariance of whitened vectors is from the identity, in two passes over the fit list."""
    means: dict[int, np.ndarray] = {}

    def adding(of_block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                lengths = batch.column("d").to_numpy()
                for d in np.unique(lengths).tolist():
                    blobs = batch.column("x").filter(pa.array(lengths == d)).to_pylist()
                    for at in range(0, len(blobs), max(1, _ENTRIES // d)):
                        part = of_block(d, models[d].project(unpacked(d, blobs[at : at + max(1, _ENTRIES // d)]))[0])
                        found[d] = found[d] + part if d in found else part
            for d, total in found.items():
                yield pa.RecordBatch.from_pydict({"d": pa.array(np.full(total.size, d, np.int32)), "k": pa.array(np.arange(total.size, dtype=np.int32)), "v": pa.array(total.ravel())})

        rows = fitted.mapInArrow(lean(run), "d int, k int, v double").groupBy("d", "k").agg(F.sum("v").alias("v")).collect()
        out = {d: np.zeros(max(r["k"] for r in rows if r["d"] == d) + 1) for d in {r["d"] for r in rows}}
        for r in rows:
            out[r["d"]][r["k"]] = r["v"]
        return out

    for d, total in adding(lambda d, w: w.sum(axis=0)).items():
        means[d] = total / models[d].n
    for d, total in adding(lambda d, w: (w - means[d]).T @ (w - means[d])).items():
        one, k = models[d], len(means[d])
        off = np.abs(total.reshape(k, k) / one.n - np.eye(k))[np.ix_(one.varies, one.varies)]
        one.identity_error = float(off.max()) if off.size else np.nan


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of the vectors."""
    fitted = materialize(fit_list(vectors, vec_col))
    models = {d: Model(*x, components) for d, x in scatter(fitted).items()}
    _measured(fitted, models)
    return models


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component."""
    vectors = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    models = fit(vectors, "v", components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, y in _vectors(batch.column("v")):
                one = models[y.shape[1]]
                w, deviation = one.project(y)
                k = len(one.varies)
                flat = np.where(one.varies, w, np.nan).ravel()
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column("vec_id").take(pa.array(np.repeat(rows, k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    "n": pa.array(np.full(len(flat), one.n, np.int64)),
                    "deviation": pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k))),
                    "whitened": pa.array(flat, mask=np.isnan(flat)),
                    "explained": pa.array(np.tile(one.explained, len(rows)), mask=np.isnan(np.tile(one.explained, len(rows)))),
                    "identity_error": pa.array(np.full(len(flat), one.identity_error), mask=np.full(len(flat), np.isnan(one.identity_error))),
                })

    return vectors.mapInArrow(lean(run), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")))
