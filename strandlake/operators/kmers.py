"""K-mer multisets, and distances to a bounded reference set that every task gets whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequences import kmers

# The length factor for protein-like rows.
LENGTH_A, LENGTH_B, LENGTH_C, LENGTH_D = 0.01, 10000.0, 10000.0, 0.1


def counts(df: DataFrame, id_col: str, seq: Column, k: int) -> DataFrame:
    """(id, kmer, n): each row's k-mer multiset."""
    return df.select(F.col(id_col).alias("id"), F.explode(kmers(seq, k)).alias("kmer")).groupBy("id", "kmer").agg(F.count("*").alias("n"))


def length_factor(a: Column, b: Column) -> Column:
    short, long = F.least(a, b), F.greatest(a, b)
    return 1.0 / (short / long * LENGTH_D + LENGTH_B / (long + LENGTH_C) + LENGTH_A)


def distance(common: Column, self_a: Column, self_b: Column, len_a: Column, len_b: Column, scale: float = 1.0) -> Column:
    """``scale * (1 - common / min(self)) * f`` with a factor for unequal lengths; ``scale`` if a row has no k-mer."""
    least = F.least(self_a, self_b)
    return F.when(least > 0, F.lit(scale) * (1.0 - common / least) * length_factor(len_a, len_b)).otherwise(F.lit(scale))


def frequencies(df: DataFrame, seq: Column, k: int) -> DataFrame:
    """(kmer, n, n_rows): how often a k-mer occurs and in how many rows, summed before the one shuffle."""
    each = df.select(kmers(seq, k).alias("all")).select(F.explode(F.concat(
        F.transform("all", lambda x: F.struct(x.alias("kmer"), F.lit(1).alias("n"), F.lit(0).alias("rows"))),
        F.transform(F.array_distinct("all"), lambda x: F.struct(x.alias("kmer"), F.lit(0).alias("n"), F.lit(1).alias("rows"))),
    )).alias("x"))
    return each.groupBy("x.kmer").agg(F.sum("x.n").alias("n"), F.sum("x.rows").alias("n_rows"))


#: Letters of all references together that every task may get; larger sets meet by an equi-join on the k-mer.
MAX_REFERENCE_LETTERS = 4_000_000
_MATCH = "ref_id long, distance double, common long, share double"


class References:
    """K-mers of a reference set as numbers: for each distinct one, which references have it and how often."""

    def __init__(self, ids: list[int], seqs: list[str], k: int):
        self.k, self.ids = k, np.array(ids, np.int64)
        points = [np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in seqs]
        self.alphabet = np.unique(np.concatenate(points)) if points else np.empty(0, np.uint32)
        self.base = len(self.alphabet) + 1
        if self.base**k >= 1 << 63:
            raise ValueError(f"{k}-mers over {len(self.alphabet)} letters don't fit in 63 bits")
        each = [np.unique(self.numbers(p), return_counts=True) for p in points]
        self.length = np.array([len(p) for p in points], np.int64)
        number = np.concatenate([u for u, _ in each]) if each else np.empty(0, np.int64)
        order = np.argsort(number, kind="stable")
        self.number, begin = np.unique(number[order], return_index=True)
        self.begin = np.r_[begin, len(order)]
        self.ref = np.repeat(np.arange(len(each)), [len(u) for u, _ in each])[order]
        self.count = (np.concatenate([c for _, c in each]) if each else np.empty(0, np.int64))[order]

    def numbers(self, points: np.ndarray) -> np.ndarray:
        """The number of each k-mer that has only letters of the references, in the order of its last letter."""
        at = np.searchsorted(self.alphabet, points)
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == points if len(self.alphabet) else np.zeros(len(points), bool)
        digit = np.where(known, at + 1, 0).astype(np.int64)
        n = max(0, len(points) - self.k + 1)
        out, ok = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(self.k):
            out = out * self.base + digit[j : j + n]
            ok &= digit[j : j + n] > 0
        return out[ok]

    def common(self, points: np.ndarray) -> np.ndarray:
        """For each reference the sum over k-mers of the smaller of the two counts."""
        number, count = np.unique(self.numbers(points), return_counts=True)
        at = np.searchsorted(self.number, number)
        hit = at < len(self.number)
        hit[hit] = self.number[at[hit]] == number[hit]
        at, count = at[hit], count[hit]
        size = self.begin[at + 1] - self.begin[at]
        entry = np.repeat(self.begin[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.bincount(self.ref[entry], np.minimum(np.repeat(count, size), self.count[entry]), len(self.ids)).astype(np.int64)

    def best(self, seq: str) -> tuple | None:
        """(ref_id, distance, common, share) of the nearest reference that shares a k-mer (ties: the least id); share is the largest part of any reference's k-mers that the row has."""
        points = np.frombuffer(seq.encode("utf-32-le"), np.uint32)
        common = self.common(points)
        some = np.flatnonzero(common)
        if not len(some):
            return None
        a, b = np.int64(len(points)), self.length[some]
        short, long = np.minimum(a, b), np.maximum(a, b)
        factor = 1.0 / (short / long * LENGTH_D + LENGTH_B / (long + LENGTH_C) + LENGTH_A)
        d = np.round((1.0 - common[some] / (short - (self.k - 1))) * factor, 9)
        one = np.lexsort((self.ids[some], d))[0]
        share = (common[some] / (b - (self.k - 1))).max()
        return int(self.ids[some[one]]), float(d[one]), int(common[some[one]]), float(share)


def nearest_references(rows: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """(id, ref_id, distance, common, share) of ``rows`` (id, seq) that share a k-mer with a stated reference set (id, seq).

    One row for each that shares any. References are sent to every task up to
    ``MAX_REFERENCE_LETTERS``; beyond, both sides' multisets meet on the k-mer.
    """
    if (references.agg(F.sum(F.length("seq"))).first()[0] or 0) > MAX_REFERENCE_LETTERS:
        return _joined_references(rows, references, k)
    known = references.where("id is not null and seq is not null").select(F.col("id").cast("long").alias("id"), "seq").collect()
    shared = rows.sparkSession.sparkContext.broadcast(References([r["id"] for r in known], [r["seq"] for r in known], k))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.best(s) if s else None for s in batch.column("seq").to_pylist()]
            hit = pa.array([f is not None for f in found])
            columns = list(zip(*[f for f in found if f is not None], strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").filter(hit), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.int64(), pa.float64()), strict=True))],
                ["id", *(x.split()[0] for x in _MATCH.split(", "))],
            )

    return rows.select("id", "seq").mapInArrow(run, f"id {id_type}, {_MATCH}")


def _joined_references(rows: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """:func:`nearest_references` as equi-joins; both sides are aggregated first, so a k-mer costs one row for each sequence that has it."""
    a = counts(rows, "id", F.col("seq"), k)
    b = counts(references, "id", F.col("seq"), k).toDF("ref_id", "kmer", "m")
    common = a.join(b, "kmer").groupBy("id", "ref_id").agg(F.sum(F.least("n", "m")).alias("common"))

    def size(df: DataFrame, id_: str, total: str, length: str) -> DataFrame:
        n = F.length("seq")
        return df.select(F.col("id").alias(id_), F.greatest(n - (k - 1), F.lit(0)).alias(total), n.alias(length))

    sized = common.join(size(rows, "id", "self_a", "len_a"), "id").join(size(references, "ref_id", "self_b", "len_b"), "ref_id")
    d = F.round(distance(*map(F.col, ("common", "self_a", "self_b", "len_a", "len_b"))), 9)
    best = F.min(F.struct(d.alias("d"), "ref_id", "common")).alias("best")
    return sized.groupBy("id").agg(best, F.max(F.col("common") / F.col("self_b")).alias("share")).select(
        "id", F.col("best.ref_id").cast("long").alias("ref_id"), F.col("best.d").alias("distance"), F.col("best.common").cast("long").alias("common"), "share"
    )
