"""Random rows that keep what a test must not depend on: pair counts, letter shares, whole columns.

``keep_pairs`` gives a row with the same counts of neighbouring letters, the same first and
the same last letter: a walk that uses each pair once. One pair out of every letter is
chosen as the last to be used, such that these lead to the last letter (a random walk
with its loops erased, from each letter in turn); the others are used in random order.
``sampled`` draws rows from the letters of a row, or from the letters that follow each
letter in it. Both are seeded by the row's id, so a task that runs again gives the same
rows.

``resampled_columns`` and ``shuffled_columns`` draw columns of aligned rows, with
replacement or in another order, the same for all rows of a family: a column's place is a
hash of family, seed and number, so tasks agree on it without exchanging it.

Defined results: null rows stay null; rows of fewer than three letters stay as they are
under ``keep_pairs``; rows narrower than their family end in gaps; an empty table stays
empty; other columns pass through.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Letters of widened rows that are sent at once.
_SEND = 4_000_000
#: Rows whose pairs are counted and sent at once.
_AT_ONCE = 500


def _letters(row: str) -> np.ndarray:
    return np.frombuffer(row.encode(), np.uint8) if row.isascii() else np.frombuffer(row.encode("utf-32-le"), np.uint32)


def _text(letters: np.ndarray) -> str:
    return letters.tobytes().decode("ascii") if letters.dtype == np.uint8 else np.asarray(letters, "<u4").tobytes().decode("utf-32-le")


def walk_of_pairs(row: str, rng: np.random.Generator) -> str:
    """A random row with the same pairs of neighbours and the same ends."""
    if len(row) < 3:
        return row
    kinds, code = np.unique(_letters(row), return_inverse=True)
    order = np.argsort(code[:-1], kind="stable")
    after, counts = code[1:][order], np.bincount(code[:-1], minlength=len(kinds))
    first = np.cumsum(counts) - counts
    following = [after[first[v] : first[v] + counts[v]] for v in range(len(kinds))]
    end, leads = int(code[-1]), {int(code[-1])}
    last: dict[int, int] = {}
    for v in range(len(kinds)):  # each letter's way to the end, loops erased
        at = v
        while at not in leads:
            last[at] = int(rng.integers(len(following[at])))
            at = int(following[at][last[at]])
        at = v
        while at not in leads:
            leads.add(at)
            at = int(following[at][last[at]])
    for v, own in enumerate(following):
        final = [int(own[last[v]])] if v != end else []
        rest = rng.permutation(np.delete(own, last[v]) if v != end else own)
        following[v] = final + rest.tolist()  # used from the back
    out, at = [int(code[0])], int(code[0])
    for _ in range(len(row) - 1):
        at = following[at].pop()
        out.append(at)
    return _text(kinds[out])


def sampled_row(row: str, rng: np.random.Generator, order: int) -> str:
    """A random row of the same length: letters drawn from the row's (order 0), or from those that follow the one before (order 1).

    After a letter that nothing follows comes any of the row's.
    """
    if not row:
        return row
    x = _letters(row)
    if order == 0:
        return _text(x[rng.integers(0, len(x), len(x))])
    kinds, code = np.unique(x, return_inverse=True)
    by = np.argsort(code[:-1], kind="stable")
    after, counts = code[1:][by], np.bincount(code[:-1], minlength=len(kinds))
    first, u, out, at = np.cumsum(counts) - counts, rng.random(len(x)), [int(code[0])], int(code[0])
    for k in range(1, len(x)):
        at = int(after[first[at] + int(u[k] * counts[at])]) if counts[at] else int(code[int(u[k] * len(code))])
        out.append(at)
    return _text(kinds[out])


def _each_row(rows: DataFrame, id_col: str, seq_col: str, seed: int, change: Callable[[str, np.random.Generator], str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [None if s is None else change(s, np.random.default_rng(zlib.crc32(f"{seed}:{i}".encode()))) for i, s in zip(batch[id_col], batch[seq_col], strict=True)]
            yield batch.assign(**{seq_col: pd.Series(out, dtype=object, index=batch.index)})

    return rows.mapInPandas(run, rows.schema)


def pair_counts(rows: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """(id_col, pairs) of rows: how often each pair of neighbouring letters stands in a row, as structs (pair, n) in order of letters.

    A row's own pairs are counted where the row is, so nothing is shuffled. Null and shorter rows have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _AT_ONCE):
                part = batch.slice(at, _AT_ONCE)
                found = []
                for row in part.column(1).to_pylist():
                    x = _letters(row or "").astype(np.int64)
                    found.append(np.unique((x[:-1] << 21) | x[1:], return_counts=True))
                key, n = (np.concatenate(side) for side in zip(*found, strict=True))
                spelled = np.stack([key >> 21, key & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
                pairs = pa.StructArray.from_arrays([pa.array([spelled[i : i + 2] for i in range(0, len(spelled), 2)], pa.string()), pa.array(n.astype(np.int64))], ["pair", "n"])
                ends = np.r_[0, np.cumsum([len(k) for k, _ in found])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], [id_col, "pairs"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, seq_col).mapInArrow(run, f"`{id_col}` {kind}, pairs array<struct<pair: string, n: long>>")


def keep_pairs(rows: DataFrame, id_col: str, seq_col: str, seed: int = 1) -> DataFrame:
    """``rows`` with each row in a random order that keeps its pair counts and its ends."""
    return _each_row(rows, id_col, seq_col, seed, walk_of_pairs)


def sampled(rows: DataFrame, id_col: str, seq_col: str, order: int = 1, seed: int = 1) -> DataFrame:
    """``rows`` with each row drawn anew from its own letters or pairs."""
    return _each_row(rows, id_col, seq_col, seed, lambda s, rng: sampled_row(s, rng, order))


def column_keys(family: object, seed: int, width: int) -> np.ndarray:
    """A 32-bit hash of each column's number, seeded by family and seed."""
    mask, factor = np.uint64(0xFFFFFFFF), np.uint64(73244475)
    start = int(hashlib.md5(f"{family}:{seed}".encode()).hexdigest()[:8], 16)
    h = (np.uint64(start) + np.arange(width, dtype=np.uint64) * np.uint64(2654435761)) & mask
    for _ in range(2):
        h = ((h ^ (h >> np.uint64(16))) * factor) & mask
    return h ^ (h >> np.uint64(16))


def _columns(rows: DataFrame, seed: int, places: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    widths = rows.groupBy(F.col("family").alias("__f")).agg(F.max(F.length("aseq")).alias("__w"))
    wide = rows.join(widths, rows["family"].eqNullSafe(F.col("__f"))).drop("__f")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: tuple = (None, None)
        for batch in batches:
            out, sent, held = [], 0, 0
            for family, width, row in zip(batch["family"], batch["__w"], batch["aseq"], strict=True):
                if row is not None:
                    if known[0] != (family, width):
                        known = (family, width), places(column_keys(family, seed, int(width)))
                    x = _letters(row)
                    filled = np.full(int(width), ord("-"), x.dtype)
                    filled[: len(x)] = x
                    row = _text(filled[known[1]])
                    held += int(width)
                out.append(row)
                if held > _SEND:  # rows are as wide as their family's widest: a batch of them has no bound
                    part = batch.iloc[sent : sent + len(out)].drop(columns="__w")
                    yield part.assign(aseq=pd.Series(out, dtype=object, index=part.index))
                    out, sent, held = [], sent + len(out), 0
            part = batch.iloc[sent:].drop(columns="__w")
            yield part.assign(aseq=pd.Series(out, dtype=object, index=part.index))

    return wide.mapInPandas(run, rows.schema)


def resampled_columns(rows: DataFrame, seed: int = 1) -> DataFrame:
    """Rows (family, name, aseq) of as many columns of their family, drawn with replacement."""
    return _columns(rows, seed, lambda h: (h % np.uint64(max(1, len(h)))).astype(np.int64))


def shuffled_columns(rows: DataFrame, seed: int = 1) -> DataFrame:
    """Rows (family, name, aseq) with the columns of their family in another order."""
    return _columns(rows, seed, lambda h: np.argsort(h, kind="stable"))
