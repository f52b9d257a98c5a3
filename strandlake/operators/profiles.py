"""Weighted profiles of aligned rows: match, insert and delete states and the steps between them.

A column is a match column if more than half of its family's rows have a residue there. In
a match column a row is in state M with a residue and D without one; residues between two
match columns are inserts, state I. The steps of a row are counted with its weight at the
match column they start from (inserts at the one before them); what a row holds before the
first match column isn't counted, and nothing follows the last.

Match columns come from packed column counts; rows are walked in tasks, which send sums for
each column and kind of step. Effective numbers are exponentials of the entropy of a
column's weighted residues.

Defined results: a null row counts as one that has ended at its start; rows that end before
their family's match columns are in state D there; a null weight is 1; a family without a
match column has no rows here; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.alignments import _GAP_CODES, _cells_of, _letters, block_counts
from strandlake.storage import materialize

STEPS = ["MM", "MD", "MI", "DM", "DD", "DI", "IM", "ID", "II"]


def match_columns(rows: DataFrame) -> DataFrame:
    """(family, cols): the match columns of each family (family, aseq), in order."""
    sizes = rows.groupBy(F.col("family").alias("__f")).agg(F.count("*").alias("rows"))
    solid = _cells_of(block_counts(rows, gaps=False)).groupBy("family", "pos").agg(F.sum("n").alias("n"))
    some = solid.join(sizes, F.col("family").eqNullSafe(F.col("__f"))).where(2 * F.col("n") > F.col("rows"))
    return some.groupBy("family").agg(F.array_sort(F.collect_list("pos")).alias("cols"))


def steps_of(row: str | None, cols: np.ndarray) -> np.ndarray:
    """How often a row takes each of ``STEPS`` from each match column."""
    x = _letters(row)
    solid = ~np.isin(x, _GAP_CODES)
    residues = np.r_[0, np.cumsum(solid)]
    at = np.minimum(cols, len(x))
    match = np.zeros(len(cols), bool)
    match[cols < len(x)] = solid[cols[cols < len(x)]]
    until = np.r_[at[1:], len(x)]
    inserts = residues[np.maximum(until, at)] - residues[np.minimum(at + 1, len(x))]
    inserts = np.maximum(inserts, 0)
    out, here, k = np.zeros((len(cols), 9)), np.where(match, 0, 3), np.arange(len(cols))
    after = np.where(match[1:], 0, 1)
    plain = inserts == 0
    steps = plain[:-1]
    np.add.at(out, (k[:-1][steps], (here[:-1] + after)[steps]), 1)
    np.add.at(out, (k[~plain], here[~plain] + 2), 1)
    out[:, 8] += np.maximum(inserts - 1, 0)
    back = ~plain[:-1]
    np.add.at(out, (k[:-1][back], 6 + after[back]), 1)
    return out


def transitions(rows: DataFrame) -> DataFrame:
    """(family, column, step, weight) of rows (family, weight, aseq): the weighted number of each step from each match column, numbered from 0; only steps that are taken."""
    found = materialize(match_columns(rows)).select(F.col("family").alias("__f"), "cols")
    wide = rows.select("family", F.coalesce("weight", F.lit(1.0)).cast("double").alias("weight"), "aseq").join(found, F.col("family").eqNullSafe(F.col("__f"))).drop("__f")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for family, weight, row, cols in zip(batch["family"], batch["weight"], batch["aseq"], batch["cols"], strict=True):
                part = weight * steps_of(row, np.asarray(cols, np.int64))
                held[family] = held[family] + part if family in held else part
        for family, total in held.items():
            k, step = np.nonzero(total)
            yield pd.DataFrame({"family": pd.Series([family] * len(k), dtype=object), "column": k.astype(np.int32), "step": pd.Series([STEPS[s] for s in step], dtype=object), "weight": total[k, step]})

    kind = rows.schema["family"].dataType.simpleString()
    return wide.mapInPandas(run, f"family {kind}, column int, step string, weight double").groupBy("family", "column", "step").agg(F.sum("weight").alias("weight"))


def effective_numbers(counted: DataFrame) -> DataFrame:
    """(family, pos, effective): the exponential of the entropy of each column's residues, from counts or weights (family, pos, residue, n), gaps left out."""
    solid = counted.where(~F.col("residue").rlike(r"[-._~ ]"))
    told = solid.groupBy("family", "pos").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("l"))
    return told.select("family", "pos", F.exp(F.ln("t") - F.col("l") / F.col("t")).alias("effective"))
