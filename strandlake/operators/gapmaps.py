"""Gap maps: what must be inserted into an alignment's columns when rows are added, as running sums that compose.

An alignment is (family, name, row) with rows of one width in a family. A gap map is
(family, col, n): ``n`` gap columns are inserted before column ``col`` (at the width: after
the last). Two alignments that share a row are brought into one frame by the gaps the
shared row has in each: before each of its residues stand the gaps of the first, then
those of the second. Maps compose, so rows can be carried over several frames at once,
and columns that are gaps in every row can be taken out and put back by the map of what
was taken.

Maps are small beside alignments (one entry for each run of gaps) and are built by windows
over one row's columns; rows meet them by family and are rewritten in tasks. Columns that
are gaps everywhere are told from one bit for each column and task.

Defined results: a null row stays null; a row narrower than its family counts as ending in
gaps; a family without a map, or with one of no entries, keeps its rows; an empty table
stays empty; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP = "-"
_MAP = ["family", "col", "n"]


def row_gaps(shared: DataFrame) -> DataFrame:
    """(family, k, col, gaps) of one row for each family: the column of its k-th residue and the gaps right before it.

    The row's end counts as one more residue, at its width.
    """
    cells = shared.select("family", F.posexplode(F.split(F.concat("row", F.lit("!")), "")).alias("col", "c")).where(~F.col("c").isin(GAP, ""))
    along = Window.partitionBy("family").orderBy("col")
    return cells.select(
        "family", (F.row_number().over(along) - 1).alias("k"), "col", (F.col("col") - F.lag("col", 1, -1).over(along) - 1).alias("gaps")
    )


def merge_maps(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The gap maps that bring two alignments into one frame, from the row they share as it stands in each (family, row)."""
    a, b = row_gaps(first), row_gaps(second).toDF("f", "k_b", "col_b", "gaps_b")
    both = a.join(b, a["family"].eqNullSafe(b["f"]) & (a["k"] == b["k_b"]))
    into_first = both.where("gaps_b > 0").select("family", "col", F.col("gaps_b").alias("n"))
    into_second = both.where("gaps > 0").select("family", (F.col("col_b") - F.col("gaps_b")).alias("col"), F.col("gaps").alias("n"))
    return into_first, into_second


def compose(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """The map that does what ``inner`` and then ``outer`` (in the columns ``inner`` made) do."""
    along = Window.partitionBy("family").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    ran = inner.groupBy("family", "col").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(along))
    # Where an entry of the inner map begins in the columns it makes, and what it makes of them.
    known = ran.select("family", (F.col("col") + F.col("upto") - F.col("n")).alias("at"), F.lit(0).alias("kind"), F.struct("col", "upto").alias("entry"), F.lit(0).cast("long").alias("n"))
    asked = outer.select("family", F.col("col").cast("long").alias("at"), F.lit(-1).alias("kind"), F.lit(None).cast("struct<col:int,upto:bigint>").alias("entry"), F.col("n").cast("long").alias("n"))
    both = known.select("family", F.col("at").cast("long").alias("at"), "kind", F.col("entry").cast("struct<col:int,upto:bigint>").alias("entry"), "n").unionByName(asked)
    last = F.last("entry", ignorenulls=True).over(Window.partitionBy("family").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("last", last).where("kind = -1")
    col = F.when(F.col("last").isNull(), F.col("at")).otherwise(F.greatest(F.col("last.col").cast("long"), F.col("at") - F.col("last.upto")))
    every = placed.select("family", col.cast("int").alias("col"), "n").unionByName(ran.select("family", F.col("col").cast("int").alias("col"), F.col("n").cast("long").alias("n")))
    return every.groupBy("family", "col").agg(F.sum("n").alias("n"))


def _letters(row: str) -> np.ndarray:
    return np.frombuffer(row.encode(), np.uint8) if row.isascii() else np.frombuffer(row.encode("utf-32-le"), np.uint32)


def _text(letters: np.ndarray) -> str:
    return letters.tobytes().decode("ascii") if letters.dtype == np.uint8 else letters.astype("<u4").tobytes().decode("utf-32-le")


_GAP = _letters(GAP)[0]


def inserted(row: str, cols: np.ndarray, counts: np.ndarray) -> str:
    """``row`` with ``counts`` gaps before each of ``cols``, in rising order; a row that ends earlier is filled up to the last."""
    x = _letters(row)
    if len(cols) and len(x) < cols[-1]:
        x = np.r_[x, np.full(cols[-1] - len(x), _GAP, x.dtype)]
    return _text(np.insert(x, np.repeat(cols, counts), _GAP))


def _packed_map(gap_map: DataFrame) -> DataFrame:
    """(family, cols, counts): each family's map as 64-bit numbers in rising order of column."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        held = group.sort_values("col", kind="stable")
        return pd.DataFrame({
            "__f": pd.Series([held["family"].iloc[0]], dtype=object), "__cols": [held["col"].to_numpy(np.int64).tobytes()], "__counts": [held["n"].to_numpy(np.int64).tobytes()],
        })

    kind = gap_map.schema["family"].dataType.simpleString()
    return gap_map.select("family", "col", "n").groupBy("family").applyInPandas(run, f"__f {kind}, __cols binary, __counts binary")


def apply(rows: DataFrame, gap_map: DataFrame, width_col: str | None = None) -> DataFrame:
    """``rows`` with the gaps of a map in; with ``width_col``, the width of a row's family, filled up to that and what is inserted.

    Entries beyond a row's end only move its width: tasks insert the others, and the end is
    filled afterwards, so that a task handles no more of a row than there is.
    """
    whole = _packed_map(gap_map)
    joined = rows.join(whole, rows["family"].eqNullSafe(whole["__f"]), "left").drop("__f").withColumn("__w", (F.col(width_col) if width_col else F.lit(None)).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, widths = [], []
            for row, cols, counts, given in zip(batch["row"], batch["__cols"], batch["__counts"], batch["__w"], strict=True):
                width = 0 if pd.isna(given) else int(given)
                if row is not None and cols is not None:
                    cols, counts = np.frombuffer(cols, np.int64), np.frombuffer(counts, np.int64)
                    width = max(len(row), width, int(cols[-1]) if len(cols) else 0) + int(counts.sum())
                    own = np.searchsorted(cols, len(row), side="left")
                    row = inserted(row, cols[:own], counts[:own])
                out.append(row)
                widths.append(width)
            yield batch.drop(columns=["__cols", "__counts"]).assign(row=pd.Series(out, dtype=object, index=batch.index), __w=pd.array(widths, "Int32"))

    kept = joined.drop("__cols", "__counts")
    told = joined.select(*kept.columns[:-1], "__cols", "__counts", "__w").mapInPandas(run, kept.schema)
    return told.select(*[F.when(F.col("__w") > F.length("row"), F.rpad("row", F.col("__w"), GAP)).otherwise(F.col("row")).alias("row") if c == "row" else F.col(f"`{c}`") for c in rows.columns])


def common_gaps(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` without the columns that are gaps in every row of their family, and the map that puts them back."""
    kind = rows.schema["family"].dataType.simpleString()

    def solid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for batch in batches:
            for family, row in zip(batch["family"], batch["row"], strict=True):
                if row is None:
                    continue
                x = _letters(row) != _GAP
                have = seen.get(family, np.zeros(0, bool))
                if len(have) < len(x):
                    have = np.r_[have, np.zeros(len(x) - len(have), bool)]
                have[: len(x)] |= x
                seen[family] = have
        if seen:
            yield pd.DataFrame({"family": pd.Series(list(seen), dtype=object), "width": [len(x) for x in seen.values()], "bits": [np.packbits(x).tobytes() for x in seen.values()]})

    def runs(group: pd.DataFrame) -> pd.DataFrame:
        have = np.zeros(int(group["width"].max()), bool)
        for width, bits in zip(group["width"], group["bits"], strict=True):
            have[:width] |= np.unpackbits(np.frombuffer(bits, np.uint8))[:width].astype(bool)
        left = np.cumsum(have) - have  # the column each would have without the gaps
        cols, n = np.unique(left[~have], return_counts=True)
        return pd.DataFrame({"family": pd.Series([group["family"].iloc[0]] * len(cols), dtype=object), "col": cols.astype(np.int32), "n": n.astype(np.int64)})

    taken = rows.select("family", "row").mapInPandas(solid, f"family {kind}, width int, bits binary").groupBy("family").applyInPandas(runs, f"family {kind}, col int, n long")
    whole = taken.groupBy(F.col("family").alias("__f")).agg(F.array_sort(F.collect_list(F.struct("col", "n"))).alias("__m"))
    joined = rows.join(whole, rows["family"].eqNullSafe(whole["__f"]), "left").drop("__f")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, entries in zip(batch["row"], batch["__m"], strict=True):
                if row is not None and entries is not None:
                    cols, n = np.array([e["col"] for e in entries]), np.array([e["n"] for e in entries])
                    starts = cols + np.cumsum(n) - n  # in the columns as they were
                    x = _letters(row)
                    gone = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    row = _text(np.delete(x, gone[gone < len(x)]))
                out.append(row)
            yield batch.drop(columns="__m").assign(row=pd.Series(out, dtype=object, index=batch.index))

    return joined.mapInPandas(cut, rows.schema), taken
