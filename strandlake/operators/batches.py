"""Batches of rows under a token budget, filled greedily in order of size.

Rows in order of size (ties by id) join the open batch while its padded size, the
greatest row times the number of rows, stays within the budget. As sizes rise, that
depends on the size and on how many rows the open batch has, so rows of one size fill
batches at a constant stride: the greedy walk is folded over the table of sizes (one
entry for each distinct size, so bounded by the longest row and not by their number),
and rows find their batch by arithmetic on their rank. Ranks come from range
partitions; neither the walk nor a popular size is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.ordering import global_rank


def fill(sizes: list[tuple[int, int]], budget: int) -> list[tuple[int, int, int, int, int, int]]:
    """What each of the (size, rows) in order finds: (size, rank of its first row, open batch, rows it has, rows that still join it, rows of a batch after it).

    A row beyond the budget is a batch of its own; before the first row batch -1 is open.
    """
    out, rank, batch, held = [], 0, -1, 0
    for size, n in sizes:
        fits = budget // size if size > 0 else n + held
        joins, each = min(n, max(0, fits - held)) if held else 0, max(1, fits)
        out.append((size, rank, batch, held, joins, each))
        rest, rank = n - joins, rank + n
        held += joins
        if rest:
            new = -(-rest // each)
            batch, held = batch + new, rest - (new - 1) * each
    return out


def token_batches(rows: DataFrame, id_col: str, size_col: str, budget: int, extra: int = 0) -> DataFrame:
    """``rows`` plus ``batch`` (from 0 in order of size) and ``place`` in it, each row ``extra`` tokens longer than ``size_col`` says.

    Ids break ties and should be unique; a null or negative size counts as none; columns of
    those names are replaced; an empty table stays empty.
    """
    if budget < 1:
        raise ValueError("a budget of at least one token")
    rows = rows.drop("batch", "place")
    size = (F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)) + extra).cast("long")
    ranked = global_rank(rows.withColumn("__size", size), [F.col("__size").asc(), F.col(id_col).asc()], "__rank")
    counted = sorted((r["__size"], r["n"]) for r in ranked.groupBy("__size").agg(F.count("*").alias("n")).toLocalIterator())  # a row for each distinct size
    table = ranked.sparkSession.createDataFrame(fill(counted, budget), "__s long, __first long, __open long, __held long, __joins long, __each long")
    r = F.col("__rank") - F.col("__first")
    joined = ranked.join(table, F.col("__size") == F.col("__s"))
    late = r - F.col("__joins")
    return joined.withColumns({
        "batch": F.when(r < F.col("__joins"), F.col("__open")).otherwise(F.col("__open") + 1 + F.floor(late / F.col("__each"))).cast("long"),
        "place": F.when(r < F.col("__joins"), F.col("__held") + r).otherwise(late % F.col("__each")).cast("long"),
    }).drop("__size", "__rank", "__s", "__first", "__open", "__held", "__joins", "__each")
