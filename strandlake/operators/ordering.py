"""Ranks and seeds over a whole table without gathering it in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.storage import materialize


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` plus its 0-based rank by ``order``, which must be total for a stable result.

    Rows are range-partitioned and sorted, numbered inside their partition as they are
    written once, and shifted by the sizes of the partitions before.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(
        df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    sizes = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect())  # one row a partition
    before, at = [], 0
    for part, n in sizes:
        before += [F.lit(part), F.lit(at)]
        at += n
    shift = F.create_map(*before)[F.col("__part")] if before else F.lit(0)
    return placed.withColumn(name, F.col("__pos") + shift).drop("__part", "__pos")


def number_of_seeds(n: int) -> int:
    """The square of log2 n, rounded down, and less than n."""
    if n <= 1:
        return 0
    return min(int(math.log2(n) ** 2), n - 1)


def stride_seeds(df: DataFrame, length: Column, id_col: str, seeds: int | None = None) -> DataFrame:
    """Rows at a constant stride in order of falling length (ties by id), with that rank."""
    ranked = global_rank(df.withColumn("__len", length), [F.col("__len").desc(), F.col(id_col).asc()])
    n = ranked.count()
    wanted = number_of_seeds(n) if seeds is None else seeds
    if not wanted:
        return ranked.where("false").drop("__len")
    stride = n // wanted
    return ranked.where((F.col("rank") % stride == 0) & (F.col("rank") / stride < wanted)).drop("__len")


def running_total(df: DataFrame, order: list[Column], value: str, name: str = "before") -> DataFrame:
    """``df`` plus the sum of ``value`` over all rows before it in ``order``, which must be total."""
    from pyspark.sql import Window

    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(partitions, *order).withColumn("__part", F.spark_partition_id()))
    sums = sorted((r["__part"], r["s"]) for r in placed.groupBy("__part").agg(F.sum(value).alias("s")).collect())  # one row a partition
    before, at = [], 0
    for part, s in sums:
        before += [F.lit(part), F.lit(at)]
        at += s or 0
    shift = F.create_map(*before)[F.col("__part")] if before else F.lit(0)
    own = F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn(name, F.coalesce(own, F.lit(0)) + shift).drop("__part")
