"""Which plan suits a set of rows: by their number and their longest length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plan_of(rows: Column, longest: Column) -> Column:
    """struct<distance, iterations, tree> as a chain of size limits."""

    def plan(distance: str, iterations: int, tree: str) -> Column:
        return F.struct(F.lit(distance).alias("distance"), F.lit(iterations).alias("iterations"), F.lit(tree).alias("tree"))

    return (
        F.when((longest < 3000) & (rows < 100), plan("local", 1000, "full"))
        .when((longest < 1000) & (rows < 200), plan("local", 2, "full"))
        .when((longest < 10000) & (rows < 500), plan("kmer", 2, "full"))
        .when(rows < 20000, plan("kmer", 0, "full, twice"))
        .when(rows < 100000, plan("kmer", 0, "compact, twice"))
        .when(rows < 200000, plan("kmer", 0, "compact, once"))
        .when(longest < 3000, plan("alignment", 0, "parted"))
        .otherwise(plan("kmer", 0, "parted"))
    )


def plans(df: DataFrame, family: str, length: Column) -> DataFrame:
    """(family, n_rows, longest, distance, iterations, tree) of each family."""
    sized = df.groupBy(family).agg(F.count("*").alias("n_rows"), F.max(length).cast("long").alias("longest"))
    return sized.withColumn("plan", plan_of(F.col("n_rows"), F.col("longest"))).select(family, "n_rows", "longest", "plan.*")
