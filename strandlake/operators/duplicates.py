"""Exact duplicates, size classes and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_groups(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(representative, n_members) of each group of equal keys; counted before the shuffle, whatever a group's size."""
    return df.groupBy(F.md5(key.cast("binary")).alias("digest")).agg(
        F.min(id_col).alias("representative"), F.count("*").alias("n_members")
    ).drop("digest")


def with_representative(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """``df`` plus the least id that has the same key."""
    keyed = df.withColumn("__digest", F.md5(key.cast("binary")))
    least = keyed.groupBy("__digest").agg(F.min(id_col).alias("representative"))
    return keyed.join(least, "__digest").drop("__digest")


def size_class(n: Column, medium: int = 1000, large: int = 10000) -> Column:
    """small, medium or large by a count."""
    return F.when(n < medium, "small").when(n < large, "medium").otherwise("large")


def quota(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group; each task keeps its own first ones before the shuffle (a top-k filter)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= most)
