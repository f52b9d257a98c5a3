"""Statistics of whole columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.ordering import running_total


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """(value, name): the mean rank of each distinct value; ranks start from 1."""
    counted = df.groupBy(value).agg(F.count("*").alias("__n"))
    placed = running_total(counted, [F.col(value).asc()], "__n", "__before")
    return placed.select(value, (F.col("__before") + (F.col("__n") + 1) / 2).alias(name))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(spearman, n): the correlation of average ranks. Rows with a null are left out; ranks are made of counts of distinct values."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("n"))
    spelled = both.withColumn("__copies", F.col("n"))
    rank_x = average_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "rx")
    rank_y = average_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), y, "ry")
    n, a, b = F.col("n"), F.col("rx"), F.col("ry")
    sums = spelled.join(rank_x, x).join(rank_y, y).agg(
        F.sum(n).alias("n"), F.sum(n * a).alias("a"), F.sum(n * b).alias("b"), F.sum(n * a * b).alias("ab"), F.sum(n * a * a).alias("aa"), F.sum(n * b * b).alias("bb")
    )
    top = F.col("n") * F.col("ab") - F.col("a") * F.col("b")
    low = F.sqrt(F.col("n") * F.col("aa") - F.col("a") * F.col("a")) * F.sqrt(F.col("n") * F.col("bb") - F.col("b") * F.col("b"))
    return sums.select(F.when(low > 0, top / low).alias("spearman"), "n")


def log_sum_exp(x: Column, most: Column) -> Column:
    """An aggregate: log of the sum of exponentials, given the largest value."""
    return most + F.log(F.sum(F.exp(x - most)))


def weighted_line(x: Column, y: Column, w: Column) -> Column:
    """An aggregate: (slope, intercept) of the line of least weighted squares; rows with a null don't count, and without two places there is no slope."""
    known = x.isNotNull() & y.isNotNull() & w.isNotNull()
    total = lambda c: F.sum(F.when(known, c))
    n, a, b, ab, aa = total(w), total(w * x), total(w * y), total(w * x * y), total(w * x * x)
    low = n * aa - a * a
    slope = F.when(low > 0, (n * ab - a * b) / low)
    return F.struct(slope.alias("slope"), ((b - slope * a) / n).alias("intercept"))
