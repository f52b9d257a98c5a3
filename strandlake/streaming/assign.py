"""New rows of a stream, assigned to fixed centers or aggregated in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.clusters import nearest


def assign_stream(stream: DataFrame, id_col: str, vector: str, centers: list[tuple[int, list[float]]]) -> DataFrame:
    """(id, cluster, distance) of each arriving vector; works on a static table alike."""
    return nearest(stream.select(id_col, vector), vector, centers).drop(vector)


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window start, by, n) with a watermark of ``late``."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
