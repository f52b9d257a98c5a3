"""Consistent anchors: of the matched segments of two rows, those that can stand in one alignment, the strongest first.

Two anchors agree if one ends before the other starts in both rows, or if they are the
same segment; else they conflict. The rule takes anchors by falling score and keeps each
that agrees with all kept before. Once the strongest of a pair of rows is kept, whatever
agrees with it lies before it or after it in both rows, and these two windows have nothing
to do with each other: so every window keeps its own strongest in the same round, and a
round is one aggregate by window and one join. Equal scores are put in order by a hash,
so windows halve on average; the rounds are as many as the kept anchors of a pair are
deep as a tree, not as many as there are.

Defined results: an anchor with a null in its place or score is left out; one that ends
before it starts as well; repeated segments are one, at their greatest score; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.storage import materialize

PLACES = ("start_a", "end_a", "start_b", "end_b")


def consistent(anchors: DataFrame, pair: list[str]) -> DataFrame:
    """(*pair, start_a, end_a, start_b, end_b, score) of the anchors that stay; both ends belong to a segment."""
    fine = anchors.select(*pair, *PLACES, "score").dropna(subset=[*PLACES, "score"]).where("start_a <= end_a and start_b <= end_b")
    once = fine.groupBy(*pair, *PLACES).agg(F.max("score").alias("score"))
    tie = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in PLACES]).cast("binary"))
    left = materialize(once.withColumn("order", F.struct("score", tie.alias("tie"), *PLACES)).withColumn("window", F.lit("")))
    kept = None
    same = [*pair, "window"]
    while not left.isEmpty():
        best = left.groupBy(*[F.col(c).alias(f"_{c}") for c in same]).agg(F.max("order").alias("best"))
        at = F.lit(True)
        for c in same:
            at = at & F.col(c).eqNullSafe(F.col(f"_{c}"))
        told = materialize(left.join(best, at).drop(*[f"_{c}" for c in same]))
        won = told.where(F.col("order") == F.col("best")).select(*pair, *PLACES, "score")
        kept = won if kept is None else kept.unionByName(won)
        before = (F.col("end_a") < F.col("best.start_a")) & (F.col("end_b") < F.col("best.start_b"))
        after = (F.col("start_a") > F.col("best.end_a")) & (F.col("start_b") > F.col("best.end_b"))
        side = F.when(before, "0").when(after, "1")
        left = materialize(told.withColumn("window", F.concat("window", side)).where(F.col("window").isNotNull()).drop("best"))
    return once.where("false") if kept is None else kept


def word_anchors(a: DataFrame, b: DataFrame, words: int) -> DataFrame:
    """(a_id, b_id, start_a, end_a, start_b, end_b, score): runs of ``words`` words that stand in rows of both (id, text), as word places from 0.

    The score is the letters of the run. Rows meet by equal runs; ``b`` should be the smaller side.
    """
    def runs(rows: DataFrame, name: str) -> DataFrame:
        split = rows.select(F.col("id").alias(f"{name}_id"), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)).alias("w")).where(F.size("w") >= words)
        placed = split.select(f"{name}_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - words)).alias(f"start_{name}"))
        return placed.select(f"{name}_id", f"start_{name}", (F.col(f"start_{name}") + words - 1).alias(f"end_{name}"), F.array_join(F.slice("w", F.col(f"start_{name}") + 1, words), " ").alias("run"))

    met = runs(a, "a").join(runs(b, "b"), "run")
    return met.select("a_id", "b_id", *PLACES, F.length(F.replace("run", F.lit(" "), F.lit(""))).alias("score"))
