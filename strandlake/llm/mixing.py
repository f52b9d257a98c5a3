"""Mixing sources to target weights: iterative proportional fitting, then sampling.

Documents are counted into cells of (source, language, topic) with their tokens.
Raking scales the cells' weights to each target marginal in turn until all three
hold. A document's sampling probability is its cell's calibrated weight times a
common scale that makes the expected tokens meet the budget, at most 1; it is taken
if a hash of its id, read as a number in [0, 1), lies below it.

A topic is a hashed cluster of words: of ``TOPICS`` classes that words of
``LONG_WORD`` bytes or more fall into by hash, the one that most of a text's
belong to (ties: the first); ``none`` for a text without such words.

The cell table is an aggregate. Up to ``MAX_CELLS`` cells are raked on the driver;
beyond that the same steps run as joins of cell tables in Spark. Probabilities reach
the documents in a join with the cells, broadcast only up to ``MAX_CELLS``.

Targets that are not given come from the corpus: shares in proportion to
tokens ** ``TEMPER``, which raises small sources, languages and topics. Defined
results: nulls are categories of their own; a target for an absent category is
ignored and the others are scaled to 1; targets that contradict each other, as cells
are missing, have no solution: raking ends when a round no longer changes what is
off, ``mix_gap`` says by how much the worst marginal of the weights misses its target
(with ``strict`` it is an error); a probability ends at 1, so a cell too small for its
weight is taken whole and its share falls short: ``mix_missed`` says by how much the
worst share of the expected tokens misses its target; a document without tokens has weight and probability
like its cell; a null doc_id is hashed as 0; rows that repeat an id are taken or left
together; an empty table gives an empty table. A text is read whole, in about a
hundred bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.textblocks import Words, lean, slices, unlike
from strandlake.storage import materialize, spread

DIMENSIONS = ("source", "lang", "topic")
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
BUDGET = 0.4
MAX_CELLS = 20_000
ROUNDS, TOLERANCE, STALL = 1000, 1e-9, 1e-7
TOPICS, LONG_WORD = 12, 6
SEED = 11


def with_topics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus mix_topic and mix_tokens (words divided by white space); columns of those names are replaced."""
    docs = docs.drop("mix_topic", "mix_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topics, tokens = [], []
            for at, to, data, offsets in slices(batch.column(text_col)):
                words = Words(data, offsets)
                long = words.ends - words.starts >= LONG_WORD
                cls = (words.hashes(lower=True)[long] >> np.uint64(40)).astype(np.int64) % TOPICS
                n = np.bincount(words.text_of_word()[long] * TOPICS + cls, minlength=(to - at) * TOPICS).reshape(-1, TOPICS)
                topics += [f"words{k:02d}" if some else "none" for k, some in zip(n.argmax(axis=1).tolist(), n.any(axis=1).tolist(), strict=True)]
                tokens += words.count.tolist()
            columns = [*batch.columns, pa.array(topics, pa.string()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "mix_topic", "mix_tokens"])

    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "mix_topic string, mix_tokens long"]
    return docs.mapInArrow(lean(run), ", ".join(schema))


def _marginal(tokens: np.ndarray, codes: np.ndarray, names: list, given: dict | None, temper: float) -> np.ndarray:
    """Target shares of the categories of one dimension."""
    total = np.bincount(codes, tokens, len(names))
    shares = np.array([float(given.get(x, 0.0)) for x in names]) if given else total**temper
    shares = np.where(total > 0, shares, 0)
    return shares / shares.sum() if shares.sum() else shares


def _settled(off: float, before: float) -> bool:
    """Whether raking is done: targets met, or as near as they will be."""
    return off < TOLERANCE or abs(before - off) <= STALL * off


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Cell weights whose marginals meet the targets, starting from the cells' own share of tokens; and how far the worst is off."""
    weight = tokens / tokens.sum() if tokens.sum() else tokens.astype(float)
    off = before = np.inf
    for _ in range(ROUNDS):
        before, off = off, 0.0
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, weight, len(target))
            factor = np.divide(target, now, out=np.zeros_like(target), where=now > 0)
            off = max(off, float(np.abs(now - target).max(initial=0)))
            weight = weight * factor[code]
        if _settled(off, before):
            break
    return weight, off


def scale_to_budget(tokens: np.ndarray, ratio: np.ndarray, budget: float) -> np.ndarray:
    """min(1, s * ratio) with s such that the expected tokens are ``budget``, as far as the corpus goes."""
    order = np.argsort(-ratio, kind="stable")
    full = np.r_[0.0, np.cumsum(tokens[order])]  # tokens of cells taken whole
    rest = np.r_[np.cumsum((tokens * ratio)[order][::-1])[::-1], 0.0]  # weighted tokens of the others
    for k in range(len(order)):
        if rest[k] <= 0:
            break
        s = max(0.0, budget - full[k]) / rest[k]
        if s * ratio[order[k]] <= 1:
            return np.minimum(1.0, s * ratio)
    return np.where(ratio > 0, 1.0, 0.0)


def _rake_tables(cells: DataFrame, targets: dict[str, dict | None]) -> tuple[DataFrame, float, dict[str, DataFrame]]:
    """The steps of :func:`rake` as joins, for more cells than the driver should hold; and the targets."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    weighted = cells.withColumn("weight", F.col("tokens") / F.lit(float(max(1, total))))
    wanted = {}
    for d in DIMENSIONS:
        of_d = cells.groupBy(d).agg(F.sum("tokens").alias("t"))
        given = targets.get(d)
        if given:
            rows = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"`{d}` string, share double")
            of_d = of_d.join(rows, of_d[d].eqNullSafe(rows[d]), "left").select(of_d[d], F.coalesce("share", F.lit(0.0)).alias("share"))
        else:
            of_d = of_d.select(d, F.pow("t", F.lit(TEMPER[d])).alias("share"))
        whole = of_d.agg(F.sum("share")).first()[0] or 1.0
        wanted[d] = materialize(of_d.select(F.col(d).alias("k"), (F.col("share") / whole).alias("target")))
    off = before = float("inf")
    for _ in range(ROUNDS):
        before, off = off, 0.0
        for d in DIMENSIONS:
            now = weighted.groupBy(F.col(d).alias("k")).agg(F.sum("weight").alias("now"))
            factor = materialize(now.join(wanted[d], now["k"].eqNullSafe(wanted[d]["k"])).select(
                now["k"], F.when(F.col("now") > 0, F.col("target") / F.col("now")).otherwise(0.0).alias("factor"), F.abs(F.col("now") - F.col("target")).alias("off")
            ))
            off = max(off, factor.agg(F.max("off")).first()[0] or 0.0)
            weighted = weighted.join(factor, weighted[d].eqNullSafe(factor["k"])).select(
                *DIMENSIONS, "tokens", (F.col("weight") * F.col("factor")).alias("weight")
            )
        weighted = materialize(weighted)
        if _settled(off, before):
            break
    return weighted, off, wanted


def mix_cells(cells: DataFrame, targets: dict[str, dict | None] | None = None, budget: float = BUDGET, max_cells: int = MAX_CELLS) -> tuple[DataFrame, bool, float, float]:
    """(source, lang, topic, weight, probability) of each cell, whether it is small enough to broadcast, how far the worst
    marginal of the weights is off, and how far the worst share of the expected sample is: probabilities end at 1."""
    spark, targets = cells.sparkSession, targets or {}
    some = cells.limit(max_cells + 1).toPandas()
    fields = "source string, lang string, topic string, weight double, probability double"
    if len(some) <= max_cells:
        some = some.astype(object).where(some.notna(), None).sort_values(list(DIMENSIONS), key=lambda c: c.map(repr), ignore_index=True)
        tokens = some["tokens"].to_numpy(np.float64)
        names = [sorted(set(some[d]), key=repr) for d in DIMENSIONS]
        codes = [some[d].map({x: k for k, x in enumerate(n)}.get).to_numpy(np.int64) if len(some) else np.empty(0, np.int64) for d, n in zip(DIMENSIONS, names, strict=True)]
        goal = [_marginal(tokens, c, n, targets.get(d), TEMPER[d]) for d, c, n in zip(DIMENSIONS, codes, names, strict=True)]
        weight, off = rake(tokens, codes, goal)
        ratio = np.divide(weight * tokens.sum(), tokens, out=np.zeros_like(tokens), where=tokens > 0)
        probability = scale_to_budget(tokens, ratio, budget * tokens.sum())
        rows = [(*map(some[list(DIMENSIONS)].iloc[k].get, DIMENSIONS), float(weight[k]), float(probability[k])) for k in range(len(some))]
        expected = tokens * probability / max(1.0, (tokens * probability).sum())
        missed = max((float(np.abs(np.bincount(c, expected, len(g)) - g).max(initial=0)) for c, g in zip(codes, goal, strict=True)), default=0.0)
        return spark.createDataFrame(rows, fields), True, off, missed
    weighted, off, wanted = _rake_tables(cells, targets)
    whole = weighted.agg(F.sum("tokens")).first()[0]
    ratio = F.when(F.col("tokens") > 0, F.col("weight") * whole / F.col("tokens")).otherwise(0.0)
    rated = materialize(weighted.withColumn("ratio", ratio))
    low, high = 0.0, 1.0
    expected = lambda s: rated.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("ratio") * s))).first()[0]
    while expected(high) < budget * whole and high < 1e12:
        high *= 4
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if expected(middle) < budget * whole else (low, middle)
    mixed = materialize(rated.select(*DIMENSIONS, "tokens", "weight", F.least(F.lit(1.0), F.col("ratio") * high).alias("probability")))
    taken, missed = F.col("tokens") * F.col("probability"), 0.0
    total = mixed.agg(F.sum(taken)).first()[0] or 1.0
    for d, goal in wanted.items():
        shares = mixed.groupBy(F.col(d).alias("have")).agg((F.sum(taken) / total).alias("share"))
        both = shares.join(goal, shares["have"].eqNullSafe(goal["k"]))
        missed = max(missed, both.agg(F.max(F.abs(F.col("share") - F.col("target")))).first()[0] or 0.0)
    return mixed.drop("tokens"), False, off, missed


def chance(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that the id and the seed fix."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id, F.lit(0)), F.lit(seed)), 11) / F.lit(float(1 << 53))


def sample_mixture(docs: DataFrame, targets: dict[str, dict | None] | None = None, budget: float = BUDGET, max_cells: int = MAX_CELLS, strict: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, lang, source) plus mix_topic, mix_tokens, mix_weight, mix_probability, mix_taken, mix_gap and mix_missed.

    Columns of those names are replaced; all others pass through.
    """
    docs = docs.drop("mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_taken", "mix_gap", "mix_missed")
    told = with_topics(docs)
    cells = materialize(with_topics(docs.select("source", "lang", "text")).groupBy("source", "lang", F.col("mix_topic").alias("topic")).agg(F.sum("mix_tokens").alias("tokens")))
    mixed, small, off, missed = mix_cells(cells, targets, budget, max_cells)
    if strict and off > 1e-6:
        raise ValueError(f"no weights meet all targets: the worst is off by {off:.3g}")
    source, lang, topic = unlike(told.columns, "__source", "__lang", "__topic")
    mixed = mixed.select(
        F.col("source").alias(source), F.col("lang").alias(lang), F.col("topic").alias(topic),
        F.col("weight").alias("mix_weight"), F.col("probability").alias("mix_probability"),
    )
    same = F.col("source").eqNullSafe(F.col(source)) & F.col("lang").eqNullSafe(F.col(lang)) & (F.col("mix_topic") == F.col(topic))
    joined = told.join(F.broadcast(mixed) if small else mixed, same, "left").drop(source, lang, topic)
    return joined.withColumns({
        "mix_taken": chance(F.col("doc_id")) < F.col("mix_probability"),
        "mix_gap": F.lit(float(off if np.isfinite(off) else 0.0)), "mix_missed": F.lit(float(missed)),
    })


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return sample_mixture(docs).select(
        "doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"),
        F.col("mix_weight").alias("cell_weight"), F.col("mix_probability").alias("probability"), F.col("mix_taken").alias("taken"),
        F.col("mix_gap").alias("weight_gap"), F.col("mix_missed").alias("share_gap"),
    )
