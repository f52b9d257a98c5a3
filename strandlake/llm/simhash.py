"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints within ``MAX_BITS`` of each other agree in at least one of
``MAX_BITS + 1`` segments of 16 bits. Once for each segment, distinct fingerprints
are rotated so that the segment leads and dealt by its value; a task sorts its
fingerprints by Gray rank, factors the bits that neighbours share into nodes of a
tree, and walks pairs of nodes from the root: differences in shared bits accumulate
downwards and a pair of whole groups is pruned once they pass ``MAX_BITS``. Only a
spanning forest of the links a task finds leaves it; components are then joined.

A segment value with more than ``MAX_GROUP`` fingerprints is dealt out further by
its next bits: each fingerprint lives in one part and is also compared in the parts
whose bits differ in at most ``MAX_BITS`` places.

Defined results: a null or empty text has fingerprint zero, which links like any
other; repeated rows have equal fingerprints and are linked; the component of
documents whose ids are all null is null.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.components import Forest, connected_components
from strandlake.llm.textblocks import LOWER, lean, slices
from strandlake.storage import materialize, spread

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 3
SEGMENT = 64 // (MAX_BITS + 1)
MAX_GROUP = 200_000
_FAN = 4
_PAIRS_AT_ONCE = 1 << 20
_HASHES_AT_ONCE = 1 << 16


def fingerprint_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _HASHES_AT_ONCE):
        part = hashes[at : at + _HASHES_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_in * 2 > len(hashes)).tobytes(), "big")


def text_fingerprint(lowered: bytes) -> int:
    words = lowered.split()
    digest, joined = xxhash.xxh64_intdigest, b" ".join
    if len(words) < SHINGLE_WORDS:
        shingles = [joined(words)] if words else []
    else:
        shingles = map(joined, zip(words, words[1:], words[2:], strict=False))
    return fingerprint_bits(np.fromiter((digest(s, SEED) for s in shingles), np.uint64))


def with_fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``simhash`` (long, the 64 bits as they are); a column of that name is replaced."""
    kept = [f for f in docs.schema.fields if f.name != text_col and f.name.lower() != "simhash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, to, data, offsets in slices(batch.column(text_col)):
                raw = LOWER[data].tobytes()
                out += [text_fingerprint(raw[offsets[k] : offsets[k + 1]]) for k in range(to - at)]
            columns = {f.name: batch.column(f.name) for f in kept}
            yield pa.RecordBatch.from_pydict(columns | {"simhash": pa.array(np.array(out, np.uint64).view(np.int64))})

    return docs.mapInArrow(lean(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "simhash long"]))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a bit pattern in reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def rotate(x: np.ndarray, bits: int) -> np.ndarray:
    bits %= 64
    return x if not bits else (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


class GrayTree:
    """Fingerprints in Gray order under nodes that hold the bits all below them share."""

    def __init__(self, x: np.ndarray):
        self.order = np.argsort(gray_rank(x), kind="stable")
        x = x[self.order]
        self.levels = [(x, np.full(len(x), ~np.uint64(0)))]  # pattern, mask of shared bits
        low, high = x, x
        while len(low) > 1:
            cuts = np.arange(0, len(low), _FAN)
            low, high = np.bitwise_and.reduceat(low, cuts), np.bitwise_or.reduceat(high, cuts)
            shared = ~(low ^ high)
            self.levels.append((low & shared, shared))

    def close_pairs(self, lead: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (in the input) of pairs that agree in the ``lead`` first bits and differ in ``max_bits`` at most."""
        head = ~np.uint64(0) << np.uint64(64 - lead) if lead else np.uint64(0)
        zero = np.zeros(1, np.int64)
        stack = [(len(self.levels) - 1, zero, zero)] if len(self.order) > 1 else []
        while stack:
            level, a, b = stack.pop()
            if len(a) > _PAIRS_AT_ONCE:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            pattern, mask = self.levels[level]
            differ = (pattern[a] ^ pattern[b]) & mask[a] & mask[b]
            stays = (np.bitwise_count(differ) <= max_bits) & ((differ & head) == 0)
            a, b = a[stays], b[stays]
            if level == 0:
                apart = a < b
                if apart.any():
                    yield self.order[a[apart]], self.order[b[apart]]
                continue
            below = len(self.levels[level - 1][0])
            fan = np.arange(_FAN)
            left = np.repeat(a * _FAN, _FAN * _FAN) + np.tile(np.repeat(fan, _FAN), len(a))
            right = np.repeat(b * _FAN, _FAN * _FAN) + np.tile(np.tile(fan, _FAN), len(a))
            inside = (left < below) & (right < below) & (left <= right)
            stack.append((level - 1, left[inside], right[inside]))


def _linking(max_bits: int):
    """mapInArrow function over rows (segment, part, home, x) sorted by segment and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        segment = table["segment"].to_numpy()
        part = table["part"].to_numpy()
        home = table["home"].to_numpy(zero_copy_only=False)
        x = table["x"].to_numpy().view(np.uint64)
        bits = 64 // (max_bits + 1)
        for s in np.unique(segment):
            whole = np.flatnonzero(segment == s)
            plain = whole[part[whole] < 0]
            parts = [plain, *(whole[part[whole] == p] for p in np.unique(part[whole][part[whole] >= 0]))]
            for rows in parts:
                if len(rows) < 2:
                    continue
                own, is_home = x[rows], home[rows]
                forest = Forest(len(own))
                for a, b in GrayTree(rotate(own, int(s) * bits)).close_pairs(bits, max_bits):
                    mine = is_home[a] | is_home[b]
                    forest.add(a[mine], b[mine])
                if forest.links:
                    a, b = np.array(forest.links).T
                    yield pa.RecordBatch.from_pydict({"a": pa.array(own[a].view(np.int64)), "b": pa.array(own[b].view(np.int64))})

    return run


def _masks(bits: int, most: int) -> list[int]:
    """All patterns of ``bits`` bits with at most ``most`` set."""
    return [sum(1 << i for i in places) for k in range(most + 1) for places in itertools.combinations(range(bits), k)]


def close_fingerprints(distinct: DataFrame, max_bits: int = MAX_BITS, max_group: int = MAX_GROUP) -> DataFrame:
    """(a, b): links that connect what fingerprints within ``max_bits`` connect. ``distinct`` has x (long)."""
    segments = max_bits + 1
    bits = 64 // segments
    spark = distinct.sparkSession
    keys = [F.shiftrightunsigned("x", 64 - bits * (s + 1)).bitwiseAND((1 << bits) - 1).cast("int") for s in range(segments)]
    rows = distinct.select("x", F.posexplode(F.array(*keys)).alias("segment", "value"))
    counts = rows.groupBy("segment", "value").count().where(F.col("count") > max_group)
    if counts.isEmpty():
        dealt = rows.select("segment", "value", F.lit(-1).alias("part"), F.lit(True).alias("home"), "x")
    else:
        # ``deeper`` further bits make parts of about max_group; they lie right after the segment, cyclically.
        hot = counts.select("segment", "value", F.greatest(F.lit(1), F.least(F.lit(12), F.ceil(F.log2(F.col("count") / max_group)) + 1)).cast("int").alias("deeper"))
        near = spark.createDataFrame(
            [(n, m) for n in range(1, 13) for m in _masks(n, max_bits)], "deeper int, flip int"
        )
        cyclic = F.lit(None).cast("long")
        for s in range(segments):
            left = bits * (s + 1) % 64
            turned = F.col("x") if not left else F.shiftleft("x", left).bitwiseOR(F.shiftrightunsigned("x", 64 - left))
            cyclic = F.when(F.col("segment") == s, turned).otherwise(cyclic)
        split = (
            rows.join(hot, ["segment", "value"])
            .withColumn("own", F.shiftrightunsigned(cyclic, 52).cast("int"))
            .withColumn("own", F.expr("shiftright(own, 12 - deeper)"))
            .join(F.broadcast(near), "deeper")
            .select("segment", "value", F.col("own").bitwiseXOR(F.col("flip")).alias("part"), (F.col("flip") == 0).alias("home"), "x")
        )
        plain = rows.join(hot, ["segment", "value"], "left_anti").select("segment", "value", F.lit(-1).alias("part"), F.lit(True).alias("home"), "x")
        dealt = plain.unionByName(split)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(partitions, "segment", "value", "part").select("segment", "part", "home", "x").mapInArrow(_linking(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, max_group: int = MAX_GROUP) -> DataFrame:
    """(doc_id, simhash, component_id) for each row of ``docs`` (doc_id, text)."""
    prints = materialize(with_fingerprints(docs.select("doc_id", "text")))
    classes = materialize(prints.groupBy(F.col("simhash").alias("x")).agg(F.min("doc_id").alias("first")))
    labels = connected_components(close_fingerprints(classes.select("x"), max_bits, max_group))
    rooted = classes.join(labels, classes["x"] == labels["node"], "left").select(
        "x", "first", F.coalesce("component", "x").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("x").alias("simhash"), "component_id")
    return prints.join(named, "simhash").select("doc_id", "simhash", "component_id")


def keep_one_of_each(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with the least doc_id of their component; one row of those that share it.

    Rows with a null doc_id are kept: nothing tells which of them came first. Ids decide
    before texts move: only repeated ids take their texts through an aggregate.
    """
    first = F.col("doc_id") == F.col("component_id")
    ids = materialize(
        near_duplicates(docs, max_bits).where("doc_id is not null").groupBy("doc_id")
        .agg(F.bool_or(first).alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    )
    left = docs.join(ids.where("not stays").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    again = ids.where("stays").select("doc_id")
    if again.isEmpty():
        return left
    repeated = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(repeated)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id"
    )
