"""Document fingerprints: Order MinHash in DataFrame functions only.

A text's k-mers (of ``K`` words, or of characters) are numbered by occurrence and
hashed with that number. One random order of the hashes, read as a circle from
``SKETCHES`` equally spaced starts, stands for as many orders: each start takes the
``TUPLE`` least k-mers that follow it, puts them back in text order and hashes the
tuple. Repeats and order both matter, so the share of equal entries follows edit
distance and not only common content.

No row leaves its task for this: a text's k-mers are arrays that are sorted once.
Whole texts are read. Hashes inside a text keep 38 bits beside a 25-bit position,
room for 33 million k-mers; the row size Spark allows ends well before that.

Defined results: a null text is the empty text, whose entries are all zero, so
empty texts are alike; a text with fewer units than ``K`` is one k-mer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.textblocks import unlike
from strandlake.storage import spread

K, TUPLE, SKETCHES = 3, 2, 64
_POSITION_BITS, _HASH_BITS = 25, 38
_WORDS = r"[ \t\n\x0B\f\r]+"
#: Range buckets for each shuffle partition when each document meets the next.
BUCKETS_PER_PARTITION = 4


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though it is used in lambdas."""
    return F.transform(F.array(value), body)[0]


def _units(text: Column, unit: str) -> Column:
    if unit == "char":
        return F.filter(F.split(text, ""), lambda c: c != "")
    return F.filter(F.split(text, _WORDS), lambda w: w != "")


def _kmers(units: Column, k: int) -> Column:
    """The hash of each k-mer beside its position, least hash first."""

    def key(w: Column, i: Column) -> Column:
        h = F.xxhash64(w, *[F.get(units, i + j) for j in range(1, k)])
        return F.shiftleft(F.shiftrightunsigned(h, 64 - _HASH_BITS), _POSITION_BITS).bitwiseOR(i)

    usable = F.greatest(F.size(units) - (k - 1), F.least(F.size(units), F.lit(1)))
    return F.array_sort(F.slice(F.transform(units, key), 1, usable))


def _numbered(s: Column) -> Column:
    """Occurrence-numbered k-mers of sorted keys: the n-th repeat of a k-mer gets a hash of its own."""

    def hash_of(x: Column) -> Column:
        return F.shiftrightunsigned(x, _POSITION_BITS)

    def again(i: Column) -> Column:
        return hash_of(s[i]) == hash_of(s[i - 1])

    def rehashed(r: Column) -> Column:
        # r holds the places of repeats; a run of consecutive places is one k-mer
        starts = F.filter(
            F.sequence(F.lit(0), F.size(r) - 1),
            lambda j: (j == 0) | (r[j] != F.get(r, j - 1) + 1) | (hash_of(s[r[j]]) != hash_of(F.get(s, F.get(r, j - 1)))),
        )

        def numbered(b: Column) -> Column:
            return F.flatten(
                F.transform(
                    b,
                    lambda first, m: F.transform(
                        F.sequence(first, F.coalesce(F.get(b, m + 1), F.size(r)) - 1),
                        lambda j: F.shiftleft(
                            F.shiftrightunsigned(F.xxhash64(hash_of(s[r[j]]), j - first + 1), 64 - _HASH_BITS), _POSITION_BITS
                        ).bitwiseOR(s[r[j]].bitwiseAND((1 << _POSITION_BITS) - 1)),
                    ),
                )
            )

        return _let(starts, numbered)

    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: (i < F.size(s)) & again(i))

    def all_of(r: Column) -> Column:
        firsts = F.filter(s, lambda x, i: (i == 0) | (hash_of(x) != hash_of(F.get(s, i - 1))))
        return F.when(F.size(r) == 0, s).otherwise(F.array_sort(F.concat(firsts, rehashed(r))))

    return _let(places, all_of)


def _entries(e: Column, sketches: int, size: int) -> Column:
    """The tuple hash from each start on the circle of sorted numbered k-mers."""
    width = _HASH_BITS + _POSITION_BITS - (sketches - 1).bit_length()
    mask = (1 << _POSITION_BITS) - 1

    def sector(x: Column) -> Column:
        return F.shiftrightunsigned(x, width).cast("int")

    firsts = F.filter(
        F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | (sector(e[i]) != sector(F.get(e, i - 1)))
    )

    def place_of_start(f: Column) -> Column:
        # every start up to a k-mer's sector, after the sector before, is followed by that k-mer
        filled = F.flatten(
            F.transform(
                f,
                lambda i, m: F.array_repeat(
                    i, sector(e[i]) - F.when(m == 0, F.lit(-1)).otherwise(sector(F.get(e, F.get(f, m - 1))))
                ),
            )
        )
        return F.concat(filled, F.array_repeat(F.lit(0), F.lit(sketches) - F.size(filled)))

    def tuple_hash(i: Column) -> Column:
        taken = [F.get(e, F.pmod(i + j, F.size(e))) for j in range(size)]
        by_place = F.array_sort(
            F.array(*[
                F.when(F.lit(j) < F.size(e), F.shiftleft(x.bitwiseAND(mask), _HASH_BITS).bitwiseOR(F.shiftrightunsigned(x, _POSITION_BITS)))
                for j, x in enumerate(taken)
            ])
        )
        hashes = F.transform(by_place, lambda x: x.bitwiseAND((1 << _HASH_BITS) - 1))
        return F.xxhash64(hashes).bitwiseAND(0xFFFF).cast("int")

    return _let(firsts, lambda f: F.transform(_let(F.array(f), lambda g: place_of_start(g[0])), tuple_hash))


def signature(text: Column, k: int = K, size: int = TUPLE, sketches: int = SKETCHES, unit: str = "word") -> Column:
    """array<int> of ``sketches`` 16-bit entries. ``sketches`` is a power of two."""
    if sketches & (sketches - 1):
        raise ValueError("sketches must be a power of two")
    empty = F.array_repeat(F.lit(0), sketches)
    units = _units(F.coalesce(text, F.lit("")), unit)
    return _let(
        units,
        lambda u: F.when(F.size(u) == 0, empty).otherwise(
            _let(_kmers(u, k), lambda s: _let(_numbered(s), lambda e: _entries(e, sketches, size)))
        ),
    )


def fingerprint(entries: Column) -> Column:
    """A signature as hex digits, four for each entry."""
    return F.array_join(F.transform(entries, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")


def likeness(a: Column, b: Column, sketches: int = SKETCHES) -> Column:
    """The share of equal entries."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(sketches))


def with_next(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``docs`` plus ``next_<column>`` of the row that follows by ``id_col``; the first follows the last.

    Ids are cut into ranges at ids that exist; the first row of a range is also sent
    to the range before, so each range finds its rows' followers by itself. Rows with
    equal ids follow each other in order of ``columns``; null ids come first.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[f"next_{c}" for c in columns])
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).alias("i"))
    least = ids.agg(F.min("i"), F.count(F.when(F.col("i").isNull(), 1)).alias("nulls")).first()
    cuts = ids.where("i is not null").approxQuantile("i", [j / buckets for j in range(1, buckets)], 0.2 / buckets) if least[0] is not None else []
    cuts = sorted({int(c) for c in cuts} - {least[0]})  # a number of bounds that the partitions fix
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    i = F.col(id_col).cast("long")
    bucket = F.coalesce(F.size(F.filter(bounds, lambda c: c <= i)), F.lit(0))
    first = i.isNull() if least["nulls"] else i == F.lit(least[0]).cast("long")
    starts_range = F.coalesce(F.array_contains(bounds, i), F.lit(False))
    homes = F.array(
        F.struct(bucket.alias("bucket"), F.lit(0).alias("guest")),
        F.when(starts_range, F.struct((bucket - 1).alias("bucket"), F.lit(1).alias("guest"))),
        F.when(F.coalesce(first, F.lit(False)), F.struct(F.lit(len(cuts)).alias("bucket"), F.lit(2).alias("guest"))),
    )
    (home,) = unlike(docs.columns, "__home")
    placed = docs.withColumn(home, F.explode(F.filter(homes, lambda h: h.isNotNull())))
    order = Window.partitionBy(f"{home}.bucket").orderBy(f"{home}.guest", F.col(id_col).asc_nulls_first(), *[F.col(c) for c in columns])
    told = placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return told.where(f"{home}.guest = 0").drop(home)


def with_signatures(docs: DataFrame, text_col: str = "text", **sizes) -> DataFrame:
    """``docs`` plus its Order MinHash entries and fingerprint; columns of those names are replaced."""
    signed = docs.drop("order_minhash", "fingerprint").withColumn("order_minhash", signature(F.col(f"`{text_col}`"), **sizes))
    return signed.withColumn("fingerprint", fingerprint(F.col("order_minhash")))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    signed = with_signatures(docs).withColumnRenamed("order_minhash", "own").drop("fingerprint")
    paired = with_next(signed, "doc_id", ["text", "own"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    judged = paired.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    judged = judged.withColumn("other", signature(F.col("edited")))
    return judged.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
