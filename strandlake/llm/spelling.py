"""Spelling variants of a corpus' words, grouped without making pairs.

Words are one code point apart by replacement if they agree in the pattern that has a
wildcard at that place, by insertion or deletion if one is the other without a code
point. So each word of the vocabulary sends one row for each place and pattern
(prefix * suffix), one for each distinct word it becomes by a deletion, and one for
itself; rows meet by that key in a single shuffle. A pattern's group keeps its size and
its two words of greatest count: all but the word itself are its near words, and the
first that is not the word is the best of them. A deletion's group holds the
vocabulary's word of that spelling, if any, next to the longer words it comes from.
Since a place has no more than 90 letters, a group has at most 90 rows for each place of
its key, whatever the corpus. What groups tell is added up for each word.

A word's form is its near word of greatest count (ties: least in code-point order) if
that is at least ``RATIO`` times its own. Counts rise tenfold along forms, so roots are
found by a few rounds of joins that double the way each time.

Words here are maximal runs of ASCII and Latin-1 letters, A-Z lower-cased. Defined
results: null and empty texts have no words; repeated rows count each time; a null doc_id
gives a null hash, so no letter is dropped from its words; texts are read whole by
built-in functions; an empty table gives an empty table; only id and text are read, so
other columns cannot clash. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.storage import materialize, spread

LEAST_LETTERS, LEAST_COUNT, RATIO, DROP_ONE_IN = 7, 2, 10, 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LETTERS  # a shorter run gives no word


def _without(word: Column, place: Column) -> Column:
    """``word`` without its code point at ``place`` (from 1)."""
    return F.concat(F.substring(word, F.lit(1), place - 1), F.substring(word, place + 1, F.length(word)))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_one_in: int | None = DROP_ONE_IN, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``LEAST_LETTERS`` that occur ``least_count`` times.

    With ``drop_one_in``, runs whose CRC32 with their doc_id it divides lose a code point first.
    """
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if drop_one_in:
        words = words.withColumn("h", F.crc32(F.concat(F.col("id").cast("string"), F.lit(":"), "word").cast("binary")))
        dropped = _without(F.col("word"), (F.col("h") % F.length("word")).cast("int") + 1)
        words = words.select(F.when(F.col("h") % drop_one_in == 0, dropped).otherwise(F.col("word")).alias("word"))
    counted = words.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _keys(words: DataFrame) -> DataFrame:
    """(key, deleted, word, n): a word's patterns, what deletions make of it, and itself.

    ``deleted`` is null for patterns and tells deletions from words themselves. Deleting
    any letter of a run of equal ones gives the same word, so only the first counts.
    """
    placed = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("place"))
    word, place = F.col("word"), F.col("place")
    before, after = F.substring(word, F.lit(1), place - 1), F.substring(word, place + 1, F.length(word))
    repeats = (place > 1) & (F.substring(word, place, F.lit(1)) == F.substring(word, place - 1, F.lit(1)))
    long_enough = (F.length(word) > LEAST_LETTERS) & ~repeats
    rows = F.when(place == 0, F.array(F.struct(word.alias("key"), F.lit(False).alias("deleted")))).otherwise(
        F.concat(
            F.array(F.struct(F.concat(before, F.lit("*"), after).alias("key"), F.lit(None).cast("boolean").alias("deleted"))),
            F.when(long_enough, F.array(F.struct(F.concat(before, after).alias("key"), F.lit(True).alias("deleted")))).otherwise(F.array()),
        )
    )
    return placed.select("word", "n", F.explode(rows).alias("row")).select("row.key", "row.deleted", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best, best_n): how many words are near each, and the one of greatest count."""
    by_count = Window.partitionBy("key").orderBy(F.col("deleted").asc(), F.col("n").desc(), F.col("word").asc())
    whole = by_count.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct("n", "word", "deleted")
    grouped = _keys(words).select(
        "*", F.count("*").over(whole).alias("size"), F.first(one).over(whole).alias("first"), F.nth_value(one, 2).over(whole).alias("second")
    )
    pattern, own, found = F.col("deleted").isNull(), ~F.col("deleted"), ~F.col("first.deleted")
    # A group of a deletion leads with the vocabulary's own word, if there is one; then come the words it is a deletion of.
    told = grouped.where((F.col("size") > 1) & (pattern | found)).select(
        "word",
        F.when(pattern | own, F.col("size") - 1).otherwise(1).alias("near"),
        F.when(own | (pattern & (F.col("first.word") == F.col("word"))), F.col("second")).otherwise(F.col("first")).alias("best"),
    )
    least = told.groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word"))).alias("best")
    )
    return words.join(least, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.word").alias("best"), (-F.col("best.n")).alias("best_n")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form (word, form), each followed to the last."""
    while True:
        above = forms.select(F.col("word").alias("form"), F.col("form").alias("above"))
        after = materialize(forms.join(above, "form", "left").select("word", F.coalesce("above", "form").alias("form"), F.col("above").isNotNull().alias("moved")))
        forms = after.select("word", "form")
        if after.where("moved").isEmpty():
            return forms.withColumnRenamed("form", "root")


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n)."""
    near = near_words(words)
    told = materialize(near.select(
        "word", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")).alias("form"), "n", "n_near",
        F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best_n")).alias("form_n"),
    ))
    roots = _roots(told.where("form is not null").select("word", "form"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return spelling_variants(materialize(vocabulary(docs)))


OP13_SQL = f"""
WITH RECURSIVE table_ AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b)),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
spelled AS (SELECT run, n, hex(encode(doc_id || ':' || run)) AS x FROM counted),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS h
  FROM spelled, table_),
kept AS (
  SELECT CASE WHEN h IS NOT NULL AND h % {DROP_ONE_IN} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
vocab AS (SELECT word, sum(n)::BIGINT AS n FROM kept WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
keys AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS wild, left(word, i - 1) || substr(word, i + 1) AS cut FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
cuts AS (SELECT DISTINCT word, n, cut FROM keys),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM keys a JOIN keys b ON a.wild = b.wild AND a.word <> b.word
  UNION ALL SELECT c.word, v.word, v.n FROM cuts c JOIN vocab v ON c.cut = v.word
  UNION ALL SELECT v.word, c.word, c.n FROM cuts c JOIN vocab v ON c.cut = v.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS top, arg_min(other, {{'m': -m, 'w': other}}) AS other FROM near GROUP BY word),
told AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= {RATIO} * n THEN other END AS form, CASE WHEN top >= {RATIO} * n THEN top END::BIGINT AS form_n
  FROM vocab LEFT JOIN best USING (word)),
way AS (SELECT word, word AS root, form AS next FROM told UNION ALL SELECT way.word, told.word, told.form FROM way JOIN told ON told.word = way.next)
SELECT told.word, told.form, way.root, told.n, told.n_near, told.form_n FROM told JOIN way ON way.word = told.word AND way.next IS NULL
"""
