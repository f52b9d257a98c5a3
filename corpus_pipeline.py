"""From raw documents to training tokens: the stages, each written and reread as the next one's input.

language ID      rejects texts without a letter and texts no language holds half of
SimHash          keeps the first document of each group of near duplicates
substring dedup  cuts word windows that stand in an earlier document
mixing           samples documents towards target shares of sources, languages and topics
BPE              encodes whole texts and checks that decoding gives them back
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, language_id, mixing, simhash, substring_dedup
from strandlake.storage import drop_written, materialize, ship, spread, written

#: A document stays if its main language holds at least this share of its lettered words.
LEAST_SHARE = 0.5


def _like(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, in their order."""
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    told = language_id.identify(docs, model)
    return _like(told.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_score") >= LEAST_SHARE)), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like(simhash.keep_one_of_each(docs), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that loses words keeps the rest; one that loses all of them goes. n_chars follows the text."""
    cut = substring_dedup.remove_repeats(docs)
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return _like(left.withColumn("n_chars", F.length("text").cast("long")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like(mixing.sample_mixture(docs).where("mix_taken"), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids and whether the ids decode to the text."""
    encoded = bpe.encode_and_check(docs.select("doc_id", "source", "lang", "text"), bpe.vocabulary_file())
    return encoded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again.

    Null or empty texts and texts without a letter go with the first stage; rows that
    repeat a doc_id are one document from the second on; a null doc_id stays, as nothing
    tells what it repeats; an empty table gives an empty table; columns beside those of
    ``documents`` pass through to the last stage, which returns its own.
    """
    ship(spark)
    docs, mark = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), written()
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        drop_written(mark)  # what the stage read and wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
