"""Language ID: script ranges narrow the candidates, then Viterbi labels spans.

A word's script leaves the languages that training texts wrote in it. Each word is
then scored by the log probabilities of its byte 2-, 3- and 4-grams under every
candidate; Viterbi over the words of a text, with a penalty for each switch of
language, labels spans of mixed-language text. The predicted language is the one
whose spans hold most bytes, and the score is its share of them.

The model is learned in Spark from labelled rows that are not held out, sampled by
a hash of doc_id down to about ``TRAIN_ROWS`` for each language; what reaches the
driver is one row for each language and hashed n-gram.

Defined results: ``und`` with score 0 for a null text, a text without a letter,
or if nothing was learned; ties go to the language that sorts first; a word in a
script no language was seen in leaves all languages; repeated rows are judged one by
one; an empty table gives an empty table; columns named as the output's are replaced.
A text is labelled whole: memory grows with the longest one, about a hundred bytes
for each of its words and ten for each of its bytes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.textblocks import Words, lean, runs, slices, word_grams
from strandlake.storage import spread

FEATURES = 1 << 16
ORDERS = (2, 3, 4)
TRAIN_ROWS = 2_000
SWITCH_PENALTY = 12.0
WORD_LIMIT = 6.0
UNKNOWN = "und"
_WORDS_AT_ONCE = 400_000

# First code points of blocks of scripts; a block lasts to the next start.
SCRIPT_STARTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB10, "other"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"), (0x30000, "other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_FROM = np.array([x for x, _ in SCRIPT_STARTS])
_SCRIPT = np.array([SCRIPTS.index(x) for _, x in SCRIPT_STARTS])
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters (Unicode general category L), built once."""
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions of characters and their code points."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int64)
    more = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64) & 0x3F
    two, three, four = lead >= 0xC0, lead >= 0xE0, lead >= 0xF0
    cp = lead
    one, b, c = more[at + 1], more[at + 2], more[at + 3]
    cp = np.where(two, ((lead & 0x1F) << 6) | one, cp)
    cp = np.where(three, ((lead & 0x0F) << 12) | (one << 6) | b, cp)
    cp = np.where(four, ((lead & 0x07) << 18) | (one << 12) | (b << 6) | c, cp)
    return at, np.minimum(cp, 0x10FFFF)


class Graded:
    """Words of a slice with the script of their first letter (-1: none) and their hashed n-grams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = words = Words(data, offsets)
        n = len(words.starts)
        if (data < 0x80).all():
            at, cp = np.arange(len(data)), data
        else:
            at, cp = _code_points(data)
        is_letter = letter_table()[cp]
        at, cp = at[is_letter], cp[is_letter]
        first = np.searchsorted(at, words.starts)
        has = np.zeros(n, bool)
        inside = first < len(at)
        has[inside] = at[first[inside]] < words.ends[inside]
        self.script = np.full(n, -1)
        self.script[has] = _SCRIPT[np.searchsorted(_FROM, cp[first[has]], "right") - 1]
        self.size = np.where(has, words.ends - words.starts, 0)

    def grams(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order: hashed features at the byte places of lettered words, and which apply."""
        self.kept = kept = np.flatnonzero(self.script >= 0)
        words = self.words
        self.begin, found = word_grams(words.data, words.starts[kept], words.ends[kept], ORDERS, FEATURES)
        return found


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    def __init__(self, langs: list[str], log_p: np.ndarray, scripts: np.ndarray):
        self.langs, self.log_p, self.scripts = langs, log_p, scripts


def _counting(langs: list[str]):
    """mapInArrow function: (lang, feature, n) counts of labelled texts; scripts count as features from FEATURES on."""
    number = {x: k for k, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), FEATURES + len(SCRIPTS)), np.int64)
        for batch in batches:
            label = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for at, to, data, offsets in slices(batch.column("text")):
                graded = Graded(data, offsets)
                of_word = label[at:to][graded.words.text_of_word()]
                lettered = graded.script >= 0
                np.add.at(counts, (of_word[lettered], FEATURES + graded.script[lettered]), 1)
                for feature, applies in graded.grams():
                    length = np.diff(np.r_[graded.begin, len(feature)])
                    lang = np.repeat(of_word[graded.kept], length)
                    flat = np.bincount(lang[applies] * FEATURES + feature[applies], minlength=len(langs) * FEATURES)
                    counts[:, :FEATURES] += flat.reshape(len(langs), FEATURES)
        lang, feature = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.int32()), "feature": pa.array(feature, pa.int32()), "n": pa.array(counts[lang, feature])})

    return run


def train(docs: DataFrame, rows_per_lang: int = TRAIN_ROWS) -> Model:
    """Learn from rows of (doc_id, text, lang) that have a language and are not held out."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, FEATURES), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    every = F.create_map(*[F.lit(y) for x in langs for y in (x, max(1, sizes[x] // rows_per_lang))])
    sample = learn.where(F.pmod(F.xxhash64("doc_id"), every[F.col("lang")]) == 0).select("lang", "text")
    counted = sample.mapInArrow(lean(_counting(langs)), "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    got = counted.toPandas()  # at most languages x (FEATURES + scripts) rows
    counts = np.zeros((len(langs), FEATURES + len(SCRIPTS)))
    counts[got["lang"], got["feature"]] = got["n"]
    grams, scripts = counts[:, :FEATURES] + 0.5, counts[:, FEATURES:]
    log_p = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)
    share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return Model(langs, np.ascontiguousarray(log_p), (share > 1e-3).T)


def word_scores(model: Model, graded: Graded) -> np.ndarray:
    """(words, languages): log likelihood below the best candidate's, at most WORD_LIMIT; -inf where the script excludes a language, 0 for words without letters."""
    out = np.zeros((len(graded.words.starts), len(model.langs)), np.float32)
    total = None
    for feature, applies in graded.grams():
        part = model.log_p[feature]
        part[~applies] = 0
        total = part if total is None else total + part
    if total is None or not len(total):
        return out
    scores = np.add.reduceat(total, graded.begin, axis=0)
    fits = model.scripts[graded.script[graded.kept]]
    fits |= ~fits.any(axis=1, keepdims=True)  # a script no language was seen in leaves all
    scores = np.where(fits, scores, -np.inf)
    scores = np.maximum(scores - scores.max(axis=1, keepdims=True), np.float32(-WORD_LIMIT))
    out[graded.kept] = np.where(fits, scores, -np.inf)  # no span of an excluded language holds the word
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best language of each word; text d has words first[d] to first[d + 1]. All texts step together."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, length = first[:-1][order], length[order]
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
    best_before = np.zeros(len(scores), np.int16)
    switched = np.zeros(scores.shape, bool)
    value = np.zeros((len(order), scores.shape[1]), np.float32)
    for t, n in enumerate(active):
        at = begin[:n] + t
        if t == 0:
            value[:n] = scores[at]
            continue
        now = value[:n]
        top = now.max(axis=1, keepdims=True) - np.float32(penalty)
        best_before[at] = now.argmax(axis=1)
        switched[at] = now < top
        value[:n] = np.maximum(now, top) + scores[at]
    label = np.zeros(len(scores), np.int16)
    current = value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        label[at] = current[:n]
        if t:
            current[:n] = np.where(switched[at, current[:n]], best_before[at], current[:n])
    return label


def _predicting(model: Model, kept: list[str], spans: bool):
    def finish(held):
        scores = np.concatenate([x[0] for x in held])
        size = np.concatenate([x[1] for x in held])
        first = np.r_[0, np.cumsum(np.concatenate([x[2] for x in held]))]
        label = viterbi(scores, first)
        texts = len(first) - 1
        of_text = np.repeat(np.arange(texts), np.diff(first))
        n = len(model.langs)
        bytes_in = np.bincount(of_text * n + label, weights=size, minlength=texts * n).reshape(texts, n)
        total = bytes_in.sum(axis=1)
        pick = bytes_in.argmax(axis=1)
        known = total > 0
        names = np.array([*model.langs, UNKNOWN], object)[np.where(known, pick, n)]
        share = np.where(known, bytes_in[np.arange(texts), pick] / np.maximum(total, 1), 0.0)
        labelled = []
        if spans:
            for a, b in zip(first[:-1], first[1:], strict=True):
                own = label[a:b]
                labelled.append([{"first_word": int(c), "n_words": int(e - c), "lang": model.langs[own[c]]} for c, e in zip(*runs(own), strict=True)])
        return names.tolist(), share, labelled

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, share, labelled, held, n_words = [], [], [], [], 0

            def flush():
                a, b, c = finish(held)
                names.extend(a)
                share.extend(b)
                labelled.extend(c)
                held.clear()

            if model.langs:
                for _, _, data, offsets in slices(batch.column("text")):
                    graded = Graded(data, offsets)
                    held.append((word_scores(model, graded), graded.size, graded.words.count))
                    n_words += len(graded.size)
                    if n_words > _WORDS_AT_ONCE:
                        flush()
                        n_words = 0
                if held:
                    flush()
            else:
                names, share, labelled = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows, [[]] * batch.num_rows
            columns = {c: batch.column(c) for c in kept}
            columns |= {"lang_pred": pa.array(names, pa.string()), "lang_score": pa.array(np.asarray(share, float), pa.float64())}
            if spans:
                columns["lang_spans"] = pa.array(labelled, pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())])))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def identify(docs: DataFrame, model: Model, keep_text: bool = True, spans: bool = False) -> DataFrame:
    """``docs`` plus lang_pred and lang_score, and with ``spans`` lang_spans (first word, words, language).

    Only ``text`` is read for a prediction. Columns of the output's names are replaced, others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages floats
    docs = docs.drop("lang_pred", "lang_score", "lang_spans")
    kept = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string, lang_score double"])
    schema += ", lang_spans array<struct<first_word:int,n_words:int,lang:string>>" * spans
    names = [f.name for f in kept]

    def run(batches):
        yield from _predicting(shared.value, names, spans)(batches)

    return docs.mapInArrow(lean(run), schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    model = train(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model, keep_text=False).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
