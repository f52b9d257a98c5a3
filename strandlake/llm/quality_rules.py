"""Quality rules, line first: lines that fail are removed, then texts that lost too much are rejected.

A line (a stretch between \\n with a word) fails by

punctuation  no word of it ends a sentence, more than a quarter of its words end in doubled
             exclamation or question marks, or it has more symbols than half its words;
navigation   a fifth or more of its words are separators of menus, or ten or fewer words
             and a name of a menu's or button's entry between separators;
boilerplate  it names a licence, rights, cookies, terms, a login or a subscription, more than
             half of its words equal the word before, or the line is equal to an earlier one.

What stays is judged by its code points in words: a text that lost more than ``MOST_LOST``
percent of them is rejected. Before that stand the base rules: fewer than ``LEAST_WORDS``
words, or more than ``MOST_REPEATED`` percent of them in 8-word windows that the text
repeats. Windows are compared by numbers that equal sequences alone share, so no hash decides.

Defined results: a null text has no words and fails the base rules, and stays null; an
empty text likewise; repeated rows are judged one by one; an empty table gives an empty
table; columns named as the output's are replaced, all others pass. A text is read whole,
in about a hundred bytes for each of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.textblocks import Words, lean, slices
from strandlake.storage import spread

LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
MOST_LOST = 50
SYMBOLS = "#*$%&|<>"
_WORD = r"[^\x20\x09-\x0D]+"
_GAP = r"[\x20\x09-\x0D]"
SENTENCE_END = r"[.!?…。！？][\"')\]»“”’]*"
SHOUT = r"[!?][!?]+"
SEPARATOR = r"[|»›•·>/\\]+"
MENU_ENTRY = (
    r"(home|menu|about( us)?|contact( us)?|login|log in|sign in|sign up|register|search|next|previous|back to top|share|print|sitemap|read more)"
)
BOILERPLATE = (
    r"(all rights reserved|\(c\) [0-9]{4}|©|copyright|licensed under|released under the|public license|cookie|privacy policy|terms of (use|service)|"
    r"click here|read more|subscribe|newsletter|sign (in|up) (to|for|with)|log ?in to|enable javascript|lorem ipsum)"
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICTS = ("base_failed", "lost_chars", "kept")

_word, _end, _shout = re.compile(_WORD), re.compile(rf"{SENTENCE_END}(?={_GAP}|$)"), re.compile(rf"{SHOUT}(?={_GAP}|$)")
_separator = re.compile(rf"(?:^|(?<={_GAP})){SEPARATOR}(?={_GAP}|$)")
_symbol, _boilerplate = re.compile(f"[{re.escape(SYMBOLS)}]"), re.compile(BOILERPLATE)
_ALONE = rf"(?:^|[|»›•·>]){_GAP}*{MENU_ENTRY}{_GAP}*(?:[|»›•·>]|$)"
_entry = re.compile(_ALONE)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), np.uint8))


def line_fails(line: str, words: list[str]) -> str:
    """The rule that a line with these words fails, or nothing."""
    n_words = len(words)
    if not _end.search(line) or len(_shout.findall(line)) * 4 > n_words or len(_symbol.findall(line)) * 2 > n_words:
        return "punctuation"
    lowered = line.translate(_LOWER)
    if len(_separator.findall(line)) * 5 >= n_words or (n_words <= 10 and _entry.search(lowered)):
        return "navigation"
    again = sum(map(str.__eq__, words, words[1:]))
    return "boilerplate" if again * 2 > n_words or _boilerplate.search(lowered) else ""


def clean_lines(text: str) -> tuple[str, int, int]:
    """What is left of a text, how many lines with a word repeat an earlier one, and code points in words that went."""
    seen: set[str] = set()
    left, repeats, lost = [], 0, 0
    for line in text.split("\n"):
        words = _word.findall(line)
        if not words:
            left.append(line)
            continue
        again = line in seen
        seen.add(line)
        repeats += again
        if again or line_fails(line, words):
            lost += sum(map(len, words))
        else:
            left.append(line)
    return "\n".join(left), repeats, lost


def repeated_words(words: Words, n: int = WINDOW) -> np.ndarray:
    """For each text, how many of its words stand in an n-word window that it holds twice or more."""
    rank, text = words.ids(), words.text_of_word()
    span = 1
    while span < n and len(rank):  # numbers of windows of 1, 2, 4, ... words
        step = min(span, n - span)
        pair = rank[: max(0, len(rank) - step)] * (int(rank.max()) + 1) + rank[step:]
        rank, span = np.unique(pair, return_inverse=True)[1], span + step
    counts = np.zeros(len(words.count), np.int64)
    if len(rank):
        starts = np.flatnonzero(text[: len(rank)] == text[n - 1 :])
        same = np.unique(rank[starts] * len(counts) + text[starts], return_inverse=True, return_counts=True)
        twice = starts[same[2][same[1]] > 1]
        change = np.zeros(len(text) + 1, np.int64)
        change[twice] += 1
        change[twice + n] -= 1
        counts = np.bincount(text[np.cumsum(change)[:-1] > 0], minlength=len(counts))
    return counts


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between each two offsets."""
    return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][offsets])


def judge(docs: DataFrame, text_col: str = "text", keep_text: bool = True, most_lost: int = MOST_LOST) -> DataFrame:
    """``docs`` with failing lines removed from its text, plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (of the text as it was), base_failed, lost_chars and kept. Without ``keep_text`` the text goes."""
    new = {*COUNTS, *VERDICTS}
    kept = [f for f in docs.schema.fields if f.name.lower() not in new and f.name.lower() != text_col.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, parts, lost, texts = batch.column(text_col), {c: [] for c in COUNTS}, [], []
            for _, _, data, offsets in slices(column):
                words = Words(data, offsets)
                parts["n_words"].append(words.count)
                parts["word_chars"].append(_sums(words.solid & ((data & 0xC0) != 0x80), offsets))
                parts["n_symbols"].append(_sums(_IS_SYMBOL[data], offsets))
                parts["n_repeat_words"].append(repeated_words(words))
                raw = data.tobytes()
                cleaned = [clean_lines(raw[a:b].decode()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                parts["n_dup_lines"].append([c[1] for c in cleaned])
                lost += [c[2] for c in cleaned]
                texts += [c[0] for c in cleaned] if keep_text else []
            n = {c: np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for c, x in parts.items()}
            gone = np.array(lost, np.int64)
            failed = (n["n_words"] < LEAST_WORDS) | (100 * n["n_repeat_words"] > MOST_REPEATED * n["n_words"])
            columns = {f.name: batch.column(f.name) for f in kept}
            if keep_text:
                known = column.is_valid().to_pylist()
                columns[text_col] = pa.array([t if ok else None for t, ok in zip(texts, known, strict=True)], pa.string())
            columns |= {c: pa.array(x) for c, x in n.items()}
            columns |= {"base_failed": pa.array(failed), "lost_chars": pa.array(gone), "kept": pa.array(~failed & (100 * gone <= most_lost * n["word_chars"]))}
            yield pa.RecordBatch.from_pydict(columns)

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{text_col}` string"] * keep_text
    schema += [f"{c} long" for c in COUNTS] + ["base_failed boolean, lost_chars long, kept boolean"]
    return docs.mapInArrow(lean(run), ", ".join(schema))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return judge(docs, keep_text=False)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SYMBOL_SQL, _WORD_SQL = _quoted(f"[{re.escape(SYMBOLS)}]"), _quoted(_WORD)
OP11_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD_SQL}) AS words FROM documents),
windows AS (SELECT row, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w FROM (SELECT *, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM docs)),
twice AS (SELECT row, w FROM windows GROUP BY row, w HAVING count(*) > 1),
repeats AS (SELECT row, count(DISTINCT i + k) AS n FROM windows JOIN twice USING (row, w), range(0, {WINDOW}) t(k) GROUP BY row),
cut AS (SELECT row, string_split(text, chr(10)) AS lines FROM docs),
numbered AS (SELECT row, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM cut),
lines AS (SELECT *, regexp_extract_all(line, {_WORD_SQL}) AS ws, row_number() OVER (PARTITION BY row, line ORDER BY place) > 1 AS again FROM numbered),
counted AS (
  SELECT row, again, ws, line, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, len(ws) AS n,
    len(list_filter(ws, lambda w: regexp_matches(w, {_quoted(SENTENCE_END + "$")}))) AS ends, len(list_filter(ws, lambda w: regexp_matches(w, {_quoted(SHOUT + "$")}))) AS shouts,
    len(list_filter(ws, lambda w: regexp_full_match(w, {_quoted(SEPARATOR)}))) AS bars, len(regexp_extract_all(line, {_SYMBOL_SQL})) AS symbols,
    len(list_filter(ws, lambda w, i: i > 1 AND w = ws[i - 1])) AS doubled
  FROM lines WHERE len(ws) > 0),
judged AS (
  SELECT row, again, list_sum(list_transform(ws, lambda w: length(w))) AS chars,
    again OR ends = 0 OR shouts * 4 > n OR symbols * 2 > n OR bars * 5 >= n OR (n <= 10 AND regexp_matches(low, {_quoted(_ALONE)})) OR doubled * 2 > n
      OR regexp_matches(low, {_quoted(BOILERPLATE)}) AS fails
  FROM counted),
lost AS (SELECT row, coalesce(sum(chars) FILTER (fails), 0) AS lost, count(*) FILTER (again) AS dup FROM judged GROUP BY row),
told AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, {_SYMBOL_SQL}))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
    coalesce(lost, 0)::BIGINT AS lost_chars
  FROM docs LEFT JOIN repeats USING (row) LEFT JOIN lost USING (row))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * lost_chars <= {MOST_LOST} * word_chars AS kept FROM told
"""
