"""Substring dedup: word windows that already start in an earlier document are removed.

Level-wise doubling over window lengths ceil(n/2) and n. At the first level only
the content-defined anchors of a document are compared: of the half-length windows
inside each n-word window the one with the least hash. Equal n-word windows choose
equal anchors, so an anchor that stands in one document alone rules out every
n-word window that chose it. The windows whose anchor is repeated are extended to
n words and compared in full. Compared means: each map task first settles what its
own documents share and sends one (hash, smallest doc_id) entry for each distinct
window, packed into binary blocks by hash bucket; so a passage that stands in a
third of all documents costs one entry for each task, not one for each document.

Hashes are 64 bits. ``doc_id`` must be an integer. Defined results: a null text has
no words; a row with a null doc_id is neither earlier nor later than any other, so
it is left alone; rows that share a doc_id don't count as earlier than each other;
a document with fewer than n words has no window and stays whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.textblocks import Words, lean, mix64, runs, slices, unlike
from strandlake.storage import materialize

WINDOW_WORDS = 13
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = "bucket int, hashes binary, docs binary"
_ANSWER = "target int, hashes binary, docs binary"
_FOUND = "doc_id long, hashes binary"
_KEY, _MATCH, _HASHES = "__sd_key", "__sd_match", "__sd_hashes"


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each position on (the last n - 1 positions have none).

    A window is hashed from the hashes of its two halves, so no sequence of words collides
    by its form alone, as sums of powers do.
    """
    out, span = mix64(words), 1
    while span < n:
        step = min(span, n - span)
        at = max(0, len(out) - step)
        out = mix64(out[:at] * _STEP + out[step : step + at])
        span += step
    return out


def _anchors(h: np.ndarray, span: int) -> np.ndarray:
    """For each n-word window the position of the least of its ``span`` half windows (leftmost of equals)."""
    at = len(h) - span + 1
    best, where = h[:at].copy(), np.arange(at)
    for j in range(1, span):
        less = h[j : j + at] < best
        best[less] = h[j : j + at][less]
        where[less] = np.flatnonzero(less) + j
    return where


class _Slice:
    """Windows of the texts of one slice that lie within one text each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int):
        self.words = Words(data, offsets)
        self.hashes = self.words.digests()
        self.text = self.words.text_of_word()
        at = max(0, len(self.hashes) - n + 1)
        self.whole = self.text[:at] == self.text[n - 1 : n - 1 + at]  # by window start

    def anchors(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window starts, the word position of each one's anchor, and half-window hashes."""
        half = (n + 1) // 2
        h = window_hashes(self.hashes, half)
        if not self.whole.any():
            return np.empty(0, np.int64), np.empty(0, np.int64), h
        where = _anchors(h, n - half + 1)
        starts = np.flatnonzero(self.whole)
        return starts, where[starts], h


def _pack(found: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pd.DataFrame]:
    """Rows of one bucket each from (hash, doc) pairs, one for each distinct hash with the least doc."""
    if not found:
        return
    h, d = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    new = np.r_[True, h[1:] != h[:-1]][: len(h)]
    h, d = h[new], d[new]
    bucket = (h % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    h, d, bucket = h[order], d[order], bucket[order]
    cuts, ends = runs(bucket)
    yield pd.DataFrame({
        "bucket": bucket[cuts],
        "hashes": [h[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)],
        "docs": [d[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)],
    })


def _answers(docs: np.ndarray, hashes: np.ndarray, targets: int) -> pd.DataFrame:
    """Finds packed by the group that gathers those of a document."""
    target = docs % targets
    order = np.argsort(target, kind="stable")
    docs, hashes, target = docs[order], hashes[order], target[order]
    cuts, ends = runs(target)
    return pd.DataFrame({
        "target": target[cuts].astype(np.int32),
        "hashes": [hashes[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)],
        "docs": [docs[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)],
    })


def _gather(group: pd.DataFrame) -> pd.DataFrame:
    """One row for each document of a group, with its finds packed."""
    h, d = _settle(_unpack(group["hashes"]), np.frombuffer(b"".join(group["docs"]), np.int64))
    order = np.argsort(d, kind="stable")
    h, d = h[order], d[order]
    cuts, ends = runs(d)
    return pd.DataFrame({"doc_id": d[cuts], "hashes": [h[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]})


def _unpack(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint64)


def _resolving(only_later: bool, targets: int):
    """applyInPandas function for one bucket.

    For anchors: those that more than one task sent, with the documents that were
    sent. For windows: the sent documents that are not the first to have one. Local
    finds, in buckets below zero, pass.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        h, d = _unpack(group["hashes"]), np.frombuffer(b"".join(group["docs"]), np.int64)
        if group["bucket"].iloc[0] < 0:
            return _answers(d, h, targets)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.r_[True, h[1:] != h[:-1]]
        if only_later:
            found = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
        else:
            found = ~new | np.r_[~new[1:], False]
        return _answers(d[found], h[found], targets)

    return run


def _settle(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, doc) pairs, sorted by hash and doc."""
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])][: len(h)]
    return h[new], d[new]


def _compare(rows, buckets: int, only_later: bool) -> Iterator[pd.DataFrame]:
    """What a task's (hash, doc) pairs show by themselves, then the entries for others.

    Local finds have a bucket below zero.
    """
    h, d = _settle(*rows)
    if not len(h):
        return
    new = np.r_[True, h[1:] != h[:-1]]
    group = np.cumsum(new) - 1
    first = d[np.flatnonzero(new)]
    found = ~new if only_later else (np.bincount(group)[group] > 1)
    if found.any():
        local = _answers(d[found], h[found], buckets).rename(columns={"target": "bucket"})
        local["bucket"] = -1 - local["bucket"]
        yield local
    yield from _pack([(h[new], first)], buckets)


#: A task's pairs are settled and sent whenever it holds this many.
_HOLD = 1_500_000


def _collecting(pairs, buckets: int, only_later: bool):
    """mapInArrow function: ``pairs`` yields (hashes, docs) for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            rows = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            for out in _compare(rows, buckets, only_later):
                out["bucket"] = out["bucket"].astype(np.int32)
                for at in range(0, len(out), 2000):
                    yield pa.RecordBatch.from_pandas(out[at : at + 2000], preserve_index=False)

        for batch in batches:
            for h, d in pairs(batch):
                held.append((h, d))
                n += len(h)
                if n > _HOLD:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    return run


def _rows(batch: pa.RecordBatch, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Document ids and which of them are known."""
    ids = batch.column(_KEY).slice(at, to - at)
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False)


def _anchor_pairs(n: int):
    def pairs(batch: pa.RecordBatch):
        for at, to, data, offsets in slices(batch.column("text")):
            ids, known = _rows(batch, at, to)
            one = _Slice(data, offsets, n)
            starts, where, h = one.anchors(n)
            where = np.unique(where)
            where = where[known[one.text[where]]]
            yield h[where], ids[one.text[where]]

    return pairs


def _window_pairs(n: int):
    def pairs(batch: pa.RecordBatch):
        batch = batch.filter(batch.column(_HASHES).is_valid())
        packed = batch.column(_HASHES)
        for at, to, data, offsets in slices(batch.column("text")):
            ids, known = _rows(batch, at, to)
            mine = packed.slice(at, to - at)
            one = _Slice(data, offsets, n)
            starts, where, h = one.anchors(n)
            candidate = _among(h[where], one.text[starts], mine, known)
            starts = starts[candidate]
            yield window_hashes(one.hashes, n)[starts], ids[one.text[starts]]

    return pairs


def _among(h: np.ndarray, text: np.ndarray, packed: pa.Array, known: np.ndarray) -> np.ndarray:
    """Whether the hash at each place is among those packed for its text."""
    out = np.zeros(len(h), bool)
    bounds = np.searchsorted(text, np.arange(len(packed) + 1))
    for k in np.flatnonzero(packed.is_valid().to_numpy(zero_copy_only=False) & known):
        a, b = bounds[k], bounds[k + 1]
        if a < b:
            out[a:b] = np.isin(h[a:b], np.frombuffer(packed[k].as_buffer(), np.uint64))
    return out


def _remove(n: int, keep_text: bool, kept_columns: list[str]):
    """mapInArrow function: drops covered words; passes the other columns on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            packed = batch.column(_HASHES)
            for at, to, data, offsets in slices(batch.column("text")):
                _, known = _rows(batch, at, to)
                one = _Slice(data, offsets, n)
                starts = np.flatnonzero(one.whole)
                repeated = _among(window_hashes(one.hashes, n)[starts], one.text[starts], packed.slice(at, to - at), known)
                change = np.zeros(len(one.hashes) + n + 1, np.int64)
                np.add.at(change, starts[repeated], 1)
                np.add.at(change, starts[repeated] + n, -1)
                stays = np.cumsum(change)[: len(one.hashes)] == 0
                n_words.append(one.words.count)
                raw = data.tobytes()
                for k in range(to - at):
                    a, b = one.words.first[k], one.words.first[k + 1]
                    left = stays[a:b]
                    n_removed.append(int(b - a - left.sum()))
                    own = raw[offsets[k] : offsets[k + 1]]
                    if left.all():
                        joined = own if keep_text else b" ".join(own.split())
                    else:
                        joined = b" ".join(w for w, ok in zip(own.split(), left, strict=True) if ok)
                    kept.append(joined if keep_text else hashlib.sha256(joined).hexdigest())
            columns = {c: batch.column(c) for c in kept_columns}
            if keep_text:
                known_text = batch.column("text").is_valid().to_pylist()
                columns["text"] = pa.array([t.decode() if ok else None for t, ok in zip(kept, known_text, strict=True)], pa.string())
            columns["n_words"] = pa.array(np.concatenate(n_words) if n_words else [], pa.int64())
            columns["n_removed"] = pa.array(n_removed, pa.int64())
            if not keep_text:
                columns["kept_sha256"] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _compared(docs: DataFrame, pairs, buckets: int, only_later: bool) -> DataFrame:
    """(doc_id, hashes) of the pairs that are repeated (or not the first), one row for each document."""
    blocks = docs.mapInArrow(lean(_collecting(pairs, buckets, only_later)), _BLOCK)
    answers = blocks.groupBy("bucket").applyInPandas(_resolving(only_later, buckets), _ANSWER)
    return answers.groupBy("target").applyInPandas(_gather, _FOUND)


def remove_repeats(docs: DataFrame, n: int = WINDOW_WORDS, keep_text: bool = True) -> DataFrame:
    """``docs`` with the words covered by repeated windows removed from ``text``, plus n_words and n_removed.

    Columns of those names that ``docs`` has are replaced; all others pass through.

    With ``keep_text`` a changed text is its kept words joined by one space, and an
    unchanged one stays as it was. Without it, ``text`` gives way to kept_sha256,
    the SHA-256 of the kept words joined by one space.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = partitions  # of hashes, and of documents; each is one group
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    hidden = {c: unlike(docs.columns, c)[0] for c in docs.columns if c.lower() in (_KEY, _MATCH, _HASHES)}
    docs = docs.withColumnsRenamed(hidden).withColumn(_KEY, F.col("doc_id").cast("long"))
    candidates = materialize(_compared(docs.select(_KEY, "text"), _anchor_pairs(n), buckets, False))

    def beside(found: DataFrame) -> DataFrame:
        found = found.toDF(_MATCH, _HASHES)
        return by_doc.join(found, F.col(_KEY) == F.col(_MATCH), "left").drop(_MATCH)

    # Both joins read one exchange of the texts: the second level and the removal are one query.
    by_doc = docs.repartition(partitions, _KEY)
    joined = beside(_compared(beside(candidates), _window_pairs(n), buckets, True))
    kept = [f for f in joined.schema.fields if f.name not in (_HASHES, _KEY, "text")]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", text string" * keep_text
    out += ", n_words long, n_removed long" + ", kept_sha256 string" * (not keep_text)
    told = joined.mapInArrow(lean(_remove(n, keep_text, [f.name for f in kept])), out)
    return told.withColumnsRenamed({v: k for k, v in hidden.items()})


def _doubled_pairs(length: int):
    """Windows of twice ``length`` words whose halves are both repeated."""

    def pairs(batch: pa.RecordBatch):
        batch = batch.filter(batch.column(_HASHES).is_valid())
        packed = batch.column(_HASHES)
        for at, to, data, offsets in slices(batch.column("text")):
            ids, known = _rows(batch, at, to)
            one = _Slice(data, offsets, 2 * length)
            starts = np.flatnonzero(one.whole)
            halves = window_hashes(one.hashes, length)
            text, mine = one.text[starts], packed.slice(at, to - at)
            both = _among(halves[starts], text, mine, known) & _among(halves[starts + length], text, mine, known)
            starts = starts[both]
            yield window_hashes(one.hashes, 2 * length)[starts], ids[one.text[starts]]

    return pairs


def repeat_levels(docs: DataFrame, n: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, length, n_windows): how many distinct windows of n, 2n, 4n, ... words a document shares with others.

    Only windows whose halves are both repeated at one length are extended to twice
    that length, and the levels end when none survives.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias(_KEY), "text").repartition(partitions, _KEY)

    def beside(found: DataFrame) -> DataFrame:
        return docs.join(found.toDF(_MATCH, _HASHES), F.col(_KEY) == F.col(_MATCH), "left").drop(_MATCH)

    found = materialize(_compared(docs, _anchor_pairs(n), partitions, False))
    found = materialize(_compared(beside(found), _window_pairs(n), partitions, False))
    levels, length = [], n
    while not found.isEmpty():
        levels.append(found.select("doc_id", F.lit(length).alias("length"), (F.length("hashes") / 8).cast("long").alias("n_windows")))
        found = materialize(_compared(beside(found), _doubled_pairs(length), partitions, False))
        length *= 2
    if not levels:
        return docs.sparkSession.createDataFrame([], "doc_id long, length int, n_windows long")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, WINDOW_WORDS, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP7_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT row, doc_id, i, array_to_string(words[i:i + 12], ' ') AS w FROM (SELECT *, unnest(range(1, len(words) - 11)) AS i FROM docs)),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
gone AS (SELECT row, list(DISTINCT i + k) AS places FROM windows JOIN firsts USING (w), range(0, 13) t(k) WHERE first < doc_id GROUP BY row),
left_ AS (SELECT doc_id, words, list_filter(words, lambda x, i: places IS NULL OR NOT list_contains(places, i)) AS kept FROM docs LEFT JOIN gone USING (row))
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - len(kept))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM left_
"""
