"""Toxicity: a bidirectional GRU with attention pooling over character and word inputs.

A word's input is the embedding of its hash beside the summed embeddings of its hashed
byte 3-, 5- and 7-grams over the root of their number. Texts are cut into overlapping windows of ``WINDOW`` words,
one every ``STRIDE`` words; all windows are scored, and a document's score is that
of its highest window. The network is trained in numpy on the driver, on a sample
of labelled rows bounded by ``TRAIN_ROWS`` for each class and ``TRAIN_BYTES`` in all.

Labels belong to documents, not to windows, so training alternates: score the
windows of the sample, take the highest of each toxic document as toxic and the
highest of each clean one (and some at random) as clean, and fit those. The first
choice follows the log odds of words and n-grams, which also start one component
of the embeddings.

Defined results: a null or empty text has one empty window; without labels of both
classes all scores are 0. A doc_id with several labels counts as toxic if any is;
repeated rows are scored one by one; an empty table gives an empty table; a column
toxicity is replaced. A text is scored whole: memory grows with the longest one,
about three hundred bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.language_id import held_out
from strandlake.llm.textblocks import Words, lean, slices, word_grams
from strandlake.storage import materialize, spread

WINDOW, STRIDE = 16, 8
BUCKETS = 1 << 18
#: Hashes with an embedding of their own, chosen on the sample; the others share one.
MAX_WORDS, MAX_GRAMS, LEAST_TEXTS = 8_000, 24_000, 3
ORDERS = (3, 5, 7)
WORD_DIM = CHAR_DIM = HIDDEN = 8
TRAIN_ROWS, TRAIN_BYTES = 2_000, 6_000_000
#: Rounds of choosing windows; in each at least about STEPS steps are taken.
ROUNDS, STEPS, STEP_SIZE, BATCH, SEED = 8, 60, 0.02, 256, 7
_WORDY = np.zeros(256, bool)
_WORDY[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_WINDOWS_AT_ONCE = 8192


class Inputs:
    """Distinct words of a slice of texts with their features, and the windows over them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets)
        wordy = np.flatnonzero(_WORDY[data])
        # trim each word to its outermost letters, digits and non-ASCII bytes
        first, last = np.searchsorted(wordy, words.starts), np.searchsorted(wordy, words.ends) - 1
        solid = last >= first
        text = words.text_of_word()[solid]
        self.count = np.bincount(text, minlength=len(words.count))
        starts, ends = wordy[first[solid]], wordy[last[solid]] + 1
        words.starts, words.ends = starts, ends
        hashes = words.hashes(lower=True)
        self.hash, one, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        self.bucket = (self.hash >> np.uint64(20)).astype(np.int64) % BUCKETS
        begin, found = word_grams(data, starts[one], ends[one], ORDERS, BUCKETS)
        lengths = np.diff(np.r_[begin, len(found[0][0])]) if found else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(one)), lengths)
        self.gram = np.concatenate([f[ok].astype(np.int32) for f, ok in found])
        self.owner = np.concatenate([owner[ok].astype(np.int32) for _, ok in found])
        del found, owner
        order = np.argsort(self.owner, kind="stable")
        self.gram, self.owner = self.gram[order], self.owner[order]
        self.n_grams = np.bincount(self.owner, minlength=len(one))
        self.first = np.r_[0, np.cumsum(self.count)]
        n = np.maximum(1, -(-(self.count - WINDOW) // STRIDE) + 1)
        self.window_text = np.repeat(np.arange(len(n)), n)
        self.window_first = np.r_[0, np.cumsum(n)]
        step = np.arange(len(self.window_text)) - np.repeat(self.window_first[:-1], n)
        self.window_start = self.first[self.window_text] + step * STRIDE
        self.window_size = np.minimum(WINDOW, self.first[self.window_text + 1] - self.window_start)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct-word indexes and mask, (windows, WINDOW)."""
        at = self.window_start[which][:, None] + np.arange(WINDOW)
        mask = np.arange(WINDOW) < self.window_size[which][:, None]
        return (self.word[np.where(mask, at, 0)] if len(self.word) else np.zeros(at.shape, np.int64)), mask


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


class Network:
    """Parameters are a dict of arrays; ``loss_gradient`` backpropagates through time."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d = WORD_DIM + CHAR_DIM

        def draw(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        self.rows = {"word": np.zeros(BUCKETS, np.int32), "char": np.zeros(BUCKETS, np.int32)}
        self.p = {"word": draw(MAX_WORDS + 1, WORD_DIM, scale=0.05), "char": draw(MAX_GRAMS + 1, CHAR_DIM, scale=0.05)}
        for side in "fb":
            self.p |= {
                f"w{side}": draw(d, 3 * HIDDEN, scale=d**-0.5), f"u{side}": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
                f"c{side}": np.zeros(3 * HIDDEN, np.float32),
            }
        self.p |= {
            "wa": draw(2 * HIDDEN, HIDDEN, scale=0.3), "ca": np.zeros(HIDDEN, np.float32), "va": draw(HIDDEN, scale=0.3),
            "wo": draw(2 * HIDDEN, scale=0.3), "co": np.zeros(1, np.float32),
        }

    def word_inputs(self, inputs: Inputs) -> np.ndarray:
        """The input vector of each distinct word."""
        out = np.zeros((len(inputs.hash), WORD_DIM + CHAR_DIM), np.float32)
        out[:, :WORD_DIM] = self.p["word"][self.rows["word"][inputs.bucket]]
        has = np.flatnonzero(inputs.n_grams)
        if len(has):
            begin = (np.cumsum(inputs.n_grams) - inputs.n_grams)[has]
            out[has, WORD_DIM:] = np.add.reduceat(self.p["char"][self.rows["char"][inputs.gram]], begin, axis=0) / np.sqrt(inputs.n_grams[has, None], dtype=np.float32)
        return out

    def _direction(self, side: str, gates: np.ndarray, mask: np.ndarray, keep: bool):
        """Hidden states for (time, windows) order; ``gates`` are the inputs times w plus c."""
        u = self.p[f"u{side}"]
        steps, n = mask.shape
        h = np.zeros((n, HIDDEN), np.float32)
        states, saved = np.empty((steps, n, HIDDEN), np.float32), [None] * steps
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            hu = h @ u
            zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(gates[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            after = h + m * ((1 - z) * (new - h))
            if keep:
                saved[t] = (h, z, r, new, hu[:, 2 * HIDDEN :], m)
            h = states[t] = after
        return states, saved

    def forward(self, x_of_word: np.ndarray, word: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; ``word`` and ``mask`` are (windows, WINDOW)."""
        word, mask = word.T, mask.T.astype(np.float32)
        tables = {s: x_of_word @ self.p[f"w{s}"] + self.p[f"c{s}"] for s in "fb"}
        both, saved = [], {}
        for s in "fb":
            states, saved[s] = self._direction(s, tables[s][word] if len(x_of_word) else np.zeros((*word.shape, 3 * HIDDEN), np.float32), mask, keep)
            both.append(states)
        h = np.concatenate(both, axis=2)
        inner = np.tanh(h @ self.p["wa"] + self.p["ca"])
        energy = inner @ self.p["va"] + np.where(mask > 0, np.float32(0), np.float32(-1e9))
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * h).sum(axis=0)
        logit = pooled @ self.p["wo"] + self.p["co"][0]
        return (logit, (word, mask, saved, h, inner, weight, pooled)) if keep else logit

    def loss_gradient(self, x_of_word: np.ndarray, word: np.ndarray, mask: np.ndarray, target: np.ndarray, importance: np.ndarray):
        """Gradients of the weighted mean log loss by parameter, and by distinct word's input."""
        logit, (word, mask, saved, h, inner, weight, pooled) = self.forward(x_of_word, word, mask, keep=True)
        g = {}
        d_logit = ((_sigmoid(logit) - target) * importance / importance.sum()).astype(np.float32)
        g["wo"], g["co"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * self.p["wo"]
        d_weight = (h * d_pooled).sum(axis=2)
        d_h = weight[:, :, None] * d_pooled
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["va"] = (inner * d_energy[:, :, None]).sum(axis=(0, 1))
        d_inner = d_energy[:, :, None] * self.p["va"] * (1 - inner * inner)
        flat = d_inner.reshape(-1, HIDDEN)
        g["wa"], g["ca"] = h.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)
        d_h = d_h + d_inner @ self.p["wa"].T
        d_x = np.zeros_like(x_of_word)
        x = x_of_word[word]
        for s, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            u, steps = self.p[f"u{s}"], len(mask)
            d_gates = np.zeros((*mask.shape, 3 * HIDDEN), np.float32)
            d_u = np.zeros_like(u)
            carry = np.zeros((mask.shape[1], HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1) if s == "f" else range(steps):
                before, z, r, new, hu_n, m = saved[s][t]
                d = carry + d_h[t, :, part]
                d_new = d * m * (1 - z) * (1 - new * new)
                d_z = d * m * (before - new) * z * (1 - z)
                d_r = d_new * hu_n * r * (1 - r)
                d_gates[t] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_hu = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_u += before.T @ d_hu
                carry = d * (1 - m) + d * m * z + d_hu @ u.T
            flat = d_gates.reshape(-1, 3 * HIDDEN)
            g[f"u{s}"], g[f"c{s}"] = d_u, flat.sum(axis=0)
            g[f"w{s}"] = x.reshape(-1, x.shape[2]).T @ flat
            np.add.at(d_x, word.reshape(-1), flat @ self.p[f"w{s}"].T)
        return g, d_x

    def score_windows(self, inputs: Inputs) -> np.ndarray:
        """Scores of all windows of a slice."""
        x = self.word_inputs(inputs)
        out = np.empty(len(inputs.window_text), np.float32)
        for at in range(0, len(out), _WINDOWS_AT_ONCE):
            which = np.arange(at, min(len(out), at + _WINDOWS_AT_ONCE))
            out[which] = _sigmoid(self.forward(x, *inputs.windows(which)))
        return out


class _Adam:
    def __init__(self, size: float):
        self.size, self.t, self.m, self.v = size, 0, {}, {}

    def step(self, params: dict, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            params[k] -= (self.size * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def _log_odds(count: list[np.ndarray], texts: list[int]) -> np.ndarray:
    """By feature: log of its rate in toxic texts over that in clean ones, smoothed; 0 if rare."""
    rate = [(c + 0.5) / (n + 1) for c, n in zip(count, texts, strict=True)]
    seen = count[0] + count[1]
    return np.where(seen >= LEAST_TEXTS, np.clip(np.log(rate[1] / rate[0]), -4, 4) * np.minimum(1, np.log1p(seen) / 3), 0)


def _choose(net: Network, table: str, odds: np.ndarray, most: int) -> None:
    """Give the features with the largest odds a row; it starts from the odds."""
    best = np.argsort(-np.abs(odds), kind="stable")[:most]
    best = best[odds[best] != 0]
    net.rows[table][best] = np.arange(1, len(best) + 1)
    net.p[table][1 : len(best) + 1, 0] = odds[best] / 3


def fit(texts: list[str], toxic: np.ndarray, seed: int = SEED) -> Network:
    """Train on texts and their labels."""
    net, rng = Network(seed), np.random.default_rng(seed)
    column = pa.array(texts, pa.large_string())
    ((_, _, data, offsets),) = slices(column, 1 << 40)
    inputs = Inputs(data, offsets)
    text_of_word = np.repeat(np.arange(len(texts)), inputs.count)
    # texts that have each distinct word, by class; a gram counts once for each word and text that has it
    pair = np.unique(text_of_word * len(inputs.hash) + inputs.word)
    label, word = toxic[pair // max(1, len(inputs.hash))], pair % max(1, len(inputs.hash))
    of_class = [np.bincount(word[label == y], minlength=len(inputs.hash)) for y in (0, 1)]
    del pair, label, word
    sizes = [int((toxic == y).sum()) for y in (0, 1)]
    word_odds = _log_odds([np.bincount(inputs.bucket, c, BUCKETS) for c in of_class], sizes)
    char_odds = _log_odds([np.bincount(inputs.gram, c[inputs.owner], BUCKETS) for c in of_class], sizes)
    _choose(net, "word", word_odds, MAX_WORDS)
    _choose(net, "char", char_odds, MAX_GRAMS)

    # the first choice of windows: the highest log odds of one word
    of_word = np.maximum(word_odds[inputs.bucket], 0)
    gram_odds = np.bincount(inputs.owner, char_odds[inputs.gram], len(of_word)) / np.sqrt(np.maximum(1, inputs.n_grams))
    of_word = of_word + np.maximum(gram_odds, 0) if len(of_word) else of_word
    scores = np.empty(len(inputs.window_text), np.float32)
    for at in range(0, len(scores), _WINDOWS_AT_ONCE):
        which = np.arange(at, min(len(scores), at + _WINDOWS_AT_ONCE))
        word, mask = inputs.windows(which)
        scores[which] = np.where(mask, of_word[word] if len(of_word) else 0, 0).max(axis=1)

    adam = _Adam(STEP_SIZE)
    is_toxic = toxic[inputs.window_text] == 1
    for round_ in range(ROUNDS):
        order = np.lexsort((-scores, inputs.window_text))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - inputs.window_first[inputs.window_text[order]]
        top = rank == 0
        hard = rank < 3
        others = rng.random(len(scores)) < min(1.0, 2 * len(texts) / max(1, len(scores)))
        sure = (scores > 0.9) if round_ else np.zeros(len(scores), bool)
        chosen = np.flatnonzero(np.where(is_toxic, top | (sure & hard), hard | others))
        passes = max(1, STEPS * BATCH // len(chosen))
        chosen = np.concatenate([rng.permutation(chosen) for _ in range(passes)])
        balance = np.sqrt((~is_toxic[chosen]).sum() / max(1, is_toxic[chosen].sum()))
        adam.size = STEP_SIZE * (1 - round_ / ROUNDS)
        for at in range(0, len(chosen), BATCH):
            which = chosen[at : at + BATCH]
            word, mask = inputs.windows(which)
            distinct, local = np.unique(word, return_inverse=True)
            local = local.reshape(word.shape)
            sub = _Subset(inputs, distinct)
            g, d_x = net.loss_gradient(net.word_inputs(sub), local, mask, is_toxic[which].astype(np.float32), np.where(is_toxic[which], balance, 1))
            g["word"] = _scatter(net.rows["word"][sub.bucket], d_x[:, :WORD_DIM], MAX_WORDS + 1)
            per = d_x[:, WORD_DIM:] / np.sqrt(np.maximum(1, sub.n_grams))[:, None]
            g["char"] = _scatter(net.rows["char"][sub.gram], per[sub.owner], MAX_GRAMS + 1)
            adam.step(net.p, g)
        scores = net.score_windows(inputs)
    return net


class _Subset:
    """The features of some distinct words."""

    def __init__(self, inputs: Inputs, which: np.ndarray):
        self.hash, self.bucket, self.n_grams = inputs.hash[which], inputs.bucket[which], inputs.n_grams[which]
        begin = (np.cumsum(inputs.n_grams) - inputs.n_grams)[which]
        self.owner = np.repeat(np.arange(len(which)), self.n_grams)
        place = np.arange(len(self.owner)) - np.repeat(np.cumsum(self.n_grams) - self.n_grams, self.n_grams)
        self.gram = inputs.gram[begin[self.owner] + place] if len(self.owner) else np.empty(0, np.int64)


def _scatter(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    return np.stack([np.bincount(at, values[:, k], rows) for k in range(values.shape[1])], axis=1).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Network | None:
    """Learn from the labelled rows of ``docs`` (doc_id, text) that are not held out."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    learn = docs.where(F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sized = learn.select("doc_id", F.octet_length("text").alias("bytes")).join(known, "doc_id").where(F.col("toxic").isin(0, 1))
    sizes = {r["toxic"]: r for r in sized.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).collect()}
    if not {0, 1} <= set(sizes):
        return None
    every = {y: max(1, -(-sizes[y]["n"] // rows), -(-sizes[y]["b"] // (size // 2))) for y in (0, 1)}
    modulus = F.when(F.col("toxic") == 1, every[1]).otherwise(every[0])
    chosen = materialize(sized.where(F.pmod(F.xxhash64("doc_id"), modulus) == 0).select("doc_id", "toxic").distinct())
    few = chosen.limit(4 * rows + 1).count() <= 4 * rows  # texts stay where they are; the chosen ids go to them
    sample = learn.select("doc_id", "text").join(F.broadcast(chosen) if few else chosen, "doc_id")
    got = sample.toPandas().sort_values(["doc_id", "text"])  # bounded by rows and size
    if got["toxic"].nunique() < 2:
        return None
    return fit(got["text"].tolist(), got["toxic"].to_numpy(np.int64))


def score(docs: DataFrame, net: Network | None, keep_text: bool = True) -> DataFrame:
    """``docs`` plus toxicity (0 to 1). Only ``text`` is read; a column toxicity is replaced, others pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of parameters
    docs = docs.drop("toxicity")
    kept = [f for f in docs.schema.fields if keep_text or f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            out = [np.zeros(0, np.float32)]
            for at, to, data, offsets in slices(batch.column("text")):
                if net is None:
                    out.append(np.zeros(to - at, np.float32))
                else:
                    inputs = Inputs(data, offsets)
                    out.append(np.maximum.reduceat(net.score_windows(inputs), inputs.window_first[:-1]))
            columns = {f.name: batch.column(f.name) for f in kept}
            yield pa.RecordBatch.from_pydict(columns | {"toxicity": pa.array(np.concatenate(out).astype(np.float64))})

    return docs.mapInArrow(lean(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "toxicity double"]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, net, keep_text=False).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
