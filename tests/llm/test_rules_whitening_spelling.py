"""Quality rules, whitening and spelling variants against brute force, and their edge cases."""

import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm import quality_rules, spelling, whitening
from strandlake.llm.textblocks import Words, slices

import pyarrow as pa

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"

# --- 11: quality rules


def plain_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é", "ab", "\n", "\t", "#|", " ", "\x0b"]), max_size=60).map(" ".join), min_size=1, max_size=5))
def test_counts_of_words_and_windows(texts):
    got = []
    for _, _, data, offsets in slices(pa.array(texts)):
        words = Words(data, offsets)
        got += zip(words.count.tolist(), quality_rules.repeated_words(words).tolist(), strict=True)
    assert got == [(plain_counts(t)[0], plain_counts(t)[4]) for t in texts]


PROSE = "The quick brown fox jumps over the lazy dog near the old mill. "
ODD_TEXTS = [
    None, "", " \n\t", "word", PROSE * 3, PROSE.strip() + " Then it slept in the shade of a very large tree all day long until evening came.",
    "Home | About | Contact | Login\n" + "A line of prose that goes on for a while and ends well. It says more than twenty words in all, so it stays put here.",
    "\n".join(f"entry{i} | entry{i + 1} | entry{i + 2} | more." for i in range(20)), "THIS!! IS!! LOUD!! " * 9, "no end of a sentence " + " ".join(f"w{i}" for i in range(40)),
    "# $ % & * | < > " * 5 + "end.", "x. " * 30, ("Same line of text here.\n" * 9) + " ".join(f"k{i}" for i in range(30)) + ".", "ß é ñ 日本。 " * 12,
]


def test_quality_rules_against_plain_counts(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD_TEXTS + ODD_TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_words string, kept string")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r, want = got[i], plain_counts(t)
        assert tuple(r[c] for c in quality_rules.COUNTS) == want, t
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["lost_chars"] * 2 <= want[1])
        assert (r["text"] is None) == (t is None)
        assert r["lost_chars"] == want[1] - len("".join(WORDS.findall(r["text"] or "")))
    assert got[5]["kept"] and got[5]["text"] == ODD_TEXTS[5]
    assert got[6]["kept"] and got[6]["text"].startswith("A line of prose")  # the menu went, the text stays
    assert not any(got[i]["kept"] for i in (7, 8, 9, 10, 11))
    assert quality_rules.judge(docs.where("false")).count() == 0


def test_quality_rules_keep_good_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.judge(docs.select("doc_id", "text"), keep_text=False).join(labels, "doc_id").where("not base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) <= 0.02 * n[0, False]


def test_quality_rules_on_a_text_of_ten_megabytes(spark):
    text = (PROSE + "\n") * 150_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = quality_rules.judge(docs, keep_text=False).first()
    assert (row["n_words"], row["n_dup_lines"], row["n_repeat_words"]) == (13 * 150_000, 149_999, 13 * 150_000)


# --- 12: whitening


def plain_whitening(vectors):
    x = {k: [math.floor(64 * float(c)) + 1_000_000 for c in v] for k, v in vectors.items()}
    distinct = sorted(set(map(tuple, x.values())))
    n, d = len(distinct), len(distinct[0])
    sums = [sum(v[i] for v in distinct) for i in range(d)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums, strict=True)] for v in distinct])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(16, d)
    white = {key: np.array([float(Fraction(n * a - s, n)) for a, s in zip(v, sums, strict=True)]) @ u[:, :k] / np.sqrt(e[:k]) for key, v in x.items()}
    return n, {key: sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for key, v in x.items()}, white, e[:k] / e.sum()


@pytest.mark.parametrize("scale", [1.0, 3e4, 20.0])
def test_whitening(spark, scale):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 24)) @ np.diag(1.5 ** -np.arange(24)) * scale + 40 * scale
    base[50:90] = base[7]  # a large group of copies counts once
    vectors = {i: v.astype(np.float32).tolist() for i, v in enumerate(base)}
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors.items()], "vec_id long, embedding array<float>, component string").repartition(3)
    got = whitening.whiten(df).toPandas()
    n, deviation, white, explained = plain_whitening(vectors)
    assert set(got["n"]) == {n} and len(got) == 400 * 16 and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-4
    assert all(deviation[v] == d for v, d in zip(got["vec_id"], got["deviation"], strict=True))
    table = got.pivot(index="vec_id", columns="component", values="whitened")
    want = np.array([white[i] for i in table.index])
    sign = np.sign((want * table.to_numpy()).sum(axis=0))
    assert np.abs(want * sign - table.to_numpy()).max() < 1e-5
    assert np.allclose(got[got["vec_id"] == 0].sort_values("component")["explained"], explained, rtol=1e-4)


def test_scatter_is_exact_beyond_doubles(spark):
    rows = [[2**61, -(2**61) + 1, 3], [2**61 - 1, 5, -7], [-(2**60), 2**61 + 9, 1]] * 2
    one = whitening.Scatter(3)
    one.add(np.array(rows[:2]))
    one.add(np.array(rows[2:]))
    assert one.n == 6 and one.cross.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]
    back = {}
    for i, j, k, part in one.limbs():
        back[i, j] = back.get((i, j), 0) + (part << (30 * k))
    assert back[-1, -1] == 6 and all(back[i, j] == one.cross[i, j] for i in range(3) for j in range(i, 3))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(-300, 300), st.integers(-(2**62), 2**62)), min_size=3, max_size=3), min_size=1, max_size=20))
def test_packed_vectors_tell_equal_ones(rows):
    y = np.array(rows, np.int64)
    blobs = whitening.packed(y)
    assert len(set(blobs)) == len(set(map(tuple, rows)))
    assert sorted(whitening.unpacked(3, blobs).tolist()) == sorted(rows)


def test_whitening_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [-inf, 1.0]), (6, []), (7, [1e300, 0.0]), (None, [3.0, 9.0]), (8, [5.0]), (9, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert Counter(r["vec_id"] for r in got) == {1: 4, 7: 2, None: 2, 8: 1, 9: 1}
    assert all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in got if r["vec_id"] in (8, 9))
    assert all(r["n"] == (1 if r["vec_id"] in (8, 9) else 3) for r in got)
    assert whitening.whiten(df.where("false")).count() == 0


# --- 13: spelling variants


def plain_variants(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda c: c[0].lower(), run)
            if doc_id is not None and (h := zlib.crc32(f"{doc_id}:{word}".encode())) % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    found = {w: [x for x in n if near(w, x)] for w in n}
    form = {w: min(found[w], key=lambda x: (-n[x], x)) if found[w] else None for w in n}
    form = {w: f if f and n[f] >= 10 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(found[w]), n.get(form[w])) for w in n}


WORD_SETS = st.lists(st.tuples(st.text("abé", min_size=6, max_size=9), st.integers(1, 150)), max_size=25)


@settings(max_examples=12, deadline=None)
@given(WORD_SETS)
def test_spelling_variants_against_all_pairs(spark, words):
    text = " ".join(" ".join([w] * k) for w, k in words)
    docs = [(1, text), (2, text.upper()), (None, text[:40]), (3, None), (4, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = spelling.spelling_variants(spelling.vocabulary(df)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == plain_variants(docs)


def test_spelling_chains_ties_and_long_texts(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaaaaaac": 20, "zzzzzzzz": 3, "zzzzzzz": 3}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: r for r in spelling.spelling_variants(words).collect()}
    assert got["aaaaaaa"]["form"] == "aaaaaaac" if "aaaaaaac" < "aaaaaab" else "aaaaaab"
    assert got["aaaaaab"]["root"] == got["aaaaabb"]["root"] == "aaaabbb" and got["aaaaaab"]["form"] == "aaaaabb"
    assert got["zzzzzzz"]["n_near"] == got["zzzzzzzz"]["n_near"] == 1 and got["zzzzzzz"]["form"] is None  # any deletion of a run is one
    docs = spark.createDataFrame([(1, "wonderful " * 1_000_000 + "wonderfull " * 3, "x")], "doc_id long, text string, word string")
    long = {r["word"]: r for r in spelling.spelling_variants(spelling.vocabulary(docs, drop_one_in=None)).collect()}
    assert long["wonderfull"]["form"] == "wonderful" and long["wonderful"]["n"] == 1_000_000
    assert spelling.spelling_variants(spelling.vocabulary(docs.where("false"))).count() == 0


def test_spelling_query_against_all_pairs(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = spelling.op13_spelling_variants(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert set(map(tuple, got)) == plain_variants(docs)
    assert "Python" not in spelling.op13_spelling_variants(spark, SF)._jdf.queryExecution().executedPlan().toString()
