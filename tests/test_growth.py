"""Steps that must not grow faster than their input: the same results from small groups, batches and rounds."""

from __future__ import annotations

import time
from collections import Counter
from functools import reduce
from operator import add
from unittest.mock import MagicMock

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import sequences
from strandlake.operators import alignments, clusters, forests, gapmaps, redundancy, shuffles, whole_alignment
from strandlake.sources import flatfiles


@pytest.mark.parametrize("gaps", [True, False])
def test_block_counts_merge_in_levels(spark, monkeypatch, gaps):
    monkeypatch.setattr(alignments, "GROUP_ROWS", 3)
    monkeypatch.setattr(alignments, "MERGED", 2)
    rng = np.random.default_rng(5)
    rows = [(f"f{i % 2}", i, "".join(rng.choice(list("AC-é\U0001F600"), rng.integers(0, 30)))) for i in range(60)]
    rows += [(None, 70, "AC" * alignments.BLOCK), (None, 71, None), (None, 72, "")]
    packed = alignments.block_counts(spark.createDataFrame(rows, "family string, name long, aseq string"), gaps)
    assert packed.groupBy("family", "block").count().where("count > 1").isEmpty()
    got = {(r["family"], r["pos"], r["residue"]): r["n"] for r in alignments._cells_of(packed).collect()}
    assert got == Counter((f, i, c) for f, _, row in rows for i, c in enumerate(row or "") if gaps or c != "-")


def test_pairs_are_counted_where_the_row_is(spark):
    rows = [(1, "ACCA-\U0001F600é\U0001F600é"), (2, "A"), (3, ""), (4, None), (5, "AB" * 60_000)]
    told = shuffles.pair_counts(spark.createDataFrame(rows, "id long, seq string"), "id", "seq")
    assert "Exchange" not in told._jdf.queryExecution().executedPlan().toString()
    for i, row in rows:
        want = Counter(a + b for a, b in zip(row or "", (row or "")[1:]))  # noqa: B905
        assert [tuple(p) for p in told.where(f"id = {i}").first()["pairs"]] == sorted(want.items())


def test_widened_rows_are_sent_in_parts(spark, monkeypatch):
    sent = []

    class Rows:  # takes the place of a DataFrame: the map is run here, on one batch of narrow rows of a wide family
        columns, schema = ["family", "name", "aseq"], None

        def __getitem__(self, name):
            return F.col(name)

        groupBy = agg = join = drop = lambda self, *a, **k: self

        def mapInPandas(self, run, schema):
            batch = pd.DataFrame({"family": "f", "name": range(40), "__w": 500_000, "aseq": ["AC", None, "é", ""] * 10})
            sent.extend(run(iter([batch])))
            return self

    monkeypatch.setattr(shuffles, "F", MagicMock())
    shuffles.resampled_columns(Rows())
    assert max(part["aseq"].str.len().sum() for part in sent) <= 4_500_000
    assert [n for part in sent for n in part["name"]] == list(range(40))
    assert {None if s is None else len(s) for part in sent for s in part["aseq"]} == {None, 500_000}


@pytest.mark.parametrize("size", [3, 1000])
def test_block_distances_and_joining_links(spark, monkeypatch, size):
    monkeypatch.setattr(clusters, "VECTORS_AT_ONCE", size)
    monkeypatch.setattr(clusters, "SEEDS_AT_ONCE", size)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(40)] + [(40, None), (41, [1.0, None, 2.0]), (42, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<double>")
    seeds = vectors.where("vec_id % 4 = 0 or vec_id = 42").toDF("seed", "c")
    apart = lambda a, b: reduce(add, [(x - y) * (x - y) for x, y in zip(a, b)]) if a and b and len(a) == len(b) and None not in a + b else None  # noqa: B905, E731
    want = {(i, j): apart(a, b) for i, a in rows for j, b in rows if j % 4 == 0 or j == 42}
    assert {(r[0], r[1]): r[2] for r in clusters.block_distances(vectors, seeds).collect()} == want
    near = {k for k, d in want.items() if d is not None and d <= 4}
    assert {(r[0], r[1]) for r in clusters.block_distances(vectors, seeds, 4.0).collect()} == near
    links = [(r[0], r[1]) for r in clusters.block_distances(vectors, seeds, 4.0, joins=True).collect()]

    def parts(pairs):
        up = {i: i for i, _ in rows}
        for _ in rows:
            for a, b in pairs:
                up[a] = up[b] = min(up[a], up[b])
        return up

    assert set(links) <= near and parts(links) == parts(near)
    assert size == 3 or len(links) < len(rows) + 12


def test_gap_maps_leave_ended_rows_to_be_filled(spark):
    rows = spark.createDataFrame([("f", 1, "AB", 6), ("f", 2, "ABCDEF", 6), ("f", 3, None, 6), ("g", 4, "É", 3)], "family string, name long, row string, width int")
    gaps = spark.createDataFrame([("f", 1, 2), ("f", 5, 1), ("f", 2, 1)], "family string, col int, n long")
    got = {r["name"]: r["row"] for r in gapmaps.apply(rows, gaps, "width").collect()}
    assert got == {1: "A--B------", 2: "A--B-CDE-F", 3: None, 4: "É--"}


def test_edits_and_shuffled_rows_against_spark(spark):
    rng = np.random.default_rng(4)
    rows = ["".join(rng.choice(list("ABC\U0001F600é"), n)) for n in (0, 1, 2, 3, 63, 64, 65, 130)] + [None]
    both = spark.createDataFrame([(a, b) for a in rows for b in rows], "a string, b string")
    told = both.select(F.levenshtein("a", "b").cast("long").alias("want"), sequences.edits(F.col("a"), F.col("b")).alias("got"))
    assert "levenshtein" not in told.select("got")._jdf.queryExecution().executedPlan().toString().lower()
    assert told.where("not want <=> got").isEmpty()
    keyed = F.transform(F.filter(F.split("a", ""), lambda c: c != ""), lambda c, i: F.struct(F.md5(F.concat_ws(":", F.lit(7), i).cast("binary")).alias("k"), c.alias("c")))
    plain = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["c"]), "")
    told = both.select(plain.alias("want"), sequences.shuffled(F.col("a"), 7).alias("got"))
    assert "md5" not in told.select("got")._jdf.queryExecution().executedPlan().toString().lower()
    assert told.where("not want <=> got").isEmpty()


def test_unlike_rows_with_common_segments_are_decided_in_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(redundancy, "materialize", lambda df, put=redundancy.materialize: rounds.append(1) or put(df))
    monkeypatch.setattr(redundancy, "CHUNK", 4, raising=False)
    rng = np.random.default_rng(6)
    piece = ["".join(rng.choice(list("ACDEFGH"), 20)) for _ in range(12)]
    rows = [("f", i, "".join(piece[2 * k + (i >> k & 1)] for k in range(6))) for i in range(64)]  # each segment stands in half the rows
    rows += [("f", 100 + i, row[:60] + "X" + row[61:]) for _, i, row in rows[:8]] + [("f", 200, rows[5][2][:40]), ("f", 201, rows[5][2][:39] + "X")]
    got = {r["id"] for r in redundancy.keep_unlike(spark.createDataFrame(rows, "family string, id long, row string")).collect()}
    assert got == {*range(64), 201}
    assert len(rounds) < 40


def test_rows_that_start_alike_are_no_candidates(spark):
    """what many rows have in common, half of their columns or more, brings none of them together."""
    rng = np.random.default_rng(8)
    drawn = lambda n: "".join(rng.choice(list("ACDEFGHIKLÉ"), n))
    head, rows = drawn(600), []
    for k in range(60):
        rows.append(("f" if k % 2 else None, k // 2, head + drawn(400)))  # one id in two families
    df = spark.createDataFrame(rows, "family string, id long, row string").withColumn("number", F.monotonically_increasing_id())
    assert redundancy.candidates(redundancy.materialize(df), 98).isEmpty()
    late = [("f", 100 + k, row[:700] + "XYXYXYXYXY" + row[710 : 1000 - 40 * (k % 3)]) for k, (f, _, row) in enumerate(rows) if f]  # near copies of many lengths
    late += [("f", 200, rows[1][2][:40]), ("f", 201, rows[1][2][:51] + "X"), ("f", 202, rows[3][2][:20] + "-" + rows[3][2][21:40])]
    got = redundancy.keep_unlike(spark.createDataFrame(rows + late, "family string, id long, row string").repartition(3), 98).collect()
    assert {(r["family"], r["id"]) for r in got} == {(f, i) for f, i, _ in rows} | {("f", 202)}


def test_rows_are_sent_once_if_their_ids_differ(spark, monkeypatch):
    """ids that stand twice are one row, the least; without any the rows are dealt by their letters alone."""
    plans = []
    monkeypatch.setattr(redundancy, "materialize", lambda df, put=redundancy.materialize: plans.append(df._jdf.queryExecution().executedPlan().toString()) or put(df))
    rows = [("f", 1, "B" * 60), ("f", 2, "C" * 60), ("f", 3, "C" * 59 + "D"), (None, 1, None), (None, 2, "")]
    for more, want in (([], {("f", 1), ("f", 2), (None, 1)}), ([("f", 2, "A" * 60), ("f", 2, None), (None, 2, "A")], {("f", 1), ("f", 2), ("f", 3), (None, 1)})):
        plans.clear()
        df = spark.createDataFrame(rows + more, "family string, id long, row string")
        assert {(r["family"], r["id"]) for r in redundancy.keep_unlike(df).collect()} == want
        assert plans[0].count("hashpartitioning") == (2 if more else 1)


@settings(max_examples=300, deadline=None)
@given(st.integers(50, 99), st.integers(2, 4), st.integers(1, 600), st.data())
def test_the_rarest_segments_of_the_shorter_row_are_enough(percent, parts, more, data):
    m = redundancy._exact(percent) + more
    most = -(-(100 - percent) * m // 100) - 1  # mismatches of rows with a greater identity
    places = data.draw(st.sets(st.integers(0, m - 1), max_size=most))
    n, width, enough = redundancy.segments_of_row(m, percent, parts)
    a = np.arange(m + 7) % 251
    b = a.copy()
    b[list(places)] += 300
    of_columns = np.random.default_rng(1).integers(1 << 63, size=width, dtype=np.uint64)
    x, y = redundancy._keys_of(a[:m].astype(np.uint8), 5, of_columns), redundancy._keys_of(b.astype(np.uint32), 5, of_columns)
    assert len(x) == n and n >= enough and (x != y[:n]).sum() < enough  # so one of any ``enough`` is shared


def test_rounds_over_nodes_send_no_table_through_the_driver(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(forests, "materialize", lambda df, put=forests.materialize: plans.append(df._jdf.queryExecution().executedPlan().toString()) or put(df))
    nodes = spark.createDataFrame([("f", i, i // 2 or None, 1.0) for i in range(1, 16)], "family string, node long, parent long, length double")
    told = forests.branch_weights(nodes)
    assert told.count() == 8
    plans.append(told._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)


def test_halving_writes_the_vectors_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(forests, "materialize", lambda df, put=forests.materialize: written.append(df.columns) or put(df))
    monkeypatch.setattr(forests, "LOCAL", 6, raising=False)
    rng = np.random.default_rng(3)
    rows = [(f, i, rng.normal(size=2).tolist()) for f, n in (("a", 50), (None, 7), ("b", 1)) for i in range(n)]
    given = spark.createDataFrame(rows, "family string, id long, v array<double>").withColumn("part", F.lit(""))
    got = forests.halved(given, 3).collect()
    assert sorted((repr(r["family"]), r["id"], r["v"]) for r in got) == sorted((repr(f), i, v) for f, i, v in rows)
    assert set(Counter((r["family"], r["part"]) for r in got).values()) <= {1, 2, 3}
    assert sum("v" in c for c in written) == 1

    def plain(rows, part=""):
        if len(rows) <= 3:
            return {i: part for i, _ in rows}
        x = np.array([v for _, v in rows])
        column = x[:, np.argmax(np.ptp(x, axis=0))]
        mid = np.sort(column)[(len(x) - 1) // 2]
        right = column > mid if mid < column.max() else column >= mid
        return plain([r for r, y in zip(rows, right, strict=True) if not y], part + "0") | plain([r for r, y in zip(rows, right, strict=True) if y], part + "1")

    assert {r["id"]: r["part"] for r in got if r["family"] == "a"} == plain([(i, v) for f, i, v in rows if f == "a"])


@pytest.mark.parametrize("form", list(flatfiles.START))
def test_long_records_are_written_in_blocks_of_lines(spark, form):
    rows = [(str(n), "".join("ACGTÉ\U0001F600"[(k * k + k // 7) % 6] for k in range(n))) for n in (0, 1, 59, 60, 61, 1919, 1920, 1921, 4000)]
    lit = flatfiles.record_text(form, *(flatfiles.F.col(c) for c in ("name", "name", "name", "seq")))
    for name, text in spark.createDataFrame(rows, "name string, seq string").select("name", lit).collect():
        seq = dict(rows)[name]
        lines = []
        for i in range(0, len(seq), 60):
            part, last = seq[i : i + 60], min(len(seq), i + 60)
            lines.append({"genbank": f"{i + 1:>9} {part}", "embl": f"     {part} {last:>9}", "pir": f"{i + 1:>7} {part}"}[form])
        assert text.endswith("\n".join(["", *lines, flatfiles.END[form]]))
    # The whole sequence is cut once a block: a million letters take seconds, not minutes.
    began = time.time()
    many = spark.range(8).select(flatfiles.F.repeat(flatfiles.F.lit("ACGTÉ"), 200_000).alias("seq"), flatfiles.F.lit("a").alias("name"))
    assert many.select(flatfiles.F.length(lit).alias("n")).where("n > 1000000").count() == 8
    assert time.time() - began < 60


def test_rows_to_align_are_parted_in_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(forests, "materialize", lambda df, put=forests.materialize: written.append(df.columns) or put(df))
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([("f", i, rng.normal(size=3).tolist()) for i in range(100)], "family string, id long, v array<double>")
    sizes = whole_alignment._parted(rows, 4).groupBy("part").count().collect()
    assert sum(r["count"] for r in sizes) == 100 and max(r["count"] for r in sizes) <= 4
    assert len(written) <= 2
