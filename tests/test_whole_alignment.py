"""Alignments of whole families against planted ones, the plain kernel and what must hold."""

from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from strandlake import queries, storage, tree_queries
from strandlake.operators import forests, progressive
from strandlake.operators import whole_alignment as W

SCHEMA = "family string, name string, seq string, row int, id string"


def path_score(a, b, to_a, to_b, width):
    """What a path costs, column by column."""
    at_a, at_b, score, last = dict(zip(to_a, range(len(a)), strict=True)), dict(zip(to_b, range(len(b)), strict=True)), 0.0, None
    for col in range(width):
        i, j = at_a.get(col), at_b.get(col)
        kind = "m" if i is not None and j is not None else "a" if j is None else "b"
        if kind == "m":
            score += W.MISMATCH * a[i].sum() * b[j].sum() + (W.MATCH - W.MISMATCH) * float(a[i] @ b[j])
        else:
            score -= W.GAP_EXTEND + (W.GAP_OPEN if kind != last else 0)
        last = kind
    return score


def rendered(row, places, width):
    cells = ["-"] * width
    for c, p in zip(row, places, strict=True):
        cells[p] = c
    return "".join(cells)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ABC-", min_size=0, max_size=9), min_size=1, max_size=3), st.lists(st.text("ABC-", min_size=0, max_size=12), min_size=1, max_size=3))
def test_matches_score_as_the_plain_kernel(left, right):
    def block(rows):
        rows = [r.ljust(max(map(len, rows)), "-") for r in rows]
        cols = [c for c in zip(*rows, strict=True) if set(c) != {"-"}]
        return ["".join(r) for r in zip(*cols, strict=True)] if cols else [""] * len(rows)

    left, right, letters = block(left), block(right), {"A": 0, "B": 1, "C": 2}
    a, b = progressive.Profile([list(r) for r in left], letters), progressive.Profile([list(r) for r in right], letters)
    to_a, to_b, width = W.matched(a.share, b.share)
    assert len(to_a) == len(a.share) and len(to_b) == len(b.share) and set(to_a) | set(to_b) == set(range(width))
    plain = progressive.merge(a, b).rows
    cols = list(zip(*plain, strict=True))
    plain_a = [i for i, c in enumerate(cols) if set(c[: len(left)]) != {"-"}]
    plain_b = [i for i, c in enumerate(cols) if set(c[len(left) :]) != {"-"}]
    assert path_score(a.share, b.share, to_a, to_b, width) == pytest.approx(path_score(a.share, b.share, plain_a, plain_b, len(cols)), abs=1e-9)


def test_matches_refuse_what_does_not_fit(monkeypatch):
    monkeypatch.setattr(W, "MAX_CELLS", 8)
    with pytest.raises(ValueError, match="3 and 3 columns"):
        W.matched(np.eye(3), np.eye(3))


@pytest.mark.parametrize("part", [4, 128])
def test_planted_alignments_come_back(spark, part):
    """Blocks taken out of rows with a letter for each place: the places are the alignment, over several levels of parts too."""
    rng, ancestor = np.random.default_rng(3), "".join(chr(0x4E00 + i) for i in range(60))
    rows, true = [], {}
    for family in ("p", "q"):
        for name in range(24):
            gone = [k for k in range(4) if rng.random() < 0.4]
            row = "".join("-" if any(8 + 14 * k <= i < 13 + 14 * k for k in gone) else c for i, c in enumerate(ancestor))
            rows.append((family, str(name), row, name, "x"))
            true[family, str(name)] = row
    got = W.align_whole(spark.createDataFrame(rows, SCHEMA), part).collect()
    assert {(r["family"], r["name"]): r["aseq"] for r in got} == true and len(got) == len(rows)


def test_odd_rows_and_many_levels(spark):
    """Nulls, empty rows, repeats, other planes' letters, clashing names of columns; parts of two, so that levels chain."""
    rng = np.random.default_rng(5)
    rows = [("a", None, None, 1, "x"), ("a", "e", "", 1, "x"), ("a", "g", "--", 1, None), ("b", "only", "QRS", 1, "x"), (None, "n", "AB", 1, "x"), (None, None, "A-C", 1, "x"), ("none", "n", "", 1, "x"), ("😀", "s", "😀é", 1, "x"), ("😀", "t", "é", 1, "x")]
    for i in range(10):
        row = "".join(rng.choice(list("ACDE"), int(rng.integers(1, 12))))
        rows += [("a", f"r{i}", row, i, "x")] * (1 + i % 3)
    got = W.align_whole(spark.createDataFrame(rows, SCHEMA), 2).collect()
    bare = lambda s: (s or "").replace("-", "")
    assert sorted(map(repr, [(r["family"], r["name"], bare(r["aseq"])) for r in got])) == sorted(map(repr, [(f, n, bare(s)) for f, n, s, *_ in rows]))
    for family in {r["family"] for r in got}:
        own = [r["aseq"] for r in got if r["family"] == family]
        assert len({len(s) for s in own}) == 1
        assert all(set(c) != {"-"} for c in zip(*own, strict=True))
    same = {}
    for r in got:
        assert same.setdefault((r["family"], bare(r["aseq"])), r["aseq"]) == r["aseq"]  # copies stand alike
    assert {(r["family"], r["name"]): r["aseq"] for r in got}["b", "only"] == "QRS"


def test_rows_of_equal_pairs_are_still_cut(spark):
    """More rows than a part holds whose letter pairs are the same: what keeps rows apart cuts them."""
    rows = [("f", "".join(p), "".join(f"A{c}" for c in p) + "A", 1, "x") for p in permutations("BCDE")][:14]
    got = W.align_whole(spark.createDataFrame(rows, SCHEMA), 3).collect()
    assert len({len(r["aseq"]) for r in got}) == 1 and {r["aseq"].replace("-", "") for r in got} == {r[2] for r in rows}


def test_empty_tables(spark):
    got = W.align_whole(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["family", "name", "aseq"] and got.count() == 0


def random_profiles(rng, letters=3):
    """Pairs of profiles of all widths from none on."""
    one = lambda: rng.dirichlet(np.ones(letters + 1), int(rng.integers(0, 12)))[:, :letters]
    return [(one(), one()) for _ in range(60)]


def counted_chunks(monkeypatch):
    calls, plain = [], W._match_chunk
    monkeypatch.setattr(W, "_match_chunk", lambda pairs, chunk, out: (calls.append(len(chunk)), plain(pairs, chunk, out)))
    return calls


def test_matches_of_many_pairs_are_filled_in_together(monkeypatch):
    """one pass for all pairs that fit, and each pair comes out as by itself, wherever the passes end."""
    pairs, calls = random_profiles(np.random.default_rng(2)), counted_chunks(monkeypatch)
    together = W.matched_all(pairs)
    assert calls == [60]
    for cells in (1, 300):
        monkeypatch.setattr(W, "CELLS_AT_ONCE", cells)
        for got, (a, b), (to_a, to_b, width) in zip(W.matched_all(pairs), pairs, together, strict=True):
            assert got[0].tolist() == to_a.tolist() and got[1].tolist() == to_b.tolist() and got[2] == width
            assert len(to_a) == len(a) and len(to_b) == len(b) and set(to_a) | set(to_b) == set(range(width))


def test_parts_are_merged_in_turns(monkeypatch):
    """eight parts take as many passes as the tallest tree has levels, and come out as by themselves."""
    rng, parts = np.random.default_rng(4), []
    for _ in range(8):
        rows = ["".join(rng.choice(list("ACDE"), int(rng.integers(0, 9)))) for _ in range(16)]
        parts.append(W._of_rows(pd.DataFrame({"row": rows}))[1:])
    alone, calls = [W.along_trees([part])[0] for part in parts], counted_chunks(monkeypatch)
    together = W.along_trees(parts)
    assert len(calls) <= 15 and sum(calls) == 8 * 15
    for (places, whole), (own, own_whole) in zip(together, alone, strict=True):
        assert [p.tolist() for p in places] == [p.tolist() for p in own] and whole.tolist() == own_whole.tolist()


def test_parts_are_read_whole_from_any_batches(monkeypatch):
    rows = pd.DataFrame({"part": [1, 1, 1, 2, 3, 3], "row": ["ABC", "", "A", "AB", "C", "D"]})
    for at_once, wanted in ((1, [[1], [2], [3]]), (5, [[1, 2], [3]]), (100, [[1, 2, 3]])):
        monkeypatch.setattr(W, "AT_ONCE", at_once)
        for size in (1, 2, 6):
            got = list(W._whole_parts((rows.iloc[i : i + size] for i in range(0, 6, size)), "row"))
            assert [[int(p["part"].iloc[0]) for p in parts] for parts in got] == wanted
            assert pd.concat([p for parts in got for p in parts], ignore_index=True).equals(rows)


def test_triples_that_repeat_often_are_counted_alike():
    rows = ["A" * 40, "A" * 30 + "CDE", "CDE", "", "AC" * 5]
    held = W._runs(rows, 3, W.TRIPLES)
    least = np.array([[np.minimum(x, y).sum() for y in held] for x in held])
    total = held.sum(axis=1)
    assert np.allclose(W._triple_distances(rows), 1 - least / np.maximum(np.minimum.outer(total, total), 1))
    assert np.allclose(W._triple_distances(rows[2:]), W._triple_distances(rows)[2:, 2:])


def test_rows_of_a_task_are_halved_without_rounds(spark):
    """a table that one task may halve is written, counted and cut there; more rounds only beyond that."""
    rows = spark.range(60).select(F.lit("f").alias("family"), "id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"), F.lit("").alias("part"))
    sizes = lambda found: sorted(r["count"] for r in found.groupBy("part").count().collect())
    before = storage.written()
    local = forests.halved(rows, 8, 64)
    assert storage.written() - before == 2 and sizes(local) == sizes(forests.halved(rows, 8, 8)) and sum(sizes(local)) == 60


def test_histories_are_those_of_the_sql(spark, tmp_path):
    """Least priority of a month, orders without a date or priority, customers without orders."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * FROM (VALUES (0, 1, TIMESTAMP '1996-03-02', '2-HIGH'), (1, 1, TIMESTAMP '1996-03-30', '5-LOW'), (2, 1, TIMESTAMP '1995-12-31', '10-X'), (3, 1, NULL, '4-NOT'), (4, 2, TIMESTAMP '1997-01-01', NULL),
        (5, 2, TIMESTAMP '1997-02-01', '3-M'), (6, NULL, TIMESTAMP '1997-02-01', '3-M')) t(o_orderkey, o_custkey, o_orderdate, o_orderpriority)) TO '{tmp_path}/orders.parquet'""")
    con.execute(f"COPY (SELECT * FROM (VALUES (1, 7), (2, NULL), (3, 7)) t(c_custkey, c_nationkey)) TO '{tmp_path}/customer.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    wanted = dict(con.execute(f"WITH {tree_queries._HISTORIES} SELECT * FROM histories").fetchall())
    got = {r["name"]: r["seq"] for r in tree_queries._histories(spark, str(tmp_path)).collect()}
    assert got == wanted | {3: None} and wanted == {1: "ABD", 2: "C"}


def test_what_must_hold_is_counted_for_odd_keys(spark, tmp_path):
    """customers without a key, keys that stand twice, a null nation and nations without orders, against the SQL."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS o_orderkey, i % 5 AS o_custkey, TIMESTAMP '1996-01-05' + INTERVAL (i * 17) DAY AS o_orderdate, (1 + i * i % 5) || '-P' AS o_orderpriority FROM range(40) t(i)) TO '{tmp_path}/orders.parquet'""")
    con.execute(f"COPY (SELECT * FROM (VALUES (0, 7), (1, 7), (1, 8), (2, 8), (3, 8), (4, NULL), (4, NULL), (NULL, 7), (NULL, 7), (99, 9)) t(c_custkey, c_nationkey)) TO '{tmp_path}/customer.parquet'")
    for table in ("orders", "customer"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    wanted = con.execute(queries.ORACLE_SQL["history_alignment_holds"]).fetchall()
    got = [tuple(r) for r in tree_queries.history_alignment_holds(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
