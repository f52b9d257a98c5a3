"""The library outside ``llm``: kernels against plain versions, formats round trip, queries against DuckDB."""

import functools
import glob
import math
import os

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake import family_queries, queries  # noqa: F401
from strandlake.operators import alignments, clusters, ordering, pairwise, trees
from strandlake.sources import formats

SF = "/root/testdata/sf0.001"


def plain_global(a, b, match=1.0, mismatch=-0.5, gap_open=1.53, gap_extend=0.123, local=False):
    @functools.cache
    def best(i, j, state):
        if i == 0 and j == 0:
            return 0.0 if state == 0 else -math.inf
        out = -math.inf
        if state == 0:
            out = max(best(i, j, 1), best(i, j, 2))
            if i and j:
                out = max(out, best(i - 1, j - 1, 0) + (match if a[i - 1] == b[j - 1] else mismatch))
        elif state == 1 and j:
            out = max(best(i, j - 1, 0) - gap_open, best(i, j - 1, 1)) - gap_extend
        elif state == 2 and i:
            out = max(best(i - 1, j, 0) - gap_open, best(i - 1, j, 2)) - gap_extend
        return max(out, 0.0) if local and state == 0 else out

    if local:
        return max(best(i, j, 0) for i in range(len(a) + 1) for j in range(len(b) + 1))
    return best(len(a), len(b), 0)


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", max_size=9), st.text("ACGT", max_size=9))
def test_global_score(a, b):
    assert pairwise.global_score(a, b) == pytest.approx(plain_global(a, b))


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", max_size=8), st.text("ACGT", max_size=8))
def test_local_score(a, b):
    got = pairwise.global_score(a, b, local=True)
    best = max((plain_global(a[i:j], b[k:m]) for i in range(len(a) + 1) for j in range(i, len(a) + 1) for k in range(len(b) + 1) for m in range(k, len(b) + 1)), default=0)
    assert got == pytest.approx(max(0.0, best))


def test_chain_distance():
    assert pairwise.chain_distance("ACGTACGT", "ACGTACGT") == 0
    assert pairwise.chain_distance("AAAA", "CCCC") == 1
    assert pairwise.chain_distance("", "A") == 1


def test_soft_kernels():
    x = np.array([[0.0], [1.0], [2.0]])
    assert pairwise.soft_dtw(x, x, 1e-3) == pytest.approx(0, abs=1e-2)
    assert pairwise.soft_symmetric_similarity(x, x) > pairwise.soft_symmetric_similarity(x, x + 3)


def test_agglomerate_and_join():
    d = np.array([[0, 2, 6, 6], [2, 0, 6, 6], [6, 6, 0, 4], [6, 6, 4, 0]], float)
    assert trees.agglomerate(d) == [(0, 1, 4, 1, 1, 1), (2, 3, 5, 2, 2, 2), (4, 5, 6, 2, 1, 3)]
    joined = trees.neighbour_join(d)
    assert len(joined) == 3 and {joined[0][0], joined[0][1]} in ({0, 1}, {2, 3})


def test_tree_tables(spark):
    rows = [("f", i, j, float(abs(i - j))) for i in range(5) for j in range(i)]
    edges = trees.build(spark.createDataFrame(rows, "family string, i int, j int, dist double"))
    assert edges.count() == 4
    assert sorted(r["leaf"] for r in trees.leaf_weights(edges).collect()) == [0, 1, 2, 3, 4]
    names = spark.createDataFrame([("f", i, f"s{i}") for i in range(5)], "family string, leaf int, name string")
    text = trees.newick(edges, names).first()["newick"]
    nodes = trees.parse_newick(text)
    assert sorted(n[2] for n in nodes if n[2]) == [f"s{i}" for i in range(5)] and len(nodes) == 9
    assert [(r["m1"], r["m2"]) for r in trees.merge_schedule(edges).orderBy("step").collect()][-1][0] == 1


def test_formats(spark, tmp_path):
    (tmp_path / "fam.fa").write_text(">a first one\r\nACG\r\nT-A\r\n>b\nGG\n\n>c\n")
    got = {r["name"]: (r["family"], r["description"], r["seq"]) for r in formats.read_fasta(spark, str(tmp_path / "fam.fa")).collect()}
    assert got == {"a": ("fam", "first one", "ACGT-A"), "b": ("fam", "", "GG"), "c": ("fam", "", "")}
    rows = spark.createDataFrame([("x", "A" * 130)], "name string, seq string")
    formats.write_fasta(rows, str(tmp_path / "out"))
    back = formats.read_fasta(spark, str(tmp_path / "out")).first()
    assert (back["name"], back["seq"]) == ("x", "A" * 130)
    (tmp_path / "t.dnd").write_text("(\n(a:0.1,\nb:0.2)\n:0.05,c:0.3)\n;\n")
    tree = {r["name"]: r["length"] for r in formats.read_newick(spark, str(tmp_path / "t.dnd")).collect() if r["name"]}
    assert tree == {"a": 0.1, "b": 0.2, "c": 0.3}
    (tmp_path / "m.dist").write_text("2\na 0 0.5\nb 0.5 0\n")
    assert {r["name"]: list(r["dist"]) for r in formats.read_distances(spark, str(tmp_path / "m.dist")).collect()} == {"a": [0, 0.5], "b": [0.5, 0]}
    (tmp_path / "c.aux").write_text("Cluster 3: object 0 has index 7 (=seq NAME 12~len)\t 01\n")
    assert tuple(formats.read_cluster_list(spark, str(tmp_path / "c.aux")).first()) == (3, 0, 7, "NAME", 12, "01")
    (tmp_path / "r.log").write_text("Now processing file (1/2) : f1\nSP-score = 0.5\nTC = 0.25\nNow processing file (2/2) : f2\nSP-score = 1\n")
    assert {tuple(r) for r in formats.read_score_log(spark, str(tmp_path / "r.log")).collect()} == {("r", "f1", 0.5, 0.25), ("r", "f2", 1.0, None)}


def test_agreement(spark):
    rows = lambda *a: spark.createDataFrame([("f", n, s) for n, s in a], "family string, name string, aseq string")
    reference = rows(("a", "AC-G"), ("b", "ACTG"))
    assert tuple(alignments.agreement(reference, reference).first()) == ("f", 1.0, 1.0)
    other = alignments.agreement(rows(("a", "ACG-"), ("b", "ACTG")), reference).first()
    assert other["sp"] == pytest.approx(2 / 3) and other["tc"] == pytest.approx(2 / 3)
    marked = lambda *at: spark.createDataFrame([("f", p) for p in at], "family string, pos int")
    predicted = rows(("a", "ACG-"), ("b", "ACTG"))
    assert tuple(alignments.agreement(predicted, reference, marked(0, 1)).first()) == ("f", 1.0, 1.0)
    assert tuple(alignments.agreement(predicted, reference, marked(1, 3)).first()) == ("f", 0.5, 0.5)
    assert alignments.agreement(predicted, reference, marked(2)).count() == 0  # one row alone has no pair


def test_ranks_and_seeds(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, i % 7) for i in range(500)], "id long, n long")
    got = {r["id"]: r["rank"] for r in ordering.global_rank(df, [F.desc("n"), F.asc("id")]).collect()}
    assert got == {i: k for k, i in enumerate(sorted(range(500), key=lambda i: (-(i % 7), i)))}
    assert ordering.number_of_seeds(1) == 0 and ordering.number_of_seeds(1000) == 99 and ordering.number_of_seeds(4) == 3
    assert ordering.global_rank(df.where("false"), [F.asc("id")]).count() == 0


def test_lloyd_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (40, 3)), rng.normal(5, 1, (30, 3))])
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, v array<double>")
    told, centers = clusters.lloyd(df, "id", "v", [(0, list(x[0])), (1, list(x[60]))])
    got = {r["id"]: r["cluster"] for r in told.collect()}
    assert all(got[i] == (i >= 40) for i in range(70))
    assert np.allclose(centers[0][1], x[:40].mean(0))
    assert {r["cluster"] for r in clusters.bisecting(df, "id", "v", 3).collect()} == {0, 1, 2}


def test_stream_assignment(spark, tmp_path):
    from strandlake.streaming.assign import assign_stream, windowed_counts

    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0])], "id long, v array<double>")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = assign_stream(stream, "id", "v", [(0, [0.0, 1.0]), (1, [5.0, 4.0])])
    q = out.writeStream.format("memory").queryName("assigned").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["id"], r["cluster"]) for r in spark.table("assigned").collect()} == {(1, 0), (2, 1)}
    events = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(f"{SF}/events.parquet*")
    assert windowed_counts(events, "ts", "event_type").isStreaming


def _rows(columns, rows):
    def plain(x):
        if isinstance(x, float):
            return None if x != x else round(x, 6)
        return int(x) if isinstance(x, np.integer) else x

    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    want_rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert _rows(columns, [r.asDict() for r in got.collect()]) == _rows(columns, want_rows)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(queries.ORACLE_SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_progressive_alignment(spark):
    from strandlake.operators import progressive

    rows = [("f", 1, "ACGTACGTAC"), ("f", 2, "ACGTCGTAC"), ("f", 3, "ACGTACGGTAC"), ("g", 1, "AAA"), ("h", 1, None), ("h", 2, "AC-G")]
    got = {(r["family"], r["name"]): r["aseq"] for r in progressive.align_families(spark.createDataFrame(rows, "family string, name int, seq string")).collect()}
    assert {k: v.replace("-", "") for k, v in got.items()} == {(f, n): (s or "").replace("-", "") for f, n, s in rows}
    for f in "fgh":
        assert len({len(v) for k, v in got.items() if k[0] == f}) == 1
    assert len(got["f", 1]) == 11


@settings(max_examples=40, deadline=None)
@given(st.text("ACG", max_size=8), st.text("ACG", max_size=8))
def test_profile_merge_is_best(a, b):
    from strandlake.operators.progressive import GAP_EXTEND, GAP_OPEN, MATCH, MISMATCH, Profile, merge

    alphabet = {c: k for k, c in enumerate("ACG")}
    x, y = merge(Profile([list(a)], alphabet), Profile([list(b)], alphabet)).rows
    total, state = 0.0, None
    for p, q in zip(x, y, strict=True):
        now = "a" if p == "-" else "b" if q == "-" else None
        if now is None:
            total += MATCH if p == q else MISMATCH
        else:
            total -= GAP_EXTEND + (GAP_OPEN if now != state else 0)
        state = now
    assert total == pytest.approx(plain_global(a, b))


def test_residue_functions(spark):
    from pyspark.sql import functions as F

    from strandlake.functions import sequences as S
    from strandlake.functions import vectors as V

    row = spark.range(1).select(
        S.translated(F.lit("ATGGCCTAAxx")).alias("t"), S.kmer_code(F.lit("RA"), 2).alias("c"), S.digits_of(F.lit(1 + 25 * 3), 2).alias("d"),
        S.one_hot(F.lit(1), 3).alias("o"), S.dealign(F.lit("A-C.G~")).alias("g"), V.kimura(F.lit(0.5)).alias("k"), V.kimura(F.lit(0.95)).alias("far"),
        S.kmers(F.lit("abcd"), 2).alias("m"), S.kmers(F.lit("a"), 2).alias("none"),
    ).first()
    assert (row["t"], row["c"], list(row["d"]), list(row["o"]), row["g"]) == ("MA*", 1, [1, 3], [0, 1, 0], "ACG")
    assert row["k"] == pytest.approx(-math.log(1 - 0.5 - 0.05)) and row["far"] == 10
    assert list(row["m"]) == ["ab", "bc", "cd"] and list(row["none"]) == []
