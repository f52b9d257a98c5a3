"""Whole families: redundancy, batches, forests, gap maps and anchors against plain versions."""

import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake import queries, tree_queries
from strandlake.operators import anchors, batches, clusters, forests, gapmaps, profiles, redundancy, shuffles

# --- redundancy


def plain_filter(rows, percent):
    kept = {}
    for family, i, row in sorted(rows, key=lambda r: (repr(r[0]), r[1])):
        row, own = row or "", kept.setdefault(family, [])
        if any(other == row or (m := min(len(row), len(other))) and 100 * sum(x == y for x, y in zip(row, other)) > percent * m for _, other in own):  # noqa: B905
            continue
        own.append((i, row))
    return sorted((repr(f), i) for f, own in kept.items() for i, _ in own)


def near_copies(rng, letters="ACDE"):
    rows = []
    for family in ("a", "b", None):
        seeds = ["".join(rng.choice(list(letters), int(rng.integers(1, 90)))) for _ in range(6)]
        for _ in range(40):
            row = list(seeds[int(rng.integers(len(seeds)))])
            for _ in range(int(rng.integers(0, 4))):
                row[int(rng.integers(len(row)))] = str(rng.choice(list(letters)))
            cut = int(rng.integers(1, len(row) + 1)) if rng.random() < 0.3 else len(row)
            rows.append((family, len(rows), "".join(row[:cut])))
    return rows + [("a", 900, ""), ("a", 901, None), ("a", 902, "A"), ("é", 1, "ÉÉÉÉ"), ("é", 2, "ÉÉÉÉ"), ("é", 3, "ÉÉÉE")]


@pytest.mark.parametrize("percent", [98, 90, 75, 50])
def test_redundancy_filter_is_the_sequential_rule(spark, percent):
    rows = near_copies(np.random.default_rng(percent))
    df = spark.createDataFrame(rows, "family string, id long, row string").repartition(5)
    got = sorted((repr(r["family"]), r["id"]) for r in redundancy.keep_unlike(df, percent).collect())
    assert got == plain_filter(rows, percent) and len(got) < len(rows) - 20
    assert redundancy.keep_unlike(df.where("false"), percent).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(50, 99), st.integers(1, 400), st.data())
def test_similar_rows_share_enough_segments(percent, m, data):
    most = -(-(100 - percent) * m // 100) - 1  # mismatches of rows with a greater identity
    places = data.draw(st.sets(st.integers(0, m - 1), max_size=max(0, most)))
    level = m.bit_length() - 1
    n, width, kept = redundancy.segments_of(level, percent)
    broken = {p // width for p in places if p < n * width}
    assert n * width <= m and n - len(broken) >= n - kept + 1  # so the rarest ``kept`` of each share one


# --- forests

def random_tree(rng, n, kind):
    """(node, parent, length) of a binary tree of n leaves: a ladder, or merges at random."""
    free, nodes, up = list(range(n)), n, {}
    while len(free) > 1:
        a = free.pop(0 if kind == "ladder" else int(rng.integers(len(free))))
        b = free.pop(0 if kind == "ladder" else int(rng.integers(len(free))))
        up[a] = up[b] = nodes
        free.insert(0, nodes)
        nodes += 1
    return [(k, up.get(k), (float(rng.random()) if rng.random() > 0.2 else 0.0) if k in up else None) for k in range(nodes)]


def plain_weights(tree):
    kids, length = {}, {k: x or 0.0 for k, _, x in tree}
    for k, up, _ in tree:
        if up is not None:
            kids.setdefault(up, []).append(k)
    root = next(k for k, up, _ in tree if up is None)
    leaves, held, order, stack = {}, {}, [], [root]
    while stack:
        k = stack.pop()
        order.append(k)
        stack += kids.get(k, [])
    for k in reversed(order):
        leaves[k] = sum(leaves[c] for c in kids.get(k, [])) or 1
        held[k] = sum(held[c] + length[c] for c in kids.get(k, []))
    shared, spread = {root: float(leaves[root])}, {root: 0.0}
    for k in order:
        for c in kids.get(k, []):
            shared[c] = shared[k] * ((held[c] + length[c]) / held[k] if held[k] > 0 else leaves[c] / leaves[k])
            spread[c] = spread[k] + length[c] / leaves[c]
    return {k: (shared[k], 1.0 if spread[k] < 1e-4 else spread[k]) for k in order if k not in kids}, kids, root


def test_weights_and_best_leaves_of_random_trees(spark):
    rng, rows, want, best = np.random.default_rng(4), [], {}, {}
    for f, (n, kind) in enumerate([(1, "any"), (2, "any"), (9, "ladder"), (40, "ladder"), (33, "any"), (64, "any")]):
        tree = random_tree(rng, n, kind)
        told, kids, root = plain_weights(tree)
        value = {k: int(rng.integers(0, 6)) for k in range(n)}
        rows += [(f"f{f}", 1000 * f + k, None if up is None else 1000 * f + up, x, value.get(k), k if k < n else None) for k, up, x in tree]
        want |= {1000 * f + k: w for k, w in told.items()}

        def winner(k):
            return k if k not in kids else max((winner(c) for c in kids[k]), key=lambda x: (value[x], -x))

        best |= {(1000 * f + k, 1000 * f + c): winner(c) for k in kids for c in kids[k]}
    nodes = spark.createDataFrame(rows, "family string, node long, parent long, length double, value long, name long").repartition(4)
    got = {r["node"]: (r["shared"], r["spread"]) for r in forests.branch_weights(nodes).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)
    assert {(r["node"], r["side"]): r["best"] for r in forests.best_of_sides(nodes, "value", "name").collect()} == best
    assert forests.branch_weights(nodes.where("false")).count() == 0


@pytest.mark.parametrize("limit", [4, 1000])
def test_planted_trees(spark, limit):
    rng = np.random.default_rng(limit)
    rows = [("a", i, rng.normal(size=3).tolist()) for i in range(60)] + [("b", i, [1.0, 2.0]) for i in range(9)] + [("c", 5, [0.5])]
    rows += [("a", 100 + i, rows[3][2]) for i in range(5)] + [("a", 200, None), ("a", 201, [1.0]), ("a", 202, [float("nan")] * 3), (None, 1, [1.0]), (None, 2, [3.0]), ("d", 1, None)]
    nodes = forests.plant(spark.createDataFrame(rows, "family string, id long, v array<double>"), limit).collect()
    assert len({r["node"] for r in nodes}) == len(nodes)
    assert sorted((repr(r["family"]), r["id"]) for r in nodes if r["id"] is not None) == sorted((repr(f), i) for f, i, _ in rows)
    by = {r["node"]: r for r in nodes}
    assert sorted(repr(r["family"]) for r in nodes if r["parent"] is None) == sorted(map(repr, ["a", "b", "c", "d", None]))
    parents = {r["parent"] for r in nodes}
    for r in nodes:
        assert (r["id"] is None) == (r["node"] in parents)
        if r["parent"] is not None:
            up = by[r["parent"]]
            assert up["family"] == r["family"] and r["length"] == pytest.approx(up["height"] - r["height"]) and r["length"] >= 0
    assert forests.plant(spark.createDataFrame(rows[:0], "family string, id long, v array<double>"), limit).count() == 0


def test_a_planted_part_is_the_average_linkage_tree(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(12, 2))
    nodes = {r["node"]: r for r in forests.plant(spark.createDataFrame([("a", i, x.tolist()) for i, x in enumerate(v)], "family string, id long, v array<double>")).collect()}
    merged = {i: frozenset([i]) for i in range(12)}
    want = set()
    while len(merged) > 1:
        apart = lambda a, b: np.mean([np.linalg.norm(v[i] - v[j]) for i in merged[a] for j in merged[b]])  # noqa: B023, E731
        a, b = min(((a, b) for a in merged for b in merged if a < b), key=lambda p: apart(*p))
        h = apart(a, b) / 2
        merged[a] = merged[a] | merged.pop(b)
        want.add((merged[a], round(h, 9)))
    under = {k: set() for k in nodes}
    for r in nodes.values():
        if r["id"] is not None:
            k = r["node"]
            while k is not None:
                under[k].add(r["id"])
                k = nodes[k]["parent"]
    assert {(frozenset(under[k]), round(r["height"], 9)) for k, r in nodes.items() if r["id"] is None} == want


# --- batches and starts


def plain_batches(sizes, budget):
    out, batch, held = {}, -1, []
    for size, i in sorted(sizes):
        if max([size, *held]) * (len(held) + 1) > budget or batch < 0:
            batch, held = batch + 1 if held or batch < 0 else batch, []
        held.append(size)
        out[i] = batch, len(held) - 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.integers(1, 60))
def test_batches_of_sizes_are_the_greedy_walk(sizes, budget):
    counted = sorted({s: sizes.count(s) for s in sizes}.items())
    want = plain_batches([(s, i) for i, s in enumerate(sizes)], budget)
    got = {}
    ranked = sorted((s, i) for i, s in enumerate(sizes))
    found = {x[0]: x[1:] for x in batches.fill(counted, budget)}
    for rank, (s, i) in enumerate(ranked):
        first, open_, held, joins, each = found[s]
        r = rank - first
        got[i] = (open_, held + r) if r < joins else (open_ + 1 + (r - joins) // each, (r - joins) % each)
    assert got == want


def test_token_batches(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(x), "b") for i, x in enumerate(rng.integers(0, 50, 300))] + [(400, None, "b"), (401, 5000, "b"), (402, 5000, "b")]
    df = spark.createDataFrame(rows, "id long, n long, batch string").repartition(6)
    got = {r["id"]: (r["batch"], r["place"]) for r in batches.token_batches(df, "id", "n", 256, 2).collect()}
    assert got == plain_batches([((n or 0) + 2, i) for i, n, _ in rows], 256)
    assert batches.token_batches(df.where("false"), "id", "n", 10).count() == 0


def test_kmeans_starts(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=3) + 20 * (i % 4)).tolist()) for i in range(80)] + [(200, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    drawn, costs = clusters.plus_plus(df, "id", "v", 4, 3)
    for start, cost in zip(drawn, costs, strict=True):
        near = np.full(80, np.inf)
        for (_, c), total in zip(start, cost, strict=True):
            near = np.minimum(near, ((np.array([v for _, v in rows[:80]]) - c) ** 2).sum(axis=1))
            assert total == pytest.approx(near.sum())
        assert len({i % 4 for i, _ in start}) == 4  # far groups each get a center
    bad = [(k, rows[4 * k][1]) for k in range(4)]  # all in one group
    told, at, cost = clusters.best_of_starts(df, "id", "v", 4, given=[bad])
    assert cost <= clusters.lloyd(df, "id", "v", bad)[0].agg({"distance": "sum"}).first()[0] and cost < 80 * 3 * 3
    same = spark.createDataFrame([(i, [1.0]) for i in range(5)], "id long, v array<double>")
    assert [len(x) for x in clusters.plus_plus(same, "id", "v", 3, 2)[0]] == [1, 1]
    assert clusters.plus_plus(same.where("false"), "id", "v", 3, 2)[0] == [[], []]


# --- anchors


def test_anchors_are_the_sequential_rule(spark):
    rng, rows, want = np.random.default_rng(3), [], set()
    for pair in range(4):
        own = []
        for _ in range([0, 1, 60, 90][pair]):
            (sa, sb), n = rng.integers(0, 120, 2).tolist(), int(rng.integers(1, 9))
            own.append((sa, sa + n - 1, sb, sb + n - 1, int(rng.integers(0, 4))))
        own += own[:3]
        rows += [(pair, *x) for x in own]
        best = {}
        for *place, score in own:
            best[tuple(place)] = max(score, best.get(tuple(place), -1))
        kept = []
        for place in sorted(best, key=lambda p: (best[p], hashlib.md5(":".join(map(str, p)).encode()).hexdigest(), p), reverse=True):
            sa, ea, sb, eb = place
            if all((e < sa and f < sb) or (s > ea and t > eb) for s, e, t, f in kept):
                kept.append(place)
        want |= {(pair, *p, best[p]) for p in kept}
    rows += [(2, 5, 4, 1, 1, 9), (2, None, 4, 1, 1, 9), (9, 1, 1, 1, 1, None)]
    df = spark.createDataFrame(rows, "pair int, start_a int, end_a int, start_b int, end_b int, score int").repartition(3)
    got = [tuple(r) for r in anchors.consistent(df, ["pair"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert anchors.consistent(df.where("false"), ["pair"]).count() == 0


def test_word_anchors(spark):
    a = spark.createDataFrame([(1, "x one two three"), (2, None), (3, "two")], "id long, text string")
    b = spark.createDataFrame([(7, "one two  one\ntwo")], "id long, text string")
    got = sorted(tuple(r) for r in anchors.word_anchors(a, b, 2).collect())
    assert got == [(1, 7, 1, 2, 0, 1, 6), (1, 7, 1, 2, 2, 3, 6)]


# --- gap maps


def gapped(rng, row, most=3):
    return "".join("-" * int(rng.integers(0, most)) + c for c in row) + "-" * int(rng.integers(0, most))


def test_gap_maps_bring_alignments_into_one_frame(spark):
    rng = np.random.default_rng(6)
    a, b, shared_a, shared_b = [], [], [], []
    for f in ("x", "y", None):
        row = "".join(rng.choice(list("ACDEé"), 12))
        for rows, shared in ((a, shared_a), (b, shared_b)):
            frame = gapped(rng, row)
            shared.append((f, frame))
            rows.append((f, "shared", frame))
            for k in range(3):
                rows.append((f, f"{len(rows)}", "".join(rng.choice(list("AC-"), len(frame) if k else len(frame) // 2))))
    table = lambda rows: spark.createDataFrame(rows, "family string, name string, row string")
    one = lambda rows: spark.createDataFrame(rows, "family string, row string")
    merged = {}
    for rows, gaps in zip((a, b), gapmaps.merge_maps(one(shared_a), one(shared_b)), strict=True):
        got = gapmaps.apply(table(rows), gaps).collect()
        assert sorted(repr((r["family"], r["name"], r["row"].rstrip("-").replace("-", ""))) for r in got) == sorted(repr((f, n, r.replace("-", ""))) for f, n, r in rows)
        for r in got:
            if r["name"] == "shared":
                merged.setdefault(r["family"], []).append(r["row"])
    assert all(len(x) == 2 and x[0] == x[1] for x in merged.values())  # the shared row stands the same in both
    assert gapmaps.apply(table(a[:1] + [("q", "z", None)]), one(shared_a[:0]).selectExpr("family", "1 as col", "1 as n")).count() == 2


@settings(max_examples=15, deadline=None)
@given(st.data())
def test_gap_maps_compose(spark, data):
    row = "ABCDEFGH"
    draw = lambda width: data.draw(st.lists(st.tuples(st.integers(0, width), st.integers(1, 3)), max_size=5, unique_by=lambda e: e[0]))
    inner = sorted(draw(len(row)))
    outer = sorted(draw(len(row) + sum(n for _, n in inner)))
    table = lambda m: spark.createDataFrame([("f", c, n) for c, n in m], "family string, col int, n long")
    rows = spark.createDataFrame([("f", "r", row)], "family string, name string, row string")
    step = gapmaps.apply(gapmaps.apply(rows, table(inner)), table(outer)).first()["row"]
    assert gapmaps.apply(rows, gapmaps.compose(table(inner), table(outer))).first()["row"] == step


def test_common_gaps_come_back(spark):
    rows = [("a", "1", "--A-C--"), ("a", "2", "--AG---"), ("a", "3", None), ("b", "1", "AC"), ("c", "1", "----"), (None, "1", "-A")]
    df = spark.createDataFrame(rows, "family string, name string, row string").repartition(3)
    cut, taken = gapmaps.common_gaps(df)
    got = {(r["family"], r["name"]): r["row"] for r in cut.collect()}
    assert got == {("a", "1"): "A-C", ("a", "2"): "AG-", ("a", "3"): None, ("b", "1"): "AC", ("c", "1"): "", (None, "1"): "A"}
    assert sorted(map(repr, gapmaps.apply(cut, taken).collect())) == sorted(map(repr, df.collect()))
    assert gapmaps.common_gaps(df.where("false"))[0].count() == 0


# --- shuffles


@settings(max_examples=150, deadline=None)
@given(st.text("abcé", max_size=40), st.integers(0, 99))
def test_walks_keep_pairs_and_ends(row, seed):
    got = shuffles.walk_of_pairs(row, np.random.default_rng(seed))
    assert sorted(zip(got, got[1:], strict=False)) == sorted(zip(row, row[1:], strict=False)) and (got[:1], got[-1:]) == (row[:1], row[-1:])
    for order in (0, 1):
        drawn = shuffles.sampled_row(row, np.random.default_rng(seed), order)
        assert len(drawn) == len(row) and set(drawn) <= set(row)
        if order and len(row) > 1:
            pairs, open_ = set(zip(row, row[1:], strict=False)), {row[-1]} - set(row[:-1])
            assert all(p in pairs or p[0] in open_ for p in zip(drawn, drawn[1:], strict=False))


def test_walks_reach_every_order(spark):
    seen = {shuffles.walk_of_pairs("abacada", np.random.default_rng(k)) for k in range(200)}
    assert len(seen) == 6  # the three ways round a, in any order


def test_shuffled_rows_and_columns(spark):
    rows = [("x", 1, "ACGTAC"), ("x", 2, "TTGGCC"), ("x", 3, "A"), ("y", 4, "GATTACA" * 9), (None, 5, "AC"), ("x", 6, None), ("x", 7, "")]
    df = spark.createDataFrame(rows, "family string, name long, aseq string").repartition(3)
    kept = {r["name"]: r["aseq"] for r in shuffles.keep_pairs(df, "name", "aseq").collect()}
    assert kept == {r["name"]: r["aseq"] for r in shuffles.keep_pairs(df.repartition(1), "name", "aseq").collect()}  # ids fix the draw
    assert kept[6] is None and kept[7] == "" and kept[4] != rows[3][2] and sorted(kept[4]) == sorted(rows[3][2])
    cells = {"x": [tuple(c) for c in zip("ACGTAC", "TTGGCC", "A-----", "------", strict=True)]}
    for draw, same in ((shuffles.resampled_columns, False), (shuffles.shuffled_columns, True)):
        got = {r["name"]: r["aseq"] for r in draw(df).collect()}
        columns = [tuple(c) for c in zip(got[1], got[2], got[3], got[7], strict=True)]
        assert set(columns) <= set(cells["x"]) and len(columns) == 6 and got[6] is None  # rows stay aligned
        assert not same or sorted(columns) == sorted(cells["x"])
    assert shuffles.sampled(df.where("false"), "name", "aseq").count() == 0


def test_resampled_letters_are_those_of_the_sql(spark, tmp_path):
    """rows none of whose columns are drawn, documents without a source, equal ids, other writing."""
    rows = [(k, "src11", "ab"[: k % 2 + 1]) for k in range(9)] + [(20, "src11", "Wide " * 9), (21, None, "xyz"), (22, "é", "Éa-\U0001F600b\n"), (22, "é", "a?"), (None, "", "tail"), (23, "x", ""), (24, "y", None)]
    rows += [(100 + k, f"s{k}", text) for k in range(12) for text in ("a", "long " * 5)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.execute(queries.ORACLE_SQL["resampled_columns"]).fetchall()
    got = [tuple(r) for r in tree_queries.resampled_columns(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr) and any(r[2] is None for r in wanted)


# --- small functions


def test_rows_and_scores(spark):
    from pyspark.sql import functions as F

    from strandlake.functions import sequences as S
    from strandlake.functions import vectors as V
    from strandlake.operators import statistics

    rows = [("A-X..X-", "ABC"), ("--", ""), ("", ""), ("AX", "A"), (None, "A"), ("É-é", "xy")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(S.restored(F.col("a"), F.col("b"))).collect()] == ["A-B..C-", "--", "", None, None, "x-y"]
    told = spark.range(1).select(V.score_distance(F.lit(3), F.lit(6), F.lit(4)), V.score_distance(F.lit(0), F.lit(0), F.lit(4)), V.score_distance(F.lit(9), F.lit(6), F.lit(4))).first()
    assert tuple(told) == (0.5, 2.0, 0.0)
    points = [(1.0, 2.0, 1.0), (2.0, 4.5, 2.0), (4.0, 7.0, 0.5), (None, 1.0, 1.0)]
    line = spark.createDataFrame(points, "x double, y double, w double").select(statistics.weighted_line(F.col("x"), F.col("y"), F.col("w")).alias("l")).first()["l"]
    slope, intercept = np.polyfit([p[0] for p in points[:3]], [p[1] for p in points[:3]], 1, w=np.sqrt([p[2] for p in points[:3]]))
    assert (line["slope"], line["intercept"]) == pytest.approx((slope, intercept))
    assert spark.createDataFrame(points[:1], "x double, y double, w double").select(statistics.weighted_line(F.col("x"), F.col("y"), F.col("w")).alias("l")).first()["l"]["slope"] is None


def test_sampled_identity_and_spans(spark):
    from pyspark.sql import functions as F

    from strandlake.functions import sequences as S
    from strandlake.operators import alignments

    rows = [("x", i, s) for i, s in enumerate(["AC-GT", "ACTG", "A", "----", None])] + [("y", 0, "AC"), (None, 0, "AA"), (None, 1, "AC")]
    ranked = spark.createDataFrame(rows, "family string, rank long, aseq string").repartition(3)
    pairs = alignments.drawn_pairs(ranked, 30).collect()
    assert {r["family"] for r in pairs} == {"x", None} and all(r["a"] != r["b"] and 0 <= r["b"] < (5 if r["family"] == "x" else 2) for r in pairs)
    text = {(f, i): s or "" for f, i, s in rows}

    def plain(f, a, b):
        x, y = text[f, a], text[f, b]
        least = min(len(x.replace("-", "")), len(y.replace("-", "")))
        return sum(p == q != "-" for p, q in zip(x, y, strict=False)) / least if least else 0.0

    got = {r["family"]: r["identity"] for r in alignments.sampled_identity(ranked, 30).collect()}
    assert got == {f: pytest.approx(np.mean([plain(r["family"], r["a"], r["b"]) for r in pairs if r["family"] == f])) for f in ("x", None)}
    spans = spark.range(1).select(S.residue_span(F.lit("-A-CG-"), F.lit(2), F.lit(4)).alias("a"), S.residue_span(F.lit("-A-CG-"), F.lit(6), F.lit(9)).alias("b")).first()
    assert tuple(spans["a"]) == (1, 2) and tuple(spans["b"]) == (None, None)


def test_corrected_distances_take_the_table(spark):
    from pyspark.sql import functions as F

    from strandlake.functions import vectors as V

    shares = [0.0, 0.5, 0.7499, 0.75, 0.7506, 0.803, 0.93, 0.9301, 1.0]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in shares], "p double").select(V.kimura(F.col("p"))).collect()]
    assert got[3:] == [1.95, 1.96, 2.50, 9.88, 10.0, 10.0] and got[:3] == pytest.approx([-np.log(1 - p - p * p / 5) for p in shares[:3]])
    assert len(V.FAR_DISTANCES) == 181 and V.FAR_DISTANCES == sorted(V.FAR_DISTANCES)


# --- profiles


def plain_transitions(rows):
    out = {}
    for family in {r[0] for r in rows}:
        own = [(w if w is not None else 1.0, s or "") for f, w, s in rows if f == family]
        width = max(len(s) for _, s in own)
        cols = [c for c in range(width) if 2 * sum(len(s) > c and s[c] != "-" for _, s in own) > len(own)]
        for w, s in own:
            s = s.ljust(width, "-")
            for j, c in enumerate(cols):
                end = cols[j + 1] if j + 1 < len(cols) else width
                way = ["M" if s[c] != "-" else "D"] + ["I" for x in s[c + 1 : end] if x != "-"] + (["M" if s[end] != "-" else "D"] if j + 1 < len(cols) else [])
                for a, b in zip(way, way[1:], strict=False):
                    out[family, j, a + b] = out.get((family, j, a + b), 0.0) + w
    return out


def test_profile_transitions_against_a_plain_walk(spark):
    rng = np.random.default_rng(12)
    rows = [(f, float(rng.integers(1, 5)) / 2, "".join(rng.choice(list("AC-"), int(rng.integers(0, 25))))) for f in ("x", "y", None) for _ in range(9)]
    rows += [("x", None, "ACAC-A"), ("x", 1.0, None), ("z", 1.0, "---"), ("z", 1.0, "A--")]
    df = spark.createDataFrame(rows, "family string, weight double, aseq string").repartition(3)
    got = {(r["family"], r["column"], r["step"]): r["weight"] for r in profiles.transitions(df).collect()}
    assert got == pytest.approx(plain_transitions(rows)) and profiles.transitions(df.where("false")).count() == 0
    counts = spark.createDataFrame([("x", 0, "A", 2), ("x", 0, "C", 2), ("x", 0, "-", 9), ("x", 1, "A", 3)], "family string, pos int, residue string, n long")
    assert {r["pos"]: r["effective"] for r in profiles.effective_numbers(counts).collect()} == pytest.approx({0: 2.0, 1: 1.0})
