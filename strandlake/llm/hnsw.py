"""Embedding near-dedup: hierarchical navigable small-world graphs, one for each shard.

Vectors of one label and length are dealt into shards by a hash; each shard becomes
a graph, written as one row of a table. Every vector then queries every shard of
its label by beam search.

Beams are as wide as audits ask. When a graph is built, ``AUDIT_ROWS`` of its
vectors are turned away until their cosine is just the threshold, and searched for:
the hardest links there can be, in any number, and no query stands in the graph
itself. The beam doubles from ``BEAM`` until ``AUDIT_RECALL`` of these queries find
the vector they were turned from. Where a block of vectors queries the shard, some of them are audited again
by their own true links, themselves left out, with the same doubling. A query with links
in a quarter of its beam (``FULL_SHARE``) may have more than it shows: it isn't judged
and goes on with twice the beam up to ``FULL_BEAM``. What is full then stands in a dense
group, and is compared with the shard: no number of links is a cap.
:func:`near_vectors` can return the pooled audits. Links are verified by cosine in
double precision, counted, and joined into components.

Exact copies are one node of a graph, with their number. Defined results: vectors
that are null, empty, zero, or hold null or non-finite components, and rows with a
null label or vec_id, link with nothing; vectors of different lengths don't link;
rows that repeat a vec_id are rows of their own for n_links; an empty table gives an
empty table. Recall rests on the audits, so links are found with the stated recall,
never invented.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.components import Forest, connected_components
from strandlake.storage import materialize

COSINE = 0.93
#: A shard's graph is sent once for each block of queries, eight times as many as it has vectors.
SHARD_ROWS, BLOCK_ROWS = 8192, 65536
LINKS, BUILD_BEAM, BEAM, FULL_BEAM, FULL_SHARE = 12, 48, 32, 128, 4
AUDIT_ROWS, AUDIT_RECALL = 256, 0.995
_AT_ONCE = 512
_OPEN_AT_ONCE = 4
_INDEX = "label int, dim int, shard int, nodes binary, copies binary, vectors binary, links binary, levels binary, beam int, expected long, reached long"
_FOUND = "a long, b long, n long, beam int, expected long, reached long"


class Graph:
    """A graph over unit vectors: links[level] is (n, width) with -1 for none."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray] | None = None):
        self.x = x
        self.links = links if links is not None else []
        if links is None:
            self._build()

    def _build(self) -> None:
        n = len(self.x)
        rng = np.random.default_rng(n)
        level = np.minimum((-np.log(rng.random(n)) / np.log(LINKS)).astype(int), 8)
        level[0] = level.max(initial=0)  # the first vector is the way in
        top = int(level.max(initial=0))
        self.links = [np.full((n, 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k in range(top + 1)]
        done = 1
        while done < n:
            new = np.arange(done, min(n, done + max(1, min(_AT_ONCE, done))))
            entry = np.zeros((len(new), 1), np.int64)
            for k in range(top, -1, -1):
                here = level[new] >= k
                found, sims = self._beam(self.x[new], entry, 1 if not here.any() else BUILD_BEAM, k)
                entry = np.where(found[:, :1] >= 0, found[:, :1], 0)
                if here.any():
                    self._connect(new[here], found[here], sims[here], k)
            done = new[-1] + 1
        self._join_parts()

    def _reached(self) -> np.ndarray:
        """Which nodes the way in leads to on the lowest level."""
        seen = np.zeros(len(self.x), bool)
        front = np.zeros(1, np.int64)
        while len(front):
            seen[front] = True
            near = np.unique(self.links[0][front])
            front = near[near >= 0][~seen[near[near >= 0]]]
        return seen

    def _join_parts(self) -> None:
        """Give nodes that nothing leads to a link from their nearest neighbour that is reached, in a further column."""
        while True:
            seen = self._reached()
            lost, known = np.flatnonzero(~seen), np.flatnonzero(seen)
            if not len(lost):
                return
            lost = lost[:_AT_ONCE]
            near = known[(self.x[lost] @ self.x[known].T).argmax(axis=1)]
            near, one = np.unique(near, return_index=True)
            more = np.full((len(self.x), 1), -1, np.int32)
            more[near, 0] = lost[one]
            self.links[0] = np.concatenate([self.links[0], more], axis=1)

    def _connect(self, new: np.ndarray, found: np.ndarray, sims: np.ndarray, k: int) -> None:
        """Link a batch to what its beams found and to each other, and back."""
        among = self.x[new] @ self.x[new].T
        np.fill_diagonal(among, -2)
        near = np.argsort(-among, axis=1)[:, : LINKS]
        pool = np.concatenate([found, new[near]], axis=1)
        score = np.concatenate([sims, np.take_along_axis(among, near, 1)], axis=1)
        pool = np.where(score > -2, pool, -1)
        chosen = self._diverse(new, pool, score, LINKS)
        self.links[k][new, :LINKS] = chosen
        source = np.repeat(new, chosen.shape[1])
        target = chosen.reshape(-1)
        ok = target >= 0
        source, target = source[ok], target[ok]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
        width = self.links[k].shape[1]
        extra = np.full((len(nodes), int(count.max(initial=0))), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(begin, count)] = source
        pool = np.concatenate([self.links[k][nodes].astype(np.int64), extra], axis=1)
        score = np.where(pool >= 0, np.einsum("id,ijd->ij", self.x[nodes], self.x[pool]), -3)
        for at in range(0, len(nodes), _AT_ONCE):
            part = slice(at, at + _AT_ONCE)
            self.links[k][nodes[part]] = self._diverse(nodes[part], pool[part], score[part], width)

    def _diverse(self, nodes: np.ndarray, pool: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of each pool: those nearer to the node than to any chosen one first, then the nearest others."""
        order = np.argsort(-score, axis=1, kind="stable")
        pool, score = np.take_along_axis(pool, order, 1), np.take_along_axis(score, order, 1)
        again = np.zeros(pool.shape, bool)  # repeated entries stand side by side or have equal scores
        by_id = np.argsort(pool, axis=1, kind="stable")
        sorted_ids = np.take_along_axis(pool, by_id, 1)
        np.put_along_axis(again, by_id, np.concatenate([np.zeros((len(pool), 1), bool), sorted_ids[:, 1:] == sorted_ids[:, :-1]], axis=1), 1)
        valid = (pool >= 0) & ~again & (pool != nodes[:, None])
        vectors = self.x[np.maximum(pool, 0)]
        taken = np.zeros(pool.shape, bool)
        nearest = np.full(pool.shape, -2.0, np.float32)  # to any chosen one
        for j in range(pool.shape[1]):
            pick = valid[:, j] & (score[:, j] > nearest[:, j]) & (taken.sum(axis=1) < most)
            taken[:, j] = pick
            rows = np.flatnonzero(pick)
            if len(rows):
                nearest[rows] = np.maximum(nearest[rows], np.einsum("id,ijd->ij", vectors[rows, j], vectors[rows]))
        rank = np.where(taken, 0, np.where(valid, 1, 2)) * pool.shape[1] + np.arange(pool.shape[1])
        first = np.argsort(rank, axis=1)[:, :most]
        out = np.take_along_axis(np.where(valid, pool, -1), first, 1)
        if out.shape[1] < most:
            out = np.concatenate([out, np.full((len(out), most - out.shape[1]), -1)], axis=1)
        return out

    def _beam(self, q: np.ndarray, entry: np.ndarray, beam: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries together on one level: ids (-1: none) and cosines, best first."""
        n, rows = len(self.x), len(q)
        links = self.links[k]
        ids = np.full((rows, beam), -1, np.int64)
        sims = np.full((rows, beam), -2, np.float32)
        width = min(beam, entry.shape[1])
        ids[:, :width] = entry[:, :width]
        sims[:, :width] = np.where(ids[:, :width] >= 0, np.einsum("id,ijd->ij", q, self.x[ids[:, :width]]), -2)
        opened = ids < 0
        seen = np.zeros((rows, n), bool)
        seen[np.arange(rows)[:, None], np.maximum(ids[:, :width], 0)] |= ids[:, :width] >= 0
        active = np.arange(rows)
        each = min(_OPEN_AT_ONCE, beam)
        while len(active):
            closed = np.where(opened[active], np.float32(-3), sims[active])
            best = np.argpartition(-closed, each - 1, axis=1)[:, :each] if each < beam else np.tile(np.arange(beam), (len(active), 1))
            worth = np.take_along_axis(closed, best, 1) > -2
            going = worth.any(axis=1)
            active, best, worth = active[going], best[going], worth[going]
            if not len(active):
                break
            opened[active[:, None], best] = True
            nodes = np.where(worth, ids[active[:, None], best], -1)
            near = np.where(nodes[:, :, None] >= 0, links[np.maximum(nodes, 0)], -1).reshape(len(active), -1).astype(np.int64)
            near.sort(axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[active[:, None], np.maximum(near, 0)]
            at, place = np.nonzero(fresh)
            got = near[at, place]
            seen[active[at], got] = True
            new_sims = np.full(near.shape, -2, np.float32)
            new_sims[at, place] = np.einsum("id,id->i", q[active[at]], self.x[got])
            all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)
            all_sims = np.concatenate([sims[active], new_sims], axis=1)
            all_open = np.concatenate([opened[active], ~fresh], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[active] = np.take_along_axis(all_ids, top, 1)
            sims[active] = np.take_along_axis(all_sims, top, 1)
            opened[active] = np.take_along_axis(all_open, top, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` found for each query: ids (-1: none) and cosines, best first."""
        entry = np.zeros((len(q), 1), np.int64)
        for k in range(len(self.links) - 1, 0, -1):
            found, _ = self._beam(q, entry, 1, k)
            entry = np.where(found >= 0, found, 0)
        return self._beam(q, entry, beam, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def turned_away(x: np.ndarray, cosine: float, seed: int) -> np.ndarray:
    """Unit vectors at just above ``cosine`` to those of ``x``, in random directions."""
    side = np.random.default_rng(seed).normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    length = np.sqrt((side * side).sum(axis=1, keepdims=True))
    side = np.divide(side, length, out=np.zeros_like(side), where=length > 1e-9)  # one dimension has no other direction
    c = min(1.0, cosine + 1e-6)
    return _unit(c * x + np.sqrt(1 - c * c) * side)


def audited_beam(graph: Graph, exact: np.ndarray, cosine: float, beam: int = BEAM, rows: int = AUDIT_ROWS, recall: float = AUDIT_RECALL) -> tuple[int, int, int]:
    """The first beam, doubled from ``beam``, that finds ``recall`` of the vectors that were turned away; how many were judged, and found.

    Queries whose beams are full of links aren't judged, as such go on to wider beams when the graph is queried.
    """
    which = np.unique(np.linspace(0, len(exact) - 1, min(rows, len(exact))).astype(int))
    q = turned_away(exact[which], cosine, len(exact))
    while True:
        beam = min(beam, len(exact))
        i, v, full = _links_of(graph, exact, q, cosine, beam)
        met = np.zeros(len(which), bool)
        met[i[v == which[i]]] = True
        true, found = int((~full).sum()), int(met[~full].sum())
        if found >= recall * true or beam == len(exact):
            return beam, true, found
        beam *= 2


def _build_shard(cosine: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """The index row of one shard."""
        group = group.sort_values("node", kind="stable")
        vectors = np.stack(group["embedding"].to_numpy()).astype(np.float32)
        exact = _unit(vectors)
        graph = Graph(exact.astype(np.float32))
        beam, expected, reached = audited_beam(graph, exact, cosine)
        return pd.DataFrame([{
            "label": group["label"].iloc[0], "dim": group["dim"].iloc[0], "shard": group["shard"].iloc[0],
            "nodes": group["node"].to_numpy(np.int64).tobytes(), "copies": group["copies"].to_numpy(np.int64).tobytes(),
            "vectors": vectors.tobytes(), "links": b"".join(x.tobytes() for x in graph.links),
            "levels": np.array([x.shape[1] for x in graph.links], np.int32).tobytes(), "beam": beam, "expected": expected, "reached": reached,
        }])

    return run


def _links_of(graph: Graph, exact: np.ndarray, q: np.ndarray, cosine: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector) pairs at or above ``cosine`` in double precision, and which beams are full of links."""
    of_query, of_vector, full = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.zeros(len(q), bool)
    single = q.astype(np.float32)
    slack = np.float32(cosine - 1e-4)
    for at in range(0, len(q), _AT_ONCE):
        ids, sims = graph.search(single[at : at + _AT_ONCE], beam)
        near = (sims >= slack) & (ids >= 0)
        full[at : at + _AT_ONCE] = (near.sum(axis=1) * FULL_SHARE >= beam) & (beam < len(graph.x))
        i, j = np.nonzero(near)
        v = ids[i, j]
        sure = np.einsum("id,id->i", q[at + i], exact[v]) >= cosine
        of_query.append(at + i[sure])
        of_vector.append(v[sure])
    return np.concatenate(of_query), np.concatenate(of_vector), full


def _all_links(exact: np.ndarray, q: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """All (query, vector) links, by matrix products."""
    of_query, of_vector = [], []
    for at in range(0, len(q), _AT_ONCE):
        i, v = np.nonzero(q[at : at + _AT_ONCE] @ exact.T >= cosine)
        of_query.append(at + i)
        of_vector.append(v)
    return np.concatenate(of_query), np.concatenate(of_vector)


def find_links(graph: Graph, exact: np.ndarray, q: np.ndarray, cosine: float, beam: int = BEAM, recall: float = AUDIT_RECALL, own: np.ndarray | None = None, rows: int = AUDIT_ROWS):
    """(query, vector) links by beams that double until audits pass; and beam, true links and found links of the audited queries.

    ``own`` is the place of each query among the vectors, -1 for none; audits don't count that pair.
    """
    own = np.full(len(q), -1) if own is None else own
    audited = np.unique(np.linspace(0, len(q) - 1, min(rows, len(q))).astype(int))
    expected = np.zeros(len(q), np.int64)
    for i in audited:
        true = np.flatnonzero(exact @ q[i] >= cosine)
        expected[i] = (true != own[i]).sum()
    is_audited = np.zeros(len(q), bool)
    is_audited[audited] = True
    open_, pairs, found, beam, first = np.arange(len(q)), [], 0, min(beam, len(exact)), None
    while len(open_):
        i, v, full = _links_of(graph, exact, q[open_], cosine, beam)
        count = np.bincount(i[v != own[open_[i]]], minlength=len(open_))
        judged = is_audited[open_] & ~full
        reached = beam >= len(exact) or count[judged].sum() >= recall * expected[open_[judged]].sum()
        closing = ~full if reached else np.zeros(len(open_), bool)
        if reached:
            first = first or beam
            found += int(count[judged & closing].sum())
        pairs.append((open_[i[closing[i]]], v[closing[i]]))
        open_ = open_[~closing]
        if reached and beam >= FULL_BEAM and len(open_):
            i, v = _all_links(exact, q[open_], cosine)
            count = np.bincount(i[v != own[open_[i]]], minlength=len(open_))
            found += int(count[is_audited[open_]].sum())
            pairs.append((open_[i], v))
            break
        beam = min(2 * beam, len(exact))
    return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs]), (first, int(expected.sum()), found)


def _query(cosine: float):
    def run(queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(index):
            return pd.DataFrame({x.split()[0]: [] for x in _FOUND.split(", ")}).astype("int64")
        row = index.iloc[0]
        nodes, copies = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["copies"], np.int64)
        exact = _unit(np.frombuffer(row["vectors"], np.float32).reshape(len(nodes), row["dim"]))
        widths = np.frombuffer(row["levels"], np.int32)
        flat, links, at = np.frombuffer(row["links"], np.int32), [], 0
        for w in widths:
            links.append(flat[at : at + len(nodes) * w].reshape(len(nodes), w))
            at += len(nodes) * w
        q = _unit(np.stack(queries["embedding"].to_numpy()).astype(np.float32))
        own = queries["node"].to_numpy(np.int64)
        place = np.minimum(np.searchsorted(nodes, own), len(nodes) - 1)  # nodes are sorted
        graph = Graph(exact.astype(np.float32), links)
        i, v, audit = find_links(graph, exact, q, cosine, int(row["beam"]), own=np.where(nodes[place] == own, place, -1))
        other = own[i] != nodes[v]
        i, v = i[other], v[other]
        n = np.bincount(i, weights=copies[v], minlength=len(own)).astype(np.int64)
        names, place = np.unique(np.concatenate([own, nodes]), return_inverse=True)
        forest = Forest(len(names))
        forest.add(place[i], place[len(own) + v])
        a, b = np.array(forest.links, np.int64).reshape(-1, 2).T
        some = n > 0
        counts = pd.DataFrame({"a": own[some], "b": own[some], "n": n[some]})
        links = pd.DataFrame({"a": names[a], "b": names[b], "n": np.zeros(len(a), np.int64)})
        told = pd.concat([counts, links, pd.DataFrame({"a": [int(row["shard"])], "b": [-1], "n": [-1]})], ignore_index=True)
        for name, value in zip(("beam", "expected", "reached"), audit, strict=True):
            told[name] = np.where(told["n"] < 0, value, 0)
        return told

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, with_audits: bool = False):
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding, label).

    With ``with_audits`` also a table (stage, beam, expected, reached): one row for each graph built and
    for each block that queried one, with the beam taken and the audited true links there are and it found.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("int").alias("label"))
    usable = F.expr(
        "vec_id is not null and label is not null and embedding is not null and size(embedding) > 0 "
        "and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
    )
    classes = materialize(
        rows.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
        .withColumn("dim", F.size("embedding")).withColumn("h", F.xxhash64("embedding"))
    )
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("rows")).select(
        F.col("label").alias("l"), F.col("dim").alias("d"),
        F.ceil(F.col("rows") / shard_rows).cast("int").alias("shards"), F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks"),
    )
    dealt = classes.join(sizes, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d"))).drop("l", "d")
    home = dealt.withColumn("shard", F.pmod("h", "shards").cast("int"))
    index = materialize(home.groupBy("label", "dim", "shard").applyInPandas(_build_shard(cosine), _INDEX), "lz4")
    placed = index.join(sizes, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d"))).drop("l", "d", "shards")
    placed = placed.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
    queries = (
        dealt.withColumn("block", F.pmod(F.xxhash64("h"), "blocks").cast("int"))
        .withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)")))
        .select("label", "dim", "shard", "block", "node", "embedding")
    )
    keys = ["label", "dim", "shard", "block"]
    found = materialize(queries.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(_query(cosine), _FOUND))
    n_links = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    components = connected_components(found.where("n = 0").select("a", "b"))
    told = (
        classes.select("label", "embedding", "node", "copies").join(n_links, "node", "left").join(components, "node", "left")
        .select(
            F.col("label").alias("l"), F.col("embedding").alias("e"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"),
        )
    )
    component = F.coalesce("component_id", "vec_id")
    out = rows.join(told, usable & (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
    if not with_audits:
        return out
    told = ["beam", "expected", "reached"]
    return out, index.select(F.lit("build").alias("stage"), *told).unionByName(found.where("n < 0").select(F.lit("query").alias("stage"), *told))


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH RECURSIVE unit AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM
  (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL)
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND len(a.u) = len(b.u) AND a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.93),
reach AS (SELECT vec_id, vec_id AS other FROM unit UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a),
least AS (SELECT vec_id, min(other) AS component FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(l.component, e.vec_id) AS component_id, e.vec_id = coalesce(l.component, e.vec_id) AS kept
FROM embeddings e LEFT JOIN counts c ON e.vec_id = c.vec_id LEFT JOIN least l ON e.vec_id = l.vec_id
"""
