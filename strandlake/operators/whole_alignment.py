"""One alignment for each family of any size: parts aligned by themselves, then profiles of parts.

Equal rows of a family are one row until the end. The distinct rows are halved by their
letter pairs until parts hold at most ``PART`` of them, each part is aligned in a task
along its average-linkage tree, and what goes on is the part's profile: how often each
letter stands in each column. Profiles are grouped by the means of their parts and aligned
in the same way, level over level, until a family is one profile; there are
log(rows) / log(``PART``) levels. A level also says where each column of what it aligned
went. These places are chained back down the levels by a join each, and a row is written
once, from its letters and the places they end at.

So no task sees more than ``PART`` rows or profiles, and what is shuffled for a row is as
long as the row. A profile is as wide as its alignment and as deep as the family has letters.

Two profiles are matched by expected scores with affine gaps. The time of a match is the
product of the two widths, and its memory one byte for each pair of columns, so that
widths beyond ``MAX_CELLS`` are refused.

Defined results: a null row and an empty one are all gaps; ``-`` in the input is no letter
and dropped; rows that repeat, names included, each come back; a null family is a family;
a family of one distinct row is that row; an empty table gives an empty one; other columns
are left out. On ties columns are matched, then gaps stand in the second profile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.forests import halved
from strandlake.operators.ordering import global_rank
from strandlake.operators.trees import agglomerate
from strandlake.storage import materialize, spread

GAP = "-"
#: Rows or profiles in one task: their distances are a matrix of this many rows.
PART = 128
#: Parts that one task aligns, one after the other.
PARTS_A_TASK = 64
#: Rows whose vectors one task halves, ``PAIRS`` + 2 numbers each: about 35 MB.
HALVED_AT_ONCE = 65_536
#: Pairs of columns in one match, a byte each.
MAX_CELLS = 400_000_000
#: Cells of the matches that are filled in together; one that is larger is by itself.
CELLS_AT_ONCE = 200_000
#: Letters of rows, or cells of profiles, in the parts that are aligned together; at least one part.
AT_ONCE = 100_000
GAP_OPEN, GAP_EXTEND, MATCH, MISMATCH = 1.53, 0.123, 1.0, -0.5
#: Letter pairs are counted in this many buckets for the halving, letter triples in the other for a part's tree.
PAIRS, TRIPLES = 64, 1024

_ALIGNED = "part long, id long, places array<int>, letters string, counts array<double>"


def matched(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Where the columns of two profiles (columns x letters, shares of rows) go in their best alignment, and its width."""
    return matched_all([(a, b)])[0]


def matched_all(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """:func:`matched` for each pair; pairs of about the same widths are filled in together, each row of all at once."""
    for a, b in pairs:
        if len(a) * len(b) > MAX_CELLS:
            raise ValueError(f"profiles of {len(a)} and {len(b)} columns; a match takes {MAX_CELLS} pairs")
    out, chunk, wide = [None] * len(pairs), [], 0
    for at in sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1]))):
        wide_now = max(wide, len(pairs[at][1]) + 1)
        if chunk and (len(chunk) + 1) * wide_now * (len(pairs[at][0]) + 1) > CELLS_AT_ONCE:
            _match_chunk(pairs, chunk, out)
            chunk, wide_now = [], len(pairs[at][1]) + 1
        chunk.append(at)
        wide = wide_now
    if chunk:
        _match_chunk(pairs, chunk, out)
    return out


def _padded(profiles: list[np.ndarray]) -> np.ndarray:
    """Profiles x columns x letters, zero behind the end of a profile: cells there come after all that it needs."""
    all_ = np.zeros((len(profiles), max(map(len, profiles)), max(p.shape[1] for p in profiles)))
    for own, p in zip(all_, profiles, strict=True):
        own[: len(p), : p.shape[1]] = p
    return all_


def _match_chunk(pairs: list[tuple[np.ndarray, np.ndarray]], chunk: list[int], out: list) -> None:
    a, b = _padded([pairs[k][0] for k in chunk]), _padded([pairs[k][1] for k in chunk])
    size, n, m = len(chunk), a.shape[1], b.shape[1]
    less, fill_b = MISMATCH * a.sum(axis=2), b.sum(axis=2)
    steps = GAP_EXTEND * np.arange(m + 1)
    # Bits of a cell: 1 it comes by a gap in b, 2 a gap in a that ends here is better, 4 that gap in b was open before, 8 a later gap in a starts here.
    way = np.zeros((n + 1, size, m + 1), np.uint8)
    h = np.zeros((size, m + 1))
    h[:, 1:] = -(GAP_OPEN + steps[1:])
    way[0, :, 1:], way[0, :, 0] = 2, 8
    f = np.full((size, m + 1), -np.inf)
    for i in range(1, n + 1):
        cell = way[i]
        opened = h - GAP_OPEN
        np.multiply(f > opened, np.uint8(4), out=cell)
        np.maximum(opened, f, out=f)
        f -= GAP_EXTEND
        diagonal = h[:, :-1] + less[:, i - 1, None] * fill_b
        diagonal += (MATCH - MISMATCH) * np.matmul(b, a[:, i - 1, :, None])[:, :, 0]  # column by column, so that rounding and ties are those of a pair by itself
        base = f.copy()
        cell[:, 1:] += f[:, 1:] > diagonal
        np.maximum(f[:, 1:], diagonal, out=base[:, 1:])
        cell[:, 0] += 1 + 8
        start = base + steps
        best = np.maximum.accumulate(start, axis=1)
        cell[:, 1:] += np.uint8(8) * (start[:, 1:] > best[:, :-1])
        e = best[:, :-1] - GAP_OPEN
        e -= steps[1:]
        cell[:, 1:] += np.uint8(2) * (e > base[:, 1:])
        np.maximum(e, base[:, 1:], out=base[:, 1:])
        h = base
    moves = _ways_back(way, np.array([len(pairs[k][0]) for k in chunk]), np.array([len(pairs[k][1]) for k in chunk]))
    for k, own in zip(chunk, moves, strict=True):
        own = own[np.flatnonzero(own)[0] :] if own.any() else own[:0]
        out[k] = np.flatnonzero(own & 1), np.flatnonzero(own & 2), len(own)


def _ways_back(way: np.ndarray, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each pair the columns of its alignment, at the end of a row: 1 where the first profile has a column, 2 the second, 3 both."""
    size = len(i)
    at, state, back = np.arange(size), np.zeros(size, np.uint8), []
    # States: 1 in a gap in b, 2 in a gap in a, 3 at the cell where that began.
    while (live := (i > 0) | (k > 0)).any():
        cell = way[i, at, k]
        along = live & ((state == 2) | ((state == 0) & (cell & 2 > 0)))
        first = live & ~along
        alone = first & ((state == 1) | (cell & 1 > 0) | (k == 0))
        second = along | (first & ~alone)
        i, k = i - first, k - second
        state = np.where(along, np.where(way[i, at, k] & 8 > 0, 3, 2), np.where(alone & (cell & 4 > 0), 1, 0)).astype(np.uint8)
        back.append(first + np.uint8(2) * second)
    return np.array(back[::-1], np.uint8).reshape(len(back), size).T


def along_trees(parts: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]]) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """For each part (counts, rows, distances) the places of each profile's columns, and the counts of the whole, merged along its average-linkage tree.

    Merges that need nothing of each other, of all parts, are matched together.
    """
    trees = [agglomerate(distances) for _, _, distances in parts]
    held, turns = [], {}
    for p, ((counts, rows, _), tree) in enumerate(zip(parts, trees, strict=True)):
        held.append({i: (counts[i], rows[i]) for i in range(len(counts))})
        turn = dict.fromkeys(range(len(counts)), 0)
        for a, b, node, *_ in tree:
            turn[node] = 1 + max(turn[a], turn[b])
            turns.setdefault(turn[node], []).append((p, a, b, node))
    went: list[dict] = [{} for _ in parts]
    for turn in sorted(turns):
        two = [(*held[p].pop(a), *held[p].pop(b)) for p, a, b, _ in turns[turn]]
        found = matched_all([(ca / na, cb / nb) for ca, na, cb, nb in two])
        for (p, _, _, node), (ca, na, cb, nb), (to_a, to_b, width) in zip(turns[turn], two, found, strict=True):
            both = np.zeros((width, ca.shape[1]))
            both[to_a] = ca
            both[to_b] += cb
            held[p][node] = both, na + nb
            went[p][node] = to_a, to_b
    out = []
    for (counts, _, _), tree, left, to in zip(parts, trees, held, went, strict=True):
        ((root, (whole, _)),) = left.items()
        places = {root: np.arange(len(whole))}
        for a, b, node, *_ in reversed(tree):
            above, (to_a, to_b) = places.pop(node), to[node]
            places[a], places[b] = above[to_a], above[to_b]
        out.append(([places[i] for i in range(len(counts))], whole))
    return out


def _codes(row: str) -> np.ndarray:
    return np.frombuffer(row.encode("utf-32-le"), "<u4").astype(np.int64)


def _runs(rows: list[str], k: int, buckets: int) -> np.ndarray:
    """For each row, how often its runs of ``k`` letters fall in each bucket."""
    x, ends = _codes("".join(rows)), np.cumsum([len(row) for row in rows])
    code = np.zeros(max(len(x) - k + 1, 0), np.int64)
    for i in range(k):
        code = (code * 1_000_003 + x[i : i + len(code)]) % 2_147_483_647
    at = np.arange(len(code))
    row = np.searchsorted(ends, at, side="right")
    inside = at + k <= ends[row] if len(code) else np.zeros(0, bool)
    return np.bincount((row * buckets + code % buckets)[inside], minlength=len(rows) * buckets).reshape(len(rows), buckets)


def _triple_distances(rows: list[str]) -> np.ndarray:
    """1 - shared letter triples / those of the shorter row; 1 where a row has none."""
    held = _runs(rows, 3, TRIPLES)
    total = held.sum(axis=1)
    held = held[:, held.any(axis=0)]
    if held.max(initial=0) <= 16:  # the smaller of two counts is the number of thresholds that both reach
        shared = np.zeros((len(rows), len(rows)))
        for least in range(1, int(held.max(initial=0)) + 1):
            reach = (held >= least).astype(np.float32)
            shared += reach @ reach.T
    else:
        shared = np.stack([np.minimum(x, held).sum(axis=1) for x in held])
    return 1 - shared / np.maximum(np.minimum.outer(total, total), 1)


def _mean_distances(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype(float)
    return np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2), 0))


def _of_rows(part: pd.DataFrame) -> tuple:
    """Letters, counts, rows and distances of a part of rows."""
    rows = list(part["row"])
    letters = "".join(sorted(set("".join(rows))))
    one, code = np.eye(len(letters)), np.searchsorted(_codes(letters), _codes("".join(rows)))
    counts = np.split(one[code].reshape(len(code), len(letters)), np.cumsum([len(row) for row in rows])[:-1])
    return letters, counts, np.ones(len(rows)), _triple_distances(rows)


def _of_profiles(part: pd.DataFrame) -> tuple:
    """The same of a part of profiles."""
    letters = "".join(sorted(set("".join(part["letters"]))))
    code, counts = {c: k for k, c in enumerate(letters)}, []
    for own, cells in zip(part["letters"], part["counts"], strict=True):
        width = len(cells) // len(own) if own else 0
        wide = np.zeros((width, len(letters)))
        wide[:, [code[c] for c in own]] = np.asarray(cells, float).reshape(width, len(own))
        counts.append(wide)
    return letters, counts, part["rows"].to_numpy(float), _mean_distances(part["v"])


def _aligned(parts: list[pd.DataFrame], told) -> pd.DataFrame:
    """For each part a row with places for each member, and one without an id for its profile."""
    of = [told(part) for part in parts]
    out = {name: [] for name in ("part", "id", "places", "letters", "counts")}
    for part, (letters, *_), (places, whole) in zip(parts, of, along_trees([x[1:] for x in of]), strict=True):
        n = len(part)
        out["part"] += [int(part["part"].iloc[0])] * (n + 1)
        out["id"] += [*part["id"].tolist(), None]
        out["places"] += [*(p.astype(np.int32) for p in places), None]
        out["letters"] += [None] * n + [letters]
        out["counts"] += [None] * n + [whole.ravel()]
    return pd.DataFrame(out).assign(id=pd.array(out["id"], "Int64"))


def _whole_parts(batches, heavy: str):
    """Lists of whole parts from batches in order of part, as many at a time as have ``AT_ONCE`` letters or cells in ``heavy``."""
    open_, whole, weight = [], [], 0  # what is read of the last part, parts before it, and what those weigh
    for batch in batches:
        for at, group in batch.groupby("part", sort=True):
            if open_ and open_[0]["part"].iloc[0] != at:
                whole.append(pd.concat(open_, ignore_index=True))
                weight, open_ = weight + int(whole[-1][heavy].str.len().sum()), []
                if weight >= AT_ONCE:
                    yield whole
                    whole, weight = [], 0
            open_.append(group)
    if open_:
        yield [*whole, pd.concat(open_, ignore_index=True)]


def _parts_aligned(members: DataFrame, told, heavy: str) -> DataFrame:
    """The parts of each partition, aligned some at a time."""

    def run(batches):
        for parts in _whole_parts(batches, heavy):
            yield _aligned(parts, told)

    return members.sortWithinPartitions("part", "id").mapInPandas(run, _ALIGNED)


def _vectors(rows: DataFrame) -> DataFrame:
    """(family, id, v): shares of letter pairs, the length as far as 1/100 of a letter pair, and last what keeps any two rows apart."""

    def run(batches):
        for batch in batches:
            long = batch["row"].str.len().to_numpy(np.int64)
            v = np.c_[_runs(list(batch["row"]), 2, PAIRS) / np.maximum(long - 1, 1)[:, None], long / 100, (batch["id"].to_numpy(float) + 1) * 2.0**-60]
            yield batch[["family", "id"]].assign(v=list(v))

    return spread(rows).mapInPandas(run, f"family {rows.schema['family'].dataType.simpleString()}, id long, v array<double>")


def _parted(vectors: DataFrame, limit: int) -> DataFrame:
    """(family, id, v, part): groups of at most ``limit``, numbered over the whole table."""
    cut = materialize(halved(vectors.withColumn("part", F.lit("")), limit, HALVED_AT_ONCE))
    named = global_rank(cut.select("family", "part").distinct(), [F.col("family"), F.col("part")], "number")
    named = named.select(F.col("family").alias("_family"), F.col("part").alias("_part"), "number")
    joined = cut.join(named, F.col("family").eqNullSafe(F.col("_family")) & (F.col("part") == F.col("_part")))
    return joined.select("family", "id", "v", F.col("number").cast("long").alias("part"))  # not written once more: most that read it leave the vectors out


def align_whole(rows: DataFrame, part: int = PART) -> DataFrame:
    """(family, name, aseq) from (family, name, seq): rows of one width in each family."""
    part = max(2, part)
    clean = F.replace(F.coalesce(F.col("seq"), F.lit("")), F.lit(GAP), F.lit(""))
    rows = materialize(rows.select("family", "name", clean.alias("row")))
    distinct = materialize(global_rank(rows.select("family", "row").distinct(), [F.col("family"), F.col("row")], "id"))
    distinct = distinct.withColumn("id", F.col("id").cast("long"))
    vectors, payload, levels = _vectors(distinct), distinct.select(F.col("id").alias("_id"), "row"), []
    while True:
        parted = _parted(vectors, part)
        members = parted.join(payload, F.col("id") == F.col("_id"))
        parts = materialize(parted.select("family", "part").distinct())
        # Parts are small in bytes and heavy in work: partitions follow their number, as AQE would join them by size.
        tasks = max(parted.sparkSession.sparkContext.defaultParallelism, parts.count() // PARTS_A_TASK)
        spaced = members.select("part", "id", *(["v"] if levels else []), *[c for c in payload.columns if c != "_id"]).repartition(tasks, "part")
        done = materialize(_parts_aligned(spaced, _of_profiles, "counts") if levels else _parts_aligned(spaced, _of_rows, "row"))
        levels.append(done)
        if parts.groupBy("family").count().where("count > 1").isEmpty():
            break
        held = parted.select("part", F.col("id").alias("_id"))
        below = F.lit(1).alias("rows") if len(levels) == 1 else F.col("rows")
        weights = held.join(payload, "_id").select("part", below).groupBy("part").agg(F.sum("rows").alias("rows"))
        each = parted.select("family", "part", F.posexplode("v").alias("i", "x")).groupBy("family", "part", "i").agg(F.avg("x").alias("m"))
        vectors = each.groupBy("family", F.col("part").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
        payload = materialize(done.where("id is null").join(weights, "part").select(F.col("part").alias("_id"), "letters", "counts", "rows"))
    # What each level's members are to the family's last columns, from the top down.
    top = levels[-1].where("id is null").select(F.col("part").alias("_part"), _width(F.col("letters"), F.col("counts")).alias("width"))
    told = levels[-1].where("id is not null").join(top, F.col("part") == F.col("_part")).select("id", "places", "width")
    for level in reversed(levels[:-1]):
        above = materialize(told.select(F.col("id").alias("_part"), F.col("places").alias("over"), "width"))
        inner = level.where("id is not null").join(above, F.col("part") == F.col("_part"))
        told = inner.select("id", F.transform("places", lambda p: F.get(F.col("over"), p)).alias("places"), "width")
    return _written(rows, distinct, told)


def _width(letters: Column, counts: Column) -> Column:
    """Columns of a profile; a family without a letter has none."""
    return F.when(F.length(letters) > 0, (F.size(counts) / F.length(letters)).cast("int")).otherwise(0)


def _written(rows: DataFrame, distinct: DataFrame, told: DataFrame) -> DataFrame:
    """Each distinct row put down once; then its copies, which AQE splits where one row has many."""

    def put(batches):
        for batch in batches:
            out = []
            for row, places, width in zip(batch["row"], batch["places"], batch["width"], strict=True):
                cells = np.full(width, ord(GAP), "<u4")
                cells[np.asarray(places, int)] = _codes(row)
                out.append(cells.tobytes().decode("utf-32-le"))
            yield batch[["id"]].assign(aseq=pd.Series(out, dtype=object, index=batch.index))

    told = told.withColumnRenamed("id", "_id")
    drawn = distinct.join(told, F.col("id") == F.col("_id")).select("id", "row", "places", "width").mapInPandas(put, "id long, aseq string")
    drawn = materialize(drawn).withColumnRenamed("id", "_id")
    known = distinct.join(drawn, F.col("id") == F.col("_id")).select(F.col("family").alias("_family"), F.col("row").alias("_row"), "aseq")
    return rows.join(known, F.col("family").eqNullSafe(F.col("_family")) & (F.col("row") == F.col("_row"))).select("family", "name", "aseq")
