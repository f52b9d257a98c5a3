"""Column statistics and scores of aligned rows (family, name, aseq).

Rows of a family may end before its longest one: what is missing counts as gaps, by
arithmetic on the number of rows and without cells of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.storage import materialize

GAPS = r"[-._~ ]"

# Groups of similar residues behind the conservation marks.
STRONG = ["STA", "NEQK", "NHQK", "NDEQ", "QHRK", "MILV", "MILF", "HY", "FYW"]
WEAK = ["CSA", "ATV", "SAG", "STNK", "STPA", "SGND", "SNDEQK", "NDEQHK", "NEQHRK", "FVLIM", "HFY"]


def _inside(group: str):
    return lambda residue: F.instr(F.lit(group), residue) > 0


def columns(rows: DataFrame) -> DataFrame:
    """(family, name, pos, residue): one row for each aligned character, positions from 0."""
    cells = rows.select("family", "name", F.posexplode(F.split("aseq", "")).alias("pos", "residue"))
    return cells.where("residue <> ''")


def composition(cells: DataFrame) -> DataFrame:
    """(family, pos, residue, n)."""
    return cells.groupBy("family", "pos", "residue").agg(F.count("*").alias("n"))


def _letters(seq: str | None) -> np.ndarray:
    return np.frombuffer((seq or "").encode("utf-32-le"), np.uint32)


_GAP_CODES = np.array([ord(c) for c in "-._~ "], np.uint32)
#: Letters of a group that are counted at once, and packed counts of a block that are merged at once.
_HOLD, MERGED = 1_000_000, 32
#: Columns of a block, and rows that meet a block's values in one group.
BLOCK, GROUP_ROWS = 2048, 4000
_CODE = 21  # bits of a code point


def _packed_rows(family: list, block: list, keys: list[np.ndarray], counts: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({
        "family": pd.Series(family, dtype=object), "block": np.array(block, np.int32),
        "keys": [k.astype(np.int64).tobytes() for k in keys], "counts": [c.astype(np.int64).tobytes() for c in counts],
    })


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("family").alias("__f")).agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("groups"))


def _pieces(rows: DataFrame, sizes: DataFrame, kept: list[str], dealt: list[str]) -> DataFrame:
    """(family, block, part, *kept, piece): rows cut into blocks of columns, large families in parts by a hash of ``dealt``; rows without a letter have none."""
    sized = rows.join(sizes, rows["family"].eqNullSafe(sizes["__f"])).where(F.length("aseq") > 0)
    cut = sized.select(
        "family", *kept, F.pmod(F.xxhash64(*dealt), F.col("groups")).cast("int").alias("part"), "aseq",
        F.explode(F.sequence(F.lit(0), F.floor((F.length("aseq") - 1) / BLOCK).cast("int"))).alias("block"),
    )
    return cut.select("family", "block", "part", *kept, F.substring("aseq", F.col("block") * BLOCK + 1, F.lit(BLOCK)).alias("piece"))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate(counts), len(key)).astype(np.int64)


def _counted(pieces: list[str], first: int, gaps: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the letters of one block's pieces, whose first column is ``first``."""
    dense, keys, counts = np.zeros(BLOCK * 128, np.int64), [], []
    step = max(1, _HOLD // BLOCK)
    for at in range(0, len(pieces), step):
        some = pieces[at : at + step]
        sizes = np.array([len(p) for p in some])
        pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        points = _letters("".join(some))
        plain = points < 128
        dense += np.bincount(pos[plain] * 128 + points[plain], minlength=len(dense))
        if not plain.all():
            key, n = np.unique(((pos[~plain] + first) << _CODE) | points[~plain], return_counts=True)
            keys.append(key)
            counts.append(n)
    if not gaps:
        dense.reshape(BLOCK, 128)[:, _GAP_CODES] = 0
    hit = np.flatnonzero(dense)
    return _summed([((hit // 128 + first) << _CODE) | (hit % 128), *keys], [dense[hit], *counts])


def block_counts(rows: DataFrame, gaps: bool = True) -> DataFrame:
    """(family, block, keys, counts): how often each residue stands in each column, packed by blocks of ``BLOCK`` columns.

    A key is the column and the residue's code point. Rows are cut into blocks and counted in
    groups of about ``GROUP_ROWS`` pieces, then packed counts are merged ``MERGED`` at a time,
    level over level, so no group grows with the table.
    """

    def count(group: pd.DataFrame) -> pd.DataFrame:
        block = int(group["block"].iloc[0])
        key, n = _counted(group["piece"].tolist(), block * BLOCK, gaps)
        return _packed_rows([group["family"].iloc[0]], [block], [key], [n]).assign(part=group["part"].iloc[0])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        held = [[np.frombuffer(x, np.int64) for x in group[c]] for c in ("keys", "counts")]
        key, n = _summed(*held)
        return _packed_rows([group["family"].iloc[0]], [group["block"].iloc[0]], [key], [n]).assign(part=group["part"].iloc[0])

    kind = rows.schema["family"].dataType.simpleString()
    schema = f"family {kind}, block int, keys binary, counts binary, part int"
    sizes = _sizes(rows)
    by = ["family", "block", "part"]
    packed = _pieces(rows, sizes, [], rows.columns).groupBy(*by).applyInPandas(count, schema)
    most = sizes.agg(F.max("groups")).first()[0] or 1
    while most > 1:
        packed = packed.withColumn("part", F.floor(F.col("part") / MERGED).cast("int")).groupBy(*by).applyInPandas(merge, schema)
        most = -(-most // MERGED)
    return packed.drop("part")


def _cells_of(packed: DataFrame) -> DataFrame:
    """(family, pos, residue, n) of packed blocks; with a column ``rows``, what a column lacks of so many counts as gaps."""
    ended = "rows" in packed.columns

    def run(group: pd.DataFrame) -> pd.DataFrame:
        r = group.iloc[0]  # a block is one row
        key, n = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["counts"], np.int64)
        if ended and len(key):
            pos = key >> _CODE
            cuts = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
            lacks = r["rows"] - np.add.reduceat(n, cuts)
            key, n = _summed([key, (pos[cuts][lacks > 0] << _CODE) | ord("-")], [n, lacks[lacks > 0]])
        residue = (key & ((1 << _CODE) - 1)).astype("<u4").tobytes().decode("utf-32-le")
        return pd.DataFrame({"family": pd.Series([r["family"]] * len(key), dtype=object), "pos": (key >> _CODE).astype(np.int32), "residue": pd.Series(list(residue), dtype=object), "n": n})

    return packed.groupBy("family", "block").applyInPandas(run, f"family {packed.schema['family'].dataType.simpleString()}, pos int, residue string, n long")


def ragged_composition(rows: DataFrame) -> DataFrame:
    """(family, pos, residue, n) of rows of any lengths; rows that have ended are gaps."""
    sizes = rows.groupBy(F.col("family").alias("__f")).agg(F.count("*").alias("rows"))
    packed = block_counts(rows)
    return _cells_of(packed.join(sizes, packed["family"].eqNullSafe(F.col("__f"))).drop("__f"))


def consensus(counted: DataFrame) -> DataFrame:
    """(family, pos, residue, n, total): the commonest residue (ties: the first in order) of each column."""
    best = F.max(F.struct(F.col("n"), (-F.ascii("residue")).alias("low"), "residue")).alias("best")
    return counted.groupBy("family", "pos").agg(best, F.sum("n").alias("total")).select(
        "family", "pos", "best.residue", F.col("best.n").alias("n"), "total"
    )


def conservation(counted: DataFrame) -> DataFrame:
    """(family, pos, mark): ``*`` all equal, ``:`` within a strong group, ``.`` within a weak one, else blank."""
    sets = counted.groupBy("family", "pos").agg(F.collect_set(F.upper("residue")).alias("seen"))  # at most the alphabet

    def within(groups: list[str]):
        tests = [F.forall("seen", _inside(g)) for g in groups]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    gap = F.exists("seen", lambda r: r.rlike(GAPS))
    mark = F.when(gap, " ").when(F.size("seen") == 1, "*").when(within(STRONG), ":").when(within(WEAK), ".").otherwise(" ")
    return sets.select("family", "pos", mark.alias("mark"))


def gap_share(counted: DataFrame, window: int = 100) -> DataFrame:
    """(family, pos, gap, mean_gap): the share of gaps, and its mean over the ``window`` columns that end here."""
    share = counted.groupBy("family", "pos").agg((F.sum(F.when(F.col("residue").rlike(GAPS), F.col("n")).otherwise(0)) / F.sum("n")).alias("gap"))
    frame = Window.partitionBy("family").orderBy("pos").rowsBetween(-(window - 1), 0)  # one row for each column
    return share.withColumn("mean_gap", F.avg("gap").over(frame))


def gap_runs(rows: DataFrame) -> DataFrame:
    """(family, name, start, length) of runs of gaps in a row, the one after its end included."""
    each = Window.partitionBy("family", "name").orderBy("pos")
    trimmed = rows.withColumn("aseq", F.regexp_replace("aseq", f"{GAPS}+$", ""))
    gaps = columns(trimmed).where(F.col("residue").rlike(GAPS)).withColumn("run", F.col("pos") - F.row_number().over(each))
    inner = gaps.groupBy("family", "name", "run").agg(F.min("pos").alias("start"), F.count("*").alias("length")).drop("run")
    longest = rows.groupBy("family").agg(F.max(F.length("aseq")).alias("longest"))
    start = F.coalesce(F.length("aseq"), F.lit(0))
    last = trimmed.select("family", "name", start.alias("start")).join(longest, "family").where("longest > start")
    return inner.unionByName(last.select("family", "name", "start", (F.col("longest") - F.col("start")).cast("long").alias("length")))


def _pack_values(values: DataFrame) -> DataFrame:
    """(family, block, keys, values) of (family, pos, residue, value), packed like :func:`block_counts`."""
    key = F.col("pos").cast("long") * (1 << _CODE) + F.ascii("residue")
    solid = values.where(~F.col("residue").rlike(GAPS)).select("family", F.floor(F.col("pos") / BLOCK).cast("int").alias("block"), key.alias("key"), F.col("value").cast("double").alias("value"))

    def run(group: pd.DataFrame) -> pd.DataFrame:  # a block's columns x the alphabet
        held = group.sort_values("key", kind="stable")
        return pd.DataFrame({
            "family": pd.Series([group["family"].iloc[0]], dtype=object), "block": group["block"].iloc[:1].to_numpy(), "keys": [held["key"].to_numpy(np.int64).tobytes()], "values": [held["value"].to_numpy(np.float64).tobytes()],
        })

    return solid.groupBy("family", "block").applyInPandas(run, f"family {values.schema['family'].dataType.simpleString()}, block int, keys binary, values binary")


def row_means(rows: DataFrame, values: DataFrame) -> DataFrame:
    """(family, name, mean): over the residues (not gaps) of each row, the mean of ``values`` (family, pos, residue, value), 0 where there is none."""
    return packed_means(rows, _pack_values(values))


def packed_means(rows: DataFrame, values: DataFrame) -> DataFrame:
    """As :func:`row_means`, of packed values (family, block, keys, values).

    Rows without a residue are left out; rows of one name in a family count as one. Rows are
    cut into blocks of ``BLOCK`` columns and meet the values by (family, block), large
    families in several groups of rows with a copy of the values each: one row moves for
    each block, none for each letter, and nothing goes to the driver.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    sizes = _sizes(rows)
    pieces = _pieces(rows, sizes, ["name"], ["name"])
    copies = values.join(sizes, values["family"].eqNullSafe(sizes["__f"])).select("family", "block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "keys", "values")

    def run(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"family": pd.Series([], dtype=object), "name": pd.Series([], dtype=object), "total": [], "n": []})
        keys = np.frombuffer(held["keys"].iloc[0], np.int64) if len(held) else np.empty(0, np.int64)
        of = np.frombuffer(held["values"].iloc[0], np.float64) if len(held) else np.empty(0)
        first = int(own["block"].iloc[0]) * BLOCK
        sums, counts = [], []
        for piece in own["piece"]:
            points = _letters(piece)
            pos = np.flatnonzero(~np.isin(points, _GAP_CODES))
            wanted = ((pos + first) << _CODE) | points[pos]
            at = np.searchsorted(keys, wanted)
            hit = at < len(keys)
            hit[hit] = keys[at[hit]] == wanted[hit]
            sums.append(float(of[at[hit]].sum()))
            counts.append(len(pos))
        return pd.DataFrame({"family": own["family"], "name": own["name"], "total": sums, "n": counts})

    by = ["family", "block", "part"]
    told = pieces.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(run, f"family {kinds['family']}, name {kinds['name']}, total double, n long")
    return told.groupBy("family", "name").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").select("family", "name", (F.col("total") / F.col("n")).alias("mean"))


def _column_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """1 / (distinct residues of a column x rows with this one), for packed counts."""
    for batch in batches:
        family, block, keys, counts = (batch.column(c) for c in ("family", "block", "keys", "counts"))
        for i in range(len(batch)):
            pos = np.frombuffer(keys[i].as_buffer(), np.int64) >> _CODE
            _, inverse, kinds = np.unique(pos, return_inverse=True, return_counts=True)
            share = 1.0 / (kinds[inverse] * np.frombuffer(counts[i].as_buffer(), np.int64))
            yield pa.RecordBatch.from_arrays([family.slice(i, 1), block.slice(i, 1), keys.slice(i, 1), pa.array([share.tobytes()], pa.binary())], ["family", "block", "keys", "values"])


def position_weights(rows: DataFrame) -> DataFrame:
    """(family, name, weight): the mean over a row's residues of 1 / (distinct residues x rows with this one) of their columns, scaled to the number of rows."""
    shares = block_counts(rows, gaps=False).mapInArrow(_column_shares, f"family {rows.schema['family'].dataType.simpleString()}, block int, keys binary, values binary")
    raw = materialize(packed_means(rows, shares))
    total = raw.groupBy("family").agg(F.sum("mean").alias("total"), F.count("*").alias("rows"))
    return raw.join(total, "family").select("family", "name", (F.col("mean") / F.col("total") * F.col("rows")).alias("weight"))


def identity_to_consensus(rows: DataFrame, voted: DataFrame) -> DataFrame:
    """(family, name, identity): the share of a row's residues that equal the consensus of their column."""
    return row_means(rows, voted.select("family", "pos", "residue", F.lit(1.0).alias("value"))).withColumnRenamed("mean", "identity")


def residue_columns(rows: DataFrame) -> DataFrame:
    """(family, name, k, pos): the column of the k-th residue (not gap) of each row."""
    solid = columns(rows).where(~F.col("residue").rlike(GAPS))
    each = Window.partitionBy("family", "name").orderBy("pos")
    return solid.select("family", "name", (F.row_number().over(each) - 1).alias("k"), "pos")


def agreement(predicted: DataFrame, reference: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """(family, sp, tc): the share of reference residue pairs that share a predicted column, and of reference columns found whole.

    Pairs are counted, not made: residues of a reference column that fall into one
    predicted column in groups of c give c (c - 1) / 2 of its pairs. With ``marked``
    (family, pos) only these reference columns are judged; a family without one that
    two rows share is left out.
    """
    p = residue_columns(predicted).withColumnRenamed("pos", "p_pos")
    r = residue_columns(reference)
    if marked is not None:
        r = r.join(marked.select("family", "pos"), ["family", "pos"], "left_semi")
    r = r.withColumnRenamed("pos", "r_pos")
    met = r.join(p, ["family", "name", "k"], "left")
    groups = met.groupBy("family", "r_pos", "p_pos").agg(F.count("*").alias("c"))
    pairs = lambda n: n * (n - 1) / 2
    of_column = groups.groupBy("family", "r_pos").agg(
        F.sum(F.when(F.col("p_pos").isNotNull(), pairs(F.col("c"))).otherwise(0.0)).alias("found"), F.sum("c").alias("size"), F.max("c").alias("most")
    )
    real = of_column.where("size > 1")
    return real.groupBy("family").agg(
        (F.sum("found") / F.sum(pairs(F.col("size")))).alias("sp"), F.avg(F.when(F.col("most") == F.col("size"), 1.0).otherwise(0.0)).alias("tc")
    )


def row_identity(rows: DataFrame, references: DataFrame) -> DataFrame:
    """(family, name, identity): columns where a row and its family's reference row (family, aseq) have the same residue, over the shorter ungapped length.

    0 if one of the two has no residue.
    """
    both = rows.join(references.select("family", F.col("aseq").alias("__ref")), "family")
    solid = F.lit("-._~ ")
    same = F.aggregate(
        F.zip_with(F.split("aseq", ""), F.split("__ref", ""), lambda a, b: F.coalesce(((a == b) & (a != "") & (F.instr(solid, a) == 0)).cast("long"), F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda t, x: t + x,
    )
    least = F.least(F.length(F.regexp_replace("aseq", GAPS, "")), F.length(F.regexp_replace("__ref", GAPS, "")))
    return both.select("family", "name", F.when(least > 0, same / least).otherwise(0.0).alias("identity"))


def drawn_pairs(rows: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """(family, draw, a, b): for each family, ``draws`` pairs of its rows (by rank of name from 0) that a hash of family, seed and draw picks; never a row with itself.

    Families of one row have none.
    """
    sizes = rows.groupBy("family").agg(F.count("*").alias("size")).where("size > 1")
    each = sizes.select("family", "size", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("family").cast("string"), F.lit("")), F.lit(seed), "draw").cast("binary"))
    pick = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    a = pick(1) % F.col("size")
    return each.select("family", "draw", a.alias("a"), ((a + 1 + pick(9) % (F.col("size") - 1)) % F.col("size")).alias("b"))


def sampled_identity(ranked: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """(family, identity): the mean identity of drawn pairs of rows (family, rank, aseq), each over the shorter ungapped length."""
    pairs = drawn_pairs(ranked, draws, seed)
    for side in ("a", "b"):
        row = ranked.select(F.col("family").alias("__f"), F.col("rank").alias("__r"), F.col("aseq").alias(f"row_{side}"))
        pairs = pairs.join(row, F.col("family").eqNullSafe(F.col("__f")) & (F.col(side) == F.col("__r"))).drop("__f", "__r")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, y in zip(batch["row_a"], batch["row_b"], strict=True):
                x, y = _letters(x), _letters(y)
                m, least = min(len(x), len(y)), min((~np.isin(x, _GAP_CODES)).sum(), (~np.isin(y, _GAP_CODES)).sum())
                same = ((x[:m] == y[:m]) & ~np.isin(x[:m], _GAP_CODES)).sum()
                out.append(float(same / least) if least else 0.0)
            yield batch[["family"]].assign(identity=out)

    kind = ranked.schema["family"].dataType.simpleString()
    return pairs.select("family", "row_a", "row_b").mapInPandas(run, f"family {kind}, identity double").groupBy("family").agg(F.avg("identity").alias("identity"))


def sum_of_pairs(counted: DataFrame, match: float = 1.0, mismatch: float = -0.5, gap: float = -1.0) -> DataFrame:
    """(family, matches, mismatches, gap_pairs, score) over all pairs of rows and columns, from column counts (family, pos, residue, n); no pair is made."""
    is_gap = F.col("residue").rlike(GAPS)
    n = F.col("n")
    column = counted.groupBy("family", "pos").agg(
        F.sum(F.when(is_gap, 0).otherwise(n)).alias("solid"), F.sum(F.when(is_gap, n).otherwise(0)).alias("gaps"),
        F.sum(F.when(is_gap, 0).otherwise(n * (n - 1) / 2)).alias("same"),
    )
    s, g = F.col("solid"), F.col("gaps")
    total = column.groupBy("family").agg(
        F.sum("same").cast("long").alias("matches"), F.sum(s * (s - 1) / 2 - F.col("same")).cast("long").alias("mismatches"), F.sum(s * g).cast("long").alias("gap_pairs")
    )
    return total.withColumn("score", F.col("matches") * match + F.col("mismatches") * mismatch + F.col("gap_pairs") * gap)


def project_columns(rows: DataFrame, keep: DataFrame) -> DataFrame:
    """(family, name, aseq) with the columns of ``keep`` (family, pos) only, in order; a row that keeps none is left out."""
    kept = columns(rows).join(keep.select("family", "pos"), ["family", "pos"], "left_semi")
    cells = F.array_sort(F.collect_list(F.struct("pos", "residue")))  # one row's own residues
    return kept.groupBy("family", "name").agg(F.array_join(F.transform(cells, lambda c: c["residue"]), "").alias("aseq"))
