"""The registered queries, and the DuckDB SQL that gives the same rows.

The driver tables stand in for biological ones: ``documents`` for sequences (their
letters as residues, ``source`` as family), ``embeddings`` for pooled vectors with
their true clusters, ``benchmark`` for a bounded set of reference sequences, and the
letters of whole texts for rows that are aligned at their start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import sequences as S
from strandlake.functions import vectors as V
from strandlake.operators import alignments, clusters, duplicates, kmers, ordering, progressive, trees
from strandlake.plans.strategy import plans
from strandlake.storage import materialize, spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), "source", S.letters(F.col("text")).alias("seq"))


SEQ = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
VEC = "list_transform(embedding, lambda x: x::DOUBLE)"


# --- functions over sequences -------------------------------------------------


@query(f"""
SELECT doc_id, length(s)::BIGINT AS n, CASE WHEN length(s) > 0 THEN length(regexp_replace(s, '[ACDEFGHIKLMNPQRSTVWY]', '', 'g')) / length(s)::DOUBLE ELSE 0 END AS unusual,
  md5(reverse(translate(s, 'ACGTUacgtu', 'TGCAAtgcaa'))) AS reverse_complement, md5(translate(s, 'ADKERNTSQYFLIVMCWHGP', 'ADKKKNTTTYYLIIICWHGP')) AS reduced,
  md5(regexp_replace(s, '[^ACDEFGHIKLMNPQRSTVWY-]', 'X', 'g')) AS sanitized
FROM (SELECT doc_id, {SEQ} AS s FROM documents)
""")
def residue_projections(spark, sf_dir):
    rows = _residues(spark, sf_dir)
    seq = F.col("seq")
    return rows.select(
        F.col("id").alias("doc_id"), F.length(seq).cast("long").alias("n"), S.unusual_share(seq).alias("unusual"),
        F.md5(S.reverse_complement(seq).cast("binary")).alias("reverse_complement"), F.md5(S.reduced(seq).cast("binary")).alias("reduced"),
        F.md5(S.sanitize(seq).cast("binary")).alias("sanitized"),
    )


@query(f"""
SELECT doc_id, CASE WHEN length(s) = 0 THEN 'other' WHEN (length(s) - length(regexp_replace(s, '[ACGTUN]', '', 'g'))) / length(s)::DOUBLE < 0.95 THEN 'protein'
  WHEN length(s) - length(regexp_replace(s, 'U', '', 'g')) > length(s) - length(regexp_replace(s, 'T', '', 'g')) THEN 'rna' ELSE 'dna' END AS kind
FROM (SELECT doc_id, {SEQ} AS s FROM documents)
""")
def residue_kind(spark, sf_dir):
    return _residues(spark, sf_dir).select(F.col("id").alias("doc_id"), S.residue_kind(F.col("seq")).alias("kind"))


@query(f"""
SELECT doc_id, coalesce(list_sum(list_filter(list_transform(list_filter(string_split(s, ''), lambda c: c <> ''), lambda c: instr('{S.RESIDUES}', c) - 1), lambda x: x >= 0)), 0)::BIGINT AS code_sum
FROM (SELECT doc_id, {SEQ} AS s FROM documents)
""")
def residue_code_sum(spark, sf_dir):
    total = F.aggregate(S.codes(F.col("seq")), F.lit(0).cast("long"), lambda a, x: a + x)
    return _residues(spark, sf_dir).select(F.col("id").alias("doc_id"), total.alias("code_sum"))


# --- duplicates, classes, order -----------------------------------------------


@query("SELECT min(doc_id) AS representative, count(*) AS n_members FROM documents GROUP BY text")
def exact_dup_groups(spark, sf_dir):
    return duplicates.duplicate_groups(_table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS representative FROM documents")
def dup_expand(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return duplicates.with_representative(docs, F.col("text"), "doc_id").select("doc_id", "representative")


_RANKED = "(SELECT doc_id, length(text) AS len, row_number() OVER (ORDER BY length(text) DESC, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)"


@query(f"""
SELECT doc_id, len::BIGINT AS n_chars, r::BIGINT AS rank FROM (SELECT *, least(floor(log2(n) ** 2)::BIGINT, n - 1) AS seeds FROM {_RANKED})
WHERE r % (n // seeds) = 0 AND r // (n // seeds) < seeds
""")
def length_stride_seeds(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"))
    return ordering.stride_seeds(docs, F.col("n_chars"), "doc_id").select("doc_id", "n_chars", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT doc_id, r::BIGINT AS rank FROM {_RANKED} WHERE r % 3 = 0")
def every_third_by_length(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("len"))
    return ordering.global_rank(docs, [F.col("len").desc(), F.col("doc_id").asc()]).where("rank % 3 = 0").select("doc_id", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT source, CASE WHEN count(*) < 100 THEN 'small' WHEN count(*) < 1000 THEN 'medium' ELSE 'large' END AS class, count(*) AS n, min(length(text))::BIGINT AS shortest, max(length(text))::BIGINT AS longest
FROM documents GROUP BY source
""")
def family_sizes(spark, sf_dir):
    n, length = F.count("*"), F.length("text").cast("long")
    return _table(spark, sf_dir, "documents").groupBy("source").agg(
        duplicates.size_class(n, 100, 1000).alias("class"), n.alias("n"), F.min(length).alias("shortest"), F.max(length).alias("longest")
    )


@query("""
SELECT source, doc_id, r::BIGINT AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS r FROM documents) WHERE r <= 10
""")
def longest_per_family(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("n"))
    return duplicates.quota(docs, ["source"], [F.desc("n"), F.asc("doc_id")], 10).select("source", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT source, count(*) AS n_rows, max(length(text))::BIGINT AS longest,
  CASE WHEN max(length(text)) < 3000 AND count(*) < 100 THEN 'local' WHEN max(length(text)) < 1000 AND count(*) < 200 THEN 'local' WHEN count(*) < 200000 THEN 'kmer' WHEN max(length(text)) < 3000 THEN 'alignment' ELSE 'kmer' END AS distance,
  CASE WHEN max(length(text)) < 3000 AND count(*) < 100 THEN 1000 WHEN max(length(text)) < 1000 AND count(*) < 200 THEN 2 WHEN max(length(text)) < 10000 AND count(*) < 500 THEN 2 ELSE 0 END AS iterations,
  CASE WHEN max(length(text)) < 3000 AND count(*) < 100 OR max(length(text)) < 1000 AND count(*) < 200 OR max(length(text)) < 10000 AND count(*) < 500 THEN 'full' WHEN count(*) < 20000 THEN 'full, twice' WHEN count(*) < 100000 THEN 'compact, twice' WHEN count(*) < 200000 THEN 'compact, once' ELSE 'parted' END AS tree
FROM documents GROUP BY source
""")
def alignment_plans(spark, sf_dir):
    return plans(_table(spark, sf_dir, "documents"), "source", F.length("text"))


# --- k-mers -------------------------------------------------------------------

_KMERS = f"SELECT doc_id AS id, unnest([substr(s, i, {{k}}) for i in range(1, length(s) - {{k}} + 2)]) AS kmer FROM (SELECT doc_id, {SEQ} AS s FROM documents)"


@query(f"SELECT kmer, count(*) AS n, count(DISTINCT id) AS n_docs FROM ({_KMERS.format(k=3)}) GROUP BY kmer")
def kmer_frequencies(spark, sf_dir):
    return kmers.frequencies(spread(_residues(spark, sf_dir)), F.col("seq"), 3).withColumnRenamed("n_rows", "n_docs")


_DISTANCE = f"""
docs AS (SELECT doc_id AS id, {SEQ} AS seq FROM documents), refs AS (SELECT item_id AS id, {SEQ} AS seq FROM benchmark),
a AS (SELECT id, kmer, count(*) AS n FROM (SELECT id, unnest([substr(seq, i, 6) for i in range(1, length(seq) - 4)]) AS kmer FROM docs) GROUP BY id, kmer),
b AS (SELECT id, kmer, count(*) AS n FROM (SELECT id, unnest([substr(seq, i, 6) for i in range(1, length(seq) - 4)]) AS kmer FROM refs) GROUP BY id, kmer),
common AS (SELECT a.id AS id, b.id AS ref_id, sum(least(a.n, b.n))::BIGINT AS common FROM a JOIN b USING (kmer) GROUP BY a.id, b.id),
told AS (SELECT c.id, c.ref_id, c.common, (1 - c.common / least(length(d.seq) - 5, length(r.seq) - 5)::DOUBLE) * (1 / (least(length(d.seq), length(r.seq)) / greatest(length(d.seq), length(r.seq))::DOUBLE * 0.1
  + 10000 / (greatest(length(d.seq), length(r.seq)) + 10000.0)::DOUBLE + 0.01)) AS distance FROM common c JOIN docs d ON c.id = d.id JOIN refs r ON c.ref_id = r.id)
"""


def _nearest_references(spark, sf_dir, k: int = 6):
    refs = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), S.letters(F.col("text")).alias("seq"))
    return kmers.nearest_references(spread(_residues(spark, sf_dir).select("id", "seq")), refs, k)


@query(f"""WITH {_DISTANCE} SELECT id AS doc_id, ref_id, round(distance, 9) AS distance, common FROM
(SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(distance, 9), ref_id) AS r FROM told) WHERE r = 1""")
def kmer_distance_topk(spark, sf_dir):
    return _nearest_references(spark, sf_dir).select(F.col("id").alias("doc_id"), "ref_id", "distance", "common")


@query(f"""WITH docs AS (SELECT doc_id AS id, {SEQ} AS seq FROM documents), refs AS (SELECT item_id AS id, {SEQ} AS seq FROM benchmark),
b AS (SELECT id, kmer, count(*) AS n FROM (SELECT id, unnest([substr(seq, i, 13) for i in range(1, length(seq) - 11)]) AS kmer FROM refs) GROUP BY id, kmer),
a AS (SELECT id, kmer, count(*) AS n FROM (SELECT id, unnest([substr(seq, i, 13) for i in range(1, length(seq) - 11)]) AS kmer FROM docs) WHERE kmer IN (SELECT kmer FROM b) GROUP BY id, kmer),
shares AS (SELECT a.id, sum(least(a.n, b.n)) / (any_value(length(r.seq)) - 12) AS share FROM a JOIN b USING (kmer) JOIN refs r ON r.id = b.id GROUP BY a.id, b.id)
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM shares WHERE share >= 0.5)""")
def kmer_uncontaminated(spark, sf_dir):
    """Documents that hold less than half of every reference's 13-mers, however long they are."""
    near = _nearest_references(spark, sf_dir, 13).where("share >= 0.5").select(F.col("id").alias("doc_id")).distinct()
    return _table(spark, sf_dir, "documents").select("doc_id").join(near, "doc_id", "left_anti")


# --- vectors and clusters -----------------------------------------------------

def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))


def _label_centers(vectors) -> list[tuple[int, list[float]]]:
    return clusters.collected(clusters.centers(vectors, "label", "v"), "label", "center")


_NEAREST = f"""
cells AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL),
means AS (SELECT label, i, sum(x) / count(x) AS m FROM cells GROUP BY label, i),
centers AS (SELECT label AS k, list(m ORDER BY i) AS c FROM means GROUP BY label),
scored AS (SELECT vec_id, label, k, c, v, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) ** 2)) AS d FROM (SELECT vec_id, label, {VEC} AS v FROM embeddings), centers),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), k) AS r FROM scored) WHERE r = 1)
"""


@query(f"WITH {_NEAREST.split('scored AS')[0].rstrip().rstrip(',')} SELECT k AS label, round(list_sum(c), {DIGITS}) AS total, round(sqrt(list_dot_product(c, c)), {DIGITS}) AS norm FROM centers")
def label_centers(spark, sf_dir):
    c = F.col("center")
    total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return clusters.centers(_vectors(spark, sf_dir), "label", "v").select("label", F.round(total, DIGITS).alias("total"), F.round(F.sqrt(V.dot(c, c)), DIGITS).alias("norm"))


@query(f"WITH {_NEAREST} SELECT vec_id, k AS cluster, round(round(d, 9), {DIGITS}) AS distance FROM best")
def nearest_center(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return clusters.nearest(vectors, "v", _label_centers(vectors)).select("vec_id", F.col("cluster").cast("int").alias("cluster"), F.round("distance", DIGITS).alias("distance"))


@query(f"WITH {_NEAREST} SELECT label, k AS cluster, count(*) AS n FROM best GROUP BY label, k")
def cluster_confusion(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    told = clusters.nearest(vectors, "v", _label_centers(vectors)).select("label", F.col("cluster").cast("int").alias("cluster"))
    return told.groupBy("label", "cluster").agg(F.count("*").alias("n"))


@query(f"WITH {_NEAREST} SELECT k AS cluster, count(*) AS n, round(sum(d), 4) AS inertia FROM best GROUP BY k")
def cluster_inertia(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    told, _ = clusters.lloyd(vectors, "vec_id", "v", _label_centers(vectors), steps=0)
    return told.groupBy(F.col("cluster").cast("int").alias("cluster")).agg(F.count("*").alias("n"), F.round(F.sum("distance"), 4).alias("inertia"))


@query(f"""
WITH {_NEAREST} SELECT vec_id, round(1 - list_dot_product(v, c) / sqrt(list_dot_product(v, v) * list_dot_product(c, c)), {DIGITS}) AS cosine,
  round(2 * (1 - list_dot_product(v, c) / sqrt(list_dot_product(v, v) * list_dot_product(c, c))), {DIGITS}) AS unit_l2,
  round(list_sum(list_transform(list_zip(v, c), lambda p: abs(p[1] - p[2]))), {DIGITS}) AS l1, round(1 - exp(-list_sum(list_transform(list_zip(v, c), lambda p: abs(p[1] - p[2])))), {DIGITS}) AS l1_exp
FROM scored WHERE label = k
""")
def center_distances(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    both = vectors.join(clusters.centers(vectors, "label", "v"), "label")
    a, b = F.col("v"), F.col("center")
    return both.select(
        "vec_id", F.round(V.cosine_distance(a, b), DIGITS).alias("cosine"), F.round(V.unit_squared_distance(a, b), DIGITS).alias("unit_l2"),
        F.round(V.manhattan(a, b), DIGITS).alias("l1"), F.round(V.saturating_manhattan(a, b), DIGITS).alias("l1_exp"),
    )


@query(f"""
WITH seeds AS (SELECT vec_id AS seed, {VEC} AS c, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings WHERE vec_id % 50 = 0)
SELECT vec_id, seed, round(list_distance({VEC}, c) ** 2, {DIGITS}) AS distance FROM embeddings, seeds
""")
def seed_vectors(spark, sf_dir):
    """Distances of all vectors to a stated set of seeds, the vectors whose id divides by 50, in blocks."""
    told = clusters.block_distances(*_with_seeds(spark, sf_dir))
    return told.select("vec_id", "seed", F.round("distance", DIGITS).alias("distance"))


def _with_seeds(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    vectors = _vectors(spark, sf_dir)
    return vectors.select("vec_id", "v"), vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("seed"), F.col("v").alias("c"))


def _lloyd_sql(steps: int) -> str:
    """Lloyd steps from the first vector of each label, unrolled; steps after the centers rest change nothing."""
    apart = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) ** 2))"
    parts = [f"v AS (SELECT vec_id, label, {VEC} AS v FROM embeddings), c0 AS (SELECT label AS k, arg_min(v, vec_id) AS c FROM v WHERE label IS NOT NULL GROUP BY label)"]
    for t in range(steps + 1):
        parts.append(f"a{t} AS (SELECT vec_id, v, k, d FROM (SELECT vec_id, v, k, {apart} AS d, row_number() OVER (PARTITION BY vec_id ORDER BY round({apart}, 9), k) AS r FROM v, c{t}) WHERE r = 1)")
        parts.append(f"m{t} AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, avg(x) AS m FROM (SELECT k, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM a{t}) GROUP BY ALL) GROUP BY k)")
        parts.append(f"c{t + 1} AS (SELECT k, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (k))")
    return "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, k::BIGINT AS cluster, round(round(d, 9), {DIGITS}) AS distance FROM a{steps}"


@query(_lloyd_sql(10))
def kmeans_lloyd(spark, sf_dir):
    """Ten Lloyd steps from the first vector of each label."""
    vectors = materialize(_vectors(spark, sf_dir))
    first = clusters.collected(vectors.where("label is not null").groupBy("label").agg(F.min_by("v", "vec_id").alias("v")), "label", "v")
    told, _ = clusters.lloyd(vectors, "vec_id", "v", first)
    return told.select("vec_id", "cluster", F.round("distance", DIGITS).alias("distance"))


@query()
def bisecting_kmeans(spark, sf_dir):
    return clusters.bisecting(_vectors(spark, sf_dir), "vec_id", "v", 8)


@query("""
SELECT round(corr(n_chars, words), 6) AS pearson, count(*) AS n FROM (SELECT length(text)::DOUBLE AS n_chars, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::DOUBLE AS words FROM documents)
""".replace("\\\\", "\\"))
def length_word_correlation(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(
        F.length("text").cast("double").alias("n_chars"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("double").alias("words")
    )
    return docs.agg(F.round(F.corr("n_chars", "words"), 6).alias("pearson"), F.count("*").alias("n"))


# --- aligned columns ----------------------------------------------------------

_ROWS = f"(SELECT source, doc_id, {SEQ} AS s FROM documents)"
_CELLS = f"SELECT source AS family, doc_id AS name, unnest(range(length(s))) AS pos, unnest(string_split(s, '')) AS residue FROM {_ROWS} WHERE length(s) > 0"
_COUNTED = f"""cells AS ({_CELLS}), solid AS (SELECT family, pos, residue, count(*) AS n FROM cells GROUP BY ALL), sizes AS (SELECT source AS family, count(*) AS n_rows FROM documents GROUP BY source),
ended AS (SELECT family, pos, '-' AS residue, any_value(n_rows) - sum(n)::BIGINT AS n FROM solid JOIN sizes USING (family) GROUP BY family, pos), counted AS (SELECT * FROM solid UNION ALL SELECT * FROM ended WHERE n > 0)"""


def _aligned(spark, sf_dir):
    """Whole texts as rows that start together; those that end before the longest of their source count as gaps from there on."""
    rows = spread(_residues(spark, sf_dir))
    return rows.select(F.col("source").alias("family"), F.col("id").alias("name"), F.col("seq").alias("aseq"))


def _composition(spark, sf_dir):
    return alignments.ragged_composition(_aligned(spark, sf_dir))


@query(f"WITH {_COUNTED} SELECT family, pos::INT AS pos, residue, n FROM counted")
def column_composition(spark, sf_dir):
    return _composition(spark, sf_dir)


@query(f"""WITH {_COUNTED} SELECT family, pos::INT AS pos, residue, n, total::BIGINT AS total FROM
(SELECT *, sum(n) OVER (PARTITION BY family, pos) AS total, row_number() OVER (PARTITION BY family, pos ORDER BY n DESC, ascii(residue)) AS r FROM counted) WHERE r = 1""")
def column_consensus(spark, sf_dir):
    return alignments.consensus(_composition(spark, sf_dir))


def _within(groups: list[str]) -> str:
    return " OR ".join(f"len(list_filter(seen, lambda x: instr('{g}', x) = 0)) = 0" for g in groups)


@query(f"""WITH {_COUNTED}, sets AS (SELECT family, pos, list(residue) AS seen FROM counted GROUP BY family, pos)
SELECT family, pos::INT AS pos, CASE WHEN list_contains(seen, '-') THEN ' ' WHEN len(seen) = 1 THEN '*' WHEN {_within(alignments.STRONG)} THEN ':' WHEN {_within(alignments.WEAK)} THEN '.' ELSE ' ' END AS mark FROM sets""")
def conservation_marks(spark, sf_dir):
    return alignments.conservation(_composition(spark, sf_dir))


@query(f"""WITH {_COUNTED}, share AS (SELECT family, pos, sum(CASE WHEN residue = '-' THEN n ELSE 0 END) / sum(n)::DOUBLE AS gap FROM counted GROUP BY family, pos)
SELECT family, pos::INT AS pos, round(gap, 9) AS gap, round(avg(gap) OVER (PARTITION BY family ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 9) AS mean_gap FROM share""")
def gap_windows(spark, sf_dir):
    told = alignments.gap_share(_composition(spark, sf_dir), 10)
    return told.select("family", "pos", F.round("gap", 9).alias("gap"), F.round("mean_gap", 9).alias("mean_gap"))


@query(f"""SELECT source AS family, doc_id AS name, coalesce(length(s), 0)::INT AS start, longest - coalesce(length(s), 0) AS length FROM (SELECT *, max(length(s)) OVER (PARTITION BY source) AS longest FROM {_ROWS})
WHERE longest > coalesce(length(s), 0)""")
def gap_runs(spark, sf_dir):
    return alignments.gap_runs(_aligned(spark, sf_dir))


@query(f"""WITH {_COUNTED}, kinds AS (SELECT family, pos, count(*) AS kinds FROM solid GROUP BY family, pos),
raw AS (SELECT s.family, s.name, sum(1.0::DOUBLE / (k.kinds * c.n)) / count(*) AS raw FROM cells s JOIN kinds k USING (family, pos) JOIN solid c USING (family, pos, residue) GROUP BY s.family, s.name)
SELECT family, name, round(raw / sum(raw) OVER (PARTITION BY family) * count(*) OVER (PARTITION BY family), {DIGITS}) AS weight FROM raw""")
def position_weights(spark, sf_dir):
    return alignments.position_weights(_aligned(spark, sf_dir)).select("family", "name", F.round("weight", DIGITS).alias("weight"))


@query(f"""WITH {_COUNTED}, vote AS (SELECT family, pos, residue AS vote FROM (SELECT *, row_number() OVER (PARTITION BY family, pos ORDER BY n DESC, ascii(residue)) AS r FROM counted) WHERE r = 1)
SELECT family, name, round(sum(CASE WHEN residue = vote THEN 1 ELSE 0 END) / count(*)::DOUBLE, {DIGITS}) AS identity FROM cells JOIN vote USING (family, pos) GROUP BY family, name""")
def consensus_identity(spark, sf_dir):
    rows = _aligned(spark, sf_dir)
    told = alignments.identity_to_consensus(rows, alignments.consensus(_composition(spark, sf_dir)))
    return told.select("family", "name", F.round("identity", DIGITS).alias("identity"))


# --- records and categories ---------------------------------------------------


@query("""
SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id
""")
def fold_records(spark, sf_dir):
    """Rows of one record folded in order."""
    rows = _table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), ">").alias("roles"),
        F.sum(F.length("text")).alias("n_chars"),
    )


@query("""
SELECT quality, toxic, count(*) AS n, round(avg(length(text)), 6) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY quality, toxic
""")
def category_means(spark, sf_dir):
    both = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    return both.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n"), 6).alias("mean_chars"))


# --- alignments and trees of bounded families ---------------------------------


@query(f"""WITH {_DISTANCE}, best AS (SELECT id, ref_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(distance, 9), ref_id) AS r FROM told) WHERE r = 1)
SELECT b.id AS doc_id, b.ref_id, levenshtein(d.seq, r.seq)::BIGINT AS edits FROM best b JOIN docs d ON b.id = d.id JOIN refs r ON b.ref_id = r.id""")
def nearest_reference_edits(spark, sf_dir):
    """Edit distance of each text to its nearest reference, a stated pair for each row."""
    best = _nearest_references(spark, sf_dir)
    refs = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), S.letters(F.col("text")).alias("ref"))
    both = best.join(_residues(spark, sf_dir).select("id", "seq"), "id").join(refs, "ref_id")
    return both.select(F.col("id").alias("doc_id"), "ref_id", S.edits(F.col("seq"), F.col("ref")).alias("edits"))


def _center_distances(spark, sf_dir) -> DataFrame:
    known = _label_centers(_vectors(spark, sf_dir))
    if len(known) > trees.MAX_LEAVES:
        raise ValueError(f"{len(known)} centers; a tree takes {trees.MAX_LEAVES}")
    centers = spark.createDataFrame(known, "label int, center array<double>")
    a, b = centers.select(F.col("label").alias("i"), F.col("center").alias("a")), centers.select(F.col("label").alias("j"), F.col("center").alias("b"))
    # at most MAX_LEAVES centers against themselves
    return a.join(b, F.col("i") > F.col("j")).select(F.lit("centers").alias("family"), "i", "j", F.round(V.squared_distance(F.col("a"), F.col("b")), 9).alias("dist"))


@query()
def center_tree(spark, sf_dir):
    """The average-linkage tree over the label centers."""
    return trees.build(_center_distances(spark, sf_dir)).select(
        "step", "a", "b", "node", *[F.round(c, DIGITS).alias(c) for c in ("len_a", "len_b", "height")]
    )


@query()
def center_tree_weights(spark, sf_dir):
    return trees.leaf_weights(trees.build(_center_distances(spark, sf_dir))).select("leaf", F.round("weight", DIGITS).alias("weight"))


@query()
def reference_alignment(spark, sf_dir):
    """The reference set aligned in families of ten."""
    refs = _table(spark, sf_dir, "benchmark")
    rows = refs.select((F.col("item_id") / 10).cast("long").alias("family"), F.col("item_id").alias("name"), S.letters(F.col("text")).alias("seq"))
    return progressive.align_families(rows)


# --- more projections, samples and records ------------------------------------


@query(f"""
SELECT code, count(*) AS n FROM (SELECT CASE WHEN least(a, b) >= 0 THEN (a + 25 * b)::BIGINT END AS code FROM
  (SELECT instr('{S.RESIDUES}', substr(kmer, 1, 1)) - 1 AS a, instr('{S.RESIDUES}', substr(kmer, 2, 1)) - 1 AS b FROM ({_KMERS.format(k=2)}))) GROUP BY code
""")
def kmer_codes(spark, sf_dir):
    each = kmers.counts(_residues(spark, sf_dir), "id", F.col("seq"), 2)
    return each.groupBy(S.kmer_code(F.col("kmer"), 2).alias("code")).agg(F.sum("n").alias("n"))


@query(f"""WITH {_COUNTED} SELECT family, keep, count(*) AS n FROM (SELECT family, pos, CASE WHEN bool_and(residue = '-') THEN 'all gaps' WHEN bool_or(residue = '-') THEN 'some gaps' ELSE 'solid' END AS keep
FROM counted GROUP BY family, pos) GROUP BY family, keep""")
def column_classes(spark, sf_dir):
    """How many columns are all gaps, partly gaps or solid."""
    gap = F.col("residue").rlike(alignments.GAPS)
    kept = _composition(spark, sf_dir).groupBy("family", "pos").agg(
        F.when(F.bool_and(gap), "all gaps").when(F.bool_or(gap), "some gaps").otherwise("solid").alias("keep")
    )
    return kept.groupBy("family", "keep").agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, round(key, 9) AS key FROM (SELECT doc_id, -ln((('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE) / greatest(length(text), 1) AS key FROM documents)
ORDER BY key, doc_id LIMIT 100
""")
def weighted_sample(spark, sf_dir):
    """A hundred texts drawn without replacement, weighted by length: the least of -ln(u) / weight (a sampling operator)."""
    u = (F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    key = -F.log(u) / F.greatest(F.length("text"), F.lit(1))
    drawn = _table(spark, sf_dir, "documents").select("doc_id", key.alias("key")).orderBy("key", "doc_id").limit(100)
    return drawn.select("doc_id", F.round("key", 9).alias("key"))


@query("""
SELECT before, event_type, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY before, event_type
""")
def event_transitions(spark, sf_dir):
    """First-order transition counts of each user's ordered events."""
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _table(spark, sf_dir, "events").select(before.alias("before"), "event_type").groupBy("before", "event_type").agg(F.count("*").alias("n"))


@query("""
SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type
""")
def event_properties(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("""
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL
""")
def event_windows(spark, sf_dir):
    """The batch form of the event-time windows of ``streaming``."""
    from strandlake.streaming.assign import windowed_counts

    return windowed_counts(_table(spark, sf_dir, "events"), "ts", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""
SELECT n_nationkey AS nation, c_mktsegment AS segment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_nationkey, c_mktsegment
""")
def category_totals(spark, sf_dir):
    """Facts met with two dimensions and summed by category."""
    orders = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    ).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query()
def center_newick(spark, sf_dir):
    """The tree over the label centers as text."""
    distances = _center_distances(spark, sf_dir)
    leaves = distances.select("i").union(distances.select("j")).distinct()
    names = leaves.select(F.lit("centers").alias("family"), F.col("i").alias("leaf"), F.concat(F.lit("label"), F.col("i").cast("string")).alias("name"))
    return trees.newick(trees.build(distances), names)
