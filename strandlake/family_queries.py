"""Queries over families: formats read back, pair kernels, identities, trees and samples, with DuckDB SQL for their rows.

Formats are written to the shared folder, or made as text in a column, and read back,
so that the SQL can tell what must come out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequences as S
from strandlake.functions import vectors as V
from strandlake.operators import alignments, clusters, kmers, ordering, pairwise, statistics, trees
from strandlake.operators.components import connected_components
from strandlake.queries import _COUNTED, _ROWS, DIGITS, SEQ, VEC, _aligned, _composition, _residues, _table, _vectors, _with_seeds, query
from strandlake.sources import formats
from strandlake.storage import materialize, scratch, spread


# --- formats ------------------------------------------------------------------


@query(f"SELECT doc_id::VARCHAR AS name, source AS description, length(s)::BIGINT AS n, md5(s) AS digest FROM {_ROWS}")
def fasta_round_trip(spark, sf_dir):
    """All texts written as wrapped FASTA records and read back."""
    path, rows = scratch(spark), spread(_residues(spark, sf_dir))
    formats.write_fasta(rows.select(F.concat_ws(" ", "id", "source").alias("name"), "seq"), path)
    back = formats.read_fasta(spark, path)
    return back.select("name", "description", F.length("seq").cast("long").alias("n"), F.md5(F.col("seq").cast("binary")).alias("digest"))


def _family_rows(spark, sf_dir) -> DataFrame:
    """The reference set in families of ten, each row filled with gaps up to the longest of its family."""
    refs = _table(spark, sf_dir, "benchmark")
    rows = refs.select((F.col("item_id") / 10).cast("long").cast("string").alias("family"), F.concat(F.lit("item"), "item_id").alias("name"), S.letters(F.col("text")).alias("seq"))
    longest = rows.groupBy("family").agg(F.max(F.length("seq")).alias("longest"))
    return rows.join(longest, "family").select("family", "name", F.expr("rpad(seq, longest, '-')").alias("aseq"))


_FAMILIES = f"""rows AS (SELECT (item_id // 10)::VARCHAR AS family, 'item' || item_id AS name, {SEQ} AS s FROM benchmark),
aligned AS (SELECT family, name, s, rpad(s, max(length(s)) OVER (PARTITION BY family)::INT, '-') AS aseq FROM rows)"""


@query(f"""WITH {_FAMILIES} SELECT kind, family, name, length(aseq)::BIGINT AS n, md5(aseq) AS digest FROM aligned, (SELECT unnest(['aln', 'stockholm', 'msf', 'phylip']) AS kind)""")
def block_formats(spark, sf_dir):
    """Families written in four block formats and told apart by content when read back."""
    rows = materialize(_family_rows(spark, sf_dir))
    out = None
    for kind in ("aln", "stockholm", "msf", "phylip"):
        back = formats.alignment_blocks(formats.alignment_text(rows, kind))
        out = back if out is None else out.unionByName(back)
    return out.select("kind", "family", "name", F.length("aseq").cast("long").alias("n"), F.md5(F.col("aseq").cast("binary")).alias("digest"))


@query("SELECT r_name AS family, n_name AS name, round(n_nationkey / 8.0::DOUBLE, 6) AS length FROM nation JOIN region ON n_regionkey = r_regionkey")
def newick_leaves(spark, sf_dir):
    """Trees of each region's nations as text, and their leaves with lengths."""
    both = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    leaf = F.concat("n_name", F.lit(":"), F.format_string("%.6f", F.col("n_nationkey") / 8.0))
    text = both.groupBy(F.col("r_name").alias("family")).agg(F.concat(F.lit("(\n"), F.array_join(F.array_sort(F.collect_list(leaf)), ",\n"), F.lit(")\n;\n")).alias("newick"))
    return formats.newick_nodes(text).where("name <> ''").select("family", "name", F.round("length", 6).alias("length"))


@query("SELECT name, len(dist)::BIGINT AS n, round(list_sum(dist), 6) AS total FROM (SELECT n_name AS name, list_transform(range(0, n_nationkey + 1), lambda x: (x * n_regionkey / 4.0)::DOUBLE) AS dist FROM nation)")
def distance_matrix_rows(spark, sf_dir):
    """A triangular matrix file: a count, then a label and numbers on each line."""
    path = scratch(spark)
    rows = _table(spark, sf_dir, "nation").select(F.concat_ws(" ", F.col("n_name"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_nationkey").cast("int")), lambda x: (x * F.col("n_regionkey") / 4.0).cast("string")), " ")).alias("value"))
    spark.createDataFrame([("25",)], "value string").unionByName(rows).write.text(path)
    told = formats.read_distances(spark, path)
    return told.select("name", F.size("dist").cast("long").alias("n"), F.round(F.aggregate("dist", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT label AS cluster, vec_id::INT AS object, (vec_id * 2)::INT AS seq_index, 'v' || vec_id AS name, len(embedding)::INT AS length, CASE WHEN label % 2 = 0 THEN '0' ELSE '01' END AS split_path FROM embeddings WHERE label IS NOT NULL")
def cluster_list_rows(spark, sf_dir):
    """A cluster list written line by line and read back."""
    path = scratch(spark)
    rows = _table(spark, sf_dir, "embeddings").where("label is not null")
    rows.select(F.format_string(
        "Cluster %d: object %d has index %d (=seq v%d %d~len)\t %s", "label", "vec_id", F.col("vec_id") * 2, "vec_id", F.size("embedding"), F.when(F.col("label") % 2 == 0, "0").otherwise("01")
    ).alias("value")).write.text(path)
    return formats.read_cluster_list(spark, path)


@query("SELECT r_name AS run, n_name AS family, round(n_nationkey / 25.0::DOUBLE, 4) AS sp, CASE WHEN n_nationkey % 3 > 0 THEN round(n_nationkey / 50.0::DOUBLE, 4) END AS tc FROM nation JOIN region ON n_regionkey = r_regionkey")
def score_log_rows(spark, sf_dir):
    """Logs that name a file and give its scores on later lines, some without one."""
    both = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    number = lambda x: F.format_string("%.4f", x)
    entry = F.concat_ws(
        "\n", F.concat(F.lit("Now processing file (1/5) : "), "n_name"), F.concat(F.lit("SP-score = "), number(F.col("n_nationkey") / 25.0)),
        F.when(F.col("n_nationkey") % 3 > 0, F.concat(F.lit("TC = "), number(F.col("n_nationkey") / 50.0))),
    )
    logs = both.groupBy(F.col("r_name").alias("run")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "\n").alias("value"))
    return formats.score_log(logs)


@query("SELECT a, b, (CASE WHEN a = b THEN 5 ELSE (ascii(a) + ascii(b)) % 7 - 4 END)::DOUBLE AS score FROM (SELECT unnest(string_split('ARNDCQ', '')) AS a), (SELECT unnest(string_split('ARNDCQ', '')) AS b)")
def substitution_scores(spark, sf_dir):
    """A substitution matrix as text with comments, as a table."""
    letters = "ARNDCQ"
    text = ["# scores", "   " + "  ".join(letters), *(" ".join([a, *(str(5 if a == b else (ord(a) + ord(b)) % 7 - 4) for b in letters)]) for a in letters)]
    return formats.substitution_matrix(spark.createDataFrame(list(enumerate(text)), "at int, value string"))


# --- projections --------------------------------------------------------------

_ALPHABET, _BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "TCAGTCAGTCAGTCAGTCAGTCAGTC"
_NUCLEOTIDES = f"translate({SEQ}, '{_ALPHABET}', '{_BASES}')"


def _nucleotides(spark, sf_dir) -> DataFrame:
    """Texts as nucleotide rows: each letter stands for one of four."""
    return spread(_residues(spark, sf_dir)).select("id", F.translate("seq", _ALPHABET, _BASES).alias("seq"))


@query(f"""SELECT doc_id, length(s) // 3 AS n, md5(array_to_string(list_transform(range(0, length(s) // 3),
  lambda i: substr('{S.CODON_RESIDUES}', ((instr('TCAG', substr(s, 3 * i + 1, 1)) - 1) * 16 + (instr('TCAG', substr(s, 3 * i + 2, 1)) - 1) * 4 + instr('TCAG', substr(s, 3 * i + 3, 1)))::INT, 1)), '')) AS protein
FROM (SELECT doc_id, {_NUCLEOTIDES} AS s FROM documents WHERE text IS NOT NULL)""")
def codon_translation(spark, sf_dir):
    protein = S.translated(F.col("seq"))
    return _nucleotides(spark, sf_dir).where("seq is not null").select(F.col("id").alias("doc_id"), F.length(protein).cast("long").alias("n"), F.md5(protein.cast("binary")).alias("protein"))


@query(f"SELECT doc_id, len(regexp_extract_all(s, '[AG]C[ACGT]T'))::BIGINT AS n FROM (SELECT doc_id, {_NUCLEOTIDES} AS s FROM documents WHERE text IS NOT NULL)")
def motif_counts(spark, sf_dir):
    return _nucleotides(spark, sf_dir).where("seq is not null").select(F.col("id").alias("doc_id"), S.motif_count(F.col("seq"), "RCNT").alias("n"))


@query("SELECT doc_id, md5(regexp_replace(text, '[-._~ ]', '', 'g')) AS digest, length(regexp_replace(text, '[-._~ ]', '', 'g'))::BIGINT AS n FROM documents")
def dealigned_rows(spark, sf_dir):
    """Rows without their gap characters."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(S.dealign(F.col("text")).cast("binary")).alias("digest"), S.lengths_without_gaps(F.col("text")).cast("long").alias("n"))


@query("""SELECT p_partkey, p_partkey % 25 + 100 * (p_partkey // 25 % 25) + 10000 * (p_partkey // 625 % 25) AS digits, array_to_string(list_transform(range(0, 7), lambda i: (i = p_size % 7)::INT), '') AS one_hot FROM part""")
def code_digits(spark, sf_dir):
    """Codes taken apart into digits, and as one-hot rows."""
    part = _table(spark, sf_dir, "part")
    d = S.digits_of(F.col("p_partkey"), 3)
    return part.select("p_partkey", (d[0] + 100 * d[1] + 10000 * d[2]).alias("digits"), F.array_join(S.one_hot(F.col("p_size") % 7, 7).cast("array<string>"), "").alias("one_hot"))


@query(f"""SELECT doc_id, md5(string_agg(c, '' ORDER BY k)) AS digest FROM (SELECT doc_id, c, md5('7:' || i) AS k FROM (SELECT doc_id, unnest(string_split(s, '')) AS c, unnest(range(length(s))) AS i
FROM (SELECT doc_id, {SEQ} AS s FROM documents) WHERE length(s) > 0)) GROUP BY doc_id""")
def shuffled_rows(spark, sf_dir):
    """Each row's residues in an order fixed by a seed."""
    rows = spread(_residues(spark, sf_dir)).where("length(seq) > 0")
    return rows.select(F.col("id").alias("doc_id"), F.md5(S.shuffled(F.col("seq"), 7).cast("binary")).alias("digest"))


@query("SELECT event_type, count(*) FILTER (WHERE regexp_matches(value::VARCHAR, '^[+-]?[0-9]+([.][0-9]*)?([eE][+-]?[0-9]+)?$')) AS reals, count(*) AS n FROM events GROUP BY event_type")
def number_fields(spark, sf_dir):
    """How many fields are real numbers."""
    events = _table(spark, sf_dir, "events")
    real = S.is_real(F.col("value").cast("string"))
    return events.groupBy("event_type").agg(F.count(F.when(real, 1)).alias("reals"), F.count("*").alias("n"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS rank FROM documents")
def hash_permutation(spark, sf_dir):
    """A permutation of all rows that a hash fixes."""
    keyed = _table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("k"))
    return ordering.global_rank(keyed, [F.asc("k"), F.asc("doc_id")]).select("doc_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT length(text) // 100 AS bucket, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ALL")
def length_buckets(spark, sf_dir):
    n = F.length("text")
    return _table(spark, sf_dir, "documents").groupBy(F.floor(n / 100).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.sum(n).alias("chars"))


# --- pairs --------------------------------------------------------------------


@query("SELECT p_partkey, -levenshtein(p_name, p_type)::DOUBLE AS score FROM part")
def global_scores(spark, sf_dir):
    """The global kernel with unit costs, on stated pairs: minus the edit distance."""
    pairs = spread(_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"))
    return pairwise.score_pairs(pairs, lambda a, b: pairwise.global_score(a, b, 0.0, -1.0, 0.0, 1.0), "p_name", "p_type").select("p_partkey", "score")


@query("""WITH parts AS (SELECT p_partkey, p_name AS a, p_type AS b FROM part), spans AS (SELECT p_partkey, b, unnest(list_distinct(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2), lambda n: substr(a, i::INT, n::INT)))))) AS s FROM parts)
SELECT p.p_partkey, coalesce(max(length(s)), 0)::DOUBLE AS score FROM parts p LEFT JOIN (SELECT * FROM spans WHERE contains(b, s)) f USING (p_partkey) GROUP BY p.p_partkey""")
def local_scores(spark, sf_dir):
    """The local kernel where only matches can pay: the longest common substring."""
    pairs = spread(_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"))
    return pairwise.score_pairs(pairs, lambda a, b: pairwise.global_score(a, b, 1.0, -1e6, 1e6, 1e6, local=True), "p_name", "p_type").select("p_partkey", "score")


@query(f"""WITH points AS (SELECT vec_id, v, unnest(range(0, len(v) // 4)) AS i FROM (SELECT vec_id, {VEC} AS v FROM embeddings)), p AS (SELECT vec_id, i, v[4 * i + 1:4 * i + 4] AS x FROM points),
s AS (SELECT a.vec_id, a.i, b.i AS j, -list_sum(list_transform(list_zip(a.x, b.x), lambda t: abs(t[1] - t[2]))) AS s FROM p a JOIN p b ON b.vec_id = a.vec_id // 50 * 50),
w AS (SELECT *, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id, i) AS u, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id, j) AS t FROM s)
SELECT vec_id, round(sum((u + t - u * t) * s) / sum(u + t - u * t), {DIGITS}) AS score FROM w GROUP BY vec_id""")
def soft_symmetric_scores(spark, sf_dir):
    """Soft symmetric similarity of each vector, as sixteen points, to the seed of its block of fifty."""
    import numpy as np

    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    seeds = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("seed"), F.col("v").alias("w"))
    pairs = vectors.join(seeds, F.floor(F.col("vec_id") / 50) * 50 == F.col("seed"))

    def kernel(a, b):
        return pairwise.soft_symmetric_similarity(np.asarray(a, float).reshape(-1, 4), np.asarray(b, float).reshape(-1, 4))

    return pairwise.score_pairs(pairs, kernel, "v", "w").select("vec_id", F.round("score", DIGITS).alias("score"))


_REFERENCE_ROW = f"firsts AS (SELECT source, s AS ref FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM {_ROWS}) WHERE r = 1)"
_IDENTITY = f"""{_REFERENCE_ROW}, told AS (SELECT source AS family, doc_id AS name, CASE WHEN least(length(s), length(ref)) > 0 THEN
  len(list_filter(list_zip(string_split(s, ''), string_split(ref, '')), lambda p: p[1] = p[2] AND p[1] <> '')) / least(length(s), length(ref))::DOUBLE ELSE 0 END AS identity FROM {_ROWS} JOIN firsts USING (source))"""


def _identities(spark, sf_dir) -> DataFrame:
    rows = _aligned(spark, sf_dir)
    first = rows.groupBy("family").agg(F.min_by("aseq", "name").alias("aseq"))  # one row a family
    return alignments.row_identity(rows, first)


@query(f"WITH {_IDENTITY} SELECT family, name, round(identity, {DIGITS}) AS identity FROM told")
def row_identities(spark, sf_dir):
    """Identity of each row to its family's first row, over the shorter ungapped length."""
    return _identities(spark, sf_dir).select("family", "name", F.round("identity", DIGITS).alias("identity"))


@query(f"""WITH {_IDENTITY}, p AS (SELECT family, name, 1 - identity AS p FROM told)
SELECT family, name, round(CASE WHEN p < 0.75 THEN -ln(1 - p - p * p / 5) WHEN p > 0.93 THEN 10 ELSE {V.FAR_DISTANCES}[floor((p - 0.75) * 1000 + 0.5)::INT + 1] / 100.0::DOUBLE END, {DIGITS}) AS distance FROM p""")
def corrected_distances(spark, sf_dir):
    """Corrected distances from the share of differing columns."""
    return _identities(spark, sf_dir).select("family", "name", F.round(V.kimura(1.0 - F.col("identity")), DIGITS).alias("distance"))


@query(f"""WITH {_FAMILIES}, longest AS (SELECT family, max(length(s)) AS n FROM rows GROUP BY family),
k AS (SELECT family, name, unnest(range(length(s))) AS k, n - length(s) AS shift FROM rows JOIN longest USING (family) WHERE length(s) > 0),
groups AS (SELECT family, k AS r, k + shift AS p, count(*) AS c FROM k GROUP BY ALL), cols AS (SELECT family, r, sum(c * (c - 1) / 2.0::DOUBLE) AS found, sum(c) AS size, max(c) AS most FROM groups GROUP BY family, r HAVING sum(c) > 1)
SELECT family, round(sum(found) / sum(size * (size - 1) / 2.0::DOUBLE), {DIGITS}) AS sp, round(avg(CASE WHEN most = size THEN 1.0::DOUBLE ELSE 0 END), {DIGITS}) AS tc FROM cols GROUP BY family""")
def alignment_agreement(spark, sf_dir):
    """Rows aligned at their end, scored against the same rows aligned at their start."""
    reference = materialize(_family_rows(spark, sf_dir))
    predicted = reference.withColumn("aseq", F.expr("lpad(regexp_replace(aseq, '-', ''), length(aseq), '-')"))
    told = alignments.agreement(predicted, reference)
    return told.select("family", F.round("sp", DIGITS).alias("sp"), F.round("tc", DIGITS).alias("tc"))


@query(f"""WITH {_FAMILIES}, ends AS (SELECT family, max(length(s)) AS n, min(length(s)) AS least FROM rows GROUP BY family),
k AS (SELECT family, unnest(range(length(s))) AS k, n - length(s) AS shift, least FROM rows JOIN ends USING (family) WHERE length(s) > 0),
groups AS (SELECT family, k AS r, k + shift AS p, count(*) AS c FROM k WHERE k < least GROUP BY ALL), cols AS (SELECT family, r, sum(c * (c - 1) / 2.0::DOUBLE) AS found, sum(c) AS size, max(c) AS most FROM groups GROUP BY family, r HAVING sum(c) > 1)
SELECT family, round(sum(found) / sum(size * (size - 1) / 2.0::DOUBLE), {DIGITS}) AS sp, round(avg(CASE WHEN most = size THEN 1.0::DOUBLE ELSE 0 END), {DIGITS}) AS tc FROM cols GROUP BY family""")
def marked_agreement(spark, sf_dir):
    """As :func:`alignment_agreement`, judged on the reference columns without a gap alone."""
    reference = materialize(_family_rows(spark, sf_dir))
    predicted = reference.withColumn("aseq", F.expr("lpad(regexp_replace(aseq, '-', ''), length(aseq), '-')"))
    marked = alignments.columns(reference).groupBy("family", "pos").agg(F.bool_or(F.col("residue").rlike(alignments.GAPS)).alias("some")).where("not some")
    told = alignments.agreement(predicted, reference, marked)
    return told.select("family", F.round("sp", DIGITS).alias("sp"), F.round("tc", DIGITS).alias("tc"))


@query(f"""WITH {_COUNTED}, cols AS (SELECT family, pos, sum(CASE WHEN residue = '-' THEN 0 ELSE n END) AS s, sum(CASE WHEN residue = '-' THEN n ELSE 0 END) AS g, sum(CASE WHEN residue = '-' THEN 0 ELSE n * (n - 1) // 2 END) AS m FROM counted GROUP BY family, pos),
t AS (SELECT family, sum(m)::BIGINT AS matches, sum(s * (s - 1) // 2 - m)::BIGINT AS mismatches, sum(s * g)::BIGINT AS gap_pairs FROM cols GROUP BY family)
SELECT *, matches * 1.0::DOUBLE + mismatches * -0.5::DOUBLE + gap_pairs * -1.0::DOUBLE AS score FROM t""")
def pair_sums(spark, sf_dir):
    """Sum-of-pairs scores from column counts."""
    return alignments.sum_of_pairs(_composition(spark, sf_dir))


@query(f"WITH {_FAMILIES} SELECT family, name, substr(s, 1, shortest::INT) AS aseq FROM (SELECT *, min(length(s)) OVER (PARTITION BY family) AS shortest FROM rows) WHERE shortest > 0")
def solid_columns(spark, sf_dir):
    """Families cut to the columns without a gap."""
    rows = materialize(_family_rows(spark, sf_dir))
    gap = F.col("residue").rlike(alignments.GAPS)
    keep = alignments.columns(rows).groupBy("family", "pos").agg(F.bool_or(gap).alias("some")).where("not some")
    return alignments.project_columns(rows, keep)


@query("SELECT source, count(*) AS rows, min(length(text)) = max(length(text)) AS aligned, round(avg(length(text)), 6) AS mean_length FROM documents GROUP BY source")
def families_aligned(spark, sf_dir):
    """Whether a family's rows are equally long, and their mean length."""
    n = F.length("text")
    return _table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("rows"), (F.min(n) == F.max(n)).alias("aligned"), F.round(F.avg(n), 6).alias("mean_length"))


def _kmer_side(name: str, seq: str) -> str:
    return f"""{name} AS (SELECT id, kmer, count(*) AS n FROM (SELECT id, unnest([substr(q, i, 6) for i in range(1, length(q) - 4)]) AS kmer FROM (SELECT doc_id AS id, {seq} AS q FROM documents)) GROUP BY id, kmer),
{name}_best AS (SELECT id, max(share) AS share FROM (SELECT {name}.id, sum(least({name}.n, b.n)) / any_value(r.n)::DOUBLE AS share FROM {name} JOIN b USING (kmer) JOIN r ON r.id = b.id GROUP BY {name}.id, b.id) GROUP BY id)"""


@query(f"""WITH refs AS (SELECT item_id AS id, {SEQ} AS q FROM benchmark), r AS (SELECT id, length(q) - 5 AS n FROM refs), b AS (SELECT id, kmer, count(*) AS n FROM (SELECT id, unnest([substr(q, i, 6) for i in range(1, length(q) - 4)]) AS kmer FROM refs) GROUP BY id, kmer),
{_kmer_side('forward', SEQ)}, {_kmer_side('turned', f"reverse({SEQ})")}
SELECT doc_id, coalesce(t.share, 0) > coalesce(f.share, 0) AS turn FROM documents LEFT JOIN forward_best f ON f.id = doc_id LEFT JOIN turned_best t ON t.id = doc_id""")
def row_directions(spark, sf_dir):
    """Whether a row shares more k-mers with the references when read backwards."""
    refs = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), S.letters(F.col("text")).alias("seq"))
    rows = spread(_residues(spark, sf_dir).select("id", "seq"))
    forward = kmers.nearest_references(rows, refs, 6).select("id", F.col("share").alias("f"))
    turned = kmers.nearest_references(rows.withColumn("seq", F.reverse("seq")), refs, 6).select("id", F.col("share").alias("t"))
    told = rows.select("id").join(forward, "id", "left").join(turned, "id", "left")
    return told.select(F.col("id").alias("doc_id"), (F.coalesce("t", F.lit(0.0)) > F.coalesce("f", F.lit(0.0))).alias("turn"))


# --- statistics ---------------------------------------------------------------


@query(f"""WITH d AS (SELECT length(text) AS x, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS y FROM documents WHERE text IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS b FROM d)
SELECT round(corr(a, b), {DIGITS}) AS spearman, count(*) AS n FROM r""")
def length_word_ranks(spark, sf_dir):
    """Rank correlation of characters and words."""
    docs = _table(spark, sf_dir, "documents").select(F.length("text").alias("x"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("y"))
    return statistics.spearman(docs, "x", "y").select(F.round("spearman", DIGITS).alias("spearman"), F.col("n").cast("long").alias("n"))


@query(f"SELECT o_orderpriority AS priority, round(regr_slope(y, x), {DIGITS}) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), {DIGITS}) AS r2 FROM (SELECT o_orderpriority, o_totalprice::DOUBLE AS y, (o_orderkey % 1000)::DOUBLE AS x FROM orders) GROUP BY o_orderpriority")
def line_fits(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").alias("y"), (F.col("o_orderkey") % 1000).cast("double").alias("x"))
    return orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.round(F.regr_slope("y", "x"), DIGITS).alias("slope"), F.round(F.regr_intercept("y", "x"), 4).alias("intercept"), F.round(F.regr_r2("y", "x"), DIGITS).alias("r2")
    )


@query(f"SELECT event_type, round(any_value(m) + ln(sum(exp(value - m))), {DIGITS}) AS total, max(value) AS most, min(value) AS least FROM (SELECT event_type, value, max(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type")
def log_sums(spark, sf_dir):
    """Log sums of exponentials without overflow."""
    events = _table(spark, sf_dir, "events")
    top = events.groupBy("event_type").agg(F.max("value").alias("most"), F.min("value").alias("least"))  # a few rows
    both = events.select("event_type", "value").join(top, "event_type")
    return both.groupBy("event_type", "most", "least").agg(F.round(statistics.log_sum_exp(F.col("value"), F.col("most")), DIGITS).alias("total"))


# --- clusters and trees -------------------------------------------------------


@query(f"""WITH RECURSIVE v AS (SELECT vec_id, {VEC} AS v FROM embeddings), links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND round(list_distance(a.v, b.v) ** 2, 6) <= 100),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT reach.vec_id, ways.b FROM reach JOIN ways ON reach.other = ways.a),
least AS (SELECT vec_id, min(other) AS component FROM reach GROUP BY vec_id)
SELECT vec_id, component, 1.0::DOUBLE / count(*) OVER (PARTITION BY component) AS weight FROM least""")
def linkage_weights(spark, sf_dir):
    """Single linkage over close pairs of vectors and seeds, and weights of one over the size of a cluster."""
    most = math.nextafter(100.0000005, 0)  # the greatest that is rounded to 100
    close = materialize(clusters.block_distances(*_with_seeds(spark, sf_dir), most, joins=True).where("vec_id <> seed").select(F.col("vec_id").alias("a"), F.col("seed").alias("b")))
    found = connected_components(close)
    told = materialize(_table(spark, sf_dir, "embeddings").select("vec_id").join(found, F.col("vec_id") == F.col("node"), "left").select("vec_id", F.coalesce("component", "vec_id").alias("component")))
    sizes = told.groupBy("component").agg((1.0 / F.count("*")).alias("weight"))
    return told.join(sizes, "component").select("vec_id", "component", "weight")


def _nation_pairs(spark, sf_dir, distance) -> DataFrame:
    """Pairs of the nations (25 rows) with a distance of their keys and regions."""
    nation = _table(spark, sf_dir, "nation")
    a, b = (nation.select(F.col("n_nationkey").alias(f"{x}"), F.col("n_regionkey").alias(f"r{x}")) for x in "ij")
    both = a.join(b, F.col("i") > F.col("j"))
    return both.select(F.lit("nations").alias("family"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), distance.alias("dist"))


_APART = "CASE WHEN a.n_regionkey = b.n_regionkey THEN 2.0 ELSE 6.0 END"


def _by_region():
    return F.when(F.col("ri") == F.col("rj"), 2.0).otherwise(6.0)


@query(f"SELECT method, a.n_nationkey::INT AS i, b.n_nationkey::INT AS j, ({_APART})::DOUBLE AS path, ({_APART} / 2)::DOUBLE AS shared FROM nation a JOIN nation b ON a.n_nationkey > b.n_nationkey, (SELECT unnest(['average', 'complete', 'single']) AS method)")
def linkage_trees(spark, sf_dir):
    """Trees of three linkages over distances that are a tree's own: paths give them back."""
    pairs = materialize(_nation_pairs(spark, sf_dir, _by_region()))
    out = None
    for method in ("average", "complete", "single"):
        told = trees.path_lengths(trees.build(pairs, method), pairs).withColumn("method", F.lit(method))
        out = told if out is None else out.unionByName(told)
    return out.select("method", "i", "j", F.round("path", DIGITS).alias("path"), F.round("shared", DIGITS).alias("shared"))


@query(f"SELECT a.n_nationkey::INT AS i, b.n_nationkey::INT AS j, round((a.n_nationkey + b.n_nationkey) / 16.0::DOUBLE + {_APART}, {DIGITS})::DOUBLE AS path FROM nation a JOIN nation b ON a.n_nationkey > b.n_nationkey")
def joined_neighbours(spark, sf_dir):
    """Neighbour joining over additive distances: paths through its tree give them back."""
    pairs = materialize(_nation_pairs(spark, sf_dir, (F.col("i") + F.col("j")) / 16.0 + _by_region()))
    return trees.path_lengths(trees.build(pairs, "nj"), pairs).select("i", "j", F.round("path", DIGITS).alias("path"))


@query(f"SELECT n_nationkey::INT AS leaf, round(1.0::DOUBLE + 2.0::DOUBLE / count(*) OVER (PARTITION BY n_regionkey), {DIGITS}) AS weight FROM nation")
def tree_weights(spark, sf_dir):
    """Weights of leaves along their paths: edge lengths over the leaves below."""
    edges = trees.build(_nation_pairs(spark, sf_dir, _by_region()))
    return trees.leaf_weights(edges).select("leaf", F.round("weight", DIGITS).alias("weight"))


@query(f"SELECT n_name AS name, 3.0::DOUBLE AS depth FROM nation")
def newick_depths(spark, sf_dir):
    """A tree written as text and read back: every leaf is as far from the root."""
    nation = _table(spark, sf_dir, "nation")
    names = nation.select(F.lit("nations").alias("family"), F.col("n_nationkey").cast("int").alias("leaf"), F.col("n_name").alias("name"))
    nodes = materialize(formats.newick_nodes(trees.newick(trees.build(_nation_pairs(spark, sf_dir, _by_region())), names)))
    far = nodes.where("name <> ''").select("name", "parent", F.col("length").alias("depth"))
    up = nodes.select(F.col("node").alias("parent"), F.col("parent").alias("above"), F.col("length").alias("more"))
    done = None
    while not far.isEmpty():  # as many rounds as the tree is deep; it has 25 leaves
        step = materialize(far.join(up, "parent").select("name", "above", (F.col("depth") + F.col("more")).alias("depth")))
        ended = step.where("above is null").select("name", "depth")
        done = ended if done is None else done.unionByName(ended)
        far = step.where("above is not null").select("name", F.col("above").alias("parent"), "depth")
    return done.select("name", F.round("depth", 4).alias("depth"))


@query()
def seed_cluster_tree(spark, sf_dir):
    """The embedding chain: distances to stride seeds as vectors, bisecting into clusters, a tree over their centers."""
    vectors = materialize(_vectors(spark, sf_dir))
    total = vectors.count()
    seeds = ordering.stride_seeds(vectors, F.size("v"), "vec_id", min(16, ordering.number_of_seeds(total)))
    known = clusters.collected(seeds.select("vec_id", "v"), "vec_id", "v")
    columns = F.array(*[F.sqrt(V.squared_distance(F.col("v"), F.array(*map(F.lit, s)))) for _, s in known])
    embedded = materialize(vectors.select("vec_id", columns.alias("v")))
    parts = clusters.bisecting(embedded, "vec_id", "v", 8)
    centers = clusters.collected(clusters.centers(embedded.join(parts, "vec_id"), "cluster", "v"), "cluster", "center")
    table = spark.createDataFrame(centers, "k long, c array<double>")
    pairs = table.toDF("i", "a").join(table.toDF("j", "b"), F.col("i") > F.col("j")).select(  # eight centers
        F.lit("centers").alias("family"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), V.squared_distance(F.col("a"), F.col("b")).alias("dist")
    )
    return trees.build(pairs).select("step", "a", "b", "node", F.round("height", DIGITS).alias("height"))
