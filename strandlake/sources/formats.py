"""Sequence, tree and matrix files as tables, and back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators.trees import parse_newick


def _records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """(file, record): file contents cut before each line that starts with ``mark``; Spark splits large files there."""
    text = spark.read.option("lineSep", f"\n{mark}").text(path).select(F.input_file_name().alias("file"), F.col("value").alias("record"))
    return text.withColumn("record", F.regexp_replace(F.regexp_replace("record", r"\r\n?", "\n"), f"^{mark}", ""))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(family, name, description, seq) from FASTA files; the family is the file's name.

    Wrapped lines are joined and white space is dropped. A record without a name is an
    error in the data and is left out; aligned rows keep their gaps.
    """
    head = F.substring_index("record", "\n", 1)
    body = F.when(F.instr("record", "\n") > 0, F.expr("substring(record, instr(record, '\\n') + 1)")).otherwise("")
    return (
        _records(spark, path, ">")
        .select(
            F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1).alias("family"),
            F.regexp_extract(head, r"^\s*(\S+)", 1).alias("name"),
            F.trim(F.regexp_extract(head, r"^\s*\S+\s*(.*)$", 1)).alias("description"),
            F.regexp_replace(body, r"\s+", "").alias("seq"),
        )
        .where("name <> ''")
    )


def fasta_text(name: Column, seq: Column, width: int = 60) -> Column:
    """One FASTA record, wrapped at ``width``."""
    wrapped = F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    return F.concat(F.lit(">"), name, F.lit("\n"), wrapped)


def write_fasta(rows: DataFrame, path: str, width: int = 60) -> None:
    """Write (name, seq) as FASTA part files."""
    rows.select(fasta_text(F.col("name"), F.col("seq"), width).alias("value")).write.text(path)


def newick_nodes(trees: DataFrame) -> DataFrame:
    """(family, node, parent, name, length) of trees as text (family, newick)."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(f, *node) for f, text in zip(batch["family"], batch["newick"], strict=True) for node in parse_newick(text or "")]
            yield pd.DataFrame(rows, columns=["family", "node", "parent", "name", "length"]).astype({"parent": "Int32"})

    return trees.select("family", "newick").mapInPandas(run, "family string, node int, parent int, name string, length double")


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """(family, node, parent, name, length) of the trees in files of one tree each."""
    whole = spark.read.text(path, wholetext=True)
    return newick_nodes(whole.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("family"), F.col("value").alias("newick")))


def alignment_blocks(files: DataFrame) -> DataFrame:
    """(family, name, aseq, kind) of alignment files as text (family, value): Stockholm, ALN, MSF or interleaved PHYLIP, told by content.

    A row's pieces are joined in the order of their blocks. Marks, headers, annotation
    and counts after a piece are left out; MSF rows start after ``//``.
    """
    text = F.regexp_replace("value", r"\r\n?", "\n")
    kind = (
        F.when(text.rlike(r"^# STOCKHOLM"), "stockholm").when(text.rlike(r"^\s*CLUSTAL"), "aln")
        .when(text.rlike(r"(?m)^//"), "msf").when(text.rlike(r"^\s*\d+\s+\d+"), "phylip")
    )
    body = F.when(kind == "msf", F.regexp_replace(text, r"(?s)^.*?\n//", "")).when(kind == "phylip", F.regexp_replace(text, r"^\s*\d+\s+\d+[^\n]*", "")).otherwise(
        F.regexp_replace(text, r"^[^\n]*", "")
    )
    rows = F.regexp_extract(text, r"^\s*(\d+)\s+\d+", 1)
    lines = files.where(kind.isNotNull()).select("family", kind.alias("kind"), F.when(kind == "phylip", rows.cast("int")).alias("rows"), F.posexplode(F.split(body, "\n")).alias("at", "line"))
    lines = lines.where(F.col("line").rlike(r"\S") & ~F.col("line").rlike(r"^\s*(#|//)") & ((F.col("kind") != "aln") | ~F.col("line").rlike(r"^\s")))
    each = Window.partitionBy("family").orderBy("at")
    lines = lines.withColumn("k", F.row_number().over(each) - 1)
    words = F.split(F.trim("line"), r"\s+")
    named = (F.col("kind") != "phylip") | (F.col("k") < F.col("rows"))
    pieces = lines.select(
        "family", "kind", "at", F.when(named, F.get(words, F.lit(0))).alias("name"), F.when(F.col("kind") == "phylip", F.pmod("k", "rows")).alias("slot"),
        F.when(F.col("kind") == "aln", F.get(words, F.lit(1))).otherwise(F.array_join(F.when(named, F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))).otherwise(words), "")).alias("piece"),
    )
    row = Window.partitionBy("family", "slot")
    pieces = pieces.withColumn("name", F.when(F.col("kind") == "phylip", F.max("name").over(row)).otherwise(F.col("name")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"]), "")
    return pieces.groupBy("family", "kind", "name").agg(joined.alias("aseq"))


def read_alignment_blocks(spark: SparkSession, path: str) -> DataFrame:
    """:func:`alignment_blocks` of files, one alignment each."""
    whole = spark.read.text(path, wholetext=True)
    return alignment_blocks(whole.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("family"), "value"))


def alignment_text(rows: DataFrame, kind: str = "aln", width: int = 60) -> DataFrame:
    """(family, value): families (family, name, aseq) of equal row lengths as text in blocks of ``width`` columns; kind is aln, stockholm, msf or phylip."""
    pieces = rows.select("family", "name", "aseq", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("aseq") / width) - 1, F.lit(0)).cast("int")), lambda i: F.substring(F.col("aseq"), i * width + 1, F.lit(width)))).alias("block", "piece"))
    bare = (F.col("block") > 0) if kind == "phylip" else F.lit(False)
    line = F.when(bare, F.col("piece")).otherwise(F.concat(F.rpad(F.col("name").cast("string"), F.greatest(F.length(F.col("name").cast("string")) + 1, F.lit(16)), F.lit(" ")), "piece"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "name", line.alias("line"))))
    joined = F.array_join(F.transform(ordered, lambda x, i: F.concat(F.when((i > 0) & (x["block"] != F.get(ordered, i - 1)["block"]), "\n").otherwise(""), x["line"])), "\n")
    # How files of each kind start and end.
    head = {
        "aln": F.lit("CLUSTAL multiple sequence alignment\n\n"), "stockholm": F.lit("# STOCKHOLM 1.0\n\n"), "msf": F.lit("PileUp\n\n//\n\n"),
        "phylip": F.concat_ws(" ", F.lit(""), F.countDistinct("name"), F.max(F.length("aseq"))),
    }[kind]
    tail = {"stockholm": "\n//\n"}.get(kind, "\n")
    head = F.concat(head, F.lit("\n")) if kind == "phylip" else head
    return pieces.groupBy("family").agg(F.concat(head, joined, F.lit(tail)).alias("value"))


def substitution_matrix(lines: DataFrame) -> DataFrame:
    """(a, b, score) from lines (at, value) of a matrix text: a row of letters, then a letter and numbers on each line; # starts a comment."""
    words = F.split(F.trim("value"), r"\s+")
    real = lines.where(~F.col("value").rlike(r"^\s*(#|$)")).select("at", words.alias("w"))
    head = real.groupBy().agg(F.min_by("w", "at").alias("letters"), F.min("at").alias("first"))  # one row
    body = real.crossJoin(F.broadcast(head)).where(F.col("at") > F.col("first"))
    return body.select(
        F.get("w", F.lit(0)).alias("a"), F.posexplode(F.slice("w", 2, F.size("w"))).alias("k", "x"), "letters"
    ).select("a", F.get("letters", F.col("k")).alias("b"), F.col("x").cast("double").alias("score"))


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """(family, i, name, dist array<double>) from square or triangular matrix files: a count, then a label and numbers on each line."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("family"), F.split(F.trim("value"), r"\s+").alias("w"))
    return lines.where((F.size("w") > 1) & ~F.get("w", F.lit(0)).rlike(r"^\d+$")).select(
        "family", F.get("w", F.lit(0)).alias("name"), F.expr("transform(slice(w, 2, size(w) - 1), x -> cast(x as double))").alias("dist")
    )


def read_cluster_list(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, object, seq_index, name, length, split_path) from lines ``Cluster k: object i has index j (=seq NAME LEN~len) BITS``."""
    # Fixed value: the line's pattern.
    pattern = re.compile(r"^Cluster (\d+): object (\d+) has index (\d+) \(=seq (\S+) (\d+)~len\)\s*(\S*)").pattern
    part = lambda k: F.regexp_extract("value", pattern, k)
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(
        part(1).cast("int").alias("cluster"), part(2).cast("int").alias("object"), part(3).cast("int").alias("seq_index"),
        part(4).alias("name"), part(5).cast("int").alias("length"), part(6).alias("split_path"),
    )


def score_log(files: DataFrame) -> DataFrame:
    """(run, family, sp, tc) from logs as text (run, value) that name a file, then its SP score and TC on later lines."""
    lines = files.select("run", F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).select(
        "run", "at", F.regexp_extract("line", r"Now processing file \(\d+/\d+\) : (\S+)", 1).alias("family"),
        F.expr(r"try_cast(regexp_extract(line, 'SP-score\\s*=\\s*([0-9.]+)', 1) as double)").alias("sp"),
        F.expr(r"try_cast(regexp_extract(line, '\\bTC\\s*=\\s*([0-9.]+)', 1) as double)").alias("tc"),
    )
    block = Window.partitionBy("run").orderBy("at")  # a log is one file, read whole
    told = lines.withColumn("family", F.last(F.when(F.col("family") != "", F.col("family")), ignorenulls=True).over(block))
    return told.where("family is not null").groupBy("run", "family").agg(F.max("sp").alias("sp"), F.max("tc").alias("tc"))


def read_score_log(spark: SparkSession, path: str) -> DataFrame:
    """:func:`score_log` of files."""
    whole = spark.read.text(path, wholetext=True)
    return score_log(whole.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("run"), "value"))
