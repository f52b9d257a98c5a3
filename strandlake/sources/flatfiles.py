"""Annotated sequence records (GenBank, EMBL, PIR) as tables, and back.

Files are cut by Spark before each line that starts a record, wherever a split begins, so
a large file is read in parallel and only by Spark's own reader, from any store it knows.
Fields are taken by built-in functions.

Defined results: text before the first record is no record; line ends of any system are
read; a field that is absent is empty; a record without sequence lines has an empty
sequence; a record without its end mark ends with the file or the next record; an empty
file has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How records and their fields begin in each format.
START = {"genbank": "LOCUS", "embl": "ID   ", "pir": "ENTRY"}
DESCRIPTION = {"genbank": "DEFINITION", "embl": "DE   ", "pir": "TITLE"}
ACCESSION = {"genbank": "ACCESSION", "embl": "AC   ", "pir": "ACCESSION"}
SEQUENCE = {"genbank": "ORIGIN", "embl": "SQ   ", "pir": "SEQUENCE"}
END = {"genbank": "//", "embl": "//", "pir": "///"}
#: Lines of a sequence that are cut at once.
LINES = 32


def kind(text: Column) -> Column:
    """``genbank``, ``embl``, ``pir`` or ``fasta`` by the first line that begins a record, null for none."""
    first = F.regexp_extract(text, r"(?m)^(LOCUS\s|ID   |ENTRY\s|>)", 1)
    return F.when(first.startswith("LOCUS"), "genbank").when(first.startswith("ID"), "embl").when(first.startswith("ENTRY"), "pir").when(first == ">", "fasta")


def _after(record: Column, mark: str) -> Column:
    """What follows the line that starts with ``mark``; empty without one."""
    at = F.instr(record, f"\n{mark}")
    return F.when(at > 0, F.regexp_replace(F.substring(record, at + 1, F.length(record)), r"^[^\n]*\n?", "")).otherwise("")


def _field(record: Column, mark: str, continued: str) -> Column:
    """The text of a field whose first line starts with ``mark`` and whose others match ``continued``, joined by single spaces."""
    whole = F.regexp_extract(record, rf"(?:^|\n){mark}([^\n]*(?:\n{continued}[^\n]*)*)", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(whole, rf"\n{continued}", " "), r"\s+", " "))


def read_records(spark: SparkSession, path: str, form: str) -> DataFrame:
    """(family, name, accession, description, seq) of the records of files in ``form``; the family is the file's name."""
    mark = START[form]
    lines = spark.read.option("lineSep", f"\n{mark}").text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"\r\n?", "\n").alias("value"))
    # A piece that starts with the mark is a file's first record; the others lost it to the cut, but for what stands before the first.
    first, known = F.col("value").startswith(mark), F.lit(False)
    for x in (DESCRIPTION[form], ACCESSION[form], SEQUENCE[form], END[form]):
        known = known | F.col("value").contains(f"\n{x}")
    text = lines.where(first | known).select("file", F.when(first, F.col("value")).otherwise(F.concat(F.lit(mark), "value")).alias("record"))
    body = _after(F.col("record"), SEQUENCE[form])
    if form == "embl":  # sequence lines begin with five spaces; what follows them is none of it
        body = F.regexp_replace(F.concat(F.lit("\n"), body), r"(?s)\n(?!     ).*", "")
    else:
        body = F.substring_index(F.concat(F.lit("\n"), body), f"\n{END[form]}", 1)
    continued = {"genbank": "            ", "embl": "DE   ", "pir": "            "}[form]
    name = F.regexp_extract("record", rf"^{mark}\s*([^\s;]+)", 1)
    return text.select(
        F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1).alias("family"), name.alias("name"),
        F.regexp_extract(_field(F.col("record"), ACCESSION[form], "\0"), r"^([^\s;]+)", 1).alias("accession"),
        _field(F.col("record"), DESCRIPTION[form], continued).alias("description"), F.regexp_replace(body, r"[\s0-9/]+", "").alias("seq"),
    ).where("name <> ''")


def record_text(form: str, name: Column, accession: Column, description: Column, seq: Column, width: int = 60) -> Column:
    """One record of ``form`` with its sequence in lines of ``width``."""
    n = F.length(seq)
    line = {
        "genbank": lambda i, part, end: F.concat(F.lpad(i.cast("string"), 9, " "), F.lit(" "), part),
        "embl": lambda i, part, end: F.concat(F.lit("     "), part, F.lit(" "), F.lpad(F.least(end, i + width - 1).cast("string"), 9, " ")),
        "pir": lambda i, part, end: F.concat(F.lpad(i.cast("string"), 7, " "), F.lit(" "), part),
    }[form]
    # Letters are found and counted by walking from a string's start, so that is done for blocks of lines and not for each line.
    block = width * LINES
    firsts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(firsts, lambda at: F.struct(at.alias("at"), F.substring(seq, at + 1, F.lit(block)).alias("letters"), F.least(n, at + block).alias("end")))
    inner = lambda b: F.transform(F.sequence(F.lit(1), F.length(b["letters"]), F.lit(width)), lambda i: line(b["at"] + i, F.substring(b["letters"], i, F.lit(width)), b["end"]))
    body = F.array_join(F.transform(blocks, lambda b: F.array_join(inner(b), "\n")), "\n")
    head = {
        "genbank": F.concat(F.lit("LOCUS       "), name, F.lit("  "), n.cast("string"), F.lit(" bp\nDEFINITION  "), description, F.lit("\nACCESSION   "), accession, F.lit("\nORIGIN\n")),
        "embl": F.concat(F.lit("ID   "), name, F.lit(";\nAC   "), accession, F.lit(";\nDE   "), description, F.lit("\nSQ   Sequence "), n.cast("string"), F.lit(";\n")),
        "pir": F.concat(F.lit("ENTRY          "), name, F.lit("\nTITLE          "), description, F.lit("\nACCESSION      "), accession, F.lit("\nSEQUENCE\n                5        10\n")),
    }[form]
    return F.concat(head, body, F.when(n > 0, "\n").otherwise(""), F.lit(END[form]))


def write_records(rows: DataFrame, path: str, form: str) -> None:
    """Write (name, accession, description, seq) as files of ``form``."""
    rows.select(record_text(form, *(F.col(c) for c in ("name", "accession", "description", "seq"))).alias("value")).write.text(path)
