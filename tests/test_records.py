"""Annotated records against fixtures of other hands, and round trips at several split sizes."""

import pytest
from pyspark.sql import functions as F

from strandlake.sources import flatfiles

GENBANK = """GBVRL.SEQ          Genetic Sequence Data Bank

LOCUS       AB000001                  21 bp    DNA     linear   VRL 01-JAN-2000
DEFINITION  A first sequence that goes
            on in a second line.
ACCESSION   AB000001 AB999999
VERSION     AB000001.1
FEATURES             Location/Qualifiers
     source          1..21
                     /note="ORIGIN of it // unknown"
ORIGIN
        1 acgtacgtac gtacgtacgt
       21 a
//
LOCUS       EMPTY1
DEFINITION  None.
ACCESSION   X1
ORIGIN
//
LOCUS       OPEN2     4 bp
ACCESSION   X2
ORIGIN
        1 acgt"""
EMBL = """ID   X56734; SV 1; linear; mRNA; STD; PLN; 30 BP.
XX
AC   X56734; S46826;
XX
DE   Trifolium repens mRNA for
DE   beta-glucosidase
FH   Key             Location/Qualifiers
SQ   Sequence 30 BP; 9 A; 7 C; 7 G; 7 T; 0 other;
     aaacaaacca aatatggatt        20
     ttattgtagc                   30
XX   extra data
     that is no sequence
//
ID   Y2
SQ   Sequence 2 BP;
     ac 2
//
"""
PIR = """\\\\\\
ENTRY            CCHU       #type complete
TITLE            cytochrome c - human
ACCESSION        A31764; A05676
SEQUENCE
                5        10        15
      1 M G D V E K G K K I F
     31 M K C
///
ENTRY            CCCZ
TITLE            cytochrome c
                 of another
SEQUENCE
                5
      1 M G
///
"""
WANT = {
    "genbank": (GENBANK, [("AB000001", "AB000001", "A first sequence that goes on in a second line.", "acgtacgtacgtacgtacgta"), ("EMPTY1", "X1", "None.", ""), ("OPEN2", "X2", "", "acgt")]),
    "embl": (EMBL, [("X56734", "X56734", "Trifolium repens mRNA for beta-glucosidase", "aaacaaaccaaatatggattttattgtagc"), ("Y2", "", "", "ac")]),
    "pir": (PIR, [("CCCZ", "", "cytochrome c of another", "MG"), ("CCHU", "A31764", "cytochrome c - human", "MGDVEKGKKIFMKC")]),
}


@pytest.mark.parametrize("form", list(WANT))
@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_records_of_other_hands(spark, tmp_path, form, ends):
    text, want = WANT[form]
    (tmp_path / "one.txt").write_text(text if ends == "\n" else text.replace("\n", ends), newline="")
    (tmp_path / "two.txt").write_text("")
    if ends == "\r\n":
        text = text.replace("\n", ends)
    got = sorted((r["name"], r["accession"], r["description"], r["seq"]) for r in flatfiles.read_records(spark, str(tmp_path), form).collect())
    assert got == want
    assert spark.range(1).select(flatfiles.kind(F.lit(WANT[form][0]))).first()[0] == form
    assert spark.range(1).select(flatfiles.kind(F.lit("no record")).alias("k")).first()["k"] is None


@pytest.mark.parametrize("form", list(WANT))
@pytest.mark.parametrize("split", ["1k", "7k", "128m"])
def test_records_come_back_at_any_split(spark, tmp_path, form, split):
    rows = [(f"N{i}", f"A{i}", f"row {i}", "ACGT" * (i * 7 % 90)) for i in range(120)]
    df = spark.createDataFrame(rows, "name string, accession string, description string, seq string").coalesce(1)
    path = str(tmp_path / "out")
    flatfiles.write_records(df, path, form)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        back = flatfiles.read_records(spark, path, form)
        got = sorted((r["name"], r["accession"], r["description"], r["seq"]) for r in back.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(rows)
