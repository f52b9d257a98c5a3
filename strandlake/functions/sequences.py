"""Column expressions over residue strings."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Residue tables that results depend on.
RESIDUES = "ARNDCQEGHILKMFPSTWYVXOUBZ"
REDUCED_FROM, REDUCED_TO = "ADKERNTSQYFLIVMCWHGP", "ADKKKNTTTYYLIIICWHGP"
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTUacgtu", "TGCAAtgcaa"
NUCLEOTIDES = "ACGTU"


def letters(text: Column) -> Column:
    """The ASCII letters of a text, upper-cased: the residue string it stands for."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def dealign(seq: Column) -> Column:
    """A row without its gaps."""
    return F.regexp_replace(seq, r"[-._~ ]", "")


def sanitize(seq: Column, usual: str = "ACDEFGHIKLMNPQRSTVWY", unknown: str = "X") -> Column:
    """Residues outside ``usual`` (and not gaps) become ``unknown``."""
    return F.regexp_replace(F.upper(seq), f"[^{usual}-]", unknown)


def unusual_share(seq: Column, usual: str = "ACDEFGHIKLMNPQRSTVWY") -> Column:
    """The share of residues outside ``usual``; 0 for an empty row."""
    odd = F.length(F.regexp_replace(seq, f"[{usual}]", ""))
    return F.when(F.length(seq) > 0, odd / F.length(seq)).otherwise(F.lit(0.0))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO))


def reduced(seq: Column) -> Column:
    """Residues mapped to the representative of their group."""
    return F.translate(seq, REDUCED_FROM, REDUCED_TO)


def codes(seq: Column) -> Column:
    """Residue numbers; residues outside the table are dropped."""
    return F.filter(F.transform(F.split(seq, ""), lambda c: F.instr(F.lit(RESIDUES), c) - 1), lambda x: x >= 0)


def residue_kind(seq: Column) -> Column:
    """dna, rna or protein by the share of nucleotide letters (0.95 and more), other for an empty row."""
    of = lambda marks: F.length(seq) - F.length(F.regexp_replace(seq, f"[{marks}]", ""))
    return (
        F.when(F.length(seq) == 0, "other").when(of(NUCLEOTIDES + "N") / F.length(seq) < 0.95, "protein")
        .when(of("U") > of("T"), "rna").otherwise("dna")
    )


def kmers(seq: Column, k: int) -> Column:
    """The k-mers of a row as substrings, in order; none if it is shorter.

    The row is split into characters once, so a long row costs its length and not its square.
    """
    chars = F.split(seq, "")
    spelled = F.transform(F.array(chars), lambda cs: F.transform(
        cs, lambda c, i: F.concat(c, *[F.get(cs, i + j) for j in range(1, k)])
    ))[0]
    return F.filter(spelled, lambda x: x.isNotNull() & (F.length(x) == k))


# Fixed value: amino acids by codon in T, C, A, G order of the three places.
CODON_RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def kmer_code(kmer: Column, k: int, base: int = 25) -> Column:
    """The number of a k-mer, least place first; null if a residue is outside the table."""
    digits = [F.instr(F.lit(RESIDUES), F.substring(kmer, i + 1, 1)) - 1 for i in range(k)]
    total = sum((d.cast("long") * base**i for i, d in enumerate(digits[1:], 1)), digits[0].cast("long"))
    return F.when(F.least(*digits) >= 0 if k > 1 else digits[0] >= 0, total)


def digits_of(number: Column, k: int, base: int = 25) -> Column:
    """The ``k`` digits of a number, least place first."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(number / F.pow(F.lit(float(base)), i)).cast("long") % base)


def one_hot(code: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == code).cast("int"))


def translated(seq: Column) -> Column:
    """Residues of a nucleotide row, three by three; X where a codon is unknown, an incomplete end is dropped."""
    place = lambda c: F.instr(F.lit("TCAG"), F.translate(c, "Uu", "TT")) - 1

    def residue(codon: Column) -> Column:
        a, b, c = (place(F.substring(codon, i, 1)) for i in (1, 2, 3))
        return F.when(F.least(a, b, c) >= 0, F.substring(F.lit(CODON_RESIDUES), a * 16 + b * 4 + c + 1, F.lit(1))).otherwise("X")

    return F.array_join(F.transform(F.regexp_extract_all(seq, F.lit("(...)"), 1), residue), "")


# Nucleotide codes and the letters they stand for.
AMBIGUOUS = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}


def motif_count(seq: Column, motif: str) -> Column:
    """How often a motif of nucleotide codes occurs in a row of A, C, G and T; occurrences don't overlap."""
    pattern = "".join(f"[{AMBIGUOUS[c]}]" for c in motif.upper())
    return F.regexp_count(seq, F.lit(pattern)).cast("long")


def is_integer(text: Column) -> Column:
    """Whether a field is a whole number: decimal with a sign, 0x and hexadecimal digits, or 0 and octal digits."""
    return text.rlike(r"^\s*[+-]?(0[xX][0-9a-fA-F]+|0[0-7]*|[1-9][0-9]*)\s*$")


def is_real(text: Column) -> Column:
    """Whether a field is a decimal number with an optional exponent."""
    return text.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$")


@functools.lru_cache(maxsize=24)
def _order_of_places(seed: int, size: int) -> np.ndarray:
    """Places 0 to ``size`` - 1 in the order of their digests; kept for each power of two."""
    return np.argsort(np.array([hashlib.md5(f"{seed}:{i}".encode()).hexdigest() for i in range(size)], "S32"), kind="stable")


def _in_order_of(seed: int, row: str) -> str:
    order = _order_of_places(seed, 1 << max(0, len(row) - 1).bit_length())
    order = order[order < len(row)]
    if row.isascii():
        return np.frombuffer(row.encode(), np.uint8)[order].tobytes().decode()
    return np.frombuffer(row.encode("utf-32-le"), "<u4")[order].tobytes().decode("utf-32-le")


def shuffled(seq: Column, seed: int = 0) -> Column:
    """The residues of a row in an order that the seed and their places fix.

    The order of a row's places is that of all places without those beyond its end, so digests are made once for a worker, not for each letter.
    """

    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else _in_order_of(seed, s) for s in rows], dtype=object, index=rows.index)

    return F.pandas_udf(run, "string")(seq)


def edit_distance(a: str, b: str) -> int:
    """The edit distance of two rows, a column of the table at a time: its rises and falls are the bits of whole numbers."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    x = np.frombuffer(a.encode("utf-32-le"), "<u4")
    at = {c: int.from_bytes(np.packbits(x == ord(c), bitorder="little").tobytes(), "little") for c in set(b)}
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        same = at[c]
        rest = same | down
        level = (((same & up) + up) ^ up) | same
        rise, fall = down | (full & ~(level | up)), up & level
        score += 1 if rise & top else -1 if fall & top else 0
        rise, fall = ((rise << 1) | 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(rest | rise)), rise & rest
    return score


def edits(a: Column, b: Column) -> Column:
    """The edit distance of two rows; null if one is."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else edit_distance(s, t) for s, t in zip(x, y, strict=True)], dtype="Int64", index=x.index)

    return F.pandas_udf(run, "long")(a, b)


def lengths_without_gaps(seq: Column) -> Column:
    return F.length(dealign(seq))


def restored(aligned: Column, original: Column) -> Column:
    """``aligned`` with its residues, in order, replaced by the letters of ``original``; null unless there are as many."""
    gaps = F.split(aligned, r"[^-._~ ]")
    letters = F.concat(F.filter(F.split(original, ""), lambda c: c != ""), F.array(F.lit("")))
    return F.when(F.size(gaps) == F.size(letters), F.array_join(F.zip_with(gaps, letters, lambda g, c: F.concat(g, c)), ""))


def residue_span(aligned: Column, first: Column, last: Column) -> Column:
    """(start, end) of the residues, counted from 1, in columns ``first`` to ``last`` (from 1); nulls where there is none."""
    before = lengths_without_gaps(F.substring(aligned, F.lit(1), first - 1))
    inside = lengths_without_gaps(F.substring(aligned, first, last - first + 1))
    return F.struct(F.when(inside > 0, before + 1).alias("start"), F.when(inside > 0, before + inside).alias("end"))
