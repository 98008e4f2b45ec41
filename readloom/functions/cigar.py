"""CIGAR strings, and projection of strings in read space onto the reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions.let import let

STEP = r"(\d+)(\D)"


def operations(cigar: Column) -> Column:
    """Array of operation letters."""
    return F.regexp_extract_all(cigar, F.lit(STEP), F.lit(2))


def lengths(cigar: Column) -> Column:
    """Array of operation lengths."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(STEP), F.lit(1)), lambda n: n.cast("int"))


def aligned_bases(cigar: Column) -> Column:
    """Aligned bases of the read: of matches, mismatches and insertions, not of deletions and clips."""
    both = F.arrays_zip(lengths(cigar).alias("n"), operations(cigar).alias("op"))
    return F.aggregate(both, F.lit(0), lambda a, x: a + F.when(x["op"].isin("M", "I", "=", "X"), x["n"]).otherwise(0))


def project(tag: Column, cigar: Column) -> Column:
    """A string with a letter for each base of the read, laid out along the reference. A deletion writes D's and
    reads nothing; a soft clip or insertion is read and not written; every other operation is read and written."""
    return let(tag, lambda t: laid_out(t, cigar))


def laid_out(tag: Column, cigar: Column) -> Column:
    both = F.arrays_zip(lengths(cigar).alias("n"), operations(cigar).alias("op"))
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        deleted, hidden = x["op"] == "D", x["op"].isin("S", "I")
        piece = F.when(deleted, F.repeat(F.lit("D"), x["n"])).when(hidden, "").otherwise(F.substr(tag, a["at"], x["n"]))
        return F.struct((a["at"] + F.when(deleted, 0).otherwise(x["n"])).alias("at"), F.concat(a["out"], piece).alias("out"))

    return F.aggregate(both, start, step, lambda a: a["out"])
