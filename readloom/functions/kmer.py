"""Overlapping k-mers of sequences whose CpG calls are written as letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions.let import let, letters

#: The letters of calls, all of which stand for a cytosine, and the bar treated alike.
CALL_LETTERS = "hHzZxX|"


def check_k(k: int) -> None:
    if k < 1 or k % 2 == 0:
        raise ValueError("k must be odd and positive")


def places(chars: Column, k: int) -> Column:
    """0-based starts of the k-mers: as many as the letters less k, so the last possible one is left out."""
    n = F.size(chars) - k
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def plain_kmers(seq: Column, k: int = 3) -> Column:
    """Array of k-mers of a sequence as it is."""
    return let(letters(seq), lambda c: F.transform(places(c, k), lambda i: F.concat(*(F.get(c, i + j) for j in range(k)))))


def kmers(seq: Column, k: int = 3) -> Column:
    """Array of k-mers with every call letter as C."""
    check_k(k)
    return plain_kmers(F.translate(seq, CALL_LETTERS, "C" * len(CALL_LETTERS)), k)


def call_codes(seq: Column, k: int = 3) -> Column:
    """Array of one code for each k-mer, by its middle letter: z 0, Z 1, any other 2."""
    check_k(k)

    def codes(c: Column) -> Column:
        middle = lambda i: F.get(c, i + k // 2)
        return F.transform(places(c, k), lambda i: F.when(middle(i) == "z", 0).when(middle(i) == "Z", 1).otherwise(2).cast("tinyint"))

    return let(letters(seq), codes)


def sentence(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def digits(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: c.cast("string")), "")


def digits_to_codes(text: Column) -> Column:
    """The codes of a digit string; an empty string has none."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.cast("tinyint"))


def n_called(text: Column) -> Column:
    """How many codes of a digit string are a call, 0 or 1."""
    return F.length(F.regexp_replace(text, "[^01]", ""))
