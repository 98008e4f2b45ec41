"""Fixed-length model inputs from token ids and call codes, and back to sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions.let import let
from readloom.functions.vocab import EOS, PAD, SOS

NO_CALL = 2


def fit(values: Column, n: int, pad: int) -> Column:
    """The first n values, filled up to n with pads."""
    kept = F.slice(values, 1, n)
    return F.concat(kept, F.array_repeat(F.lit(pad), n - F.size(kept)))


def framed(values: Column, n: int, end: int, start: int, pad: int) -> Column:
    """n + 1 values: the start, the values with an end after them (over the last if n or more), and pads."""

    def one(v: Column) -> Column:
        full = F.concat(F.slice(v, 1, n - 1), F.array(F.lit(end)))
        short = F.concat(v, F.array(F.lit(end)), F.array_repeat(F.lit(pad), F.greatest(n - F.size(v) - 1, F.lit(0))))
        return F.concat(F.array(F.lit(start)), F.when(F.size(v) < n, short).otherwise(full))

    return let(values, one)


def frame_ids(ids: Column, n: int = 150) -> Column:
    return framed(ids, n, EOS, SOS, PAD)


def frame_codes(codes: Column, n: int = 150) -> Column:
    """Codes framed alike: start, end and pads are no call."""
    return framed(F.transform(codes, lambda c: c.cast("int")), n, NO_CALL, NO_CALL, NO_CALL)


def sequence_of(tokens: Column) -> Column:
    """The sequence that 3-mers spell: the first letter of the first, the middle of each, the last of the last;
    special tokens are left out."""

    def spelled(t: Column) -> Column:
        middle = F.array_join(F.transform(t, lambda x: F.substring(x, 2, 1)), "")
        first, last = F.get(t, F.lit(0)), F.get(t, F.size(t) - 1)
        return F.when(F.size(t) > 0, F.concat(F.substring(first, 1, 1), middle, F.substring(last, -1, 1))).otherwise("")

    return let(F.filter(tokens, lambda x: ~x.contains("<")), spelled)
