"""Modification tags: delta-coded base modifications (MM) and their probabilities (ML).

An entry such as `C+hm,0,3` names a base, a strand, one or more modification codes, and how many bases of
that kind are passed over before each modified one, along the sequence as it was read. ML has one
byte for each modified base and code, in the order of the entries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRY = re.compile(r"([ACGTUN])([+-])([a-z]+|\d+)[.?]?((?:,\d+)*)$")
COMPLEMENT = str.maketrans("ACGTN", "TGCAN")
SCHEMA = "struct<h: array<struct<pos: int, prob: int>>, m: array<struct<pos: int, prob: int>>>"


def decode_one(mm: str | None, ml: list[int] | None, seq: str | None, reverse: bool) -> dict[str, list[dict[str, int]] | None]:
    """(pos, prob) lists of cytosine modifications h and m, positions in the sequence as aligned, ascending; None
    where there is no entry. An entry that can't be read is passed over with its probabilities unread."""
    out: dict[str, list[dict[str, int]] | None] = {"h": None, "m": None}
    if not mm or not seq:
        return out
    read = seq.upper().translate(COMPLEMENT)[::-1] if reverse else seq.upper()
    used, probabilities, of_base = 0, ml or [], {}
    for entry in filter(None, mm.split(";")):
        if not (e := ENTRY.match(entry)):
            continue
        base, strand, codes, deltas = e.groups()
        codes = [codes] if codes.isdigit() else list(codes)
        skip = [int(d) for d in deltas.split(",")[1:]]
        if base not in of_base:
            of_base[base] = [i for i, b in enumerate(read) if base == "N" or b == ("T" if base == "U" else base)]
        places = of_base[base]
        at, found = -1, []
        for d in skip:
            at += d + 1
            if at >= len(places):
                break
            found.append(len(read) - 1 - places[at] if reverse else places[at])
        values = probabilities[used : used + len(skip) * len(codes)]
        used += len(skip) * len(codes)
        for k, code in enumerate(codes):
            if base == "C" and strand == "+" and code in out:
                mine = [{"pos": p, "prob": int(v)} for p, v in zip(found, values[k :: len(codes)])]
                out[code] = sorted((out[code] or []) + mine, key=lambda x: x["pos"])
    return out


def decode_batch(mm: pd.Series, ml: pd.Series, seq: pd.Series, reverse: pd.Series) -> pd.DataFrame:
    rows = [decode_one(*x) for x in zip(mm, (None if v is None else list(v) for v in ml), seq, reverse)]
    return pd.DataFrame(rows, columns=["h", "m"], dtype=object)


def modifications(mm: Column, ml: Column, seq: Column, flag: Column) -> Column:
    """struct<h, m> of the two lists. ml: array<int>. An Arrow function, since deltas count along the read."""
    return F.pandas_udf(decode_batch, SCHEMA)(mm, ml, seq, flag.bitwiseAND(F.lit(16)) != 0)
