"""Masked-token examples for pretraining, with hashed randomness that every rerun and engine repeats.

A uniform number comes from the MD5 of seed, row, stream and place, so it depends on nothing else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions.let import let
from readloom.functions.vocab import EOS, MASK, PAD, SOS, SPECIALS

IGNORED = -100


def uniform(row: Column, place: Column, stream: str, seed: int) -> Column:
    """A number from 0 to 1 for a row and place."""
    text = F.concat_ws("|", F.lit(str(seed)), row.cast("string"), F.lit(stream), place.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def neighbours(k: int) -> list[int]:
    """Offsets at which tokens overlap a token's middle: up to half of k to both sides, for an even k one fewer to the right."""
    out = [d for j in range(1, k // 2 + 1) for d in (-j, j)]
    return out if k % 2 else out[:-1]


def truncated(ids: Column, row: Column, n: int, seed: int, least: int = 5) -> Column:
    """Every second row cut to a random length from `least` to n."""
    cut = F.floor(uniform(row, F.lit(0), "length", seed) * (n - least + 1)).cast("int") + least
    return F.when(uniform(row, F.lit(0), "truncate", seed) < 0.5, F.slice(ids, F.lit(1), cut)).otherwise(ids)


def masked(ids: Column, row: Column, vocabulary: int, k: int = 3, rate: float = 0.15, seed: int = 0) -> Column:
    """struct<input, label, mask>, each one longer than ids. Ordinary tokens are chosen at a rate; they and their neighbours
    inside the text are labelled, and become the mask (80 %), a random token (10 %) or stay. The last real token becomes the
    end, and a start goes before. mask marks the chosen ones alone."""
    head = lambda v: F.array(F.lit(v))

    def example(t: Column, places: Column, real: Column, chosen: Column, covered: Column) -> Column:
        at, on = (lambda i: F.get(t, i)), (lambda i: F.get(covered, i))

        def token(i: Column) -> Column:
            u = uniform(row, i, "replace", seed)
            random = F.floor(uniform(row, i, "token", seed) * vocabulary).cast("int")
            return F.when(i == real - 1, EOS).when(~on(i), at(i)).when(u < 0.8, MASK).when(u < 0.9, random).otherwise(at(i))

        return F.struct(
            F.concat(head(SOS), F.transform(places, token)).alias("input"),
            F.concat(head(IGNORED), F.transform(places, lambda i: F.when(on(i), at(i)).otherwise(IGNORED))).alias("label"),
            F.concat(head(False), chosen).alias("mask"),
        )

    def near(chosen: Column, real: Column, i: Column) -> Column:
        out = F.get(chosen, i)
        for d in neighbours(k):
            out = out | F.when((i + d >= 0) & (i + d < real), F.get(chosen, i + d)).otherwise(False)
        return out & (i < real)

    def bound(t: Column) -> Column:
        n, real = F.size(t), F.size(F.filter(t, lambda x: x != PAD))
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        chosen = F.transform(places, lambda i: (F.get(t, i) >= len(SPECIALS)) & (uniform(row, i, "choose", seed) < rate))
        return let(real, lambda r: let(chosen, lambda c: let(F.transform(places, lambda i: near(c, r, i)), lambda v: example(t, places, r, c, v))))

    return let(ids, bound)
