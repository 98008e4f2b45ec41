"""Ids of k-mer tokens: five special tokens, then all k-mers of A, C, G and T in alphabetical order."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Special tokens in the order of their ids.
SPECIALS = ("<pad>", "<unk>", "<eos>", "<sos>", "<mask>")
PAD, UNK, EOS, SOS, MASK = range(5)
BASES = "ACGT"


def size(k: int = 3) -> int:
    return len(SPECIALS) + len(BASES) ** k


def token_list(k: int = 3) -> list[str]:
    return [*SPECIALS, *map("".join, product(BASES, repeat=k))]


def token_id(token: Column, k: int = 3) -> Column:
    """The id of a token by base-4 arithmetic; what isn't a k-mer of bases or a special token is unknown."""
    places = [F.instr(F.lit(BASES), F.substring(token, j + 1, 1)) for j in range(k)]
    number = sum(((p - 1) * len(BASES) ** (k - 1 - j) for j, p in enumerate(places)), F.lit(len(SPECIALS)))
    out = F.when((F.length(token) == k) & (F.least(*places, F.lit(1)) > 0), number)
    for i, s in enumerate(SPECIALS):
        out = out.when(token == s, i)
    return out.otherwise(UNK).cast("int")


def to_ids(tokens: Column, k: int = 3) -> Column:
    return F.transform(tokens, lambda t: token_id(t, k))


def sentence_to_ids(text: Column, k: int = 3) -> Column:
    """Ids of a space-joined sentence; an empty one has none."""
    return to_ids(F.filter(F.split(text, " "), lambda t: t != ""), k)


def to_tokens(ids: Column, k: int = 3, drop_pads: bool = False) -> Column:
    """Tokens of ids; an id out of range is written in angle brackets."""
    names = F.array(*map(F.lit, token_list(k)))
    kept = F.filter(ids, lambda i: i != PAD) if drop_pads else ids
    return F.transform(kept, lambda i: F.when((i >= 0) & (i < size(k)), F.get(names, i)).otherwise(F.concat(F.lit("<"), i.cast("string"), F.lit(">"))))


def to_sentence(ids: Column, k: int = 3, drop_pads: bool = False) -> Column:
    return F.array_join(to_tokens(ids, k, drop_pads), " ")
