"""CpG calls of aligned reads written into their reference slices.

A call is one letter at a CpG's cytosine: z unmethylated, Z methylated. Rows that a caller can't use
get a null sequence; a call that contradicts its context gets an error text in a column of its own, so that one
bad row doesn't end a run (`strict` raises instead)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions.cigar import project
from readloom.functions.let import let, letters

#: Flag bits.
PAIRED, REVERSE, FIRST, DUPLICATE = 1, 16, 64, 1024
#: Fixed value: of 255, the joint probability from which a base counts as methylated.
METHYLATED = 178


def bit(flag: Column, mask: int) -> Column:
    return flag.bitwiseAND(F.lit(mask)) != 0


def letter(chars: Column, i: Column) -> Column:
    """The letter at 0-based i, or a dot outside."""
    return F.coalesce(F.when(i >= 0, F.get(chars, i)), F.lit("."))


def calls_forward(flag: Column) -> Column:
    """Whether a call stands at the C of its CpG rather than at the G: single reads forward, and in pairs the reads
    whose strand differs from being first."""
    return F.when(bit(flag, PAIRED), bit(flag, REVERSE) != bit(flag, FIRST)).otherwise(~bit(flag, REVERSE))


def write_letters(ref: Column, tag: Column, pick) -> Column:
    """The reference with `pick(tag's letters, i)` at each 0-based i where CG begins."""

    def written(r: Column, t: Column) -> Column:
        at_cpg = lambda i: (F.get(r, i) == "C") & (letter(r, i + 1) == "G")
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: F.when(at_cpg(i), pick(t, i)).otherwise(F.get(r, i))), "")

    return F.when(F.length(ref) > 0, let(letters(ref), lambda r: let(letters(tag), lambda t: written(r, t)))).otherwise(ref)


def has_call(seq: Column) -> Column:
    return seq.rlike("[zZ]")


def bismark(ref: Column, xm: Column, cigar: Column, flag: Column, strict: bool = False) -> tuple[Column, Column]:
    """(sequence, error) of a read with a call string in an XM tag. The sequence is null for duplicates, reads without
    the tag or without a CpG call, and slices without a CG."""

    def pick(t: Column, i: Column) -> Column:
        here, after = letter(t, i), letter(t, i + 1)
        x = F.when(calls_forward(flag), here).otherwise(after)
        x = F.when(i >= F.size(t), ".").otherwise(x)
        gap = (here == "D") | (after == "D")
        return F.when(x.isin(".", "D"), "C").when(x.isin("x", "h", "X", "H"), F.when(gap, "C").otherwise("!")).otherwise(x)

    usable = ~bit(flag, DUPLICATE) & xm.isNotNull() & has_call(xm) & ref.contains("CG")
    seq = write_letters(ref, project(xm, cigar), pick)
    wrong = F.coalesce(usable & seq.contains("!"), F.lit(False))
    if strict:
        seq = F.when(wrong, F.raise_error(F.lit("a call of another context stands at a CpG"))).otherwise(seq)
    return F.when(usable & ~wrong, seq), F.when(wrong, F.lit("a call of another context stands at a CpG"))


def same_positions(a: Column, b: Column) -> Column:
    """Whether two arrays of (pos, prob) hold the same positions in order."""
    return (F.size(a) == F.size(b)) & (F.transform(a, lambda x: x["pos"]) == F.transform(b, lambda x: x["pos"]))


def dorado(ref: Column, seq: Column, cigar: Column, flag: Column, mod_h: Column, mod_m: Column, threshold: int = METHYLATED, uncalled: str = "z", strict: bool = False) -> tuple[Column, Column]:
    """(sequence, error) of a read with modification lists: arrays of (pos, prob) of 5hmC and 5mC, positions in the
    read as aligned. A list that is missing counts as zeros at the other's positions; both missing, hard clips, no sequence or
    a slice without a CG give null. A CpG without a call is `uncalled`: z, as unmethylated, or skip, as C."""
    zeros = lambda of: F.transform(of, lambda x: F.struct(x["pos"].alias("pos"), F.lit(0).alias("prob")))
    none = lambda c: c.isNull() | (F.size(c) == 0)
    h, m = F.when(none(mod_h), zeros(mod_m)).otherwise(mod_h), F.when(none(mod_m), zeros(mod_h)).otherwise(mod_m)
    total = F.zip_with(h, m, lambda a, b: F.struct((a["pos"] - F.when(bit(flag, REVERSE), 1).otherwise(0)).alias("pos"), F.when(a["prob"] + b["prob"] >= threshold, "Z").otherwise("z").alias("call")))
    n = F.length(seq) - 1
    placed = F.transform(F.filter(total, lambda x: (x["pos"] >= 0) & (x["pos"] < n)), lambda x: F.struct(x["pos"].cast("int").alias("pos"), F.lit(0).alias("after"), x["call"].alias("call")))
    unknown = F.lit("z" if uncalled == "z" else ".")

    def rest(r: Column) -> Column:
        """What stands where there is no call, for every place."""
        at_cpg = lambda i: (letter(r, i) == "C") & (letter(r, i + 1) == "G")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("pos"), F.lit(1).alias("after"), F.when(at_cpg(i), unknown).otherwise(".").alias("call")))

    def vector(all_: Column) -> Column:
        """The first of each place in order, which is a call if there is one: a sort, as looking places up in a map takes a search for each."""
        first = F.filter(all_, lambda x, k: (k == 0) | (F.get(all_, F.greatest(k - 1, F.lit(0)))["pos"] != x["pos"]))
        return F.array_join(F.transform(first, lambda x: x["call"]), "")

    tag = project(F.when(n > 0, let(letters(ref), lambda r: let(F.array_sort(F.concat(placed, rest(r))), vector))).otherwise(""), cigar)

    def pick(t: Column, i: Column) -> Column:
        x = letter(t, i)
        return F.when(x.isin("z", "Z"), x).otherwise("C")

    usable = seq.isNotNull() & (seq != "*") & ~F.coalesce(cigar, F.lit("")).contains("H") & ref.contains("CG") & ~(none(mod_h) & none(mod_m))
    wrong = F.coalesce(usable & ~same_positions(h, m), F.lit(False))
    out = write_letters(ref, tag, pick)
    if strict:
        out = F.when(wrong, F.raise_error(F.lit("the two modification lists differ in positions"))).otherwise(out)
    return F.when(usable & ~wrong, out), F.when(wrong, F.lit("the two modification lists differ in positions"))
