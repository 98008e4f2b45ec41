"""From aligned reads, regions and a genome to token sequences of reads: one plan, no loop over files or regions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions import calls
from readloom.functions.kmer import call_codes, digits, kmers, sentence
from readloom.functions.modtags import modifications
from readloom.operators.overlap import contained, with_reference

CALLERS = ("bismark", "dorado")


@dataclass(frozen=True)
class Options:
    caller: str = "bismark"
    k: int = 3
    strict: bool = False
    uncalled: str = "z"
    threshold: int = calls.METHYLATED
    chunk: int = 1 << 16

    def __post_init__(self):
        if self.caller not in CALLERS:
            raise ValueError(f"a caller is one of {', '.join(CALLERS)}")
        if self.k % 2 == 0 or self.k < 1:
            raise ValueError("k must be odd and positive")


#: What may take the place of `extract`: reads, regions, genome pieces, options -> reads with dna_seq and methyl_seq.
Extractor = Callable[[DataFrame, DataFrame, DataFrame, Options], DataFrame]


def called(reads: DataFrame, options: Options = Options()) -> DataFrame:
    """Reads with `ref` -> reads with `rf`, the reference with calls as letters, and `problem`."""
    tag = lambda name: F.col("tags")[name]
    if options.caller == "bismark":
        rf, problem = calls.bismark(F.col("ref"), tag("XM"), F.col("cigar"), F.col("flag"), options.strict)
        return reads.withColumns({"rf": rf, "problem": problem})
    ml = F.transform(F.filter(F.split(tag("ML"), ","), lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("int"))
    x = reads.withColumn("mods", modifications(tag("MM"), ml, F.col("seq"), F.col("flag")))
    rf, problem = calls.dorado(F.col("ref"), F.col("seq"), F.col("cigar"), F.col("flag"), F.col("mods.h"), F.col("mods.m"), options.threshold, options.uncalled, options.strict)
    return x.withColumns({"rf": rf, "problem": problem}).drop("mods")


def tokens(reads: DataFrame, k: int = 3) -> DataFrame:
    """Reads with a call left -> dna_seq, a sentence of k-mers, and methyl_seq, a digit for each."""
    x = reads.where(calls.has_call(F.col("rf")))
    return x.withColumn("dna_seq", sentence(kmers(F.col("rf"), k))).withColumn("methyl_seq", digits(call_codes(F.col("rf"), k)))


def extract(reads: DataFrame, regions: DataFrame, genome: DataFrame, options: Options = Options()) -> DataFrame:
    """reads: as sources.sam.placed gives them. regions: (chr, start, end, ctype, dmr_id). genome: (contig, bin, seq). A read
    in several regions is there once for each. Rows that a caller rejects are dropped; `quarantine` shows them."""
    r = regions.select("chr", "start", "end", F.col("ctype").alias("dmr_ctype"), F.col("dmr_id").alias("dmr_label"))
    x = with_reference(contained(reads, r), genome, options.chunk)
    return tokens(called(x, options).where("problem is null"), options.k).drop("r_start", "r_end", "ref", "rf", "problem", "chr", "pos", "qlen")


def quarantine(reads: DataFrame, regions: DataFrame, genome: DataFrame, options: Options = Options()) -> DataFrame:
    """The reads whose calls contradict their context, with the problem."""
    r = regions.select("chr", "start", "end", F.col("ctype").alias("dmr_ctype"), F.col("dmr_id").alias("dmr_label"))
    return called(with_reference(contained(reads, r), genome, options.chunk), options).where("problem is not null")
