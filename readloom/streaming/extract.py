"""Extraction and counts over streams of aligned reads.

Containment and calls are row by row, so a stream of reads joins static regions and a static genome in append
mode; the genome's pieces are made as long as the regions ask for. Sums of the likelihood on a fixed grid are a running aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators.overlap import inside, reaching
from readloom.plans.extract import Options, called, tokens
from readloom.plans.likelihood import ln, mixed


def extract_stream(reads: DataFrame, regions: DataFrame, genome: DataFrame, options: Options = Options()) -> DataFrame:
    """A stream of reads with `chr, pos, qlen` -> a stream of reads with dna_seq and methyl_seq."""
    r = regions.select(F.col("chr").alias("r_chr"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("ctype").alias("dmr_ctype"), F.col("dmr_id").alias("dmr_label"))
    x = reads.join(r, (F.col("chr") == F.col("r_chr")) & inside(F.col("pos"), F.col("qlen"), F.col("r_start"), F.col("r_end")))
    g = reaching(genome, regions, options.chunk).withColumnsRenamed({"contig": "c_contig", "bin": "c_bin", "seq": "c_seq"})
    x = x.join(g, (F.col("chr") == F.col("c_contig")) & (F.floor(F.col("pos") / options.chunk) == F.col("c_bin")))
    x = x.withColumn("ref", F.substr(F.col("c_seq"), (F.col("pos") - F.col("c_bin") * options.chunk + 1).cast("int"), F.col("qlen").cast("int")))
    return tokens(called(x, options).where("problem is null"), options.k)


def likelihood_stream(reads: DataFrame, m_n: float, m_t: float, n_grid: int = 100) -> DataFrame:
    """(dmr_label, i, ll) of all scored reads so far, for complete or update mode."""
    x = reads.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))))
    return x.groupBy("dmr_label", "i").agg(F.sum(ln(mixed(F.col("i") / float(n_grid), m_n, m_t))).alias("ll"))
