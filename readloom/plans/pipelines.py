"""The three verbs: preprocess to read datasets, train a read classifier, estimate a sample's shares."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.kmer import n_called
from readloom.operators.corpus import windows
from readloom.operators.labels import attach_ctype, n_regions
from readloom.operators.regions import harmonise_contigs, prefixed, select_contigs, top_regions
from readloom.operators.split import Ratio, shuffled, split, split_mode
from readloom.plans.extract import Extractor, Options, extract
from readloom.plans.purity import deconvolve
from readloom.plans.scorer import LinearScorer, Scorer, Steps, evaluate, load_scorer, train_steps
from readloom.sources import sam as alignments
from readloom.sources import tables
from readloom.sources.fasta import contig_lines, genome_chunks, ordered_lines

#: The files of a split.
NAMES = {"train": "train_seq.csv", "test": "test_seq.csv", "val": "val_seq.csv"}


def same_file(uri: str) -> str:
    """A URI with one slash after its scheme, which is written with one or more."""
    return re.sub("^([a-z0-9]+):/+", r"\1:/", uri)


def load_reads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Reads of BAM and SAM files, by their names' ends."""
    bams, sams = [p for p in paths if p.endswith(".bam")], [p for p in paths if not p.endswith(".bam")]
    frames = [f(spark, p) for f, p in ((alignments.bam, bams), (alignments.sam, sams)) if p]
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def preprocess(spark: SparkSession, f_dmr: str, f_ref: str, output_path: str, input_file: str | None = None, sc_dataset: str | None = None, split_ratio: Ratio = 0.8, n_dmrs: int | None = None, n_mers: int = 3, methyl_caller: str = "bismark", ignore_sex_chromo: bool = True, use_file_name: bool = False, seed: int = 950410, extractor: Extractor = extract) -> DataFrame:
    """Writes dmrs.csv and train_seq.csv, test_seq.csv and val_seq.csv, or data.csv without a split, and gives the reads. One of
    input_file and sc_dataset, a list of files with classes, is needed. use_file_name keeps a file's reads in one part."""
    if (input_file is None) == (sc_dataset is None):
        raise ValueError("exactly one of an input file and a list of files is needed")
    options, shares = Options(methyl_caller, n_mers), split_mode(split_ratio)
    files = tables.one_file(spark, input_file) if input_file else tables.manifest(spark, sc_dataset)
    regions = tables.regions(spark, f_dmr)
    style = prefixed(regions)
    regions = top_regions(select_contigs(regions, style, ignore_sex_chromo), n_dmrs)
    if regions.isEmpty():
        raise ValueError("no region is left")
    tables.write_tsv(regions, f"{output_path}/dmrs.csv", single=True)
    genome = harmonise_contigs(genome_chunks(contig_lines(spark, f_ref)), style)
    listed = files.collect()  # a row for each input file
    reads = alignments.placed(load_reads(spark, [r["path"] for r in listed]))
    # Files are told apart by their whole paths, as names may repeat in different folders.
    of_file = spark.createDataFrame([(same_file(tables.file_uri(r["path"])), r["ctype"]) for r in listed], "path string, ctype string").dropDuplicates(["path"])
    reads = attach_ctype(reads.withColumn("path", F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/")), of_file)
    reads = reads.withColumn("filename", F.regexp_extract("path", r"[^/]+$", 0))
    out = extractor(reads, regions, genome, options)
    if out.isEmpty():
        warnings.warn("no read with a call lies in a region", stacklevel=2)
    if shares == (1.0, 0.0, 0.0):
        out = out.drop("path")
        tables.write_reads(shuffled(out, "name", seed), f"{output_path}/data.csv")
        return out
    parts = split(out, "path" if use_file_name else "name", split_ratio, seed).drop("path")
    for p, share in zip(NAMES, shares):
        if share:
            tables.write_reads(shuffled(parts.where(F.col("part") == p).drop("part"), "name", seed), f"{output_path}/{NAMES[p]}")
    return parts


def finetune(spark: SparkSession, train_dataset: str, output_path: str, test_dataset: str | None = None, iterations: int = 50, **parameters) -> Scorer | LinearScorer:
    """Trains and saves a classifier, with train.csv, eval.csv if there is a test set, and train_param.txt. With `steps` among the
    parameters (those of scorer.Steps) it is trained by steps: train.csv has loss, accuracy and rate of each, the model that was best on
    the test set is saved, and those of every `save_freq` steps beside it; else by quasi-Newton iterations, whose loss train.csv has."""
    train = tables.reads(spark, train_dataset)
    test = tables.reads(spark, test_dataset) if test_dataset else None
    used = {"iterations": iterations}
    if "steps" in parameters:
        how = Steps(**parameters)
        scorer, log, evaluations = train_steps(train, test, how, lambda step, s: s.save(f"{output_path}/read_model_step{step}"))
        log, used = spark.createDataFrame(log, "step int, loss double, ctype_acc double, lr double"), vars(how)
        evaluations = spark.createDataFrame(evaluations, "step int, loss double, ctype_acc double")
    else:
        if parameters:
            raise ValueError(f"without steps there are no parameters {', '.join(parameters)}")
        scorer = Scorer.fit(train, iterations=iterations)
        trace = [(s, float(loss)) for s, loss in scorer.trace()]
        log = spark.createDataFrame(trace, "step int, loss double")
        evaluations = evaluate(scorer.transform(test)).select(F.lit(len(trace)).alias("step"), "loss", "ctype_acc") if test else None
    scorer.save(f"{output_path}/read_model")
    tables.write_tsv(log, f"{output_path}/train.csv", single=True)
    if test:
        tables.write_tsv(evaluations, f"{output_path}/eval.csv", single=True)
    regions = n_regions(train).first()["n_dmrs"]
    tables.write_parameters({"train_dataset": train_dataset, "test_dataset": test_dataset, "n_dmrs": regions} | used, f"{output_path}/train_param.txt")
    return scorer


def classify(reads: DataFrame, scorer) -> DataFrame:
    """All input columns with pred, n_cpg, P_ctype and P_N."""
    return scorer.transform(reads.drop("ctype_label")).withColumn("n_cpg", n_called(F.col("methyl_seq")))


def deconvolute(spark: SparkSession, model_dir: str, input_data: str, output_path: str, n_grid: int = 10_000, adjustment: bool = False, train_dataset: str | None = None, scorer=None) -> DataFrame:
    """Scores a bulk dataset and writes res.csv, deconvolution.csv and FI.csv. The training reads are those of train_param.txt
    unless given."""
    if train_dataset is None:
        parameters = tables.read_parameters(f"{model_dir}/train_param.txt")
        train_dataset = parameters["train_dataset"]
    scorer = scorer or load_scorer(f"{model_dir}/read_model")
    scored = classify(tables.reads(spark, input_data), scorer).persist()
    tables.write_tsv(scored.drop("P_N"), f"{output_path}/res.csv")
    shares, details = deconvolve(scored, tables.reads(spark, train_dataset), n_grid, adjustment)
    tables.write_tsv(shares, f"{output_path}/deconvolution.csv", single=True)
    if details is not None:
        tables.write_tsv(details, f"{output_path}/FI.csv", single=True)
    scored.unpersist()
    return shares


def corpus(spark: SparkSession, f_ref: str, output_path: str, seq_len: int = 510, k: int = 3, compatible: bool = False) -> DataFrame:
    """Writes a pretraining corpus of a genome, a sentence in each line."""
    out = windows(ordered_lines(spark, f_ref), seq_len, k, compatible, "file", "block")
    tables.write_sentences(out, output_path)
    return out
