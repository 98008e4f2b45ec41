"""Classes of reads: attachment, counts, margins and derived labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of a read dataset.
MANDATORY = ("dna_seq", "methyl_seq", "ctype", "dmr_ctype", "dmr_label")
UNKNOWN = "NA"


def check_columns(df: DataFrame, columns: tuple[str, ...] = MANDATORY) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def attach_ctype(reads: DataFrame, manifest: DataFrame, path: str = "path") -> DataFrame:
    """Reads with the class of their file; files without a class are unknown. A manifest has a row for each file."""
    m = manifest.select(F.col("path").alias("m_path"), F.col("ctype").alias("m_ctype"))
    return reads.join(m, F.col(path) == F.col("m_path"), "left").withColumn("ctype", F.coalesce("m_ctype", F.lit(UNKNOWN))).drop("m_path", "m_ctype")


def is_region_class() -> Column:
    """1 where a read's class is its region's, 0 otherwise, missing classes included."""
    return F.coalesce((F.col("ctype") == F.col("dmr_ctype")).cast("int"), F.lit(0))


def class_of_names(reads: DataFrame, key: str = "name", order: str = "load_order") -> DataFrame:
    """(key, ctype): the class of the last row of each key."""
    return reads.groupBy(key).agg(F.max_by("ctype", F.struct(F.col(order), F.col("ctype"))).alias("ctype"))


def class_counts(reads: DataFrame, column: str = "ctype") -> DataFrame:
    return reads.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def margins(reads: DataFrame, column: str = "ctype") -> DataFrame:
    """(ctype, margin): shares of the known classes, largest first."""
    n = reads.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("ctype")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("ctype", (F.col("n") / F.col("total")).alias("margin"), "n").orderBy(F.desc("n"), "ctype").drop("n")  # total is one row


def n_regions(reads: DataFrame, column: str = "dmr_label") -> DataFrame:
    """One row, n_dmrs: distinct labels, or the largest plus one, whichever is more."""
    return reads.agg(F.greatest(F.count_distinct(column), F.coalesce(F.max(column) + 1, F.lit(0))).cast("long").alias("n_dmrs"))


def accuracy(df: DataFrame, prediction: str = "pred", label: str = "label") -> DataFrame:
    return df.agg(F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"))


def batch_mean(df: DataFrame, value: str, batch: str) -> DataFrame:
    """The mean of batch means, as loaders of unequal last batches give it."""
    return df.groupBy(batch).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean"))
