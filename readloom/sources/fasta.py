"""FASTA files as pieces of contigs, without ever holding a contig in one cell.

Spark splits a text file into blocks. Lines are numbered within their block, blocks carry over which contig they begin in and
how many of its bases came before; a genome's blocks are read side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ordered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, line_no, line): lines in file order by (block, line_no)."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), F.trim("value").alias("line"))


def contig_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(contig, start, seq): a row for each line of bases, upper case, with its place in its contig. A contig's name is the
    header up to the first white space; bases before any header are dropped."""
    x = ordered_lines(spark, path).withColumn("header", F.col("line").startswith(">"))
    x = x.withColumn("n", F.when(F.col("header"), 0).otherwise(F.length("line")).cast("long"))
    x = x.withColumn("name", F.when(F.col("header"), F.get(F.split(F.substring("line", 2, 1 << 30), r"\s+"), F.lit(0))))
    by = Window.partitionBy("file", "block").orderBy("line_no")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("nth", F.sum(F.col("header").cast("int")).over(upto)).withColumn("own", F.last("name", ignorenulls=True).over(upto))
    inside = Window.partitionBy("file", "block", "nth").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("start", F.sum("n").over(inside) - F.col("n"))
    # One row for each block: its last header, and the bases after it (all, if it has none).
    last = x.groupBy("file", "block").agg(F.max_by("own", "line_no").alias("last"), F.max("nth").alias("headers"), F.max_by(F.col("start") + F.col("n"), "line_no").alias("tail"))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("group", F.sum((F.col("headers") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = last.withColumn("carried", F.last("last", ignorenulls=True).over(before)).withColumn("running", F.sum("tail").over(Window.partitionBy("file", "group").orderBy("block")))
    last = last.withColumn("offset", F.coalesce(F.lag("running").over(order), F.lit(0)))
    x = x.join(last.select("file", "block", "carried", "offset"), ["file", "block"]).where(~F.col("header") & (F.col("n") > 0))
    first = F.col("nth") == 0
    out = x.select(F.when(first, F.col("carried")).otherwise(F.col("own")).alias("contig"), (F.col("start") + F.when(first, F.col("offset")).otherwise(0)).alias("start"), F.upper("line").alias("seq"))
    return out.where("contig is not null")


def genome_chunks(lines: DataFrame, size: int = 1 << 16, overlap: int = 1 << 12) -> DataFrame:
    """(contig, bin, seq): pieces of `size` bases with `overlap` bases of the next one. No piece is longer than both."""
    end = F.col("start") + F.length("seq")
    first = F.greatest(F.floor((F.col("start") - overlap) / size), F.lit(0))
    x = lines.withColumn("bin", F.explode(F.sequence(first, F.floor((end - 1) / size))))
    low, high = F.col("bin") * size, F.col("bin") * size + size + overlap
    a, b = F.greatest(low, F.col("start")), F.least(high, end)
    x = x.where(a < b).withColumn("piece", F.substr(F.col("seq"), (a - F.col("start") + 1).cast("int"), (b - a).cast("int")))
    pieces = F.array_sort(F.collect_list(F.struct("start", "piece")))
    return x.groupBy("contig", "bin").agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("seq"))
