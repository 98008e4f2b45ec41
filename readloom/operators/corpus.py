"""Pretraining corpora: fixed-length windows of contigs as sentences of k-mers.

Lines come with their file's order. Headers and lines with an N empty the buffer; a buffer of at least the length gives one
window for each line read, at most. If c is the running length of a run of lines and j a line's number in it, the windows
given up to line i are i + min(0, min over j up to i of (floor(c_j / length) - j))."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.kmer import plain_kmers, sentence

#: The contigs of a pretraining corpus, upper case; the compatible set has 0 and lacks 22.
CONTIGS = [*(f"CHR{i}" for i in range(1, 23)), "CHRX", "CHRY"]
COMPATIBLE = [*(f"CHR{i}" for i in range(22)), "CHRX", "CHRY"]


def windows(lines: DataFrame, length: int = 510, k: int = 3, compatible: bool = False, file: str | None = None, block: str | None = None) -> DataFrame:
    """(run, chunk, sentence) from lines (line_no, line[, file][, block]). compatible: header lines with an N are gaps, so the
    contig before them goes on; contigs are 0 to 21. A blank line ends the scan. Files are independent and spread over tasks; with
    `block`, whose lines are numbered within it, so are a file's blocks: what the lines before a block leave, the contig, the number
    of runs, and a run's length, lines and least term, is worked out from a row for each block and run and joined."""
    parts, inner = [file] if file else [], [c for c in (file, block) if c]
    order = ["line_no"]

    def upto(*more: str):
        return Window.partitionBy(*inner, *more).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def carried(x: DataFrame, by: list[str], totals: dict, before: dict) -> DataFrame:
        """x with columns that follow from the totals of the blocks before, a row for each block and `by`."""
        earlier = Window.partitionBy(*parts, *by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        t = x.groupBy(*inner, *by).agg(*(v.alias(f"_{n}") for n, v in totals.items()))
        t = t.select(*inner, *by, *(f(F.col(f"_{n}")).over(earlier).alias(name) for name, (n, f) in before.items()))
        return x.join(t, [*inner, *by])

    x = lines.withColumn("line", F.upper(F.trim("line"))).withColumn("blank", F.sum((F.col("line") == "").cast("int")).over(upto()))
    if block:
        # Blocks after the one with a blank line have nothing; the lines after it are left out of all totals below.
        x = carried(x, [], {"blank": F.max("blank")}, {"ended": ("blank", F.max)}).where(F.coalesce("ended", F.lit(0)) == 0).drop("ended")
    x = x.where("blank = 0")
    header = F.col("line").startswith(">")
    gap = F.col("line").contains("N") if compatible else F.col("line").contains("N") & ~header
    contig = F.get(F.split(F.substring("line", 2, 1 << 30), r"\s+"), F.lit(0))
    x = x.withColumn("gap", gap).withColumn("header", header & ~gap)
    x = x.withColumn("here", F.when(F.col("header"), contig.isin(COMPATIBLE if compatible else CONTIGS)))
    x = x.withColumn("on", F.last("here", ignorenulls=True).over(upto())).withColumn("run", F.sum((F.col("gap") | F.col("header")).cast("int")).over(upto()))
    if block:
        last = {"on": F.max_by("on", "line_no"), "run": F.max("run")}
        x = carried(x, [], last, {"was_on": ("on", lambda c: F.last(c, ignorenulls=True)), "runs": ("run", F.sum)})
        x = x.withColumn("on", F.coalesce("on", "was_on")).withColumn("run", F.col("run") + F.coalesce("runs", F.lit(0)))
    x = x.where(F.coalesce("on", F.lit(False)) & ~F.col("gap") & ~F.col("header"))
    x = x.withColumn("c", F.sum(F.length("line")).over(upto("run"))).withColumn("j", F.count("*").over(upto("run")))
    if block:
        x = carried(x, ["run"], {"c": F.max("c"), "j": F.max("j")}, {"c_before": ("c", F.sum), "j_before": ("j", F.sum)})
        x = x.withColumn("c", F.col("c") + F.coalesce("c_before", F.lit(0))).withColumn("j", F.col("j") + F.coalesce("j_before", F.lit(0)))
    x = x.withColumn("m", F.least(F.lit(0), F.min(F.floor(F.col("c") / length) - F.col("j")).over(upto("run"))))
    if block:
        x = carried(x, ["run"], {"m": F.min("m")}, {"m_before": ("m", F.min)}).withColumn("m", F.least("m", F.coalesce("m_before", F.lit(0))))
    # A window is spelled by the lines that overlap it, so no run is ever one string.
    ends = x.groupBy(*parts, "run").agg(F.max(F.col("j") + F.col("m")).alias("n_windows"))
    first = F.floor((F.col("c") - F.length("line")) / length)
    pieces = x.join(ends, [*parts, "run"]).where(F.length("line") > 0)
    pieces = pieces.withColumn("chunk", F.explode(F.sequence(first, F.floor((F.col("c") - 1) / length)))).where("chunk < n_windows")
    begin = F.greatest(F.col("chunk") * length - (F.col("c") - F.length("line")), F.lit(0)).cast("int")
    end = F.least((F.col("chunk") + 1) * length - (F.col("c") - F.length("line")), F.length("line")).cast("int")
    pieces = pieces.withColumn("piece", F.substr(F.col("line"), begin + 1, end - begin))
    spelled = pieces.groupBy(*parts, "run", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "piece"))), lambda p: p["piece"]), "").alias("seq"))
    return spelled.select(*parts, "run", "chunk", sentence(plain_kmers(F.col("seq"), k)).alias("sentence"))
