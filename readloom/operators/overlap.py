"""Containment of reads in regions, and lookup of reference slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Regions in bins are broadcast up to so many rows and bytes; beyond, both sides are dealt by contig and bin.
FEW_REGIONS, FEW_BYTES = 200_000, 64 << 20


def inside(pos: Column, n: Column, start: Column, end: Column) -> Column:
    """Whether n aligned bases from pos lie in the half-open region."""
    return (pos >= start) & (pos + n <= end)


def contained(reads: DataFrame, regions: DataFrame, few: int = FEW_REGIONS, few_bytes: int = FEW_BYTES) -> DataFrame:
    """Reads (chr, pos, qlen, ...) joined with every region (chr, start, end, ...) that contains them, by contig and bin. A
    bin is as wide as regions are on average, so a region is in few bins and a read meets few regions that don't contain it. Binned
    regions are broadcast if they are `few` and small; the rows and the join are the same either way."""
    size = regions.agg(F.count("*").alias("n"), F.avg(F.greatest(F.col("end") - F.col("start"), F.lit(1))).alias("mean"), F.avg(F.octet_length(F.to_json(F.struct(*regions.columns)))).alias("bytes")).first()
    width = 64
    while width < (size["mean"] or 0):
        width *= 2
    small = 4 * size["n"] <= few and 4 * size["n"] * (size["bytes"] or 0) <= few_bytes  # a region is in 3 bins on average, at most
    return contained_binned(reads, regions, width, small)


def contained_binned(reads: DataFrame, regions: DataFrame, width: int = 4096, small: bool = False) -> DataFrame:
    """The same by an equal-key join on contig and bin: a region is in every bin that it touches, a read in the bin where
    it begins, so each pair meets once. small: whether the regions may be broadcast."""
    w = F.lit(width)
    r = regions.withColumnsRenamed({"chr": "r_chr", "start": "r_start", "end": "r_end"})
    r = r.where("r_start < r_end").withColumn("r_bin", F.explode(F.sequence(F.floor(F.col("r_start") / w), F.floor((F.col("r_end") - 1) / w))))
    q = reads.withColumn("bin", F.floor(F.col("pos") / w))
    # A read without bases can begin at a region's end, beyond its last bin.
    edge = regions.withColumnsRenamed({"chr": "r_chr", "start": "r_start", "end": "r_end"}).where("r_start <= r_end").withColumn("r_bin", F.floor(F.col("r_end") / w))
    r = r.unionByName(edge.where((F.col("r_end") % w == 0) | (F.col("r_start") == F.col("r_end"))))
    r = F.broadcast(r) if small else r
    on = (F.col("chr") == F.col("r_chr")) & (F.col("bin") == F.col("r_bin")) & inside(F.col("pos"), F.col("qlen"), F.col("r_start"), F.col("r_end"))
    return q.join(r, on).drop("r_chr", "bin", "r_bin")


def running(x: DataFrame, values: list[str], width: int) -> DataFrame:
    """The sums of `values` over all rows of the same chr up to (at, turn), for the rows of `x` whose `turn` is 1. They are made within
    contig and bin, the bins' totals are carried on."""
    cut = x.withColumn("bin", F.floor(F.col("at") / width))
    inner = Window.partitionBy("chr", "bin").orderBy("at", "turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.partitionBy("t_chr").orderBy("t_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(F.col("chr").alias("t_chr"), F.col("bin").alias("t_bin")).agg(*(F.sum(v).alias(f"t_{v}") for v in values))
    totals = totals.select("t_chr", "t_bin", *(F.coalesce(F.sum(f"t_{v}").over(outer), F.lit(0)).alias(f"t_{v}") for v in values))
    got = cut.withColumns({v: F.sum(v).over(inner) for v in values}).where("turn = 1")
    got = got.join(totals, (F.col("chr") == F.col("t_chr")) & (F.col("bin") == F.col("t_bin")))
    return got.withColumns({v: F.col(v) + F.col(f"t_{v}") for v in values}).drop("bin", "t_chr", "t_bin", *(f"t_{v}" for v in values))


def contained_totals(reads: DataFrame, regions: DataFrame, by: str, width: int = 1 << 16) -> DataFrame:
    """(chr, by, n, places): how many pairs `contained` would give for each contig and value of the regions' column `by`, and the sum of
    their reads' positions, without making the pairs, whose number grows with reads times regions.

    Reads that begin at or after a region's start and end by its end are those that end by its end, less those that begin before its start,
    but for those that do the latter and end behind it. The first two are running sums along a contig. The third are reads longer than the
    region: such reads are listed under the blocks of 1, 2, 4, ... positions in which they begin, a region names the few blocks that
    make up the positions in question, and within each block a running sum from the last end tells how many end behind it."""
    values = ["n", "places"]
    q = reads.where("chr is not null and pos is not null and qlen is not null").select("chr", F.col("pos").cast("long").alias("pos"), (F.col("pos") + F.col("qlen")).cast("long").alias("stop"))
    r = regions.where("chr is not null and start is not null and end is not null").groupBy("chr", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col(by).alias("by")).agg(F.count("*").alias("m"))
    shortest = r.agg(F.min(F.col("end") - F.col("start"))).first()[0]
    longest = q.agg(F.max(F.col("stop") - F.col("pos"))).first()[0]

    def points(at: str) -> DataFrame:
        return q.groupBy("chr", F.col(at).alias("at")).agg(F.count("*").alias("n"), F.sum("pos").alias("places")).select("chr", "at", F.lit(0).alias("turn"), *values, F.lit(None).cast(r.schema["by"].dataType).alias("by"), F.lit(0).cast("long").alias("m"))

    def asked(at: Column) -> DataFrame:
        none = (F.lit(0).cast("long").alias(v) for v in values)
        return r.groupBy("chr", at.alias("at"), "by").agg(F.sum("m").alias("m")).select("chr", "at", F.lit(1).alias("turn"), *none, "by", "m")

    def part(x: DataFrame, sign: int) -> DataFrame:
        return x.select("chr", "by", *((F.col(v) * F.col("m") * sign).alias(v) for v in values))

    out = part(running(points("stop").union(asked(F.col("end"))), values, width), 1)
    out = out.union(part(running(points("pos").union(asked(F.col("start") - 1)), values, width), -1))
    if shortest is not None and longest is not None and longest >= shortest + 2:
        # Where a read must begin: from end - longest + 1, or it ends too soon, to start - 1.
        levels = F.explode(F.sequence(F.lit(0), F.lit(int(longest - shortest).bit_length()))).alias("level")
        block = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("level"))).cast("long")
        long = q.where(F.col("stop") - F.col("pos") >= shortest + 2).groupBy("chr", "pos", "stop").agg(F.count("*").alias("n")).withColumn("places", F.col("n") * F.col("pos"))
        long = long.select("*", levels).select("chr", "level", block(F.col("pos")).alias("block"), F.col("stop").alias("at"), F.lit(1).alias("turn"), *values, F.lit(None).cast(r.schema["by"].dataType).alias("by"), F.lit(0).cast("long").alias("m"))
        span = r.where(F.col("end") - F.col("start") <= longest - 2).select("*", levels)
        span = span.withColumns({"low": -block(-(F.col("end") - longest + 1)), "high": block(F.col("start"))}).where("low < high")
        odd = lambda c: F.pmod(F.col(c), F.lit(2)) == 1
        named = F.array_compact(F.array(F.when(odd("low"), F.col("low")), F.when(odd("high"), F.col("high") - 1)))
        span = span.select("chr", "level", F.explode(named).alias("block"), F.col("end").alias("at"), F.lit(0).alias("turn"), *(F.lit(0).cast("long").alias(v) for v in values), "by", "m")
        behind = Window.partitionBy("chr", "level", "block").orderBy(F.desc("at"), "turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.union(part(long.union(span).withColumns({v: F.sum(v).over(behind) for v in values}).where("turn = 0"), 1))
    return out.groupBy("chr", F.col("by").alias(by)).agg(*(F.sum(v).alias(v) for v in values)).where("n > 0")


def chunk_genome(genome: DataFrame, size: int = 1 << 16, overlap: int = 1 << 12) -> DataFrame:
    """(contig, bin, seq) from (contig, seq): upper-cased pieces that reach `overlap` bases into the next one. For contigs that fit
    a cell; each is cut once, by bytes, as pieces of letters of one byte can be (others are cut letter by letter)."""
    n = F.length("seq")
    pieces = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.substring(F.col("raw"), i * size + 1, F.lit(size + overlap))))
    plain = genome.where((n > 0) & (n == F.octet_length("seq"))).withColumn("raw", F.col("seq").cast("binary"))
    plain = plain.select("contig", pieces.alias("bin", "seq")).select("contig", F.col("bin").cast("long").alias("bin"), F.upper(F.col("seq").cast("string")).alias("seq"))
    g = genome.where((n > 0) & (n != F.octet_length("seq"))).withColumn("bin", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))))
    return plain.unionByName(g.select("contig", F.col("bin").cast("long").alias("bin"), F.upper(F.substr(F.col("seq"), F.col("bin") * size + 1, F.lit(size + overlap))).alias("seq")))


def with_reference(reads: DataFrame, chunks: DataFrame, size: int = 1 << 16) -> DataFrame:
    """Reads with `ref`, the reference at their place, as long as their aligned bases. A read meets every piece that it
    touches, takes `size` bases at most from each and joins them in order, so no read is too long for the pieces' overlap.
    Reads on unknown contigs are dropped."""
    c = chunks.withColumnsRenamed({"contig": "c_contig", "bin": "c_bin", "seq": "c_seq"})
    x = reads.select(F.monotonically_increasing_id().alias("r_row"), F.struct(*reads.columns).alias("r"), F.col("chr").alias("r_chr"), F.col("pos").alias("r_pos"), (F.col("pos") + F.col("qlen")).alias("r_end"))
    x = x.withColumn("r_bin", F.explode(F.sequence(F.floor(F.col("r_pos") / size), F.floor(F.greatest("r_pos", F.col("r_end") - 1) / size))))
    x = x.join(c, (F.col("r_chr") == F.col("c_contig")) & (F.col("r_bin") == F.col("c_bin")))
    low = F.col("c_bin") * size
    a, b = F.greatest(F.col("r_pos"), low), F.least(F.col("r_end"), low + size)
    part = F.struct("c_bin", F.substr(F.col("c_seq"), (a - low + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")).alias("part"))
    x = x.groupBy("r_row").agg(F.first("r").alias("r"), F.array_sort(F.collect_list(part)).alias("parts"))
    return x.select("r.*", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("ref"))


def reaching(chunks: DataFrame, regions: DataFrame, size: int = 1 << 16) -> DataFrame:
    """(contig, bin, seq): the pieces in which reads of the regions (chr, start, end) may begin, each as far as the furthest of these
    regions goes. So one piece holds the reference of every read, for streams, which can't gather a read's parts."""
    first = F.floor(F.greatest(F.col("start"), F.lit(0)) / size)
    r = regions.where("start <= end").select(F.col("chr").alias("r_chr"), F.col("end").alias("r_end"), F.explode(F.sequence(first, F.floor(F.col("end") / size))).alias("r_bin"))
    r = r.groupBy("r_chr", "r_bin").agg(F.max("r_end").alias("r_end"))
    r = r.withColumn("part", F.explode(F.sequence("r_bin", F.greatest("r_bin", F.floor((F.col("r_end") - 1) / size)))))
    x = r.join(chunks, (F.col("r_chr") == F.col("contig")) & (F.col("part") == F.col("bin")))
    parts = F.array_sort(F.collect_list(F.struct("part", F.substr(F.col("seq"), F.lit(1), F.lit(size)).alias("seq"))))
    x = x.groupBy("contig", "r_bin").agg(parts.alias("parts"))
    return x.select("contig", F.col("r_bin").alias("bin"), F.array_join(F.transform("parts", lambda p: p["seq"]), "").alias("seq"))
