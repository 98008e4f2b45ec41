"""Regions: contig names, selection of the strongest, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType

REQUIRED = ("chr", "start", "end", "ctype")


def check_regions(regions: DataFrame) -> DataFrame:
    if missing := [c for c in REQUIRED if c not in regions.columns]:
        raise ValueError(f"regions need the columns {', '.join(REQUIRED)}; missing: {', '.join(missing)}")
    return regions


def prefixed(regions: DataFrame) -> bool:
    """Whether contigs are named with chr, by the first region."""
    first = regions.select("chr").first()
    return first is not None and "chr" in str(first["chr"])


def select_contigs(regions: DataFrame, with_prefix: bool = True, ignore_sex: bool = True) -> DataFrame:
    """Regions on numbered contigs, or on these and X and Y. The name need only contain such a part, so alternative
    contigs of a chromosome pass and the mitochondrion doesn't."""
    return regions.where(F.col("chr").cast("string").rlike(("chr" if with_prefix else "") + (r"\d+" if ignore_sex else r"[\d+|X|Y]")))


def harmonise_contigs(genome: DataFrame, with_prefix: bool, column: str = "contig") -> DataFrame:
    """Contig names in the regions' style."""
    c = F.col(column)
    name = F.when(c.contains("chr"), c).otherwise(F.concat(F.lit("chr"), c)) if with_prefix else F.when(c.contains("chr"), F.get(F.split(c, "chr"), F.lit(1))).otherwise(c)
    return genome.withColumn(column, name)


def rank_regions(regions: DataFrame) -> DataFrame:
    """Adds the magnitude of areaStat, else of diff.Methy, and the rank by it, largest first, missing last, ties
    by contig, start and end, then by the other columns as they come. Without either statistic the rank is by contig and start."""
    # Regions that are alike in all of these are alike throughout, so that the rank doesn't hang on the order of rows.
    sortable = [f.name for f in regions.schema if isinstance(f.dataType, AtomicType) or isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, AtomicType)]
    order = [F.col("chr"), F.col("start"), F.col("end"), *(F.col(f"`{c}`") for c in sortable if c not in ("chr", "start", "end"))]
    for stat in ("areaStat", "diff.Methy"):
        if stat in regions.columns:
            regions = regions.withColumn(f"abs_{stat}", F.abs(F.col(f"`{stat}`").cast("double")))
            order = [F.when(F.isnan(F.col(f"`abs_{stat}`")), None).otherwise(F.col(f"`abs_{stat}`")).desc_nulls_last(), *order]
            break
    # Region tables are small: one row for each region of a genome.
    return regions.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_regions(regions: DataFrame, n: int | None = None) -> DataFrame:
    """The n strongest regions of each class, classes in the order of their strongest region, labelled 0, 1, ... in
    dmr_id unless the table has labels."""
    r = rank_regions(check_regions(regions))
    if n:
        by = Window.partitionBy("ctype")
        r = r.withColumn("place", F.row_number().over(by.orderBy("rank"))).withColumn("first", F.min("rank").over(by)).where(F.col("place") <= n)
        order = ("first", "rank")
    else:
        order = ("rank",)
    if "dmr_id" not in r.columns:
        r = r.withColumn("dmr_id", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    return r.orderBy(*order).drop("rank", "place", "first")
