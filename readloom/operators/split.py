"""Reproducible shuffles, subsets, and splits that keep a key's rows together and the classes' shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Digits of a draw that make a range, and how many ranges there are.
DIGITS = 3
RANGES = 16**DIGITS
Ratio = float | tuple[float, float, float] | None


def draw(key: str, seed: int) -> Column:
    """A key's place in a seeded random order."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(draw(key, seed), key)


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows of an order."""
    return df.orderBy(order).limit(n)


def random_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(draw(key, seed), key).limit(n)


def split_mode(ratio: Ratio) -> tuple[float, float, float]:
    """Shares of train, test and validation. A number is the share of train, three numbers are shares whose sum is 1, none
    is everything in one part."""
    if ratio is None:
        return 1.0, 0.0, 0.0
    if isinstance(ratio, (int, float)):
        if not 0 < ratio <= 1:
            raise ValueError("the share of train must be over 0 and at most 1")
        return float(ratio), 1 - float(ratio), 0.0
    if len(ratio) != 3 or sum(ratio) != 1.0:
        raise ValueError("three shares with a sum of 1 are needed")
    return tuple(map(float, ratio))


def assign_parts(keys: DataFrame, key: str, ratio: Ratio, seed: int = 0) -> DataFrame:
    """Distinct (key, ctype) with `part`: train, test or val. Within each class, keys in seeded order are cut at rounded
    shares. Keys are counted by class and the first digits of their draw, of which there are RANGES; running sums of these counts, a
    small table, and ranks within such a range give every key's place, so no task ranks a class."""
    train, test, _ = split_mode(ratio)
    k = keys.withColumn("_draw", draw(key, seed)).withColumn("_range", F.substring("_draw", 1, DIGITS))
    sizes = k.groupBy(F.col("ctype").alias("_ctype"), F.col("_range").alias("_of")).agg(F.count("*").alias("_m"))
    by = Window.partitionBy("_ctype")
    sizes = sizes.withColumn("_before", F.sum("_m").over(by.orderBy("_of")) - F.col("_m")).withColumn("_n", F.sum("_m").over(by))
    k = k.join(F.broadcast(sizes), F.col("ctype").eqNullSafe(F.col("_ctype")) & (F.col("_range") == F.col("_of")))  # at most RANGES rows a class
    place = F.col("_before") + F.row_number().over(Window.partitionBy("ctype", "_range").orderBy("_draw", key))
    first, second = F.round(F.col("_n") * F.lit(train)), F.round(F.col("_n") * F.lit(train + test))
    k = k.withColumn("_place", place)
    return k.withColumn("part", F.when(F.col("_place") <= first, "train").when(F.col("_place") <= second, "test").otherwise("val")).select(*keys.columns, "part")


def assign_by_hash(keys: DataFrame, key: str, ratio: Ratio, seed: int = 0) -> DataFrame:
    """The same shares in expectation, key by key without a shuffle: for key sets whose classes no task can rank."""
    train, test, _ = split_mode(ratio)
    u = F.conv(F.substring(draw(key, seed), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return keys.withColumn("part", F.when(u < train, "train").when(u < train + test, "test").otherwise("val"))


def split(df: DataFrame, key: str, ratio: Ratio, seed: int = 0, order: str | None = None, by_hash: bool = False) -> DataFrame:
    """Rows with `part`. A key's class is that of its last row by `order`, or its largest; rows without a key are train.
    Each part alone is a filter away; membership is a semi-join on the key."""
    latest = F.max_by("ctype", F.struct(F.col(order), F.col("ctype"))) if order else F.max("ctype")
    keys = df.where(F.col(key).isNotNull()).groupBy(key).agg(latest.alias("ctype"))
    parts = (assign_by_hash if by_hash else assign_parts)(keys, key, ratio, seed).select(F.col(key).alias("s_key"), "part")
    return df.join(parts, F.col(key) == F.col("s_key"), "left").drop("s_key").withColumn("part", F.coalesce("part", F.lit("train")))


def part(df: DataFrame, key: str, parts: DataFrame, name: str) -> DataFrame:
    """The rows whose key is in a part: a semi-join."""
    return df.join(parts.where(F.col("part") == name).select(key), key, "left_semi")


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; a column that some lack is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
