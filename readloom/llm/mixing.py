"""Mixing sources to target sizes by nested hash thresholds, with DataFrame functions only.

Every document has a 60-bit hash. A source whose target is m whole sizes and a rest takes all its
documents m times, and once more those whose hash is below a threshold. The threshold comes from
histograms: sizes are summed by source and the first bits of the hash, the bucket in which the
running sum passes the rest is found, and only that bucket's documents are summed again by the next
bits, until the bits are used up. Nothing is sorted but histograms, of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import NOT_SPACE, cut

#: Bits of the hash by which one level of histograms divides a bucket.
LEVELS = (12, 16, 32)
BITS = sum(LEVELS)


def hashed(column: str) -> Column:
    """The first 60 bits of the MD5 of an id's text; null hashes as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): sources by code point, null last,
    weigh `weights` in turn. They share `share` of the total by weight; a target stops at `most`
    times its source's size and what is over goes to the others by weight. In the order of cap by
    weight, the level at which the first so many stop is greatest where the sharing ends."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(every) * share - before * most) / rest)
    return s.select("source", "source_size", F.least(F.col("cap"), F.max("level").over(every) * F.col("weight")).alias("target"))


def thresholds(docs: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(of, source_size, target, times, bound) for each source `of`: its documents are taken so many times, and once more
    below the bound. docs: (source, size, hash)."""
    t = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    t = cut(t.withColumn("times", times).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")))

    # before: what is taken below the bucket; low: the bucket's first hash.
    at, inside = t.where("rest > 0").select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("low")), docs
    shift = BITS
    for bits in LEVELS:
        shift -= bits
        inside = inside.select("source", "size", "hash", F.shiftright("hash", shift + bits).alias("bucket"))
        edge = at.select("s", "rest", "before", F.shiftright("low", shift + bits).alias("b"))
        inside = inside.join(edge, inside["source"].eqNullSafe(edge["s"]) & (inside["bucket"] == edge["b"])).select("source", "size", "hash", "rest", "before")
        bars = inside.groupBy("source", "rest", "before", F.shiftright("hash", shift).alias("bar")).agg(F.sum("size").alias("here"))
        running = F.col("before") + F.sum("here").over(Window.partitionBy("source").orderBy("bar"))
        bars = bars.withColumn("through", running).where(F.col("through") > F.col("rest"))
        at = bars.groupBy(F.col("source").alias("s"), "rest").agg(F.min(F.struct("bar", "through", "here")).alias("m"))
        at = at.select("s", "rest", (F.col("m.through") - F.col("m.here")).alias("before"), F.shiftleft("m.bar", shift).alias("low"), "m.through")
    # The last bucket is one hash: it is taken if that comes nearer.
    with_it = F.col("through") - F.col("rest") < F.col("rest") - F.col("before")
    bound = at.select("s", (F.col("low") + with_it.cast("long")).alias("bound"))
    t = t.join(bound, t["source"].eqNullSafe(bound["s"]), "left")
    return cut(t.select(F.col("source").alias("of"), "source_size", "target", "times", F.coalesce("bound", F.lit(0)).alias("bound")))


def beside(docs: DataFrame, t: DataFrame, source: str = "source", hash_: str = "hash", few: int = 50_000, salts: int = 64) -> DataFrame:
    """Documents with their source's row of `t` in a column mix: broadcast if there are few sources, else with each source dealt
    to many tasks, since one may hold a third of all documents."""
    t = t.select(F.struct(*t.columns).alias("mix"))
    same = docs[source].eqNullSafe(F.col("mix.of"))
    if t.count() <= few:
        return docs.join(F.broadcast(t), same)
    t = t.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return docs.join(t, same & (F.pmod(docs[hash_], F.lit(salts)) == t["to"])).drop("to")


def slim(df: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    return cut(df.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), words_in(F.col(text_column)).alias("size"), hashed(id_column).alias("hash")))


def mix(df: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken, copies) for every row. A row is taken a whole number of times;
    within a source rows of smaller hash are taken once more than the others, so that what is
    taken is as near to the target as whole documents allow (on a tie, the less). Rows of one id hash
    alike and are taken alike; null is a source of its own; an empty table gives no rows.
    Reruns agree, since a hash depends on nothing but the id."""
    docs = slim(df, id_column, text_column, source_column)
    out = beside(docs, thresholds(docs, weights, share, most))
    copies = F.col("mix.times") + (F.col("hash") < F.col("mix.bound")).cast("int")
    return out.select(F.col("id").alias(id_column), "size", "mix.source_size", "mix.target", (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"))


def apply_mix(df: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of `df`, each as often as the mix takes it: a filter by the thresholds, so that texts aren't moved."""
    t = thresholds(slim(df, id_column, text_column, source_column), weights, share, most)
    rows = df.select(F.struct(*df.columns).alias("doc"), F.col(source_column).alias("source"), hashed(id_column).alias("hash"))
    out = beside(rows, t).withColumn("copies", F.col("mix.times") + (F.col("hash") < F.col("mix.bound")).cast("int"))
    return out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint as hash
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight, source_size * 2e0 as cap from s),
o as (select *, (sum(source_size) over () * 1.5e0
                 - coalesce(sum(source_size) over (order by cap / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0) * 2e0)
                / sum(weight) over (order by cap / weight, source asc nulls last rows between current row and unbounded following) as level from w),
t as (select source, source_size, least(cap, max(level) over () * weight) as target from o),
m as (select *, case when source_size > 0 then cast(floor(target / source_size) as int) else 0 end as times from t),
r as (select d.doc_id, d.size, d.hash, m.*, target - times * source_size as rest,
             sum(d.size) over (partition by d.source order by d.hash range between unbounded preceding and current row) as through,
             sum(d.size) over (partition by d.source, d.hash) as here
      from d join m on d.source is not distinct from m.source)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(size * (times + case when rest <= 0 then 0 when through <= rest then 1
                                 when through - here > rest then 0
                                 when through - rest < rest - (through - here) then 1 else 0 end) as bigint) as taken,
       times + case when rest <= 0 then 0 when through <= rest then 1
                    when through - here > rest then 0
                    when through - rest < rest - (through - here) then 1 else 0 end as copies
from r
"""
