"""What several operators share: checkpoints in the shared folder, bounded batches, components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word rule here: space and the five controls from tab to carriage return.
NOT_SPACE = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Caches by which a worker keeps what an operator loads, from task to task.
KEPT: list = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode, where no such setting is needed,
    a temporary one is made; on a cluster its absence is an error."""
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    if conf := sc.getConf().get("spark.checkpoint.dir"):
        sc.setCheckpointDir(conf)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="readloom-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder: survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(stage: Callable[..., DataFrame], most: str = "4m") -> Callable[..., DataFrame]:
    """The same stage, for which the session sends Python workers batches of about `most` bytes, unless a size is set: Spark's own 64 MB
    are held several times, by the executor and each of its workers. The setting stays, since it holds when the rows are asked for."""

    @functools.wraps(stage)
    def run(spark: SparkSession, *args) -> DataFrame:
        name = "spark.sql.execution.arrow.maxBytesPerBatch"
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, most)
        return stage(spark, *args)

    return run


def without_shuffle_files(spark: SparkSession, action) -> None:
    """Runs a query whose shuffle files go as soon as it ends, where Spark knows that setting."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        action()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A batch's texts, null as empty."""
    return batch.column(column).fill_null("").to_pylist()


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a piece holds about `most` bytes of text, or one row."""
    for batch in batches:
        start, held = 0, 0
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def kept(load: Callable) -> Callable:
    """`load` with its last results cached, until `lean` is used for something else in the same process."""
    KEPT.append(functools.lru_cache(maxsize=2)(load))
    return KEPT[-1]


def give_back() -> None:
    """Returns freed memory to the system, which else stays with the process (glibc, Arrow)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(batches: Iterable[pa.RecordBatch], column: str = "text", keep: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """`sliced` into smaller pieces, for workers that live on through several operators: first goes what other operators have
    loaded than `keep`, and at the end freed memory goes back, so that a worker holds no more than the operator at work needs."""
    for cache in KEPT:
        if cache is not keep and cache.cache_info().currsize:
            cache.cache_clear()
    yield from sliced(batches, column, 1 << 18)
    give_back()


class Memo(dict):
    """Words to what `make` gives for them. Long words aren't kept. `trim` sets a full half aside,
    dropping the half set aside before, from which words still in use come back: memory is bounded
    whatever the corpus holds, and frequent words stay."""

    def __init__(self, make, words: int = 800_000, longest: int = 64):
        super().__init__()
        self.make, self.half, self.longest, self.old = make, words // 2, longest, {}

    def __missing__(self, word):
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        if len(word) <= self.longest:
            self[word] = got
        return got

    def trim(self) -> None:
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b of one comparable type), root the least
    node that it reaches. Alternating large-star and small-star rounds, each cut in the shared
    folder; a hub is the one key of a plain join, whose hot partitions adaptive execution splits."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
