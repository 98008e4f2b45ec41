"""Delimited tables: regions, manifests, read datasets, results, parameters."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.labels import check_columns, is_region_class
from readloom.operators.regions import check_regions

WHOLE = ("start", "end", "length", "nCG", "dmr_id")
REAL = ("meanMethy1", "meanMethy2", "diff.Methy", "areaStat", "abs_areaStat", "abs_diff.Methy")


def tsv(spark: SparkSession, path: str | list[str], header: bool = True, schema: str | None = None) -> DataFrame:
    r = spark.read.option("sep", "\t").option("header", header).option("enforceSchema", False).option("mode", "FAILFAST")
    return (r.schema(schema) if schema else r).csv(path)


def regions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A region table. Whole numbers may be spelled as decimals; missing required columns are an error; an index column
    without a name is dropped."""
    r = check_regions(tsv(spark, path))
    r = r.drop(*(c for c in r.columns if c == "_c0"))
    for c in r.columns:
        kind = "bigint" if c in WHOLE else "double" if c in REAL else None
        if kind:
            r = r.withColumn(c, F.col(f"`{c}`").cast("double").cast(kind))
    return r


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, ctype) of input files; the class may be left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    f = F.split(F.trim("value"), "\t")
    return lines.select(F.get(f, F.lit(0)).alias("path"), F.get(f, F.lit(1)).alias("ctype"))


def one_file(spark: SparkSession, path: str, ctype: str | None = None) -> DataFrame:
    return spark.createDataFrame([(path, ctype)], "path string, ctype string")


def reads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A read dataset: header, equal numbers of fields, mandatory columns, and the derived label."""
    r = check_columns(tsv(spark, path))
    return r.withColumn("dmr_label", F.col("dmr_label").cast("double").cast("bigint")).withColumn("ctype_label", is_region_class())


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """A pretraining corpus, a sentence in each line."""
    return spark.read.text(path).withColumnRenamed("value", "sentence")


def write_tsv(df: DataFrame, path: str, single: bool = False) -> None:
    """A folder of tab-separated files with headers. single: one file, for tables of regions or results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def write_reads(df: DataFrame, path: str) -> None:
    """A read dataset. Maps become columns, one for each tag that occurs; the last column is empty, so that no reader
    takes a missing last field for a short line."""
    if dict(df.dtypes).get("tags", "").startswith("map"):
        names = sorted(r["t"] for r in df.select(F.explode(F.map_keys("tags")).alias("t")).distinct().collect())  # two-letter names
        df = df.select(*(c for c in df.columns if c != "tags"), *(F.col("tags")[n].alias(n) for n in names if n not in df.columns))
    write_tsv(df.withColumn("non_null_col", F.lit("")), path)


def write_sentences(df: DataFrame, path: str) -> None:
    df.select("sentence").write.mode("overwrite").text(path)


def hadoop_path(path: str):
    """A path of any file system that Spark reaches, and the file system."""
    sc = SparkSession.active().sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(sc._jsc.hadoopConfiguration())


def write_text(text: str, path: str) -> None:
    """A small file, written whole."""
    where, fs = hadoop_path(path)
    out = fs.create(where, True)
    out.write(text.encode())
    out.close()


def read_text(path: str) -> str:
    where, fs = hadoop_path(path)
    with_stream = SparkSession.active().sparkContext._jvm.org.apache.commons.io.IOUtils
    data = fs.open(where)
    try:
        return bytes(with_stream.toByteArray(data)).decode()
    finally:
        data.close()


def file_uri(path: str) -> str:
    """The name by which Spark's `_metadata.file_path` calls a file."""
    where, fs = hadoop_path(path)
    return fs.makeQualified(where).toUri().toString()


def write_parameters(values: Mapping[str, object], path: str) -> None:
    """Tab-separated names and values."""
    write_text("".join(f"{k}\t{v}\n" for k, v in values.items()), path)


def read_parameters(path: str) -> dict[str, str]:
    return dict(line.split("\t", 1) for line in read_text(path).splitlines() if "\t" in line)


def read_config(path: str) -> dict[str, object]:
    """A JSON file of options; null leaves an option at its default, false is a value like any other."""
    return {k: v for k, v in json.loads(read_text(path)).items() if v is not None}


def write_config(values: Mapping[str, object], path: str) -> None:
    write_text(json.dumps(dict(values), indent=2, default=str) + "\n", path)
