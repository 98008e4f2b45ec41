"""Aligned reads from SAM text and BAM files, as one schema with tags in a map."""

from __future__ import annotations

import gzip
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.cigar import aligned_bases

SCHEMA = "name string, flag int, ref_name string, ref_pos bigint, map_quality int, cigar string, next_ref_name string, next_ref_pos bigint, length int, seq string, qual string, tags map<string,string>"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
#: Letters of bases and of CIGAR operations by their codes, and of tag types with their struct formats.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, fields) of SAM text. Header lines and lines with too few fields are dropped. ref_pos is 1-based as in the file."""
    x = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    x = x.where(~F.col("value").rlike(r"^@[A-Z]{2}(\t|$)")).withColumn("f", F.split("value", "\t")).where(F.size("f") >= 11)
    kinds = [t.dataType.simpleString() for t in spark.createDataFrame([], SCHEMA).schema][:11]
    columns = [F.col("f")[i].try_cast(kind).alias(name) for i, (name, kind) in enumerate(zip(FIELDS, kinds))]
    tag = lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, 6, 1 << 30).alias("value"))
    tags = F.map_from_entries(F.transform(F.slice("f", 12, 1 << 20), tag))
    return x.select("path", *columns, tags.alias("tags"))


def tag_values(data: bytes, at: int) -> dict[str, str]:
    out = {}
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in NUMBERS:
            f = "<" + NUMBERS[kind]
            value, at = str(struct.unpack_from(f, data, at)[0]), at + struct.calcsize(f)
        elif kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode(), end + 1
        else:  # B: an array
            of, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{NUMBERS[of]}", data, at + 5)
            value, at = ",".join([of, *map(str, values)]), at + 5 + struct.calcsize(f"<{n}{NUMBERS[of]}")
        out[name] = value
    return out


def decode_bam(raw: bytes):
    """Records of a BAM file's bytes as tuples in the order of FIELDS. BGZF blocks are gzip members."""
    data = gzip.decompress(raw)
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    names, n_refs = [], struct.unpack_from("<i", data, at)[0]
    at += 4
    for _ in range(n_refs):
        n = struct.unpack_from("<i", data, at)[0]
        names.append(data[at + 4 : at + 3 + n].decode())
        at += 8 + n
    ref = lambda i: names[i] if i >= 0 else "*"
    while at < len(data):
        size = struct.unpack_from("<i", data, at)[0]
        r = data[at + 4 : at + 4 + size]
        at += 4 + size
        rid, pos, n_name, mapq, _, n_cigar, flag, n_seq, nrid, npos, tlen = struct.unpack_from("<iiBBHHHiiii", r)
        k = 32 + n_name
        cigar = "".join(f"{c >> 4}{OPERATIONS[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", r, k)) or "*"
        k += 4 * n_cigar
        packed = r[k : k + (n_seq + 1) // 2]
        seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_seq] or "*"
        k += (n_seq + 1) // 2
        qual = r[k : k + n_seq]
        qual = "*" if not n_seq or qual[0] == 255 else "".join(chr(q + 33) for q in qual)
        next_name = "=" if nrid >= 0 and nrid == rid else ref(nrid)
        yield r[32 : 31 + n_name].decode(), flag, ref(rid), pos + 1, mapq, cigar, next_name, npos + 1, tlen, seq, qual, tag_values(r, k + n_seq)


def bam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, fields) of BAM files: a task for each file, whose size Spark limits to 2 GB. One scan with one join on regions
    takes the place of an indexed fetch for each region; larger files are read as SAM text, which splits."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = []
                for row in decode_bam(content):
                    rows.append((path, *row))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=["path", *FIELDS])
                        rows = []
                yield pd.DataFrame(rows, columns=["path", *FIELDS])

    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), "content")
    return files.repartition(max(1, len(files.inputFiles())), "path").mapInPandas(run, f"path string, {SCHEMA}")


def placed(reads: DataFrame) -> DataFrame:
    """Adds what the region join needs: chr, pos (0-based) and qlen, the aligned bases of the read. Unmapped reads are dropped."""
    x = reads.where((F.col("flag").bitwiseAND(F.lit(4)) == 0) & (F.col("ref_name") != "*"))
    return x.withColumn("chr", F.col("ref_name")).withColumn("pos", F.col("ref_pos") - 1).withColumn("qlen", aligned_bases(F.col("cigar")))
