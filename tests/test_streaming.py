"""Streams give what batches give."""

from pyspark.sql import functions as F

from readloom.operators.overlap import chunk_genome, with_reference
from readloom.plans.extract import Options, extract
from readloom.plans.likelihood import grid_likelihood
from readloom.streaming.extract import extract_stream, likelihood_stream


def drained(stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_extraction(spark, tmp_path):
    ref = "ACGTACGTTTCGAACGCGTA" * 5
    rows = [(f"r{i}", 0, "chr1", i, 12, "12M", ref[i : i + 12], {"XM": "".join("Z" if ref[k : k + 2] == "CG" else "." for k in range(i, i + 12))}) for i in range(0, 80, 7)]
    reads = spark.createDataFrame(rows, "name string, flag int, chr string, pos long, qlen int, cigar string, seq string, tags map<string,string>")
    regions = spark.createDataFrame([("chr1", 0, 50, "T", 0)], "chr string, start long, end long, ctype string, dmr_id long")
    genome = spark.createDataFrame([("chr1", 0, ref)], "contig string, bin long, seq string")
    reads.write.parquet(f"{tmp_path}/reads")
    stream = spark.readStream.schema(reads.schema).parquet(f"{tmp_path}/reads")
    got = drained(extract_stream(stream, regions, genome, Options()), "append", "extracted").select("name", "dna_seq", "methyl_seq", "dmr_label")
    batch = extract(reads, regions, genome).select("name", "dna_seq", "methyl_seq", "dmr_label")
    assert sorted(got.collect()) == sorted(batch.collect()) and got.count() == 6


def test_reads_longer_than_the_overlap(spark, tmp_path):
    ref = "ACGTACGTTTCGAACGCGTAT" * 40
    size = 100
    places = [(0, 30), (90, 20), (95, 330), (199, 1), (200, 100), (150, 600), (700, 140), (830, 10)]
    rows = [(f"r{i}", 0, "chr1", p, n, f"{n}M", ref[p : p + n], {"XM": "".join("Z" if ref[k : k + 2] == "CG" else "." for k in range(p, p + n))}) for i, (p, n) in enumerate(places)]
    reads = spark.createDataFrame(rows, "name string, flag int, chr string, pos long, qlen int, cigar string, seq string, tags map<string,string>")
    regions = spark.createDataFrame([("chr1", 0, 800, "T", 0), ("chr1", 700, len(ref), "N", 1)], "chr string, start long, end long, ctype string, dmr_id long")
    genome = chunk_genome(spark.createDataFrame([("chr1", ref)], "contig string, seq string"), size, 20)
    assert {r.name: r.ref for r in with_reference(reads, genome, size).collect()} == {f"r{i}": ref[p : p + n] for i, (p, n) in enumerate(places)}
    whole = spark.createDataFrame([("chr1", 0, ref)], "contig string, bin long, seq string")
    names = ("name", "dna_seq", "methyl_seq", "dmr_label")
    expected = sorted(extract(reads, regions, whole).select(*names).collect())
    assert sorted(extract(reads, regions, genome, Options(chunk=size)).select(*names).collect()) == expected and len(expected) == 7
    reads.write.parquet(f"{tmp_path}/reads")
    stream = spark.readStream.schema(reads.schema).parquet(f"{tmp_path}/reads")
    assert sorted(drained(extract_stream(stream, regions, genome, Options(chunk=size)), "append", "long_reads").select(*names).collect()) == expected


def test_likelihood(spark, tmp_path):
    reads = spark.createDataFrame([(0.1 * i, 1 - 0.1 * i, i % 2) for i in range(1, 10)], "P_ctype double, P_N double, dmr_label int")
    reads.write.parquet(f"{tmp_path}/scored")
    got = drained(likelihood_stream(spark.readStream.schema(reads.schema).parquet(f"{tmp_path}/scored"), 0.4, 0.6, 20), "complete", "sums")
    batch = grid_likelihood(reads, 0.4, 0.6, 20, ("dmr_label",))
    key = lambda df: sorted(map(tuple, df.select("dmr_label", "i", F.round("ll", 9)).collect()))
    assert key(got) == key(batch)
