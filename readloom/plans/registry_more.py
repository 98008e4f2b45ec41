"""Further registered queries: operators over the stand-in tables of `registry`, and sources and sinks by files that a query
writes and reads again in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import calls, encode, kmer, mask, modtags, moments, vocab
from readloom.functions.let import let, letters
from readloom.operators import labels, overlap, regions, split
from readloom.plans import purity
from readloom.plans.registry import ID_SQL, KMER_SQL, SQL_MARGINS, SQL_READS, SQL_REGIONS, SQL_SEQ, query, region_table, rounded, scored, sql_grid, table, two_margins, v_reads, v_regions, v_seq
from readloom.plans.scorer import evaluate
from readloom.sources import fasta, sam, tables


def shared_folder(spark: SparkSession) -> str:
    """A new folder where driver and executors share files: that of checkpoints; in local mode without one a temporary one."""
    base = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = base.get() if base.isDefined() else spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="readloom-")
    return f"{base}/files-{uuid.uuid4().hex}"


LONG_SQL = f"""with {SQL_SEQ}, r as (select l_orderkey as name, l_linenumber as mate, l_partkey % (select count(*) from documents) as contig, (l_orderkey * 131 + l_linenumber * 17) % 500 as pos, cast(l_quantity as int) * 20 as qlen from lineitem)
select name, mate, length(substr(seq, pos + 1, qlen)) as n, md5(substr(seq, pos + 1, qlen)) as ref from r join v_seq on doc_id = contig where length(seq) > pos"""


@query(LONG_SQL)
def genome_lookup_long(spark, sf_dir):
    """Reference slices of reads of up to 1,000 bases, from pieces of 128 that overlap by 32."""
    seqs = v_seq(spark, sf_dir).select(F.col("doc_id").cast("string").alias("contig"), "seq")
    n = table(spark, sf_dir, "documents").count()
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("mate"), (F.col("l_partkey") % n).cast("string").alias("chr"), ((F.col("l_orderkey") * 131 + F.col("l_linenumber") * 17) % 500).alias("pos"), (F.col("l_quantity").cast("int") * 20).alias("qlen"))
    got = overlap.with_reference(x, overlap.chunk_genome(seqs, 128, 32), 128).where("length(ref) > 0")
    return got.select("name", "mate", F.length("ref").cast("long").alias("n"), F.md5(F.col("ref").cast("binary")).alias("ref"))


@query(f"with {SQL_REGIONS} select region_id, chr as with_prefix, replace(chr, 'chr', '') as bare, 'chr' || replace(chr, 'chr', '') as again from v_regions")
def genome_style(spark, sf_dir):
    """Contig names in both styles, and back."""
    x = v_regions(spark, sf_dir).select("region_id", F.col("chr").alias("with_prefix"), F.col("chr").alias("bare"))
    x = regions.harmonise_contigs(regions.harmonise_contigs(x, True, "with_prefix"), False, "bare").withColumn("again", F.col("bare"))
    return regions.harmonise_contigs(x, True, "again")


@query(f"with {SQL_READS} select name, mate, chr, pos from v_reads order by name, mate limit 100")
def first_reads(spark, sf_dir):
    """The first hundred rows of an order."""
    x = v_reads(spark, sf_dir).withColumn("o", F.struct("name", "mate"))
    return split.first_rows(x, "o", 100).select("name", "mate", "chr", "pos")


@query("select o_orderkey, o_totalprice from orders order by md5(concat(cast(o_orderkey as varchar), '|5')), o_orderkey limit 100")
def random_orders(spark, sf_dir):
    """A hundred rows of a seeded random order."""
    return split.random_rows(table(spark, sf_dir, "orders"), "o_orderkey", 100, 5).select("o_orderkey", "o_totalprice")


@query("select o_orderkey, row_number() over (order by md5(concat(cast(o_orderkey as varchar), '|950410')), o_orderkey) as place from orders")
def shuffled_orders(spark, sf_dir):
    """Every row's place in a seeded shuffle: ranks within the partitions of the sort, and rows before each partition."""
    x = split.shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 950410)
    x = x.select("o_orderkey", F.spark_partition_id().alias("p"), (F.monotonically_increasing_id() % (1 << 33)).alias("i")).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else x.select("o_orderkey", F.spark_partition_id().alias("p"), (F.monotonically_increasing_id() % (1 << 33)).alias("i")).persist()
    sizes = sorted((r.p, r.n) for r in x.groupBy("p").agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, n = [], 0
    for p, m in sizes:
        before.append((p, n))
        n += m
    return x.join(F.broadcast(spark.createDataFrame(before, "p int, n long")), "p").select("o_orderkey", (F.col("n") + F.col("i") + 1).alias("place"))


HASH_U = "cast('0x' || substr(md5(concat(cast(name as varchar), '|11')), 1, 12) as bigint) / 281474976710656e0"


@query(f"with {SQL_READS}, k as (select distinct name from v_reads), a as (select name, {HASH_U} as u from k) select case when u < 0.5e0 then 'train' when u < 0.75e0 then 'test' else 'val' end as part, count(*) as n, cast(sum(name) as bigint) as names from a group by part")
def hash_split(spark, sf_dir):
    """Keys split by their own hash, without ranks."""
    keys = v_reads(spark, sf_dir).select("name").distinct()
    return split.assign_by_hash(keys, "name", (0.5, 0.25, 0.25), 11).groupBy("part").agg(F.count("*").alias("n"), F.sum("name").alias("names"))


PART_SQL = f"""with {SQL_READS}, k as (select name, max(ctype) as ctype from v_reads group by name),
p as (select *, row_number() over (partition by ctype order by md5(concat(cast(name as varchar), '|11')), name) as place, count(*) over (partition by ctype) as n from k)
select ctype, count(*) as n, cast(sum(pos) as bigint) as places from v_reads where name in (select name from p where place > round(n * 0.7e0)) group by ctype"""


@query(PART_SQL)
def test_part(spark, sf_dir):
    """The rows whose key is in the test part: a semi-join."""
    x = v_reads(spark, sf_dir)
    parts = split.assign_parts(x.groupBy("name").agg(F.max("ctype").alias("ctype")), "name", 0.7, 11)
    return split.part(x, "name", parts, "test").groupBy("ctype").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


@query(f"with {SQL_READS}, x as (select *, ln(p_ctype) - ln(1 - p_ctype) as z, cast(ctype = dmr_ctype as int) as y from v_reads) select round(avg(case when y = 1 then ln(1 + exp(-z)) else ln(1 + exp(z)) end), 9) as loss, avg(cast((p_ctype > 0.5) = (y = 1) as double)) as ctype_acc from x")
def evaluation(spark, sf_dir):
    """Loss and accuracy of scored reads."""
    x = scored(spark, sf_dir).withColumn("pred", (F.col("P_ctype") > F.col("P_N")).cast("int"))
    return rounded(evaluate(x), "loss", digits=9)


@query(f"with {SQL_READS.replace('from lineitem', 'from lineitem where l_linenumber > 2').replace('v_reads as', 'v_called as')}, {SQL_READS}, {SQL_MARGINS}, {sql_grid(500).replace('from v_reads', 'from v_called')}, x as (select unnest(['T', 'N']) as cell_type, theta from b) select cell_type, case cell_type when 'T' then theta else 1 - theta end as pred from x")
def deconvolve_two(spark, sf_dir):
    """Shares of two classes by the dispatch on the training reads' classes; reads without a call are left out."""
    x = scored(spark, sf_dir).withColumn("n_cpg", F.when(F.col("mate") > 2, 1).otherwise(0))
    train = v_reads(spark, sf_dir).select(F.col("tn").alias("ctype"))
    return purity.deconvolve(x, train, 500)[0]


GREEDY = """{k}_p as (select c, low + step * j as t, step from {f}, range({n}) as g(j) where low + step * j < 1e0 - 1e-10),
{k}_s as (select p.c, p.t, p.step, -sum(w * (a - b) / ((1 - p.t) * b + p.t * a)) as slope from {k}_p p join w on w.c = p.c group by p.c, p.t, p.step),
{k}_r as (select *, row_number() over (order by slope, c) as place from {k}_s),
{k} as (select f.c, f.low + f.step * greatest(count(r.t) - 2, 0) as low, f.step * {finer} as step from {f} f left join {k}_r r on r.c = f.c and r.place <= round((1 - (select sum(low) from {f})) / f.step) group by f.c, f.low, f.step)"""


def mixture_sql() -> str:
    """Equal slopes on a grid: the sum of the shares is the number of grid steps taken, and steps are taken where the sum falls fastest.
    Each grid of 100,000 steps is followed by a finer one from two steps below."""
    levels, before = [], "l0"
    for k, (n, finer) in enumerate(((10_000, 1e-3), (6_000, 1e-3), (6_000, 1e-3), (6_000, 1e-3)), 1):
        levels.append(GREEDY.format(k=f"l{k}", f=before, n=n, finer=finer))
        before = f"l{k}"
    return f"""with {SQL_READS}, m as (select ctype as c, count(*) * 1e0 / sum(count(*)) over () as margin from v_reads group by ctype),
w as (select dmr_ctype as c, p_ctype / any_value(margin) as a, (1 - p_ctype) / (1 - any_value(margin)) as b, count(*) as w from v_reads join m on c = dmr_ctype group by dmr_ctype, p_ctype),
l0 as (select c, 1e-10 as low, 1e-4 as step from m),
{", ".join(levels)},
e as (select c, low / sum(low) over () as pred from {before})
select e.c as cell_type, round(any_value(pred), 4) as pred, round(-sum(w * ln((1 - pred) * b + pred * a)), 4) as nll from e join w on w.c = e.c group by e.c"""


DORADO_SQL = f"""with {SQL_SEQ}, l as (select doc_id, seq, i, substr(seq, i, 2) = 'CG' as cpg, (i * 37 + doc_id) % 256 as prob from v_seq, range(1, length(seq) + 1) as g(i) where seq like '%CG%'),
h as (select doc_id, count(*) filter (cpg and i % 3 <> 0) as mods from l group by doc_id),
c as (select l.doc_id, i, case when not cpg then substr(seq, i, 1) when i >= length(seq) then 'C' when i % 3 = 0 then 'z' when prob >= 178 then 'Z' else 'z' end as c from l join h on h.doc_id = l.doc_id where mods > 0)
select doc_id, string_agg(c, '' order by i) as rf from c group by doc_id"""


@query(DORADO_SQL)
def dorado_calls(spark, sf_dir):
    """Modification lists written into references; a CpG without a call counts as unmethylated."""
    x = v_seq(spark, sf_dir).where(F.col("seq").contains("CG"))
    cpg = lambda r: F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (F.get(r, i) == "C") & (F.get(r, i + 1) == "G") & ((i + 1) % 3 != 0))
    at = let(letters(F.col("seq")), cpg)
    x = x.withColumn("m", F.transform(at, lambda i: F.struct(i.alias("pos"), (((i + 1) * 37 + F.col("doc_id")) % 256).cast("int").alias("prob"))))
    x = x.withColumn("h", F.lit(None).cast("array<struct<pos:int,prob:int>>")).withColumn("cigar", F.concat(F.length("seq").cast("string"), F.lit("M")))
    rf, _ = calls.dorado(F.col("seq"), F.col("seq"), F.col("cigar"), F.lit(0), F.col("h"), F.col("m"))
    return x.select("doc_id", rf.alias("rf")).where("rf is not null")


MOD_SQL = f"""with {SQL_SEQ}, s as (select doc_id, substr(seq, 1, 200) as seq from v_seq), l as (select doc_id, i - 1 as pos, row_number() over (partition by doc_id order by i) as k from s, range(1, length(seq) + 1) as g(i) where substr(seq, i, 1) = 'C')
select doc_id, count(*) as n, cast(sum(pos) as bigint) as places, cast(sum((k // 2 * 7) % 256) as bigint) as probs from l where k % 2 = 0 group by doc_id"""


@query(MOD_SQL)
def modification_tags(spark, sf_dir):
    """Every second cytosine by delta-coded tags, decoded to positions and probabilities."""
    x = v_seq(spark, sf_dir).select("doc_id", F.substring("seq", 1, 200).alias("seq"))
    n = F.floor(F.length(F.regexp_replace("seq", "[^C]", "")) / 2).cast("int")
    x = x.withColumn("n", n).where("n > 0").withColumn("mm", F.concat(F.lit("C+m"), F.repeat(F.lit(",1"), F.col("n")), F.lit(";")))
    x = x.withColumn("ml", F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: (i * 7 % 256).cast("int")))
    x = x.select("doc_id", F.explode(modtags.modifications(F.col("mm"), F.col("ml"), F.col("seq"), F.lit(0))["m"]).alias("m"))
    return x.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("m.pos").cast("long")).alias("places"), F.sum(F.col("m.prob").cast("long")).alias("probs"))


@query("select l_orderkey, l_linenumber, list_transform(range(1, l_linenumber + 1), lambda i: i * 10) = list_transform(range(1, l_linenumber + 1), lambda i: i * 10 + case when l_orderkey % 3 = 0 and i = 2 then 1 else 0 end) as same from lineitem")
def same_modification_places(spark, sf_dir):
    """Whether two lists of modifications hold the same positions."""
    mods = lambda shift: F.transform(F.sequence(F.lit(1), F.col("l_linenumber").cast("int")), lambda i: F.struct((i * 10 + shift(i)).alias("pos"), i.alias("prob")))
    odd = lambda i: F.when((F.col("l_orderkey") % 3 == 0) & (i == 2), 1).otherwise(0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", calls.same_positions(mods(lambda i: F.lit(0)), mods(odd)).alias("same"))


CUT = "cast('0x' || substr(md5(concat('3|', cast(doc_id as varchar), '|{0}|0')), 1, 12) as bigint) / 281474976710656e0"


@query(
    f"""with {SQL_SEQ}, k as ({KMER_SQL.format(c='seq')}), g as (select doc_id, list({ID_SQL} order by i) as ids from k group by doc_id),
u as (select v.doc_id, coalesce(ids, []) as ids, {CUT.format('truncate').replace('doc_id', 'v.doc_id')} as u, cast(floor({CUT.format('length').replace('doc_id', 'v.doc_id')} * 96) as int) + 5 as n from v_seq v left join g on g.doc_id = v.doc_id),
c as (select doc_id, case when u < 0.5 then ids[:n] else ids end as ids from u)
select doc_id, array_to_string(ids[:100] || [0 for x in range(100 - least(len(ids), 100))], ' ') as ids from c"""
)
def pretrain_inputs(spark, sf_dir):
    """Token ids of pretraining: every second row cut to a random length, then 100 places filled with pads."""
    x = v_seq(spark, sf_dir).select("doc_id", vocab.to_ids(kmer.kmers(F.col("seq"))).alias("ids"))
    ids = encode.fit(mask.truncated(F.col("ids"), F.col("doc_id"), 100, 3), 100, vocab.PAD)
    return x.select("doc_id", F.array_join(F.transform(ids, lambda i: i.cast("string")), " ").alias("ids"))


@query(
    f"""with {SQL_READS}, a as (select dmr_label, avg(p_ctype) as c from v_reads group by dmr_label)
select dmr_label, round(avg(power(p_ctype - c, 5)), 9) as m5, round(avg(power(p_ctype - c, 6)), 9) as m6 from v_reads join a using (dmr_label) group by dmr_label"""
)
def high_moments(spark, sf_dir):
    x = F.col("p_ctype")
    return v_reads(spark, sf_dir).groupBy("dmr_label").agg(*(F.round(moments.moment(x, k), 9).alias(f"m{k}") for k in (5, 6)))


@query(f"with {SQL_REGIONS} select region_id, chr, cast(rstart as bigint) as start, cast(rend as bigint) as \"end\", ctype, round(area_stat, 6) as strength from v_regions")
def region_file(spark, sf_dir):
    """A region table written as tab-separated text and read again, starts spelled as decimals and an index column without a name."""
    path = shared_folder(spark)
    x = region_table(spark, sf_dir).select(F.monotonically_increasing_id().alias(" "), "region_id", "chr", F.col("start").cast("double"), F.col("end").cast("double"), "ctype", "areaStat")
    tables.write_tsv(x.withColumnRenamed(" ", "_c0"), path)
    return tables.regions(spark, path).select(F.col("region_id").cast("long"), "chr", "start", "end", "ctype", F.round("areaStat", 6).alias("strength"))


@query(f"with {SQL_READS} select name, mate, ctype, dmr_ctype, cast(dmr_label as bigint) as dmr_label, cast(ctype = dmr_ctype as int) as ctype_label from v_reads")
def read_dataset_file(spark, sf_dir):
    """A read dataset written and read again, with its derived label."""
    path = shared_folder(spark)
    x = v_reads(spark, sf_dir).withColumns({"dna_seq": F.lit("ACG CGT"), "methyl_seq": F.lit("02"), "tags": F.create_map(F.lit("XM"), F.lit("Z"))})
    tables.write_reads(x, path)
    got = tables.reads(spark, path).where("XM = 'Z' and dna_seq = 'ACG CGT'")
    return got.select(F.col("name").cast("long"), F.col("mate").cast("int"), "ctype", "dmr_ctype", "dmr_label", "ctype_label")


@query("select 's3://reads/' || n_name || '.bam' as path, case when n_regionkey > 1 then 'T' end as ctype from nation")
def manifest_file(spark, sf_dir):
    """A list of files, some without a class."""
    path = shared_folder(spark)
    x = table(spark, sf_dir, "nation").select(F.concat(F.lit("s3://reads/"), "n_name", F.lit(".bam"), F.when(F.col("n_regionkey") > 1, "\tT").otherwise("")).alias("value"))
    x.write.text(path)
    return tables.manifest(spark, path)


@query(f"with {SQL_SEQ}, k as ({KMER_SQL.format(c='seq')}) select string_agg(kmer, ' ' order by i) as sentence, count(distinct doc_id) as n from k group by doc_id having count(*) < 400")
def sentence_file(spark, sf_dir):
    """A pretraining corpus written as text and read again."""
    path = shared_folder(spark)
    x = v_seq(spark, sf_dir).select(kmer.kmers(F.col("seq")).alias("k")).where("size(k) between 1 and 399")
    tables.write_sentences(x.select(kmer.sentence(F.col("k")).alias("sentence")), path)
    return tables.sentences(spark, path).select("sentence", F.lit(1).cast("long").alias("n"))


@query(f"with {SQL_SEQ} select 'doc' || doc_id as contig, length(seq) as n, md5(seq) as digest from v_seq where length(seq) > 0")
def fasta_file(spark, sf_dir):
    """A genome written as lines of 60 bases in lower case, read again in pieces, and put together."""
    path = shared_folder(spark)
    x = v_seq(spark, sf_dir).where("length(seq) > 0").select(F.concat(F.lit(">doc"), "doc_id", F.lit(" words\n"), F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n")).alias("value"))
    x.write.text(path)
    pieces = fasta.genome_chunks(fasta.contig_lines(spark, path), 512, 0)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin", "seq"))), lambda p: p["seq"]), "")  # contigs of this table fit a cell
    return pieces.groupBy("contig").agg(whole.alias("seq")).select("contig", F.length("seq").cast("long").alias("n"), F.md5(F.col("seq").cast("binary")).alias("digest"))


@query(f"with {SQL_READS} select name, chr, cast(pos as bigint) as pos, qlen, case when mate % 2 = 0 then 'Z' || mate end as xm from v_reads where mate <> 3")
def sam_file(spark, sf_dir):
    """Reads written as SAM text with a header and unmapped ones, read again and placed."""
    path = shared_folder(spark)
    n = F.col("qlen").cast("string")
    xm = F.when(F.col("mate") % 2 == 0, F.concat(F.lit("\tXM:Z:Z"), F.col("mate").cast("string"))).otherwise("")
    line = F.concat_ws("\t", F.col("name").cast("string"), F.when(F.col("mate") == 3, "4").otherwise("0"), "chr", (F.col("pos") + 1).cast("string"), F.lit("60"), F.concat(n, F.lit("M3I2D"), F.lit("4S")), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"))
    x = v_reads(spark, sf_dir).select(F.concat(line, xm).alias("value"))
    x.unionByName(spark.createDataFrame([("@HD\tVN:1.6",)], "value string")).write.text(path)
    got = sam.placed(sam.sam(spark, path))
    return got.select(F.col("name").cast("long"), "chr", "pos", (F.col("qlen") - 3).cast("int").alias("qlen"), F.col("tags")["XM"].alias("xm"))


def register_mixture() -> None:
    from readloom.plans.registry import SQL

    SQL["mixture_solve"] = mixture_sql()


register_mixture()
