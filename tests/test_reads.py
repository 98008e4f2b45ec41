"""Sequence functions against plain statements of their rules, and hand-made files end to end."""

import gzip
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.functions import calls, cigar, encode, kmer, losses, mask, modtags, vocab
from readloom.operators import corpus, labels, overlap, regions, split
from readloom.plans import pipelines
from readloom.plans.extract import Options
from readloom.plans.likelihood import best_on_grid, grid_likelihood
from readloom.plans.purity import adjusted_purity, deconvolve, mixture, purity, quasi_newton, squared_skewness
from readloom.plans.scorer import BatchScorer, LinearScorer, Steps, loss_and_slope
from readloom.sources import fasta, sam, tables


def one(df, column):
    return df.select(column.alias("x")).first()["x"]


def laid_out(tag, text):
    out, at = "", 0
    for n, op in re.findall(r"(\d+)(\D)", text):
        n = int(n)
        if op == "D":
            out += "D" * n
            continue
        if op not in "SI":
            out += tag[at : at + n]
        at += n
    return out


def random_cigar(rng, n):
    text, left = "", n
    while left:
        k = rng.randint(1, left)
        op = rng.choice("MMMISNX")
        text += f"{k}{op}"
        left -= k
        if rng.random() < 0.3:
            text += f"{rng.randint(1, 3)}D"
    return text


def test_kmers(spark):
    df = spark.createDataFrame([("ACzGT",), ("AC",), ("",), (None,)], "s string")
    got = df.select(kmer.sentence(kmer.kmers(F.col("s"))).alias("d"), kmer.digits(kmer.call_codes(F.col("s"))).alias("m")).collect()
    assert [(r.d, r.m) for r in got] == [("ACC CCG", "20"), ("", ""), ("", ""), ("", "")] or [(r.d, r.m) for r in got][:3] == [("ACC CCG", "20"), ("", ""), ("", "")]
    with pytest.raises(ValueError):
        kmer.kmers(F.col("s"), 4)


def test_cigar(spark):
    rng = random.Random(1)
    rows = [("abcde", "1S2M1D1I1M"), ("abcd", "1M2N1M")]
    for _ in range(200):
        tag = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12)))
        rows.append((tag, random_cigar(rng, len(tag))))
    got = spark.createDataFrame(rows, "t string, c string").select("t", "c", cigar.project(F.col("t"), F.col("c")).alias("x"), cigar.aligned_bases(F.col("c")).alias("n")).collect()
    assert got[0].x == "bcDe" and got[1].x == "abcd"
    assert all(r.x == laid_out(r.t, r.c) for r in got)
    assert all(r.n == sum(int(n) for n, op in re.findall(r"(\d+)(\D)", r.c) if op in "MI=X") for r in got)


def bismark_rule(ref, xm, text, flag):
    if flag & 1024 or xm is None or not re.search("[zZ]", xm) or "CG" not in ref:
        return None
    tag, out = laid_out(xm, text), list(ref)
    at = lambda i: tag[i] if i < len(tag) else "."
    first = (bool(flag & 16) != bool(flag & 64)) if flag & 1 else not flag & 16
    for i in range(len(ref)):
        if ref[i : i + 2] == "CG":
            c = "." if i >= len(tag) else at(i) if first else at(i + 1)
            if c in ".D":
                out[i] = "C"
            elif c in "xhXH":
                if "D" not in (at(i), at(i + 1)):
                    return "!"
                out[i] = "C"
            else:
                out[i] = c
    return "".join(out)


def test_bismark(spark):
    rng = random.Random(2)
    rows = [("ACGT", ".Z..", "4M", 0), ("ACGT", "..z.", "4M", 16), ("ACGT", ".Z..", "4M", 16)]
    for _ in range(400):
        ref = "".join(rng.choice("ACGCG") for _ in range(rng.randint(1, 12)))
        xm = "".join(rng.choice(".zZzZ.xh") for _ in range(len(ref)))
        rows.append((ref, xm, random_cigar(rng, len(xm)), rng.choice([0, 16, 99, 147, 83, 163, 1024])))
    df = spark.createDataFrame(rows, "r string, x string, c string, f int")
    seq, problem = calls.bismark(F.col("r"), F.col("x"), F.col("c"), F.col("f"))
    got = df.select("*", seq.alias("s"), problem.alias("p")).collect()
    assert [g.s for g in got[:3]] == ["AZGT", "AzGT", "ACGT"]
    for g in got:
        rule = bismark_rule(g.r, g.x, g.c, g.f)
        assert (g.s, g.p is not None) == ((None, True) if rule == "!" else (rule, False))


def test_dorado(spark):
    mods = "array<struct<pos:int,prob:int>>"
    rows = [("ACGTA", "ACGTA", "5M", 0, [(1, 77)], [(1, 100)]), ("ACGTA", "ACGTA", "5M", 0, [(1, 78)], [(1, 100)]), ("ACGTA", "ACGTA", "5M", 16, None, [(2, 200)]), ("ACGTA", "ACGTA", "5M", 0, [(0, 1)], [(1, 1)]), ("ACGCG", "ACGCG", "5M", 0, None, [(1, 200)]), ("ACGTA", "ACGTA", "5M", 0, None, None), ("ACGTA", "ACGTA", "2H5M", 0, None, [(1, 200)])]
    df = spark.createDataFrame(rows, f"r string, q string, c string, f int, h {mods}, m {mods}")
    seq, problem = calls.dorado(*map(F.col, "rqcfhm"))
    got = df.select(seq.alias("s"), problem.alias("p")).collect()
    assert [g.s for g in got] == ["AzGTA", "AZGTA", "AZGTA", None, "AZGzG", None, None]
    assert [g.p is not None for g in got] == [False, False, False, True, False, False, False]
    skipped = df.select(calls.dorado(*map(F.col, "rqcfhm"), uncalled="skip")[0].alias("s")).collect()
    assert skipped[4].s == "AZGCG"


def test_modification_tags(spark):
    d = modtags.decode_one
    assert d("C+m,0,1;", [200, 10], "ACCGC", False) == {"h": None, "m": [{"pos": 1, "prob": 200}, {"pos": 4, "prob": 10}]}
    assert d("C+hm?,1;", [5, 250], "ACCG", False) == {"h": [{"pos": 2, "prob": 5}], "m": [{"pos": 2, "prob": 250}]}
    assert d("C+m,0;", [9], "ACGT", True) == {"h": None, "m": [{"pos": 2, "prob": 9}]}
    assert d("A+a,0;C+m,0;", [1, 7], "AC", False)["m"] == [{"pos": 1, "prob": 7}]
    assert d(None, None, "AC", False) == {"h": None, "m": None}
    df = spark.createDataFrame([("C+m,0;", [9], "ACGT", 0), (None, None, None, 0)], "mm string, ml array<int>, s string, f int")
    got = df.select(modtags.modifications(*map(F.col, ("mm", "ml", "s", "f"))).alias("x")).collect()
    assert got[0].x.m[0].prob == 9 and got[0].x.h is None and got[1].x.m is None


def test_vocabulary_and_frames(spark):
    df = spark.createDataFrame([(["AAA", "ACG", "TTT", "NNN", "<mask>"], [7, 8], [7, 8, 9, 10])], "t array<string>, a array<int>, b array<int>")
    assert one(df, vocab.to_ids(F.col("t"))) == [5, 11, 68, 1, 4] and vocab.size() == 69 == len(vocab.token_list())
    assert one(df, vocab.to_sentence(vocab.to_ids(F.col("t")))) == "AAA ACG TTT <unk> <mask>"
    assert one(df, encode.frame_ids(F.col("a"), 4)) == [3, 7, 8, 2, 0] and one(df, encode.frame_ids(F.col("b"), 4)) == [3, 7, 8, 9, 2]
    assert one(df, encode.sequence_of(F.array(F.lit("<sos>"), F.lit("ACG"), F.lit("CGT")))) == "ACGT"
    assert one(df, vocab.to_tokens(F.array(F.lit(0), F.lit(99), F.lit(5)), drop_pads=True)) == ["<99>", "AAA"]


def test_masking(spark):
    df = spark.createDataFrame([(i, [5 + (i * j) % 64 for j in range(40)] + [0] * 5) for i in range(200)], "i int, ids array<int>")
    got = df.select("ids", mask.masked(F.col("ids"), F.col("i"), 69).alias("m")).collect()
    again = df.select(mask.masked(F.col("ids"), F.col("i"), 69).alias("m")).collect()
    assert [g.m for g in got] == [a.m for a in again]
    assert all(len(g.m.input) == 46 and g.m.input[0] == 3 and g.m.input[40] == 2 and g.m.label[0] == -100 for g in got)
    chosen = sum(sum(g.m.mask) for g in got) / (200 * 40)
    assert 0.12 < chosen < 0.18
    for g in got:
        for i in range(40):
            near = any(g.m.mask[1 + j] for j in (i - 1, i, i + 1) if 0 <= j < 40)
            assert (g.m.label[1 + i] == g.ids[i]) if near else (g.m.label[1 + i] == -100)
    assert mask.neighbours(3) == [-1, 1] and mask.neighbours(4) == [-1, 1, -2]


@pytest.mark.parametrize("compatible", [False, True])
def test_corpus_windows_by_blocks(spark, compatible):
    """A file in blocks of any size gives the windows of the whole; also where a header, a gap or a blank line ends a block."""
    rng = random.Random(8)
    for turn in range(4):
        lines = []
        for f in "ab":
            text = [rng.choice([">chr1", ">chr2 x", ">chrM", ">chrUn"])] + ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 14))) if rng.random() < 0.85 else rng.choice(["ANA", ">chr3", ">chrN", "NN", ">chrM"]) for _ in range(60)]
            text.insert(rng.randint(30, 60), "")
            lines += [(f, i, t) for i, t in enumerate(text)]
        size = rng.choice([1, 3, 7, 20])
        whole = spark.createDataFrame(lines, "file string, line_no long, line string")
        parted = spark.createDataFrame([(f, i // size * 1000, i % size, t) for f, i, t in lines], "file string, block long, line_no long, line string")
        rows = lambda x: sorted(map(tuple, x.select("file", "run", "chunk", "sentence").collect()))
        expected = rows(corpus.windows(whole, 9, 3, compatible, "file"))
        assert expected and rows(corpus.windows(parted, 9, 3, compatible, "file", "block")) == expected


def test_slopes_of_losses(spark):
    z, y = np.linspace(-4, 4, 17), np.arange(17) % 2
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(z, y)], "z double, y int")
    for name, column in (("cross_entropy", losses.cross_entropy(F.lit(0.0), F.col("z"), F.col("y"))), ("focal", losses.sigmoid_focal(F.col("z"), F.col("y")))):
        each, slope = loss_and_slope(z, y, name)
        assert np.allclose(each, [r.x for r in df.select(column.alias("x")).collect()])
        assert np.allclose(slope, (loss_and_slope(z + 1e-6, y, name)[0] - each) / 1e-6, atol=1e-4)


def test_false_in_a_file_of_options(spark, tmp_path):
    tables.write_config({"ignore_sex_chromo": False, "n_dmrs": None, "seed": 3}, str(tmp_path / "o.json"))
    assert tables.read_config(str(tmp_path / "o.json")) == {"ignore_sex_chromo": False, "seed": 3}


def test_adjustment_over_several_regions(spark):
    """Shares that lie evenly about their mean need no weights; skewed ones get weights under which they are hardly skewed."""
    even = [0.1, 0.2, 0.3, 0.4, 0.5]
    df = lambda x: spark.createDataFrame(list(enumerate(x)), "dmr_label int, theta double")
    assert abs(adjusted_purity(df(even)) - 0.3) < 1e-9 and adjusted_purity(df([0.7])) == 0.7
    skewed = [0.2, 0.21, 0.22, 0.23, 0.9, 0.24, 0.2, 0.25]
    x = np.array(skewed)
    estimate = x.mean()
    w = quasi_newton(lambda w: squared_skewness(x * w, estimate), np.ones(len(x)))
    assert squared_skewness(x * w, estimate) < 1e-3 * squared_skewness(x, estimate)
    assert abs(adjusted_purity(df(skewed), rounds=1) - np.clip((x * w).mean(), 0, 1)) < 1e-9
    assert 0 <= adjusted_purity(df(skewed)) <= 1


def test_losses(spark):
    df = spark.range(11)
    got = [r.x for r in df.select(losses.rate_multiplier(F.col("id"), 3, 6, 10).alias("x")).collect()]
    assert [got[i] for i in (0, 3, 5, 6, 8, 10)] == [0, 1, 1, 1, 0.5, 0]
    with pytest.raises(ValueError):
        losses.reduced(F.col("id"), "median")


def test_regions(spark):
    rows = [("chr1", 1, 9, "T", 3.0), ("chr2", 1, 9, "T", -7.0), ("chr3", 1, 9, "N", 5.0), ("chrX", 1, 9, "N", None), ("chr1_random", 1, 9, "N", 1.0), ("chrM", 1, 9, "N", 99.0)]
    df = spark.createDataFrame(rows, "chr string, start long, end long, ctype string, areaStat double")
    kept = regions.select_contigs(df)
    assert sorted(r.chr for r in kept.collect()) == ["chr1", "chr1_random", "chr2", "chr3"]
    top = regions.top_regions(regions.select_contigs(df, ignore_sex=False), 2).collect()
    assert [(r.chr, r.dmr_id) for r in top] == [("chr2", 0), ("chr1", 1), ("chr3", 2), ("chr1_random", 3)]
    with pytest.raises(ValueError):
        regions.top_regions(df.drop("ctype"))
    g = spark.createDataFrame([("1",), ("chr2",)], "contig string")
    assert sorted(r.contig for r in regions.harmonise_contigs(g, True).collect()) == ["chr1", "chr2"]
    assert sorted(r.contig for r in regions.harmonise_contigs(g, False).collect()) == ["1", "2"]


def test_containment(spark):
    rng = random.Random(3)
    reads = [("a", 100, 100), ("a", 99, 10), ("a", 150, 51), ("b", 100, 1), ("a", 200, 0)] + [(rng.choice("ab"), rng.randint(0, 600), rng.randint(0, 60)) for _ in range(300)]
    regs = [("a", 100, 200)] + [(rng.choice("ab"), s := rng.randint(0, 500), s + rng.randint(0, 200)) for _ in range(60)]
    r, q = spark.createDataFrame(regs, "chr string, start long, end long"), spark.createDataFrame(reads, "chr string, pos long, qlen int")
    brute = sorted((c, p, n, s, e) for c, p, n in reads for d, s, e in regs if c == d and p >= s and p + n <= e)
    for x in (overlap.contained(q, r), overlap.contained_binned(q, r, 64), overlap.contained(q, r, few=3), overlap.contained(q, r, few_bytes=10)):
        assert sorted(map(tuple, x.select("chr", "pos", "qlen", "r_start", "r_end").collect())) == brute


def test_containment_counted_without_pairs(spark):
    rng = random.Random(4)
    reads = [("a", 100, 100), ("a", 100, 100), (None, 1, 1), ("a", None, 1), ("a", 1, None), ("a", -9, 300), ("b", 5, -2)]
    reads += [(rng.choice("abd"), rng.randint(-50, 600), rng.choice([0, 1, rng.randint(0, 60), rng.randint(0, 400)])) for _ in range(400)]
    regs = [("a", 100, 200, "x"), ("a", None, 9, "x"), ("a", 9, None, "x"), ("e", 0, 900, "x"), ("a", 40, 30, "z"), ("b", -70, 500, None)]
    regs += [(rng.choice("abc"), s := rng.randint(-60, 500), s + rng.choice([0, 1, rng.randint(0, 30), rng.randint(0, 300)]), rng.choice("xy")) for _ in range(200)]
    r, q = spark.createDataFrame(regs, "chr string, start long, end long, kind string"), spark.createDataFrame(reads, "chr string, pos long, qlen int")
    brute = {}
    for c, p, n in reads:
        for d, s, e, k in regs:
            if None not in (c, p, n, s, e) and c == d and p >= s and p + n <= e:
                m, t = brute.get((c, k), (0, 0))
                brute[c, k] = (m + 1, t + p)
    for width in (1 << 16, 64, 1):
        assert {(x.chr, x.kind): (x.n, x.places) for x in overlap.contained_totals(q, r, "kind", width).collect()} == brute
    none = q.where("pos is null and qlen > 5")
    assert not overlap.contained_totals(none, r, "kind").count() and not overlap.contained_totals(q, r.where("start = 1e6"), "kind").count()


@pytest.mark.parametrize("name", ["overlap_containment", "overlap_binned"])
def test_containment_makes_no_pairs(spark, name):
    from readloom.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert joins and not any("<=" in x or ">=" in x for x in joins)


def test_regions_alike_in_place_and_strength(spark):
    rows = [("chr1", 1, 9, "T", 3.0, i) for i in range(50)]
    df = spark.createDataFrame(rows[::-1], "chr string, start long, end long, ctype string, areaStat double, name long")
    assert [(x.name, x.dmr_id) for x in regions.top_regions(df.repartition(4), 10).collect()] == [(i, i) for i in range(10)]


def test_corpus_windows(spark):
    rows = [(i, t) for i, t in enumerate([">chr1", "ACGT", "AC", "GT", "NAC", "ACG"])]
    got = corpus.windows(spark.createDataFrame(rows, "line_no long, line string"), 4, 3).collect()
    assert [r.sentence for r in got] == ["ACG", "ACG"]
    rng = random.Random(4)
    for length in (3, 5, 8):
        lines = ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 12))) if rng.random() < 0.9 else "ANA" for _ in range(60)]
        expected, buffer = [], ""
        for line in lines:
            if "N" in line:
                buffer = ""
                continue
            buffer += line
            if len(buffer) >= length:
                expected.append(buffer[:length])
                buffer = buffer[length:]
        df = spark.createDataFrame([(0, ">chr2"), *((i + 1, x) for i, x in enumerate(lines))], "line_no long, line string")
        got = corpus.windows(df, length, 1).orderBy("run", "chunk").collect()
        assert [r.sentence.replace(" ", "") for r in got] == [e[:-1] for e in expected]


def test_purity_by_hand(spark):
    df = spark.createDataFrame([(0.9, 0.1, "T", 0, 1), (0.2, 0.8, "T", 0, 1)], "P_ctype double, P_N double, dmr_ctype string, dmr_label int, n_cpg int")
    best = best_on_grid(grid_likelihood(df, 0.5, 0.5, 10)).first()
    assert best.theta == 0.6 and abs(best.likelihood - 0.02058629) < 1e-6
    m = spark.createDataFrame([("N",), ("T",)], "ctype string")
    shares, fi = deconvolve(df, m, 10)
    assert {r.cell_type: round(r.pred, 9) for r in shares.collect()} == {"T": 0.6, "N": 0.4} and fi.columns == ["fi", "likelihood"]
    adjusted, by = deconvolve(df, m, 10, adjust=True)
    assert abs(sum(r.pred for r in adjusted.collect()) - 1) < 1e-9 and by.count() == 1
    with pytest.raises(ValueError):
        purity(df, labels.margins(m.where("ctype = 'T'")))
    with pytest.raises(ValueError):
        deconvolve(df.where("n_cpg > 5"), m)


def test_mixture_is_the_same_at_every_size(spark):
    """Confident scores, some beyond the sixth digit: as an exact table gives them, also where there are over 100,000."""
    rng = random.Random(11)
    rows = [(1 - p if rng.random() < share else p, k) for k, share in (("A", 0.6), ("N", 0.01), ("R", 0.3)) for p in (3e-8 * rng.random() for _ in range(40_000))]
    df = spark.createDataFrame(rows, "P_ctype double, dmr_ctype string").repartition(4)
    m = spark.createDataFrame([("A", 0.3), ("N", 0.5), ("R", 0.2)], "ctype string, margin double")
    a, b = ({r.cell_type: (r.pred, r.nll) for r in x.collect()} for x in (mixture(df, m), mixture(df, m, few=1 << 30)))
    assert df.distinct().count() > 100_000 and abs(sum(p for p, _ in a.values()) - 1) < 1e-9
    for k in "ANR":
        assert abs(a[k][0] - b[k][0]) < 1e-9 and abs(a[k][1] / b[k][1] - 1) < 1e-9


def test_grid_vectors_equal_exploded_grids(spark):
    rng = random.Random(9)
    rows = [(p := rng.random(), 1 - p, i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "P_ctype double, P_N double, dmr_label int")
    for groups in ((), ("dmr_label",)):
        a, b = (sorted(map(tuple, grid_likelihood(df, 0.4, 0.6, 50, groups, few).select(*groups, "i", F.round("ll", 6)).collect())) for few in (1000, 10))
        assert a == b and len(a) == 50 * 3 ** len(groups)


def test_split(spark):
    df = spark.createDataFrame([(i // 3, "TN"[i // 3 % 2], i) for i in range(3000)], "name long, ctype string, i int")
    s = split.split(df, "name", 0.7, 5)
    n = {r.part: r["count"] for r in s.groupBy("part").count().collect()}
    assert abs(n["train"] / 3000 - 0.7) < 0.05 and s.groupBy("name").agg(F.count_distinct("part").alias("k")).where("k > 1").count() == 0
    three = split.split(df, "name", (0.5, 0.25, 0.25), 5).select("part").distinct().count()
    by_hash = split.split(df, "name", 0.7, 5, by_hash=True).where("part = 'train'").count()
    assert three == 3 and abs(by_hash / 3000 - 0.7) < 0.08
    with pytest.raises(ValueError):
        split.split_mode((0.5, 0.5, 0.5))
    with pytest.raises(ValueError):
        Options("other")


def write_bam(path, refs, records):
    body = b"BAM\1" + struct.pack("<ii", 0, len(refs))
    for name, n in refs:
        body += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    for name, flag, ref, pos, ops, seq, tags in records:
        packed = bytes(sam.BASES.index(a) << 4 | (sam.BASES.index(b) if b else 0) for a, b in zip(seq[::2], [*seq[1::2], *[""] * (len(seq) % 2)]))
        r = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        r += b"".join(struct.pack("<I", n << 4 | sam.OPERATIONS.index(op)) for n, op in ops) + packed + b"\x1e" * len(seq)
        for key, kind, value in tags:
            r += key.encode() + kind.encode() + (value.encode() + b"\0" if kind == "Z" else value)
        body += struct.pack("<i", len(r)) + r
    path.write_bytes(gzip.compress(body[:100]) + gzip.compress(body[100:]))


def test_files_end_to_end(spark, tmp_path):
    rng = random.Random(6)
    genome = {f"chr{c}": "".join(rng.choice("ACGTCG") for _ in range(700)) for c in (1, 2)}
    (tmp_path / "ref.fa").write_text("".join(f">{c} words\n" + "\n".join(s.lower()[i : i + 60] for i in range(0, 700, 60)) + "\n" for c, s in genome.items()))
    (tmp_path / "dmrs.csv").write_text("chr\tstart\tend\tareaStat\tctype\n" + "".join(f"{c}\t{s}\t{s + 300}.0\t{s + 5}\tT\n" for c in genome for s in (0, 350)))
    paths = []
    for ctype in "TN":
        recs, lines = [], ["@HD\tVN:1.6"]
        for i in range(60):
            c = rng.choice((1, 2))
            pos = rng.choice((0, 350)) + rng.randint(0, 200)
            ref = genome[f"chr{c}"][pos : pos + 80]
            xm = "".join((("Z" if ctype == "T" else "z") if ref[k : k + 2] == "CG" else ".") for k in range(80))
            recs.append((f"{ctype}{i}", 0, c - 1, pos, [(80, "M")], ref, [("XM", "Z", xm), ("NM", "C", b"\3"), ("ZB", "B", b"S" + struct.pack("<I2H", 2, 7, 8))]))
            lines.append(f"{ctype}{i}\t0\tchr{c}\t{pos + 1}\t60\t80M\t*\t0\t0\t{ref}\t{'?' * 80}\tXM:Z:{xm}\tNM:i:3\tZB:B:S,7,8")
        write_bam(tmp_path / f"{ctype}.bam", [("chr1", 700), ("chr2", 700)], recs)
        (tmp_path / f"{ctype}.sam").write_text("\n".join(lines) + "\n")
        a = sam.bam(spark, str(tmp_path / f"{ctype}.bam")).drop("path").toPandas().astype(str)
        b = sam.sam(spark, str(tmp_path / f"{ctype}.sam")).drop("path").toPandas().astype(str)
        assert a.drop(columns="tags").equals(b.drop(columns="tags")) and set(a["tags"].map(lambda t: "".join(sorted(t)))) == set(b["tags"].map(lambda t: "".join(sorted(t))))
        paths.append(f"{tmp_path}/{ctype}.bam\t{ctype}")
    (tmp_path / "files.tsv").write_text("\n".join(paths) + "\n")
    chunks = fasta.genome_chunks(fasta.contig_lines(spark, str(tmp_path / "ref.fa")), 256, 100).collect()
    assert all(r.seq == genome[r.contig][r.bin * 256 : r.bin * 256 + 356] for r in chunks) and len(chunks) == 6
    out = str(tmp_path / "out")
    got = pipelines.preprocess(spark, str(tmp_path / "dmrs.csv"), str(tmp_path / "ref.fa"), out, sc_dataset=str(tmp_path / "files.tsv"), split_ratio=0.7)
    n = got.count()
    assert n > 100
    train, test = (tables.reads(spark, f"{out}/{f}") for f in ("train_seq.csv", "test_seq.csv"))
    assert train.count() + test.count() == n and abs(train.count() / n - 0.7) < 0.06
    first = train.first()
    assert len(first.dna_seq.split(" ")) == len(first.methyl_seq) == 77
    pipelines.finetune(spark, f"{out}/train_seq.csv", f"{out}/model", f"{out}/test_seq.csv", iterations=5)
    assert {r.n_dmrs for r in labels.n_regions(train).collect()} == {4}
    assert tables.tsv(spark, f"{out}/model/train.csv").columns == ["step", "loss"]
    stepped = pipelines.finetune(spark, f"{out}/train_seq.csv", f"{out}/steps", f"{out}/test_seq.csv", steps=12, warmup=3, decrease=9, lr=0.1, loss="focal", eval_freq=5, save_freq=6, batches=2, features=512)
    log, evals = tables.tsv(spark, f"{out}/steps/train.csv").toPandas(), tables.tsv(spark, f"{out}/steps/eval.csv").toPandas()
    assert list(log.columns) == ["step", "loss", "ctype_acc", "lr"] and len(log) == 12 and set(evals["step"].astype(int)) == {5, 10, 12}
    assert float(log["loss"].iloc[-1]) < float(log["loss"].iloc[0]) and max(evals["ctype_acc"].astype(float)) > 0.9
    assert [round(float(r), 4) for r in log["lr"][[0, 2, 5, 8, 10]]] == [0.0333, 0.1, 0.1, 0.1, 0.0333]
    assert (LinearScorer.load(f"{out}/steps/read_model").weights == stepped.weights).all() and all(LinearScorer.load(f"{out}/steps/read_model_step{k}").features == 512 for k in (6, 12))
    by_steps = pipelines.deconvolute(spark, f"{out}/steps", f"{out}/test_seq.csv", f"{out}/stepped", n_grid=100)
    assert abs(sum(r.pred for r in by_steps.collect()) - 1) < 1e-9
    with pytest.raises(ValueError):
        Steps(loss="other")
    shares = pipelines.deconvolute(spark, f"{out}/model", f"{out}/test_seq.csv", f"{out}/result", n_grid=100, adjustment=True)
    assert abs(sum(r.pred for r in shares.collect()) - 1) < 1e-9
    assert tables.tsv(spark, f"{out}/result/FI.csv").count() == test.select("dmr_label").distinct().count()
    assert "P_ctype" in tables.tsv(spark, f"{out}/result/res.csv").columns
    spy = BatchScorer(lambda: lambda ids, codes, region: [[0.25, 0.75]] * len(ids), 150)
    assert {(r.P_N, r.pred) for r in spy.transform(test).select("P_N", "pred").collect()} == {(0.25, 1)}
    pipelines.corpus(spark, str(tmp_path / "ref.fa"), f"{out}/corpus", 60)
    assert tables.sentences(spark, f"{out}/corpus").count() == 22
