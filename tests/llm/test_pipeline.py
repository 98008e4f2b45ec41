"""The corpus pipeline's stages against plain statements of what each keeps."""

import hashlib
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from readloom.llm import bpe_automaton, mixing, quality_crf, simhash

SF = "/root/testdata/sf0.001"


def frame(df):
    return df.toPandas().sort_values("doc_id").reset_index(drop=True)


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixing", "encoding"]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    all_docs = frame(docs)

    kept = stages["quality"](spark, docs, SF)
    model = quality_crf.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = all_docs[model.scores([t.encode() for t in all_docs["text"]]) >= 0.7]
    kept_rows = frame(kept)
    assert kept.columns == docs.columns and kept_rows.equals(good.reset_index(drop=True)) and 0 < len(good) < len(all_docs)

    one = stages["near_duplicates"](spark, kept, SF)
    fp = simhash.fingerprints_of([t.encode() for t in good["text"]]).view(np.uint64)
    seen, least = set(), []
    for i in range(len(fp)):
        if i in seen:
            continue
        least.append(i)
        front = [i]
        while front:
            near = np.flatnonzero(np.bitwise_count(fp ^ fp[front.pop()]) <= 3).tolist()
            front += [j for j in near if j not in seen]
            seen.update(near)
    assert one.columns == docs.columns and frame(one)["doc_id"].tolist() == sorted(good["doc_id"].iloc[least])

    mixed = stages["mixing"](spark, one, SF)
    con = duckdb.connect()
    con.register("documents", frame(one))
    times = {i: c for i, c in con.execute(f"select doc_id, copies from ({mixing.SQL})").fetchall() if c}
    rows = frame(mixed)
    assert mixed.columns == docs.columns and Counter(rows["doc_id"]) == times

    got = frame(stages["encoding"](spark, mixed, SF))
    tk = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = [tk.encode(t, add_special_tokens=False).ids for t in rows["text"]]
    assert got["n_tokens"].tolist() == list(map(len, ids))
    assert got["ids_sha256"].tolist() == [hashlib.sha256(",".join(map(str, i)).encode()).hexdigest() for i in ids]
    assert got["decoded_sha256"].tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in rows["text"]]
    assert frame(corpus_pipeline.run(spark, SF)).equals(got)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, hash long, size long, id long, copies int"
GOOD = "The thing that was in the other place is not there now, and we are to go on with it as it is."


def odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, and further columns with the operators' own names."""
    texts = [GOOD, GOOD, None, "", " \n", GOOD + " And so it went on for a while.", "x### y$$$ z%%% !!! | " * 40, (GOOD + "\n") * 20000, "a" * 100_000]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 2}" if i % 3 else None, None, 1, 2, 3, 4, 5) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[3], (None, GOOD, None, None, None, None, None, None, None, None), (None,) * 10]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_stages_of_odd_rows_and_empty_tables(spark):
    labels = f"{SF}/labels.parquet"
    stages, docs = dict(corpus_pipeline.STAGES), odd_rows(spark)
    rows = [tuple(r) for r in docs.collect()]
    model = quality_crf.train(docs, spark.read.parquet(labels))
    kept = stages["quality"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter(r for r in rows if model.scores([r[1] and r[1].encode()])[0] >= 0.7)
    one = [tuple(r) for r in stages["near_duplicates"](spark, docs, SF).collect()]
    fp = {t: int(f) for t in {r[1] for r in rows} for f in simhash.fingerprints_of([t and t.encode()]).view(np.uint64)}
    near = lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3
    assert set(one) <= set(rows) and Counter(r for r in one if r[0] is None) == Counter(r for r in rows if r[0] is None)
    ids = [r[0] for r in one if r[0] is not None]
    assert len(ids) == len(set(ids)) and not any(near(a[1], b[1]) for a in one for b in one if a[0] is not None and b[0] is not None and a[0] != b[0])
    assert all(any(near(r[1], x[1]) for x in rows if x[0] in ids) for r in rows)
    mixed = stages["mixing"](spark, docs, SF)
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] += r.copies
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == +copies
    got = stages["encoding"](spark, docs, SF)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in rows) and {r.n_tokens for r in got.where("doc_id in (2, 3)").collect()} == {0}
    for stage in stages.values():
        assert not stage(spark, docs.limit(0), SF).count()


def test_run_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert not corpus_pipeline.run(spark, str(tmp_path)).count()


def test_repeated_ids_lose_copies_only(spark):
    a, b, c = ("%s one two three four five six seven" % x * 3 for x in ("red", "blue", "green"))
    fp = simhash.fingerprints_of([x.encode() for x in (a, b, c)]).view(np.uint64)
    assert all(np.bitwise_count(fp[i] ^ fp[j]) > 3 for i, j in ((0, 1), (0, 2), (1, 2)))
    rows = [(5, a, 1), (5, b, 1), (3, b, 1), (9, a.upper(), 1), (7, c, 1), (7, c, 1), (8, c, 1), (None, c, 1)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, fp long").repartition(3))
    assert got.columns == ["doc_id", "text", "fp"] and Counter(map(tuple, got.collect())) == Counter([(5, a, 1), (3, b, 1), (7, c, 1), (None, c, 1)])
    both = simhash.one_of_each(spark.createDataFrame([(5, a), (5, b)], "doc_id long, text string"))
    assert Counter(map(tuple, both.collect())) == Counter([(5, a), (5, b)])


@pytest.mark.parametrize("copies", [1, 9])
def test_near_duplicates_shuffle_no_texts(spark, copies):
    """Whichever are fewer, ids that go or ids that stay; beyond `few` the rows are the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.range(copies).withColumnRenamed("id", "k")
    docs = docs.crossJoin(more).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id") + F.col("k") * 1000)).drop("k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, none = simhash.one_of_each(docs), simhash.one_of_each(docs, few=0)
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (few, none)]
        rows = [Counter(map(tuple, x.collect())) for x in (few, none)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning" not in plans[0] and "BroadcastHashJoin" in plans[0] and "hashpartitioning" in plans[1]
    assert ("LeftAnti" in plans[0]) == (copies == 1) and few.columns == docs.columns
    assert rows[0] == rows[1] and sum(n for r, n in rows[0].items() if r[0] is None) == 4 * copies


def test_stages_send_small_batches_unless_a_size_is_set(spark):
    name, docs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    before = spark.conf.get(name, None)
    try:
        for size, held in ((None, "4m"), ("9m", "9m")):
            spark.conf.set(name, size) if size else spark.conf.unset(name)
            dict(corpus_pipeline.STAGES)["encoding"](spark, docs, SF)
            assert spark.conf.get(name) == held
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


class Caught:
    """In the place of a DataFrame: gives the function that workers would run."""

    schema, columns = {"doc_id": type("Id", (), {"dataType": type("Long", (), {"simpleString": lambda _: "bigint"})()})()}, ["doc_id", "text"]

    def select(self, *_):
        return self

    def withColumnRenamed(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


def test_a_worker_holds_little_and_nothing_of_another_stage(spark):
    """One worker serves all stages, so what one leaves there adds to the next."""
    texts = [("Some words of a line, 17 of them.\n" * 40 + str(k)) for k in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(texts)], ["id", "text"])
    encoding, quality, near = (f(Caught()).run for f in (lambda d: bpe_automaton.encode_decode(d, P.path("byte_bpe_50k.json")), lambda d: quality_crf.keep_good(d, quality_crf.Model()), simhash.fingerprints))
    for run in (quality, near):
        list(encoding([batch.slice(0, 2)]))
        assert bpe_automaton.tokenizer.cache_info().currsize == 1
        list(run([batch.slice(0, 2)]))
        assert bpe_automaton.tokenizer.cache_info().currsize == 0
    list(encoding([batch.slice(0, 2)]))
    loaded = bpe_automaton.tokenizer(P.path("byte_bpe_50k.json"))
    list(encoding([batch.slice(0, 2)]))
    assert bpe_automaton.tokenizer(P.path("byte_bpe_50k.json")) is loaded
    tracemalloc.start()
    try:
        for _ in quality([batch]):
            pass
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 50e6, most


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
