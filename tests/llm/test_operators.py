"""The ten operators against libraries, brute force and hard inputs: nulls in any column, empty and very long
texts, ties, repeated rows, empty tables and further columns whose names could clash."""

import hashlib
import itertools
import math
import re
import struct
import subprocess
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readloom.llm import bpe_automaton, common, cover_tree, jpeg_dc, lbl_lm, mixing, quality_crf, simhash, token_counts, training_order, url_cascade

TEXTS = [None, "", " ", "\n\n\t", "a", "A b\tC\nd", "two  spaces ▁ mark", "日本 x 🎉🎉 é ﬁ", "<s> </s> <|endoftext|> hi<|endoftext|>", "\0a\x1c b\x85c\xa0 d", "don't I'LL we'll x²½ ٣ ǅ", "a" * 30000, "aaa bbb " * 4000, "The the of of. " * 50, "SHOUT!! " * 40, "x | y | z"]
#: Further columns have the names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, token string, size long, hash long, row long, target double"


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, None, f"s{i % 3}" if i % 5 else None, None, 1, 2, "t", 3, 4, 5, 6.0) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, "no id", "en", "s1", 5, 1, 2, "t", 3, 4, 5, 6.0), (None, None, None, None, *[None] * 8)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def plain(df):
    return pd.DataFrame([tuple(r) for r in df.select("doc_id", "text").collect()], columns=["doc_id", "text"], dtype=object)


def by_id(df, *columns):
    return sorted(((r.doc_id, *(r[c] for c in columns)) for r in df.collect()), key=repr)


def test_token_counts(spark, hard, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for df in (hard, docs):
        got = token_counts.count_tokens(df, P.path("piece_bpe_32k.model"))
        expected = sorted(((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in plain(df).itertuples(index=False)), key=repr)
        assert by_id(got, "n_bytes", "n_tokens", "over_limit") == expected
    assert token_counts.count_tokens(hard.limit(0), P.path("piece_bpe_32k.model")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab ▁é\n日thein"), max_size=40))
def test_token_counts_of_any_text(text):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    m = token_counts.model(P.path("piece_bpe_32k.model"))
    assert m.count(text) == len(sp.encode(text)) == (m.merge(m.prefix + text.replace(" ", "▁")) if text else 0)


def test_bpe(spark, hard, docs):
    tk = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df in (hard, docs):
        expected = []
        for i, t in plain(df).itertuples(index=False):
            ids = tk.encode(t or "", add_special_tokens=False).ids
            expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(tk.decode(ids, skip_special_tokens=False))))
        got = bpe_automaton.encode_decode(df, P.path("byte_bpe_50k.json"), keep_ids=True)
        assert by_id(got, "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)
        assert all(r.decoded == (r.text or "") for r in got.where("doc_id is not null").join(df.select("doc_id", "text"), "doc_id").collect())
    assert bpe_automaton.encode_decode(hard.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def explicit(n, merges):
    """The gadgets with explicit states: arcs taken from the state after each token, and the living tokens."""
    gone, alive = {t: set() for t in range(n)}, set(range(n))
    for u, v, w in merges:
        if not {u, v} <= alive or v in gone[u]:
            continue
        alive.add(w)
        gone[w] = set(gone[v])
        gone[u].add(v)
        for arcs in gone.values():
            if u in arcs:
                arcs.add(w)
    return gone, alive


def merged(tokens, merges):
    for u, v, w in merges:
        out = []
        for t in tokens:
            if out and out[-1] == u and t == v:
                out[-1] = w
            else:
                out.append(t)
        tokens = out
    return tokens


def test_automaton_is_that_of_the_gadgets(monkeypatch):
    """Forked states and arcs against explicit states, for random merges over a small alphabet; also with a table that is often emptied."""
    rng = np.random.default_rng(1)
    for turn in range(30):
        monkeypatch.setattr(bpe_automaton, "STATES", 5 if turn % 2 else 1 << 20)
        labels, merges = {0: b"a", 1: b"b", 2: b"c"}, []
        while len(merges) < 12:
            u, v = (int(x) for x in rng.choice(list(labels), 2))
            if labels[u] + labels[v] not in labels.values():
                merges.append((u, v, len(labels)))
                labels[len(labels)] = labels[u] + labels[v]
        gone, alive = explicit(3, merges)
        a = bpe_automaton.Automaton(dict(labels), merges)
        assert set(labels) - alive == a.dead and all(a.leads(s, t) == (t not in gone[s]) for s in alive for t in alive)
        for word in map(bytes, itertools.product(b"abc", repeat=6)):
            assert a.tokens(word) == merged([{97: 0, 98: 1, 99: 2}[c] for c in word], merges)
        assert len(a.members) <= bpe_automaton.STATES


def test_automaton_of_the_real_file():
    """The first merges of the real file against explicit states, and all of it, word by word, against the library."""
    bpe = bpe_automaton.ByteBpe(P.path("byte_bpe_50k.json"))
    by_label = {label: t for t, label in bpe.automaton.labels.items()}
    arcs = sorted((time, u, v) for u, taken in bpe.automaton.removed.items() for v, time in taken.items())[:500]
    number = {by_label[bytes([b])]: b for b in range(256)}
    labels, merges = {b: bytes([b]) for b in range(256)}, []
    for _, u, v in arcs:
        w = by_label[bpe.automaton.labels[u] + bpe.automaton.labels[v]]
        number[w] = len(labels)
        merges.append((number[u], number[v], number[w]))
        labels[number[w]] = bpe.automaton.labels[w]
    gone, alive = explicit(256, merges)
    a = bpe_automaton.Automaton(dict(labels), merges)
    assert set(labels) - alive == a.dead and len(alive) > 700
    assert all(a.leads(s, t) == (t not in gone[s]) for s in alive for t in alive)
    rng = np.random.default_rng(2)
    for _ in range(200):
        word = bytes(rng.choice(list(b" theinorasd"), rng.integers(1, 30)))
        assert a.tokens(word) == merged(list(word), merges)
    tk = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for word in ("a" * 3000, " " * 2000 + "x", "".join(rng.choice(list("abcdefghij"), 5000))):
        assert ",".join(bpe.encode(word)) == ",".join(map(str, tk.encode(word, add_special_tokens=False).ids))


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    score, pair, doc = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3])
    p, pairs = quality_crf.marginals(score, pair, doc)
    for d in range(4):
        at = np.flatnonzero(doc == d)
        total, one, two = 0, np.zeros(len(at)), np.zeros((len(at), 2, 2))
        for z in itertools.product((0, 1), repeat=len(at)):
            w = math.exp(sum(score[i] / 2 * (2 * y - 1) for i, y in zip(at, z)) + sum(pair[a, b] for a, b in zip(z, z[1:])))
            total, one = total + w, one + w * np.array(z)
            for k in range(1, len(at)):
                two[k, z[k - 1], z[k]] += w
        assert np.allclose(one / total, p[at]) and np.allclose(two / total, pairs[at])


def plain_quality(model, text):
    """A text's quality by plain loops: features of lines, weights of a line and its neighbours, sums over all labellings by
    the chain rule, and the mean by bytes. Also the lines' chances of being good."""
    fold = lambda b: b.translate(simhash.LOWER)
    lines = [x for x in (text or b"").split(b"\n") if x.split()] or [b""]
    rows = []
    for line in lines:
        words, n = [fold(w) for w in line.split()], sum(c not in b" \t\n\v\f\r" for c in line)
        upper, lower = sum(65 <= c <= 90 for c in line), sum(97 <= c <= 122 for c in line)
        kinds = [sum(c in b"0123456789" for c in line), sum(c in b".,;:'\"-?()" for c in line), 0, line.count(b"|"), line.count(b"!"), sum(c >= 128 for c in line)]
        kinds[2] = n - upper - lower - sum(kinds)
        again = [sum(a == b for a, b in zip(words, words[k:])) / max(len(words), 1) for k in (1, 2)]
        rows.append([upper / max(upper + lower, 1), *(k / max(n, 1) for k in kinds), n / max(len(words), 1), len(words), again[0], sum(fold(x) == fold(line) for x in lines), again[1]])
    bins = [[sum(v >= e for e in edges) for v, edges in zip(row, quality_crf.EDGES)] for row in rows]
    none, f = [quality_crf.BINS] * len(quality_crf.EDGES), len(quality_crf.EDGES)
    score = []
    for i in range(len(bins)):
        near = [*(bins[i - 1] if i else none), *bins[i], *(bins[i + 1] if i + 1 < len(bins) else none)]
        score.append(sum(model.weights[k * (quality_crf.BINS + 1) + b] for k, b in enumerate(near)))
    assert len(near) == 3 * f
    unary = [(math.exp(-max(min(s, 60), -60) / 2), math.exp(max(min(s, 60), -60) / 2)) for s in score]
    ahead, back = [unary[0]], [(1.0, 1.0)]
    norm = lambda v: tuple(x / sum(v) for x in v)
    for u in unary[1:]:
        ahead.append(norm([sum(ahead[-1][a] * math.exp(model.pair[a, b]) for a in (0, 1)) * u[b] for b in (0, 1)]))
    for u in unary[:0:-1]:
        back.append(norm([sum(math.exp(model.pair[a, b]) * u[b] * back[-1][b] for b in (0, 1)) for a in (0, 1)]))
    p = [norm([x * y for x, y in zip(a, b)])[1] for a, b in zip(ahead, back[::-1])]
    size = [max(1, sum(c not in b" \t\n\v\f\r" for c in x)) for x in lines]
    return sum(a * b for a, b in zip(p, size)) / sum(size), p


def test_quality_by_plain_loops(monkeypatch):
    d, labels = (pd.read_parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    x = d.merge(labels, on="doc_id").head(150)
    lines = quality_crf.Lines([t.encode() for t in x["text"]])
    model = quality_crf.Model().fit(lines.bins, lines.doc, x["quality"].to_numpy(), lines.size)
    assert np.abs(model.pair).max() > 0.01
    texts = [*(t.encode() for t in d["text"].head(120)), *((t or "").encode() for t in TEXTS), b"x\r\n\r\nX \nx\n", b"A a A\na A a\n" * 5]
    expected = [plain_quality(model, t)[0] for t in texts]
    assert np.allclose(model.scores(texts), expected, atol=1e-9)
    monkeypatch.setattr(quality_crf, "MANY", 7)  # chains in blocks
    assert np.allclose(model.scores(texts), expected, atol=1e-9)
    monkeypatch.setattr(quality_crf, "PIECE", 3000)  # measured in pieces; here no line is longer
    short = [k for k, t in enumerate(texts) if max(map(len, t.split(b"\n"))) < 3000]
    assert len(short) > 100 and np.allclose(model.scores([texts[k] for k in short]), [expected[k] for k in short], atol=1e-9)


def test_lines_of_mixed_documents(monkeypatch):
    """Labels are of documents only; most lines of a document are of its kind, the others are found."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("etaoinshr"), rng.integers(2, 8)))
    clean = lambda: " ".join(word() for _ in range(10)) + "."
    junk = lambda: " ".join(word() + rng.choice(["###", "$$$", "%%%"]) for _ in range(10))
    texts, label, kinds = [], [], []
    for _ in range(300):
        y = int(rng.random() < 0.6)
        kind = np.where(rng.random(16) < 0.15, 1 - y, y)
        texts.append("\n".join(clean() if k else junk() for k in kind).encode())
        label.append(y)
        kinds.append(kind)
    lines = quality_crf.Lines(texts)
    model = quality_crf.Model().fit(lines.bins, lines.doc, np.array(label), lines.size)
    truth = np.concatenate(kinds)
    assert ((model.good(lines) > 0.5) == truth).mean() > 0.97 and (model.lines == truth).mean() > 0.95
    assert ((model.scores(texts) >= 0.7) == (np.array([k.mean() for k in kinds]) >= 0.7)).mean() > 0.8


def test_long_lines_are_cut_at_white_space():
    for text in (b"ab cd\nef gh ij", b"x" * 50, b"one two three four", b"\n\n\n\n\n", b"", b"a\n" * 20):
        for most in (1, 4, 9, 100):
            got = list(quality_crf.pieces(text, most))
            assert all(len(p) <= most for p in got) and b"".join(b"".join(p.split(b"\n")) for p in got) == text.replace(b"\n", b"")
    assert list(quality_crf.pieces(b"one two three", 6)) == [b"one ", b"two ", b"three"] and quality_crf.Lines([b"one two three"], 6).docs == 1
    assert len(quality_crf.Lines([b"one two three", b"", None], 6).doc) == 5


def test_quality(spark, hard):
    sf = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_crf.quality(d, labels).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    out = got[got["held_out"]]
    assert (out["predicted"] == out["quality"]).mean() > 0.97 and got["score"].between(0, 1).all()
    model = quality_crf.train(d, labels, most=300)
    assert np.allclose(quality_crf.train(d.unionByName(d), labels, most=300).weights, model.weights)
    odd = labels.select("doc_id", F.lit(None).cast("int").alias("quality"), "toxic").unionByName(labels).unionByName(labels)
    assert np.allclose(quality_crf.train(d, odd, most=300).weights, model.weights)
    s = quality_crf.score(hard, model)
    assert s.count() == hard.count() and s.where("score between 0 and 1").count() == hard.count()
    kept = quality_crf.keep_good(hard, model)
    assert kept.columns == hard.columns and kept.count() == s.where("predicted = 1").count()
    untrained = quality_crf.train(d.limit(0), labels)
    assert quality_crf.score(hard, untrained).where("score = 0.5").count() == hard.count() and quality_crf.score(hard.limit(0), model).count() == 0
    assert np.allclose(model.scores([b"a b\n" * 20000, None, b""]), [model.scores([b"a b\n" * 20000])[0], *[model.scores([b""])[0]] * 2])


def test_mixing(spark, hard, docs):
    con = duckdb.connect()
    for df in (hard, docs):
        documents = df.select("doc_id", "text", "source").toPandas()
        documents["doc_id"] = documents["doc_id"].astype("Int64")
        con.register("documents", documents)
        got = mixing.mix(df).toPandas()
        expected = con.execute(mixing.SQL).df()
        key = lambda x: sorted(map(repr, x[sorted(x.columns)].astype(object).where(lambda v: v.notna(), None).itertuples(index=False, name=None)))
        norm = lambda x: x.astype({"doc_id": "Int64"})
        assert key(norm(got)) == key(norm(expected))
        assert (got["taken"] <= 2 * got["size"]).all()
        assert mixing.apply_mix(df).count() == got["copies"].sum() and mixing.apply_mix(df).columns == df.columns
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()
    assert abs(got.groupby("source")["target"].first().sum() - 1.5 * got["size"].sum()) < 1e-6
    assert mixing.mix(hard.limit(0)).count() == 0
    slim = mixing.slim(docs, "doc_id", "text", "source")
    t = mixing.thresholds(slim, (3, 1, 2), 1.5, 2.0)
    few, many = (sorted(map(repr, mixing.beside(slim, t, few=n).collect())) for n in (50_000, 0))
    assert few == many and len(few) == docs.count()


def slow_fingerprint(text):
    t = (text or "").translate(str.maketrans(common.UPPER, common.UPPER.lower()))
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def least_reachable(n, links):
    root = list(range(n))
    for a, b in links:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    for i in range(n):
        root[i] = root[root[i]]
    return root


@pytest.mark.parametrize("largest", [simhash.LARGEST, 2])
def test_simhash(spark, hard, docs, largest):
    for df in (hard, docs):
        rows = plain(df)
        got = simhash.near_duplicates(df, largest=largest).select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")
        fp = {t: slow_fingerprint(t) for t in set(rows["text"])}
        order = sorted({i for i in rows["doc_id"] if i is not None})
        first = {i: fp[t] for i, t in rows.itertuples(index=False) if i is not None}
        root = least_reachable(len(order), [(a, b) for a in range(len(order)) for b in range(a) if bin(first[order[a]] ^ first[order[b]]).count("1") <= 3])
        comp = {i: order[root[k]] for k, i in enumerate(order)}
        for r in got.collect():
            if r.doc_id is not None:
                assert r.component_id == comp[r.doc_id] and r.fingerprint == f"{first[r.doc_id]:016x}"
        kept = simhash.one_of_each(df)
        assert kept.columns == df.columns
        ids = [r.doc_id for r in kept.collect()]
        assert sorted(i for i in ids if i is not None) == sorted(set(comp.values())) and ids.count(None) == rows["doc_id"].isna().sum()
    assert simhash.near_duplicates(hard.limit(0)).count() == 0


@pytest.mark.parametrize("piece", [1, 7, 40, 1000])
def test_long_texts_have_the_fingerprint_of_their_whole(monkeypatch, piece):
    texts = [t for t in TEXTS if t and len(t) < 2000] + ["Ab cd  ef\ngh " * 30, " x", "x y ", "x y z", "\t" * 90]
    whole = simhash.fingerprints_of([t.encode() for t in texts]).view(np.uint64)
    assert [int(f) for f in whole] == [slow_fingerprint(t) for t in texts]
    for t, f in zip(texts, whole):
        assert int.from_bytes(simhash.fingerprint_of_long(t.encode(), 3, piece).tobytes(), "big") == int(f)
    monkeypatch.setattr(simhash, "PIECE", piece)
    assert (simhash.fingerprints_of([t.encode() for t in texts]).view(np.uint64) == whole).all()


PEAK = """
import resource, sys
import numpy as np
from readloom.llm import jpeg_dc, quality_crf, simhash
word = " ".join(str(i * 7919 % 100003) for i in range(12))
text = ((word + "\\n") * ((64 << 20) // (len(word) + 1) + 1)).encode()
assert len(text) >= 64 << 20
if sys.argv[1] == "simhash":
    simhash.fingerprints_of([text])
elif sys.argv[1] == "jpeg":
    padded = text.ljust(-(-len(text) // 192) * 192, b" ")
    images = jpeg_dc.read_many(jpeg_dc.encode_many([padded]))
    assert jpeg_dc.payload_of(images[0]) == padded and jpeg_dc.feature(images[0])
else:
    assert 0 <= quality_crf.Model().scores([text])[0] <= 1
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


@pytest.mark.parametrize("which", ["simhash", "jpeg", "crf"])
def test_a_text_of_64_mb_takes_less_than_a_gb(which):
    got = subprocess.run([sys.executable, "-c", PEAK, which], capture_output=True, text=True, check=True)
    assert int(got.stdout) < 1000


def test_simhash_lists_lose_no_link(spark):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.unique([int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for s in seeds for _ in range(60)]).astype(np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    x = fps[:, None] ^ fps[None, :]
    root = least_reachable(len(fps), zip(*np.nonzero(np.triu(np.bitwise_count(x) <= 3, 1))))
    for largest in (1, 5, 10_000):
        got = {r.node: r.root for r in common.components(simhash.links(df, largest)).collect()}
        parts = [got.get(int(v), int(v)) for v in fps.view(np.int64)]
        assert len(set(zip(parts, root))) == len(set(parts)) == len(set(root))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_urls(spark):
    odd = [None, "", "x", "://", "http://", "http://NET", "http://NET/", "http://a.net/EN/", "http://example.net/en/", "http://xexample.net/en/", "http://b.example.net/en/?q", "http://example.com/de/", "http://b.org/fr/x#y", "http://b.org/frx", "http://.net/", "http://a..net/", "a://b://net/", "http://net?x/", "http://net#/", "http://\nnet/x", "http://é.net/é/", "http://a.example.com/de", "http://net/" + "x" * 50000, "http://" + "a." * 50000 + "b.example.com/de/", "http://" + "." * 3000 + "net/", "http://" + "x" * 300000, "://" * 30000 + "org/fr/"]
    rows = [(i, u, "h", "p", "r", "k") for i, u in enumerate(odd)] + [(6, odd[6], "h", "p", "r", "k"), (None, odd[6], "h", "p", "r", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, key string").repartition(2)
    pages = df.toPandas()
    pages["page_id"] = pages["page_id"].astype("Int64")
    con = duckdb.connect()
    con.register("pages", pages)
    expected = sorted(map(repr, con.execute(url_cascade.SQL).fetchall()))
    for largest in (url_cascade.LARGEST, 1):
        got = url_cascade.judge(df, url_cascade.RULES, largest=largest)
        assert sorted(repr(tuple(r)) for r in got.collect()) == expected
    assert url_cascade.judge(df.limit(0), url_cascade.RULES).count() == 0
    with pytest.raises(ValueError):
        url_cascade.judge(df, {"net": "block"})


def test_cascade_is_exact(spark):
    rules = [f"k{i}" for i in range(0, 20000, 37)]
    universe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    levels = url_cascade.cascade(universe, rules)
    h = universe.select("key", *(h.alias(n) for h, n in zip(url_cascade.hashes(F.col("key")), "ab"))).toPandas()
    assert len(levels) > 1 and set(h["key"][url_cascade.listed(levels, h["a"].to_numpy(), h["b"].to_numpy())]) == set(rules)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id long, unit string, space string").repartition(3)


@pytest.mark.parametrize("block, pivots", [(cover_tree.BLOCK, cover_tree.PIVOTS), (40, 3)])
def test_cover_tree(spark, block, pivots):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    made = np.concatenate([base[k % 12] + rng.normal(scale=s, size=16) for k, s in enumerate(rng.choice([0.02, 0.15, 0.3, 1], 240))]).reshape(-1, 16).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 2), 1, "u", "s") for i, v in enumerate(made)]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(300 + i, v, 1, 1, "u", "s") for i, v in enumerate(bad)]
    rows += [(400, rows[1][1], None, 1, "u", "s"), (401, rows[1][1], 1, 1, "u", "s"), (402, (made[1] * 2).tolist(), 1, 1, "u", "s"), (403, made[1].tolist()[:8], 1, 1, "u", "s"), (401, rows[1][1], 1, 1, "u", "s"), (404, (made[1] * np.float32(1e-30)).tolist(), 1, 1, "u", "s")]
    got = sorted(map(tuple, cover_tree.near_vectors(vectors(spark, rows), block=block, pivots=pivots).collect()))
    links = []
    for a in range(len(rows)):
        for b in range(a):
            u, v = rows[a][1], rows[b][1]
            if u in bad or v in bad or rows[a][2] is None or rows[a][2] != rows[b][2] or len(u) != len(v):
                continue
            x, y = np.array(u, float), np.array(v, float)
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links.append((a, b))
    n, order = Counter(k for e in links for k in e), sorted(range(len(rows)), key=lambda k: rows[k][0])
    at = {k: i for i, k in enumerate(order)}
    root = least_reachable(len(rows), [(at[a], at[b]) for a, b in links])
    expected = sorted((rows[k][0], n[k], (c := rows[order[root[at[k]]]][0]), rows[k][0] == c) for k in range(len(rows)))
    assert got == expected
    assert cover_tree.near_vectors(vectors(spark, rows).limit(0)).count() == 0
    one = cover_tree.near_vectors(vectors(spark, [(None, rows[0][1], 0, 1, "u", "s"), *rows[:1]])).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in one), key=repr) == [(0, 0, 0, True), (None, 0, None, False)]


def test_rings_hold_all_that_may_link():
    """Every pair within the threshold meets in the pair of its blocks, from both sides; every vector meets its own block."""
    rng = np.random.default_rng(12)
    eps = math.sqrt(2 - 2 * 0.93)
    for scale in (0.02, 0.2, 1):
        x = np.concatenate([c + rng.normal(scale=scale, size=(100, 6)) for c in rng.normal(size=(5, 6))])
        x /= np.linalg.norm(x, axis=1)[:, None]
        centres = x[rng.choice(500, 4, replace=False)]
        d = cover_tree.apart(x @ centres.T)
        cell = d.argmin(1)
        bars = np.array([np.bincount(cover_tree.bar_of(d[cell == c, c]), minlength=cover_tree.BARS) for c in range(4)])
        space = cover_tree.Space(centres, bars, 30)
        number = rng.integers(0, 1 << 40, 500)
        own, row, block = space.pairs(x, cell, cover_tree.bar_of(d[np.arange(500), cell]), number, eps)
        meets = np.zeros((500, space.n_blocks), bool)
        meets[row, block] = True
        assert meets.sum() == len(row) and meets[np.arange(500), own].all()
        u, v = np.nonzero(x @ x.T >= 0.93)
        assert meets[u, own[v]].all()


def test_cover_tree_of_many_labels_with_pivots(spark):
    """More large labels than pivots have room for: each still has one, and the result is that of brute force."""
    rng = np.random.default_rng(13)
    x = np.concatenate([c + rng.normal(scale=0.15, size=(30, 5)) for c in rng.normal(size=(12, 5))])
    label = np.repeat(np.arange(6), 60)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int").repartition(4)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = (u @ u.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    root = least_reachable(len(x), list(zip(*np.nonzero(np.triu(hit)))))
    vectors_ = df.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("space"), cover_tree.unit(F.col("embedding")).alias("unit"), F.lit(1).cast("long").alias("copies"))
    made, _ = cover_tree.layout(vectors_, 20, 8, 2 * 6 * 8 * 5)
    assert len(made) == 6 and all(1 <= len(s.centres) <= 2 for s in made.values())
    got = cover_tree.near_vectors(df, block=20, pivots=8).orderBy("vec_id").collect()
    assert [(r.n_links, r.component_id) for r in got] == list(zip(hit.sum(1).tolist(), root))


def test_dual_traversal_counts_every_pair():
    rng = np.random.default_rng(8)
    for scale in (0.01, 0.1, 0.3):
        x = np.concatenate([c + rng.normal(scale=scale, size=(50, 8)) for c in rng.normal(size=(4, 8))])
        x /= np.linalg.norm(x, axis=1)[:, None]
        w = rng.integers(1, 4, len(x)).astype(float)
        a, b = cover_tree.Tree(x[:120], w[:120]), cover_tree.Tree(x[120:], w[120:])
        n_a, n_b, u, v = cover_tree.dual(a, b, 0.93)
        hit = x[:120] @ x[120:].T >= 0.93
        assert np.allclose(n_a, hit @ w[120:]) and np.allclose(n_b, hit.T @ w[:120])
        root = cover_tree.forest(u, v, len(x))
        full = least_reachable(len(x), [(i, j + 120) for i, j in zip(*np.nonzero(hit))])
        assert root.tolist() == full
        for k in range(1, len(a.levels)):
            assert set(a.levels[k - 1].centres) <= set(a.levels[k].centres)


def test_language_model(spark, hard, docs):
    for df, options in ((docs, {"frequent": 500, "words": 100, "classes": 32, "width": 8}), (hard, {"words": 5, "classes": 4, "width": 4})):
        got = lbl_lm.scored(df, **options).collect()
        rows = plain(df)
        held = lambda i: i is not None and zlib.crc32(str(int(i)).encode()) % 7 == 2
        tokens = lambda t: [*(t or "").encode().translate(simhash.LOWER).split(), b""]
        c = Counter(w for i, t in rows.itertuples(index=False) if not held(i) for w in tokens(t))
        n, v = sum(c.values()), len(c)
        expected = sorted(((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t in rows.itertuples(index=False)), key=repr)
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=repr) == expected
        assert all(r.score < 0 for r in got)
    assert lbl_lm.scored(hard.limit(0), words=5, classes=4, width=4).count() == 0
    none = lbl_lm.score_texts(hard, hard.limit(0), words=5, classes=4, width=4)
    assert none.count() == hard.count() and none.where("n_known = 0 and train_tokens = 0").count() == hard.count()


def test_language_model_beats_single_tokens(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lbl_lm.scored(d).where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum() + 0.2 * got["n_tokens"].sum()
    assert (got["score"] > got["base_score"]).mean() > 0.9


def test_language_model_has_2559_words_of_its_own(spark, monkeypatch):
    made, make = [], lbl_lm.Vocabulary.__init__
    monkeypatch.setattr(lbl_lm.Vocabulary, "__init__", lambda self, *a: made.append(self) or make(self, *a))
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(4000))) for i in range(3)], "doc_id long, text string")
    lbl_lm.score_texts(df, df)
    assert len(made[0].words) == 2559 and made[0].size == 3072


@pytest.mark.parametrize("frequent", [30, 100_000])
def test_language_model_scores_by_plain_loops(spark, hard, docs, monkeypatch, frequent):
    """Scores of all texts against softmax sums over all symbols, token by token, for a model of arbitrary parts; also with words
    that are joined, long ones among them."""
    kept = []

    def arbitrary(training, v, model, rounds, tasks):
        rng = np.random.default_rng(3)
        model.parts = [rng.normal(0, 0.5, p.shape).astype(np.float32) for p in model.parts]
        kept.append((v, model))
        return model

    monkeypatch.setattr(lbl_lm, "fitted", arbitrary)
    df = docs.select("doc_id", "text").limit(40).unionByName(hard.select("doc_id", "text")).unionByName(spark.createDataFrame([(900, "x" * 65 + " b " + "x" * 65), (901, "y" * 65 + " b")], "doc_id long, text string"))
    rows = plain(df)
    training = rows[rows["doc_id"].notna()].head(40)
    fit = spark.createDataFrame(list(training.itertuples(index=False, name=None)) + [(902, "x" * 65)], "doc_id long, text string")
    got = sorted(((r.n_tokens, r.n_known, round(r.score, 3), round(r.base_score, 3)) for r in lbl_lm.score_texts(df, fit, words=20, classes=6, width=5, frequent=frequent).collect()), key=repr)
    v, model = kept[0]
    tokens = lambda t: [*(t or "").encode().translate(simhash.LOWER).split(), b""]
    c = Counter(w for t in [*training["text"], "x" * 65] for w in tokens(t))
    n = sum(c.values())
    share = Counter()
    for w in c:
        share[v.symbol(w)] += c[w] + 1
    context, target, c1, c2, bias = (p.astype(float) for p in model.parts)
    expected = []
    for t in rows["text"]:
        s, base, one, two = 0.0, 0.0, 0, 0
        for w in tokens(t):
            k = v.symbol(w)
            all_ = target @ (context[one] @ c1 + context[two] @ c2) + bias
            s += (all_[k] - all_.max() - math.log(np.exp(all_ - all_.max()).sum())) / math.log(10)
            if k > len(v.words):
                s += math.log10((c[w] + 1) / (share[k] + 1))
            base += math.log10((c[w] + 1) / (n + len(c) + 1))
            one, two = k, one
        expected.append((len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), s, base))
    expected.sort(key=lambda x: repr((x[0], x[1], round(x[2], 3), round(x[3], 3))))
    assert len(got) == len(expected)
    order = lambda rows: sorted(rows, key=lambda x: (x[0], x[1], x[3], x[2]))
    for g, e in zip(order(got), order(expected)):
        assert g[:2] == e[:2] and abs(g[2] - e[2]) < 0.02 + 1e-6 * abs(e[2]) * e[0] and abs(g[3] - e[3]) < 0.01


def test_language_model_counts_ends_below_the_bar(spark):
    """Few long texts: more frequent words than are broadcast, all of them above the end."""
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(10)) + " w0" * 5) for i in range(2)], "doc_id long, text string")
    c = {**{f"w{j}": 2 for j in range(1, 10)}, "w0": 12, "": 2}
    n = sum(c.values())
    for frequent in (0, 1, 3, 100):
        for r in lbl_lm.score_texts(df, df, words=5, classes=4, width=4, frequent=frequent).collect():
            assert (r.n_tokens, r.n_known) == (16, 16)
            expected = sum(math.log10(c[w] + 1) * (6 if w == "w0" else 1) for w in c) - 16 * math.log10(n + len(c) + 1)
            assert abs(r.base_score - expected) < 1e-9


def test_log_bilinear_is_normalised_and_learns():
    """Words that follow from one of the two symbols before, by drawn noise."""
    rng = np.random.default_rng(5)
    for place in (0, 1):
        one, two = rng.integers(0, 6, (2, 40_000))
        word = ((one, two)[place] + 1) % 6
        m = lbl_lm.LogBilinear(6, 8, np.bincount(word, minlength=6))
        assert m.fit(iter([(one, two, word)]), rng, least=600) == 40_000
        near, far, sums = m.tables(block=4)
        p = np.exp((near[:, None, :] + far[None, :, :]) @ m.parts[1].T + m.parts[4] - sums[:, :, None])  # by one, two, word
        follows = (np.arange(6) + 1) % 6
        assert np.allclose(p.sum(2), 1, atol=1e-4) and (p.argmax(2) == (follows[:, None] if place == 0 else follows[None, :])).all()
        assert p.max(2).min() > 0.5


def test_log_bilinear_steps_follow_the_gradient():
    """A step's gradients against differences of the objective, with draws that weigh as many as there should be."""
    rng = np.random.default_rng(7)
    one, two, word, drawn, noise = *rng.integers(0, 5, (3, 12)), rng.integers(0, 5, 9), 4
    m = lbl_lm.LogBilinear(5, 3, np.arange(1, 6))
    m.parts = [rng.normal(0, 0.4, p.shape) for p in m.parts]
    m.q = m.q.astype(float)

    def objective(parts):
        context, target, c1, c2, bias = parts
        made = context[one] @ c1 + context[two] @ c2
        s = lambda w: (made * target[w]).sum(1) + bias[w] - np.log(noise * m.q[w])
        return -np.log1p(np.exp(-s(word))).sum() - sum(np.log1p(np.exp(s(np.full(12, d)))).sum() * noise / 9 for d in drawn)

    got = [np.zeros_like(p) for p in m.parts]
    parts = [p.copy() for p in m.parts]
    m.move = lambda k, at, g, rate: got[k].__setitem__(at, got[k][at] + g)
    m.step(one, two, word, drawn, noise, 0.1)
    for k, p in enumerate(parts):
        for i in np.ndindex(p.shape):
            moved = [x.copy() for x in parts]
            moved[k][i] += 1e-6
            assert abs((objective(moved) - objective(parts)) / 1e-6 - got[k][i]) < 1e-3


@pytest.mark.parametrize("width", [1, 4, 33])
def test_sums_of_rows(width):
    rng = np.random.default_rng(width)
    at, rows = rng.integers(0, 40, 500).astype(np.uint16), rng.normal(size=(500, width)).astype(np.float32)
    expected = np.zeros((40, width))
    np.add.at(expected, at, rows)
    numbers, got = lbl_lm.summed(at, rows)
    assert numbers.tolist() == sorted(set(at.tolist())) and got.dtype == np.float32
    assert np.abs(got - expected[numbers]).max() < 1e-4


def test_contexts_begin_anew_with_each_text():
    v = lbl_lm.Vocabulary([b"a", b"b", b"c"], 1)
    s, n = lbl_lm.chain([[b"a", b"b", b"c"], [], [b"c", b"a"]], lbl_lm.Memoised(v))
    one, two = lbl_lm.contexts(s, n)
    assert s[2:].tolist() == [1, 2, 3, 0, 0, 3, 1, 0] and one.tolist() == [0, 1, 2, 3, 0, 0, 3, 1] and two.tolist() == [0, 0, 1, 2, 0, 0, 0, 3]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 1 << 40))
def test_permutation(n, key):
    p = training_order.Permutation(n, key)
    x = p.walk(np.arange(n))
    assert sorted(x) == list(range(n)) and (p.walk(x, True) == np.arange(n)).all()


def test_training_order(spark, hard, docs, tmp_path):
    args = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    for name, df in (("hard", hard), ("docs", docs)):
        uri = f"file://{tmp_path}/{name}"
        r = training_order.materialise(df, *args, uri, length=64, per_shard=100).toPandas().sort_values("ordinal")
        seq = training_order.read(uri, 0, 1 << 40, 64, 100)
        assert sorted(r["slot"]) == list(range(len(r))) and len(seq) == len(r)
        assert (training_order.read(uri, 57, 60, 64, 100) == seq[57:117]).all()
        assert all(zlib.crc32(seq[s].tobytes()) == c and o == s % 100 * 128 for s, c, o in zip(r["slot"], r["crc32"], r["byte_offset"]))
        flat = np.concatenate([seq[s][:n] for s, n in zip(r["slot"], r["n_tokens"])])
        ends, enc = np.flatnonzero(flat == 50256), training_order.encoding(*args)[0]
        texts = Counter(enc.decode(flat[a:b].tolist()) for a, b in zip([0, *ends[:-1] + 1], ends))
        assert texts == Counter(t or "" for t in plain(df)["text"]) and r["n_docs"].sum() == df.count()
    assert training_order.materialise(hard.limit(0), *args, f"{tmp_path}/none").count() == 0
    assert training_order.manifest(f"{tmp_path}/none")["sequences"] == 0 and not len(training_order.read(f"{tmp_path}/none", 0, 5))


def test_training_order_of_reused_folders_and_partitions(spark, hard, docs, tmp_path):
    """Shards of another key, of other texts and of more texts don't stay; partitions don't matter."""
    args, form = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN), {"length": 64, "per_shard": 100}
    files = lambda name: {f.name: f.read_bytes() for f in (tmp_path / name).iterdir()}

    def write(df, name, **options):
        r = training_order.materialise(df, *args, f"{tmp_path}/{name}", **form, **options).toPandas()
        seq = training_order.read(f"{tmp_path}/{name}", 0, 1 << 40, **form)
        assert len(seq) == len(r) and all(zlib.crc32(seq[s].tobytes()) == c for s, c in zip(r["slot"], r["crc32"]))
        return len(r)

    n = write(docs, "a")
    assert write(docs, "a", key=21) == n and write(docs, "b", key=21) == n and files("a") == files("b")
    upper = docs.withColumn("text", F.upper("text"))
    assert write(upper, "a") and write(hard, "a") < n and write(hard, "c") and files("a") == files("c")
    (tmp_path / "a" / "shard-00000000.bin").write_bytes(files("c")["shard-00000000.bin"][::-1])
    write(hard, "a")
    assert files("a") == files("c")
    small = {"group_bytes": 100_000}
    assert write(docs.coalesce(1), "one", **small) == write(docs.repartition(7), "seven", **small) > n and files("one") == files("seven")
    (tmp_path / "one" / training_order.MANIFEST).unlink()
    with pytest.raises(ValueError):
        training_order.read(f"{tmp_path}/one", 0, 1, **form)


def test_training_order_of_long_white_space():
    enc, _ = training_order.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    bpe = bpe_automaton.tokenizer(P.path("byte_bpe_50k.json"))
    long = [" " * 2_000_000, "a" + " " * 2_000_000 + "b", "\n" * 1_000_000 + " \tx", " \u3000" * 20_000 + "yes" + "\t" * 30_000]
    for text, ids in zip(long, training_order.encode_all(enc, long)):
        assert ids == [int(t) for w in bpe.encode(text) for t in w.split(",")]
    for text in ("a" + " " * 20_000 + "b", "\n" * 15_000, " \n" * 9_000 + "'s", "", "x"):
        assert training_order.encode_all(enc, [text]) == [enc.encode_ordinary(text)]


def plain_feature(text):
    """Dimensions and cells of the thumbnail whose rows are the payload's runs of 192 bytes, for payloads of one image column."""
    payload = text.ljust(max(1, -(-len(text) // 192)) * 192, b" ")
    rows = [payload[i : i + 192] for i in range(0, len(payload), 192)]
    h, cells = len(rows), []
    for i in range(8):
        for j in range(8):
            a, b = h * i // 8, h * (i + 1) // 8
            here = [v for r in rows[a : max(b, a + 1)] for v in r[24 * j : 24 * j + 24]]
            cells.append(sum(here) / len(here))
    mean = sum(cells) / 64
    return f"{192 * 8}x{h * 8}:{sum((c > mean) << 63 - k for k, c in enumerate(cells)):016x}"


def test_media(spark, hard, docs):
    for df in (hard, docs):
        got = jpeg_dc.store_texts(df, keep_media=True)
        expected = []
        for i, t in plain(df).itertuples(index=False):
            b = (t or "").encode()
            p = b.ljust(max(1, -(-len(b) // 192)) * 192, b" ")
            expected.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
        assert by_id(got, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(expected, key=repr)
        assert all(hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes for r in got.collect())
        back = jpeg_dc.jpeg_columns(got.select("doc_id", F.col("media").alias("image")))
        assert back.where("not error and width % 8 = 0").count() == df.count()
    assert jpeg_dc.store_texts(hard.limit(0)).count() == 0
    texts = dict(by_id(hard.where("doc_id is not null"), "text"))
    for r in jpeg_dc.store_texts(hard.where("doc_id is not null")).collect():
        assert r.feature == plain_feature((texts[r.doc_id] or "").encode())
    odd = spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(b"\xff\xd8\xff\xd9")), (4, bytearray(b"text"))], "doc_id long, image binary")
    assert jpeg_dc.jpeg_columns(odd).where("error and width is null").count() == 4


def test_large_payloads_and_broken_files():
    big = np.random.default_rng(1).integers(0, 256, 192 * 9000, dtype=np.uint8).tobytes()
    media = jpeg_dc.encode_many([big, b"x" * 192])
    images = jpeg_dc.read_many(media)
    assert jpeg_dc.payload_of(images[0]) == big and images[0][0][0].width == 2 * 192 * 8
    assert jpeg_dc.read_many([media[1][:-3], media[1][:40], media[0][: len(media[0]) // 2], None]) == [None] * 4


def ordinary_jpeg(rng, restart):
    """A colour image of 4:2:0 blocks with AC coefficients and tables of its own, written bit by bit, and its luminance."""
    dc = {s: (c, n) for s, c, n in jpeg_dc.codes([0, 1, 5, 1, 1, 1, 1, 1, 1, *[0] * 7], list(range(12)))}
    ac_symbols = [0x01, 0x02, 0x00, 0xF0, 0x13, 0x25, 0x81]
    ac_bits = [0, 2, 1, 1, 1, 1, 1, *[0] * 9]
    ac = {s: (c, n) for s, c, n in jpeg_dc.codes(ac_bits, ac_symbols)}
    across, down, q = 3, 2, 5
    luma = np.zeros((down * 2, across * 2), int)
    bits, scans, last = "", [], [0, 0, 0]

    def put(code, n):
        nonlocal bits
        bits += format(code, f"0{n}b") if n else ""

    def value(v, n):
        put(v if v > 0 else v + (1 << n) - 1, n)

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        scans.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0"))
        bits = ""

    for m in range(across * down):
        if restart and m and m % restart == 0:
            flush()
            last = [0, 0, 0]
        for c, (h, v) in enumerate(((2, 2), (1, 1), (1, 1))):
            for y, x in itertools.product(range(v), range(h)):
                level = int(rng.integers(-180, 180))
                if c == 0:
                    luma[m // across * 2 + y, m % across * 2 + x] = level
                d, last[c] = level - last[c], level
                n = abs(d).bit_length()
                put(*dc[n])
                value(d, n)
                k = 0
                while k < 50 and rng.random() < 0.6:
                    s = int(rng.choice([s for s in ac_symbols if s]))
                    put(*ac[s])
                    if s & 15:
                        value(int(rng.choice([-1, 1])) * ((1 << (s & 15)) - 1), s & 15)
                    k += (s >> 4) + 1
                if k < 63:
                    put(*ac[0])
    flush()
    table = lambda cls, b, s: jpeg_dc.segment(0xC4, bytes([cls, *b, *s]))
    head = b"\xff\xd8" + jpeg_dc.segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + jpeg_dc.segment(0xDB, bytes([0, q, *[3] * 63])) + jpeg_dc.segment(0xDB, bytes([1, 9, *[3] * 63]))
    head += jpeg_dc.segment(0xC0, struct.pack(">BHHB", 8, down * 16 - 3, across * 16 - 5, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    head += table(0, [0, 1, 5, 1, 1, 1, 1, 1, 1, *[0] * 7], range(12)) + table(0x10, ac_bits, ac_symbols) + (jpeg_dc.segment(0xDD, struct.pack(">H", restart)) if restart else b"")
    head += jpeg_dc.segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    body = b"".join(s + (b"\xff" + bytes([0xD0 + i % 8]) if i < len(scans) - 1 else b"") for i, s in enumerate(scans))
    return head + body + b"\xff\xd9", np.clip((luma * q + 4 >> 3) + 128, 0, 255)


def test_ordinary_images():
    rng = np.random.default_rng(4)
    made = [ordinary_jpeg(rng, r) for r in (0, 1, 2, 4) for _ in range(5)]
    for (data, luma), got in zip(made, jpeg_dc.read_many([d for d, _ in made])):
        (image, thumb), = got
        assert (image.width, image.height) == (43, 29) and (thumb == luma).all()


def test_two_documents_score_as_they_do_alone():
    rng = np.random.default_rng(5)
    model = quality_crf.Model(rng.normal(0, 0.3, quality_crf.N_WEIGHTS), rng.normal(0, 1, (2, 2)))
    line = lambda k: " ".join(["Word", "x#", "!! |", "ten 10 10", "and so it is."][: k % 5 + 1])
    texts = ["\n".join(line(a + i) for i in range(n)).encode() for a, n in ((0, 9), (3, 8), (1, 1), (2, 1), (4, 3))]
    alone = np.array([model.scores([t])[0] for t in texts])
    for n in range(1, len(texts) + 1):
        for which in itertools.permutations(range(len(texts)), n):
            assert np.allclose(model.scores([texts[i] for i in which]), alone[list(which)], rtol=0, atol=1e-12)
    for doc in ([1], [1, 1], [-1, -1, 0], [-1], []):
        assert quality_crf.places(np.array(doc, np.int64)).tolist() == [doc[:i].count(d) for i, d in enumerate(doc)]
