"""Token ids as fixed-stride binary shards in a keyed training order.

Texts are dealt to groups by a hash of id and text, and within a group ordered by it, so that nothing depends on how many
tasks there are. A group's texts are packed, one after the other with an end token, into sequences of fixed
length. A keyed Feistel network permutes the smallest power of four that holds all sequence numbers;
walking the cycle until a number is in range gives every sequence a slot of its own in 0..n-1.
Slots are dealt in ranges to shards, and a shard's file holds its sequences at fixed strides: the
place of a slot is arithmetic, reading in training order is sequential, and it resumes at any slot.

Shards are written under a temporary name and moved, so a lost executor's task is simply run again. A shard that is there
already is kept only if its bytes are the same. The manifest goes first and comes back last, when all shards
are there and those past the end are gone: a folder without one isn't whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.bpe_automaton import SPACES
from readloom.llm.common import cut, delete, shared_dir, sliced, texts, without_shuffle_files

ROUNDS = 6
#: Bytes of text of a group, and the most partitions that groups are dealt to.
GROUP_BYTES, MOST_PARTITIONS = 64 << 20, 16384
#: White space beyond this many characters is cut out before a text goes to the tokenizer, whose pattern can't take it.
LONG_SPACE = 10_000
MANIFEST = "manifest.json"


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed hash of 64-bit numbers."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A keyed permutation of 0..n-1 and its inverse, number by number."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.low = (np.uint64(1) << self.half) - np.uint64(1)
        self.keys = [(key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) % (1 << 64) for r in range(ROUNDS)]

    def once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.low
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (mixed(left, key) & self.low), left
            else:
                left, right = right, left ^ (mixed(right, key) & self.low)
        return left << self.half | right

    def walk(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        out = self.once(np.asarray(x).astype(np.uint64), back)
        while (out_of := np.flatnonzero(out >= self.n)).size:
            out[out_of] = self.once(out[out_of], back)
        return out.astype(np.int64)


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), len(ranks)


LONG = re.compile(f"[{SPACES}]{{{LONG_SPACE},}}")


def encode_all(enc, batch: list[str]) -> list[list[int]]:
    """Ids of texts. The pattern takes white space before a word as one piece less its last character, and at a text's end whole;
    long white space is cut out by that rule and merged as a piece of its own."""
    out = enc.encode_ordinary_batch([t if len(t) < LONG_SPACE or not LONG.search(t) else "" for t in batch], num_threads=1)
    for k, t in enumerate(batch):
        if t and not out[k]:
            ids, at = [], 0
            for m in LONG.finditer(t):
                end = m.end() - (m.end() < len(t))
                ids += enc.encode_ordinary(t[at : m.start()])
                ids += enc._encode_single_piece(t[m.start() : end].encode())
                at = end
            out[k] = ids + enc.encode_ordinary(t[at:])
    return out


def tokenized(df: DataFrame, path: str, pattern: str, id_column: str, text_column: str) -> DataFrame:
    """(h, k, id, tokens): two hashes of id and text, and 16-bit ids with the id after the vocabulary's last as their end."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches):
        enc, end = encoding(path, pattern)
        if end > 0xFFFF:
            raise ValueError("ids don't fit 16 bits")
        for batch in sliced(batches):
            tokens = [np.array([*ids, end], "<u2").tobytes() for ids in encode_all(enc, texts(batch))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "k", "id")), pa.array(tokens, pa.binary())], ["h", "k", "id", "tokens"])

    name = F.col(id_column).cast("string")
    hashes = (F.xxhash64(F.lit(n), name, F.col(text_column)).alias(c) for n, c in enumerate("hk"))
    return df.select(*hashes, F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"h long, k long, id {kind}, tokens binary")


def packed(df: DataFrame, path: str, pattern: str, length: int, id_column: str, text_column: str, group_bytes: int) -> DataFrame:
    """(g, i, tokens, n_tokens, n_docs, first_id): the sequences of each group in order, `length` 16-bit ids each. What is left of a
    group's texts is filled up with the end id. n_docs: texts that end inside. Groups are as many as the bytes of all texts ask for."""
    total = df.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    groups = -(-total // group_bytes) or 1
    parts = min(groups, MOST_PARTITIONS)
    kind = df.schema[id_column].dataType.simpleString()
    rows = tokenized(df, path, pattern, id_column, text_column).withColumn("g", F.pmod("h", F.lit(groups)))
    rows = rows.repartitionById(parts, F.pmod("g", F.lit(parts)).cast("int")).sortWithinPartitions("g", "h", "k")

    def run(batches):
        end = encoding(path, pattern)[1]
        group, i, held, ends, names = None, 0, np.empty(0, "<u2"), [], []  # of texts not yet written out: places and ids

        def emit(whole: int, last: int = length):
            nonlocal i, held, ends, names
            tokens = held[: whole * length].reshape(whole, length)
            e = np.array(ends, np.int64)
            first = np.searchsorted(e, np.arange(whole) * length, side="right")  # the text that covers a sequence's first id
            n_docs = np.diff(np.searchsorted(e, np.arange(whole + 1) * length, side="right"))
            n_tokens = np.full(whole, length)
            n_tokens[-1] = last
            columns = [pa.array(np.full(whole, group), pa.int64()), pa.array(np.arange(i, i + whole)), pa.array([r.tobytes() for r in tokens], pa.binary()), pa.array(n_tokens, pa.int32()), pa.array(n_docs, pa.int32()), pa.array([names[k] for k in first], id_type)]
            held, i = held[whole * length :], i + whole
            keep = int(np.searchsorted(e, whole * length, side="right"))
            ends, names = (e[keep:] - whole * length).tolist(), names[keep:]
            return pa.RecordBatch.from_arrays(columns, ["g", "i", "tokens", "n_tokens", "n_docs", "first_id"])

        def finish():
            nonlocal held
            if n := len(held):
                held = np.concatenate([held, np.full(length - n, end, "<u2")])
                yield emit(1, n)

        for batch in sliced(batches, "tokens"):
            id_type, gs = batch.column("id").type, batch.column("g").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(gs)) + 1, [len(gs)]]).tolist()
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if gs[a] != group:
                    yield from finish()
                    group, i = int(gs[a]), 0
                here = batch.slice(a, z - a)
                tokens = [np.frombuffer(t, "<u2") for t in here.column("tokens").to_pylist()]
                ends += (len(held) + np.cumsum([len(t) for t in tokens])).tolist()
                names += here.column("id").to_pylist()
                held = np.concatenate([held, *tokens])
                if len(held) >= length:
                    yield emit(len(held) // length)
        yield from finish()

    return rows.select("g", "id", "tokens").mapInArrow(run, f"g long, i long, tokens binary, n_tokens int, n_docs int, first_id {kind}")


def store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def put(uri: str, name: str, data) -> None:
    """Writes a file under a name of its own and moves it, unless the same bytes are there."""
    fs, base = store(uri)
    fs.create_dir(base, recursive=True)
    info = fs.get_file_info(f"{base}/{name}")
    if info.size == len(data):
        with fs.open_input_stream(info.path) as f:
            if hashlib.file_digest(f, "sha256").digest() == hashlib.sha256(data).digest():
                return
    other = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(other) as out:
        out.write(data)
    if info.type != pyarrow.fs.FileType.NotFound:
        fs.delete_file(info.path)  # not every store moves over a file
    fs.move(other, info.path)


def manifest(uri: str) -> dict | None:
    """What a folder of shards holds; None if it isn't whole."""
    fs, base = store(uri)
    if fs.get_file_info(f"{base}/{MANIFEST}").type == pyarrow.fs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


def tidy(uri: str, shards: int) -> None:
    """Deletes shards past the end and files that lost tasks left."""
    fs, base = store(uri)
    fs.create_dir(base, recursive=True)
    for info in fs.get_file_info(pyarrow.fs.FileSelector(base)):
        number = re.fullmatch(r"shard-(\d+)\.bin", info.base_name)
        if info.base_name.startswith(".shard-") or number and int(number[1]) >= shards:
            fs.delete_file(info.path)


#: What a sequence has beside its tokens, in the blocks that go to a shard.
ABOUT = "slot, ordinal, n_tokens, n_docs, first_id"


def blocks(rows: DataFrame, order: Permutation, per_shard: int) -> DataFrame:
    """(shard, tokens, slot, ordinal, n_tokens, n_docs, first_id): what a batch has for each shard, tokens compressed together, the
    rest as arrays. rows: (ordinal, n_tokens, n_docs, first_id, tokens)."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=5)
        for batch in batches:
            slot = order.walk(batch.column("ordinal").to_numpy())
            by = np.argsort(slot, kind="stable")
            shard = slot[by] // per_shard
            edges = np.flatnonzero(np.diff(shard, prepend=-1)).tolist() + [len(by)]
            batch, slot = batch.take(pa.array(by)), slot[by]
            tokens = batch.column("tokens").to_pylist()
            cuts = pa.array(edges, pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, c) for c in (pa.array(slot), *(batch.column(n) for n in ("ordinal", "n_tokens", "n_docs", "first_id")))]
            packs = [squeeze.compress(b"".join(tokens[a:z])) for a, z in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(shard[edges[:-1]], pa.int32()), pa.array(packs, pa.binary()), *lists], ["shard", "tokens", *ABOUT.split(", ")])

    arrays = ", ".join(f"{n} array<{kinds.get(n, 'bigint')}>" for n in ABOUT.split(", "))
    return rows.mapInArrow(run, f"shard int, tokens binary, {arrays}")


def write_shards(dealt: DataFrame, uri: str, n: int, per_shard: int, stride: int) -> DataFrame:
    """Writes the shards, of which a partition has all blocks of one, and gives a row for each sequence. A shard is put together
    in memory, per_shard * stride bytes."""
    kinds = {f.name: f.dataType.simpleString().removeprefix("array<").removesuffix(">") for f in dealt.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ABOUT.split(", ")) + ", shard int, byte_offset long, crc32 long"

    def run(batches):
        import zstandard

        expand, shards = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for k, s in enumerate(batch.column("shard").to_pylist()):
                if s not in shards:
                    size = min(per_shard, n - s * per_shard)
                    shards[s] = np.zeros((size, stride), np.uint8), []
                places = batch.column("slot")[k].values.to_numpy() - s * per_shard
                shards[s][0][places] = np.frombuffer(expand.decompress(batch.column("tokens")[k].as_py()), np.uint8).reshape(-1, stride)
                shards[s][1].append([batch.column(c)[k].values for c in ABOUT.split(", ")])
        for s, (data, about) in shards.items():
            put(uri, shard_name(s), data.data)
            columns = [pa.concat_arrays(c) for c in zip(*about)]
            place = columns[0].to_numpy() - s * per_shard
            extra = [pa.array(np.full(len(place), s), pa.int32()), pa.array(place * stride), pa.array([zlib.crc32(data[p].data) for p in place], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *extra], [*ABOUT.split(", "), "shard", "byte_offset", "crc32"])

    return dealt.mapInArrow(run, schema)


def materialise(df: DataFrame, path: str, pattern: str, uri: str, key: int = 20, length: int = 1024, per_shard: int = 16384, id_column: str = "doc_id", text_column: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Writes all texts of `df` (null: empty) as shards under `uri`, a folder that driver and executors reach, and gives
    (slot, ordinal, n_tokens, n_docs, first_id, shard, byte_offset, crc32) for each sequence. Equal rows give equal shards, however
    they are partitioned; repeated rows are packed as often as they occur; an empty table gives a manifest without shards; further
    columns don't matter, whatever their names. What another run left in the folder is replaced."""
    spark = df.sparkSession
    stage = f"{shared_dir(spark)}/sequences-{uuid.uuid4().hex}"
    sequences = packed(df, path, pattern, length, id_column, text_column, group_bytes)
    without_shuffle_files(spark, lambda: sequences.write.option("compression", "zstd").parquet(stage))
    rows = spark.read.parquet(stage)
    sizes = rows.groupBy("g").count().orderBy("g").collect()  # a row for each group
    starts, n = [], 0
    for r in sizes:
        starts.append((r["g"], n))
        n += r["count"]
    order = Permutation(n, key)
    at = spark.createDataFrame(starts, "g long, start long")
    numbered = rows.join(F.broadcast(at), "g").select((F.col("start") + F.col("i")).alias("ordinal"), "n_tokens", "n_docs", "first_id", "tokens")
    shards = -(-n // per_shard)
    fs, base = store(uri)
    if manifest(uri):
        fs.delete_file(f"{base}/{MANIFEST}")
    # Slots are evenly spread: each range of equal width is a partition, without sampling or hashing.
    dealt = blocks(numbered, order, per_shard).repartitionById(max(1, shards), F.col("shard"))
    out = cut(write_shards(dealt, uri, n, per_shard, 2 * length))
    tidy(uri, shards)
    digest = out.agg(F.sum(F.xxhash64("slot", "crc32").cast("decimal(38,0)"))).first()[0]
    put(uri, MANIFEST, json.dumps({"sequences": n, "length": length, "per_shard": per_shard, "key": key, "digest": str(digest or 0)}).encode())
    delete(spark, stage)
    return out


def read(uri: str, slot: int, count: int, length: int = 1024, per_shard: int = 16384) -> np.ndarray:
    """Sequences of `count` slots from `slot` on, by their places; fewer where the order ends."""
    fs, base = store(uri)
    has = manifest(uri)
    if not has or (has["length"], has["per_shard"]) != (length, per_shard):
        raise ValueError("the folder isn't whole, or its sequences have another form")
    count = min(count, max(0, has["sequences"] - slot))
    parts, stride = [np.empty((0, length), np.uint16)], 2 * length
    while count > 0:
        info = fs.get_file_info(f"{base}/{shard_name(slot // per_shard)}")
        if info.type == pyarrow.fs.FileType.NotFound:
            break
        with fs.open_input_file(info.path) as f:
            f.seek(slot % per_shard * stride)
            got = np.frombuffer(f.read(min(count, per_shard - slot % per_shard) * stride), "<u2").reshape(-1, length)
        if not len(got):
            break
        parts.append(got)
        slot, count = slot + len(got), count - len(got)
    return np.concatenate(parts)


def ordered(spark: SparkSession, docs: DataFrame, path: str, pattern: str, **options) -> DataFrame:
    return materialise(docs, path, pattern, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", **options)
