"""Near-duplicates by 64-bit fingerprints, through an inverted index of positional bytes.

Two fingerprints that differ in at most 3 bits agree in at least 5 of their 8 bytes. The index
posts each distinct fingerprint under the bytes at 4 positions at a time. The 14 sets of positions
are those whose numbers have an exclusive-or of zero: every 3 positions lie outside exactly one of
them, so a pair with 5 shared bytes meets in at least one posting list, and a list has 2^-32 of
the fingerprints unless they are alike. For the pairs that meet, shared positional bytes are
tallied; those that reach the guaranteed minimum of 5 are verified bit by bit.

A list gives the edges of a spanning forest of its links, fewer than it has members, never its
pairs. Lists beyond `LARGEST` members are linked without comparing members: if two fingerprints
are 3 bits apart, some value is within 1 bit of one and 2 of the other. Every member names the
values within 2 bits of it, and each value links all who name it to the least one within 1 bit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh64_digest

from readloom.llm.common import UPPER, components, cut, lean

BYTES, MOST = 8, 3
LEAST_SHARED = BYTES - MOST
BLOCKS = [b for b in combinations(range(BYTES), 4) if not b[0] ^ b[1] ^ b[2] ^ b[3]]
LARGEST = 8192
#: So many ids are sent to every task at most: about 64 MB of longs.
FEW = 1 << 20
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: A longer text is taken in pieces of so many bytes.
PIECE = 1 << 20


def digests_of(w: list[bytes], words: int) -> list[bytes]:
    """Hashes of all shingles of a sequence of more than `words` words less one."""
    joined = b" ".join(w)
    ends = list(accumulate(map((1).__add__, map(len, w))))
    return [xxh64_digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[words - 1 :])]


def bits_of(digests: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, BYTES), axis=1)


def runs(text: bytes, most: int) -> Iterator[bytes]:
    """A text in pieces of about `most` bytes, cut at white space."""
    at = 0
    while at < len(text):
        end = SPACE.search(text, at + most)
        end = end.start() if end else len(text)
        yield text[at:end]
        at = end


def fingerprint_of_long(text: bytes, words: int, most: int = PIECE) -> np.ndarray:
    """The bytes of a text's fingerprint, a piece at a time; pieces share the words that shingles reach across."""
    total, n, w = np.zeros(8 * BYTES, np.int64), 0, []
    for piece in runs(text, most):
        w += piece.translate(LOWER).split()
        if len(w) >= words:
            digests = digests_of(w, words)
            total += bits_of(digests).sum(0, dtype=np.int64)
            n += len(digests)
            w = w[len(w) - words + 1 :]
    if not n and w:
        total, n = bits_of([xxh64_digest(b" ".join(w), 42)])[0].astype(np.int64), 1
    return np.packbits(total * 2 > n)


def fingerprints_of(texts: list[bytes | None], words: int = 3) -> np.ndarray:
    """Signed 64-bit fingerprints. A bit is set if it is set in over half the hashes of the text's
    shingles, repeats included; a text without words has fingerprint zero."""
    digests, counts, long = [], [], []
    for k, text in enumerate(texts):
        if text and len(text) > PIECE:
            long.append(k)
            counts.append(0)
            continue
        w = (text or b"").translate(LOWER).split()  # bytes split at the same six characters
        here = digests_of(w, words) if len(w) > words else [xxh64_digest(b" ".join(w), 42)] if w else []
        digests += here
        counts.append(len(here))
    n, out = np.array(counts, np.int64), np.zeros((len(texts), BYTES), np.uint8)
    if digests:
        full = np.flatnonzero(n)
        starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        out[full] = np.packbits(np.add.reduceat(bits_of(digests), starts, axis=0, dtype=np.int32) * 2 > n[full, None], axis=1)
    for k in long:
        out[k] = fingerprint_of_long(texts[k], words)
    return out.view(">i8").ravel().astype(np.int64)


def fingerprints(df: DataFrame, words: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp) for every row, fp a signed long. Null counts as an empty text."""

    def run(batches):
        for batch in lean(batches):
            fp = fingerprints_of(batch.column("text").cast(pa.binary()).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp, pa.int64())], ["id", "fp"])

    source = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return source.mapInArrow(run, f"id {df.schema[id_column].dataType.simpleString()}, fp long").withColumnRenamed("id", id_column)


def key_of(block: tuple[int, ...]) -> Column:
    """The list of a fingerprint for one set of positions: the set's number above the four bytes."""
    key = F.lit(BLOCKS.index(block)).cast("long")
    for p in block:
        key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
    return key


def shared_bytes(x: Column) -> Column:
    """The tally of a pair: bytes of the exclusive-or that are zero."""
    return sum((F.when(F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for p in range(BYTES)), F.lit(0))


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links in one list: each member is compared with those not yet reached."""
    left, a, b = fps, [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = left ^ front[-1]
            shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
            near = (shared >= LEAST_SHARED) & (np.bitwise_count(x.view(np.uint64)) <= MOST)
            here, found = front.pop(), left[near]
            if len(found):
                a.append(np.full(len(found), here))
                b.append(found)
                front += list(found)
                left = np.ascontiguousarray(left[~near])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def small_lists(batches):
    for batch in batches:
        found = [forest(x.values.to_numpy().astype(np.int64)) for x in batch.column("fps")]
        a, b = (np.concatenate([np.empty(0, np.int64), *(f[i] for f in found)]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def masks(spark) -> DataFrame:
    """For each set of positions, all changes of up to 2 bits at the other positions: 14 x 529 rows."""
    rows = []
    for k, block in enumerate(BLOCKS):
        free = [1 << 8 * p + i for p in range(BYTES) if p not in block for i in range(8)]
        for m, weight in [(0, 0), *((x, 1) for x in free), *((x | y, 2) for x, y in combinations(free, 2))]:
            rows.append((k, m - (1 << 64) if m >> 63 else m, weight))
    return spark.createDataFrame(rows, "block int, mask long, weight int")


def links(fps: DataFrame, largest: int = LARGEST) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints that links of up to 3 bits connect.
    fps: distinct values of a column fp."""
    postings = fps.select("fp", F.explode(F.array(*map(key_of, BLOCKS))).alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    lists = cut(lists)
    x = F.col("a").bitwiseXOR(F.col("b"))
    pairs = lists.where("n = 2").where((shared_bytes(x) >= LEAST_SHARED) & (F.bit_count(x) <= MOST)).select("a", "b")
    more = postings.join(lists.where("n > 2").select("key", "n"), "key")
    # Up to `largest` values in a list, so the array is bounded.
    small = more.where(F.col("n") <= largest).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    small = small.mapInArrow(small_lists, "a long, b long")
    out = pairs.union(small)
    if lists.where(F.col("n") > largest).limit(1).count():
        large = more.where(F.col("n") > largest).withColumn("block", F.shiftright("key", 32).cast("int"))
        near = large.join(F.broadcast(masks(fps.sparkSession)), "block").select("fp", "weight", F.col("fp").bitwiseXOR(F.col("mask")).alias("x"))
        least = F.min(F.when(F.col("weight") <= 1, F.col("fp"))).over(Window.partitionBy("x"))
        out = out.union(near.select("fp", least.alias("least")).where("fp <> least").select("fp", "least").distinct())
    return out


def near_duplicates(df: DataFrame, words: int = 3, id_column: str = "doc_id", text_column: str = "text", largest: int = LARGEST) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id reachable by links
    between fingerprints of up to 3 differing bits, the row's own included. Equal fingerprints are
    one node, so copies are never paired. Null and empty texts and those of white space have fingerprint zero and are
    linked like any other. Rows without an id take part; a component of such rows
    alone has a null component_id. Repeated rows stay repeated; an empty table gives no rows; further columns of `df` don't
    matter, whatever their names. Long texts are worked through in pieces."""
    return grouped(df, words, id_column, text_column, largest).select(id_column, "fp", "component_id")


def grouped(df: DataFrame, words: int, id_column: str, text_column: str, largest: int = LARGEST) -> DataFrame:
    """near_duplicates with root, which names a component even where an id is in several."""
    docs = cut(fingerprints(df, words, id_column, text_column))
    nodes = cut(docs.groupBy("fp").agg(F.min(id_column).alias("least")))
    roots = components(links(nodes.select("fp"), largest))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(best, "root").select("fp", "root", "component_id")
    return docs.join(named, "fp").select(id_column, "fp", "root", "component_id")


def one_of_each(df: DataFrame, words: int = 3, id_column: str = "doc_id", text_column: str = "text", few: int = FEW) -> DataFrame:
    """The rows of `df` less all but one document of each group: that of the smallest id stays, and of its texts in
    the group that of the least fingerprint. Rows without an id stay, since nothing can name them; of repeated rows of
    one id one stays, and of different texts of one id one in each group. Texts without words are one group; an empty table gives
    no rows; all columns stay as they are. If the ids that go or those that stay are up to `few`, the lesser are sent to every task and
    no text is shuffled; else ids and texts are."""
    groups = cut(grouped(df, words, id_column, text_column))
    # Of each id: its rows, and whether it takes more than the id to tell which of them stay, or none does.
    ids = groups.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.count("*").alias("_n"), F.max(F.col(id_column) != F.col("component_id")).alias("_gone"))
    ids = cut(ids.withColumn("_gone", F.col("_gone") | (F.col("_n") > 1)))
    weight = 1 + (F.octet_length(F.col(id_column).cast("string")) / 64).cast("long")  # long ids count for several
    gone, stay, again = (n or 0 for n in ids.agg(*(F.sum(F.when(F.expr(c), weight)) for c in ("_gone", "not _gone", "_n > 1"))).first())
    if stay < gone and stay <= few:
        by_id = F.broadcast(ids.where("not _gone").select(F.col(id_column).alias("_id")))
        out = df.join(by_id, df[id_column] == by_id["_id"], "left").where(by_id["_id"].isNotNull() | df[id_column].isNull()).select(*(df[c] for c in df.columns))
    else:
        dropped = ids.where("_gone").select(id_column)
        out = df.join(F.broadcast(dropped) if gone <= few else dropped, id_column, "left_anti").select(*df.columns)
    if again:
        # An id that is repeated doesn't tell its rows apart: they are judged by id and fingerprint.
        repeated = ids.where("_n > 1").select(id_column)
        kept = groups.where(F.col(id_column) == F.col("component_id")).groupBy("root").agg(F.min("fp").alias("_fp"), F.first(id_column).alias("_id"))
        several = with_fingerprint(df.join(F.broadcast(repeated) if again <= few else repeated, id_column, "left_semi").select(*df.columns), words, text_column)
        several = several.join(kept, (F.col(id_column) == F.col("_id")) & (several["_fp"] == kept["_fp"]), "left_semi")
        out = out.unionByName(several.dropDuplicates([id_column, "_fp"]).drop("_fp"))
    return out


def with_fingerprint(df: DataFrame, words: int, text_column: str) -> DataFrame:
    """All columns and _fp."""

    def run(batches):
        for batch in lean(batches, text_column):
            fp = fingerprints_of(batch.column(text_column).cast(pa.binary()).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp, pa.int64())], [*batch.schema.names, "_fp"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("_fp", LongType())]))


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
