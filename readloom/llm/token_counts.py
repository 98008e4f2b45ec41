"""Token counts of whole texts under a piece model, by heap-and-linked-list pair merging.

A text's symbols form a linked list; a heap holds the adjacent pairs that spell a piece. The pair
of the best piece, leftmost among equals, is merged until none is left. The count is the number
of initial symbols less the number of merges; ids are never made. A character outside the
vocabulary counts once for each of its UTF-8 bytes.

Where no piece holds anything but a word mark before a word mark, merges never cross the place
where a word ends, so words are merged one at a time and remembered in a bounded memo.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import Memo, sliced, texts

MARK = "▁"
NORMAL, USER_DEFINED = 1, 4
#: Bits of a heap entry: the pair's length is in the lowest, its place above that, its rank on top.
LENGTH, PLACE = 8, 48


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """The pieces, scores and text rules of a sentencepiece BPE model file."""

    def __init__(self, path: str):
        pieces, trainer, rules = [], {}, {}
        with open(path, "rb") as f:
            for n, value in fields(f.read()):
                if n == 1:
                    p = dict(fields(value))
                    pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
                elif n == 2:
                    trainer = dict(fields(value))
                elif n == 3:
                    rules = dict(fields(value))
        if trainer.get(3) != 2 or not trainer.get(35, 0):
            raise ValueError("only BPE models with byte fallback are supported")
        if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or any(kind == USER_DEFINED for _, _, kind in pieces):
            raise ValueError("the model changes texts or defines symbols in a way that isn't supported")
        self.prefix = MARK if rules.get(3, 1) else ""
        normal = {piece: -score for piece, score, kind in pieces if kind == NORMAL}
        rank = {score: r for r, score in enumerate(sorted(set(normal.values())))}
        if max(map(len, normal)) >= 1 << LENGTH:
            raise ValueError("a piece is too long")
        #: Piece to its rank, room for a place, and its length: with the place added, an entry of the heap.
        self.order = {piece: rank[score] << PLACE | len(piece) for piece, score in normal.items()}
        inside = set("".join(self.order))
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.order)
        self.by_line = "\n" not in inside
        self.memo = Memo(self.merge)

    def merge(self, word: str) -> int:
        """Tokens of a string whose spaces are marks."""
        n, order = len(word), self.order
        size = [1] * n  # of the symbol that begins here; 0 once it is part of another
        before = list(range(-1, n - 1))
        heap = [order[p] + (i << LENGTH) for i in range(n - 1) if (p := word[i : i + 2]) in order]
        heapify(heap)
        merges = 0
        while heap:
            top = heappop(heap)
            whole, i = top & (1 << LENGTH) - 1, (top & (1 << PLACE) - 1) >> LENGTH
            left = size[i]
            j = i + left
            if not left or j >= n or left + size[j] != whole:
                continue  # one of the two has been merged since
            size[i], size[j] = whole, 0
            merges += 1
            if (k := i + whole) < n:
                before[k] = i
                if (p := word[i : k + size[k]]) in order:
                    heappush(heap, order[p] + (i << LENGTH))
            if (h := before[i]) >= 0 and (p := word[h:k]) in order:
                heappush(heap, order[p] + (h << LENGTH))
        return n - merges + sum(len(c.encode()) - 1 for i, c in enumerate(word) if size[i] == 1 and c not in order)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_word or not self.by_line:
            return self.merge(self.prefix + text.replace(" ", MARK))
        memo = self.memo
        if text[0] == " " or MARK in text or "  " in text or not self.prefix:
            words = re.findall(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+", self.prefix + text.replace(" ", MARK))
        else:
            words = (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")
        return sum(map(memo.__getitem__, words))


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def count_tokens(df: DataFrame, path: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; null and empty texts count 0; repeated
    rows stay repeated; further columns of `df` don't matter. A narrow pass without a shuffle."""
    schema = f"id {df.schema[id_column].dataType.simpleString()}, n_bytes long, n_tokens long"

    def run(batches):
        m = model(path)
        for batch in sliced(batches):
            column = batch.column("text")
            n_bytes = pc.binary_length(column).fill_null(0).cast(pa.int64())
            n_tokens = pa.array([m.count(t) for t in texts(batch)], pa.int64())
            m.memo.trim()
            yield pa.RecordBatch.from_arrays([batch.column("id"), n_bytes, n_tokens], ["id", "n_bytes", "n_tokens"])

    out = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
