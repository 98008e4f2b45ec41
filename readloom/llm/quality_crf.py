"""Document quality by a linear-chain conditional random field over lines.

Every line with words is good or bad. A line's score is a sum of weights of its own binned features
and of those of the lines before and after it; neighbouring labels have weights of their own.
Forward-backward marginals of all lines of a batch come from a segmented scan of 2 x 2 matrix
products, in as many steps as the logarithm of the longest document's lines. A document's
quality is the mean of its lines' marginals, weighted by their lengths in bytes.

Weights are fitted to labelled documents. Their lines' labels aren't known: they begin as the document's, and after a fit
a line whose own features speak clearly against that takes the other label, as long as the document's bytes still
stand for its label; then the field is fitted again.

Long texts are taken in pieces: a line of more than PIECE bytes counts as several lines, cut at white space, and beyond MANY
lines the chain is summed block by block with messages carried over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import lean

UPPER, LOWER, DIGIT, STOP, SYMBOL, PIPE, SHOUT, HIGH, SPACE = range(9)
CLASS = np.full(256, SYMBOL, np.uint8)
CLASS[65:91], CLASS[97:123], CLASS[48:58], CLASS[128:] = UPPER, LOWER, DIGIT, HIGH
CLASS[[ord(c) for c in ".,;:'\"-?()"]] = STOP
CLASS[ord("|")], CLASS[ord("!")] = PIPE, SHOUT
CLASS[[32, *range(9, 14)]] = SPACE
FOLD = np.arange(256, dtype=np.uint64)
FOLD[65:91] += 32

SHARES = (1e-9, 0.01, 0.03, 0.07, 0.15, 0.3, 0.6)
#: Lower edges of the bins of each feature of a line.
EDGES = (
    (1e-9, 0.02, 0.06, 0.15, 0.3, 0.6, 0.9),  # upper case among ASCII letters
    SHARES,  # digits
    SHARES,  # stops
    SHARES,  # symbols
    SHARES,  # bars
    SHARES,  # exclamation marks
    SHARES,  # bytes beyond ASCII
    (2, 3, 4, 5, 6, 8, 12),  # mean word length
    (2, 4, 8, 16, 32, 64, 128),  # words
    (1e-9, 0.02, 0.05, 0.1, 0.2, 0.5, 0.8),  # words that equal the word before
    (2, 3, 5, 9, 17, 33, 65),  # times the line occurs in its document
    (1e-9, 0.02, 0.05, 0.1, 0.2, 0.5, 0.8),  # words that equal the word before the last
)
BINS, PLACES, TIMES = 8, 3, 10
ODD, DOCUMENT = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
#: Bytes of text that are measured at a time, and lines of a chain that are summed at a time.
PIECE, MANY = 1 << 20, 1 << 18
BLANK = re.compile(rb"[\x20\x09-\x0d]")
POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number and of its inverse modulo 2 to the 64. n is bounded by what is measured at a time."""
    if not POWERS or len(POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, x in (("up", ODD), ("down", pow(ODD, -1, 1 << 64))):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            POWERS[name] = np.multiply.accumulate(steps)
    return POWERS["up"][:n], POWERS["down"][:n]


def pieces(text: bytes, most: int) -> Iterator[bytes]:
    """A text in pieces of up to `most` bytes, cut after lines where there are any, else at white space, else anywhere."""
    at = 0
    while len(text) - at > most:
        end = text.rfind(b"\n", at, at + most) + 1
        if not end:
            end = max(text.rfind(bytes([c]), at, at + most) for c in (32, *range(9, 14))) + 1 or at + most
        yield text[at:end].removesuffix(b"\n")
        at = end
    yield text[at:]


class Lines:
    """The lines with words of a batch of texts. A text without words has one empty line."""

    def __init__(self, texts: list[bytes | None], most: int = 0):
        most = most or PIECE
        cut = [(k, p) for k, t in enumerate(texts) for p in pieces(t or b"", most)]
        parts, held, size = [], [], 0
        for k, p in cut:
            if held and size + len(p) > most:
                parts.append(self.measured(held))
                held, size = [], 0
            held.append((k, p))
            size += len(p) + 1
        if held:
            parts.append(self.measured(held))
        bins, doc, size, hashed, full = (np.concatenate(c) for c in zip(*parts))
        bare = np.ones(len(texts), bool)
        bare[doc[full]] = False
        keep = full.copy()
        keep[np.searchsorted(doc, np.flatnonzero(bare))] = True
        bins, self.doc, self.size, hashed, self.docs = bins[keep], doc[keep], np.maximum(size[keep], 1), hashed[keep], len(texts)
        _, which, times = np.unique(hashed * np.uint64(ODD) + self.doc.astype(np.uint64) * np.uint64(DOCUMENT), return_inverse=True, return_counts=True)
        bins[:, TIMES] = np.digitize(times[which], EDGES[TIMES])
        self.bins = bins

    @staticmethod
    def measured(texts: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
        """Of all lines of texts with numbers: bins without the times a line occurs, the text's number, bytes that aren't white space,
        a hash, and whether there are words."""
        raw = np.frombuffer(b"".join(t + b"\n" for _, t in texts), np.uint8)
        kind = CLASS[raw]
        ends = np.flatnonzero(raw == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        text_ends = np.cumsum([len(t) + 1 for _, t in texts])
        doc = np.array([k for k, _ in texts], np.int64)[np.searchsorted(text_ends, ends, side="right")]
        count = lambda what: np.add.reduceat(what, starts, dtype=np.int64)
        up, down = powers(len(raw) + 1)
        summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum((FOLD[raw] + np.uint64(1)) * up[: len(raw)])])
        hashed = lambda a, b: (summed[b] - summed[a]) * down[a]
        inside = kind != SPACE
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        w0, w1 = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        w_line = np.searchsorted(ends, w0)
        n_words = np.bincount(w_line, minlength=len(ends))
        h = hashed(w0, w1)
        again = [np.bincount(w_line[k:][(h[k:] == h[:-k]) & (w_line[k:] == w_line[:-k])], minlength=len(ends)) if len(h) > k else np.zeros(len(ends), np.int64) for k in (1, 2)]
        upper, lower, digit, stop, symbol, pipe, shout, high = (count(kind == k) for k in range(8))
        size = upper + lower + digit + stop + symbol + pipe + shout + high
        bytes_, words = np.maximum(size, 1), np.maximum(n_words, 1)
        values = (upper / np.maximum(upper + lower, 1), digit / bytes_, stop / bytes_, symbol / bytes_, pipe / bytes_, shout / bytes_, high / bytes_, size / words, n_words, again[0] / words, np.zeros(len(ends)), again[1] / words)
        bins = np.stack([np.digitize(v, e) for v, e in zip(values, EDGES)], axis=1).astype(np.uint8)
        return bins, doc, size, hashed(starts, ends), n_words > 0


def places(doc: np.ndarray) -> np.ndarray:
    """The place of each line in its document."""
    first = np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1))  # the first line begins a document, whatever its number
    return np.arange(len(doc)) - np.repeat(first, np.diff(first, append=len(doc)))


def ids(bins: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each line the numbers of its active weights: one for each feature of the line before, itself
    and the line after; a line that isn't there has bin BINS in all."""
    n, f = bins.shape
    none = np.full((1, f), BINS, np.uint8)
    before = np.concatenate([none, bins[:-1]]) if n else bins
    after = np.concatenate([bins[1:], none]) if n else bins
    edge = np.diff(doc) != 0
    before[1:][edge], after[:-1][edge] = BINS, BINS
    flat = np.concatenate([before, bins, after], axis=1).astype(np.int32)
    return flat + np.arange(PLACES * f, dtype=np.int32) * (BINS + 1)


N_WEIGHTS = PLACES * len(EDGES) * (BINS + 1)


def scan(m: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Products of the 2 x 2 matrices of each document up to each line, up to scale."""
    m, d = m / m.sum((1, 2), keepdims=True), 1
    while d <= place.max(initial=0):
        at = np.flatnonzero(place >= d)
        p, q = m[at - d], m[at]
        new = np.empty_like(p)
        for i in (0, 1):
            for j in (0, 1):
                new[:, i, j] = p[:, i, 0] * q[:, 0, j] + p[:, i, 1] * q[:, 1, j]
        m = m.copy()
        m[at] = new / new.sum((1, 2), keepdims=True)
        d *= 2
    return m


def unaries(score: np.ndarray) -> np.ndarray:
    half = np.clip(score, -60, 60) / 2
    return np.exp(np.stack([-half, half], axis=1))


def forward_messages(unary: np.ndarray, t: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each line the weights of its labels over all labellings of the lines up to it, up to scale."""
    m = t[None] * unary[:, None, :]
    first = place == 0
    m[first] = np.stack([unary[first]] * 2, axis=1)
    return scan(m, place)[:, 0, :]


def marginals(score: np.ndarray, pair: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and P(label before, label) of each line that has one before (else zeros)."""
    place, unary, t = places(doc), unaries(score), np.exp(pair)
    forward = forward_messages(unary, t, place)
    # Backward: the same over reversed lines, each matrix leading from the label after to the label.
    backward = forward_messages(unary[::-1], t.T, places(-doc[::-1]))[::-1] / unary  # without the line's own score
    both = forward * backward
    p = both / both.sum(1, keepdims=True)
    pairs = np.zeros((len(score), 2, 2))
    at = np.flatnonzero(place > 0)
    x = forward[at - 1][:, :, None] * t[None] * (unary[at] * backward[at])[:, None, :]
    pairs[at] = x / x.sum((1, 2), keepdims=True)
    return p[:, 1], pairs


def long_marginals(score: np.ndarray, pair: np.ndarray, block: int) -> np.ndarray:
    """P(good) of each line of one long document, in blocks: the message into each block from before is kept, then blocks are
    gone through from the last to the first with the message from behind."""
    t, p = np.exp(pair), np.empty(len(score))
    starts = range(0, len(score), block)

    def forward(a: int, message: np.ndarray | None) -> np.ndarray:
        unary = unaries(score[a : a + block])
        if message is not None:
            unary[0] *= message @ t
        return forward_messages(unary, t, np.arange(len(unary)))

    into: list[np.ndarray | None] = [None]
    for a in starts:
        into.append(forward(a, into[-1])[-1])
    behind = None
    for a, message in zip(reversed(starts), into[-2::-1]):
        unary = unaries(score[a : a + block])
        back = unary.copy()
        if behind is not None:
            back[-1] *= t @ behind
        back = forward_messages(back[::-1], t.T, np.arange(len(back)))[::-1]
        both = forward(a, message) * (back / unary)
        p[a : a + block] = both[:, 1] / both.sum(1)
        behind = back[0]
    return p


class Model:
    def __init__(self, weights: np.ndarray | None = None, pair: np.ndarray | None = None):
        self.weights = np.zeros(N_WEIGHTS) if weights is None else weights
        self.pair = np.zeros((2, 2)) if pair is None else pair

    def fit(self, bins: np.ndarray, doc: np.ndarray, label: np.ndarray, size: np.ndarray | None = None, rounds: int = 2, clear: float = 0.75, most: float = 0.3) -> Model:
        """From documents' labels. Lines begin with their document's; after each round those that by their own features are of the
        other label with a probability of `clear` take it, unless in their document these hold over `most` of the bytes. size: bytes of
        each line."""
        if not len(doc):
            return self
        of_doc, size = label[doc].astype(np.int64), np.ones(len(doc)) if size is None else size
        self.fit_lines(bins, doc, of_doc)
        for _ in range(rounds):
            # Only a line's own features, fitted alone, so that neighbours don't decide for it.
            alone = Model().fit_lines(bins, np.arange(len(doc)), self.lines, weigh=1 / np.bincount(doc)[doc])
            p = 1 / (1 + np.exp(-alone.line_scores(bins, np.arange(len(doc)))))
            against = np.where(of_doc == 1, 1 - p, p) >= clear
            share = np.bincount(doc, weights=size * against) / np.bincount(doc, weights=size)
            lines = np.where(against & (share <= most)[doc], 1 - of_doc, of_doc)
            if (lines == self.lines).all():
                break
            self.fit_lines(bins, doc, lines)
        return self

    def fit_lines(self, bins: np.ndarray, doc: np.ndarray, y: np.ndarray, steps: int = 80, rate: float = 0.15, decay: float = 1e-3, weigh: np.ndarray | None = None) -> Model:
        """Maximum likelihood of the lines' labels by Adam on the exact gradient. Documents weigh alike, whatever
        their number of lines, unless weights are given. doc: the document's number of each line, ascending."""
        self.lines, active = y, ids(bins, doc)
        self.weights, self.pair = np.zeros(N_WEIGHTS), np.zeros((2, 2))
        weigh = 1 / np.bincount(doc)[doc] if weigh is None else weigh
        weigh = weigh / weigh.sum()
        at = np.flatnonzero(places(doc) > 0)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at - 1], y[at]), weigh[at])
        x = np.concatenate([self.weights, self.pair.ravel()])
        m, v = np.zeros_like(x), np.zeros_like(x)
        for step in range(1, steps + 1):
            p, pairs = marginals(x[:N_WEIGHTS][active].sum(1), x[N_WEIGHTS:].reshape(2, 2), doc)
            miss = weigh * (y - p)
            g = np.concatenate([np.bincount(active.ravel(), weights=np.repeat(miss, active.shape[1]), minlength=N_WEIGHTS), (seen - (pairs * weigh[:, None, None]).sum(0)).ravel()]) - decay * x / len(EDGES)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            x = x + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        self.weights, self.pair = x[:N_WEIGHTS], x[N_WEIGHTS:].reshape(2, 2)
        return self

    def line_scores(self, bins: np.ndarray, doc: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """The summed weights of each line, whose neighbours may lie outside a block."""
        out = np.empty(len(doc))
        for a in range(0, len(doc), block):
            low, high = max(a - 1, 0), min(a + block + 1, len(doc))
            out[a : a + block] = self.weights[ids(bins[low:high], doc[low:high])].sum(1)[a - low : a - low + block]
        return out

    def good(self, lines: Lines) -> np.ndarray:
        """P(good) of each line."""
        score, p = self.line_scores(lines.bins, lines.doc), np.empty(len(lines.doc))
        edges = np.searchsorted(lines.doc, np.arange(lines.docs + 1))
        long = np.flatnonzero(np.diff(edges) > MANY)
        a = 0
        for k in [*long.tolist(), lines.docs]:
            b = edges[k]
            if a < b:
                p[a:b] = marginals(score[a:b], self.pair, lines.doc[a:b])[0]
            if k < lines.docs:
                p[b : edges[k + 1]] = long_marginals(score[b : edges[k + 1]], self.pair, MANY)
                a = edges[k + 1]
        return p

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """The quality of each text, from 0 to 1."""
        if not texts:
            return np.empty(0)
        lines = Lines(texts)
        total = np.bincount(lines.doc, weights=lines.size, minlength=lines.docs)
        return np.clip(np.bincount(lines.doc, weights=self.good(lines) * lines.size, minlength=lines.docs) / total, 0, 1)


def held_out(id_column: str = "doc_id") -> Column:
    """Whether the remainder by 4 of the CRC-32 of the id's text is 2; false without an id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = 6000, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", most_lines: int = 2000) -> Model:
    """A model of the labelled documents that aren't held out. `most` bounds how many are used: those
    whose ids have the least hashes; `most_lines` bounds a document's lines in the fit alone, never in a score. Labels of 0 and 1
    count; an id with both counts as 1; of different texts of one id one is taken. Without any
    labelled document all weights are zero and every score is a half."""
    known = labels.where(F.col(label_column).isin(0, 1) & ~held_out(id_column)).groupBy(id_column).agg(F.max(label_column).cast("int").alias("y"))
    known = known.where(F.col(id_column).isNotNull()).orderBy(F.xxhash64(id_column), id_column).limit(most)
    chosen = docs.select(F.col(id_column), F.col(text_column).alias("text")).join(F.broadcast(known), id_column)  # at most `most` rows

    def run(batches):
        for batch in lean(batches):
            lines = Lines(batch.column("text").cast(pa.binary()).to_pylist())
            at = np.searchsorted(lines.doc, np.arange(lines.docs + 1))
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("y"), pa.array([lines.bins[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()), pa.array([lines.size[a:b].astype("<i8").tobytes() for a, b in zip(at, at[1:])], pa.binary())], ["i", "y", "bins", "size"])

    measured = chosen.select(F.col(id_column).alias("i"), "y", "text").mapInArrow(run, f"i {docs.schema[id_column].dataType.simpleString()}, y int, bins binary, size binary")
    # Repeated rows of an id count once, and a document of very many lines by its first, so that what the driver holds is bounded.
    measured = measured.groupBy("i").agg(F.min(F.struct("y", F.substring("bins", 1, len(EDGES) * most_lines).alias("bins"), F.substring("size", 1, 8 * most_lines).alias("size"))).alias("m"))
    rows = sorted(measured.select("i", "m.*").collect())
    bins = [np.frombuffer(r.bins, np.uint8).reshape(-1, len(EDGES)) for r in rows]
    size = np.concatenate([np.empty(0), *(np.frombuffer(r.size, "<i8") for r in rows)])
    doc = np.repeat(np.arange(len(rows)), [len(b) for b in bins])
    return Model().fit(np.concatenate([np.empty((0, len(EDGES)), np.uint8), *bins]), doc, np.array([r.y for r in rows], np.int64), size)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row; null and empty texts are one empty line. Repeated
    rows stay repeated; an empty table gives no rows; further columns of `docs` don't matter, whatever their names. Long texts are
    taken in pieces. A narrow pass without a shuffle."""

    def run(batches):
        for batch in lean(batches):
            s = model.scores(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s, pa.float64())], ["id", "score"])

    out = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {docs.schema[id_column].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_column), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7, text_column: str = "text") -> DataFrame:
    """The rows of `docs` whose quality reaches the threshold, all columns as they are. A null or empty text is judged as one empty
    line; repeated rows stay or go together; an empty table gives no rows."""

    def run(batches):
        for batch in lean(batches, text_column):
            yield batch.filter(pa.array(model.scores(batch.column(text_column).cast(pa.binary()).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, most: int = 6000, threshold: float = 0.7) -> DataFrame:
    return score(docs, train(docs, labels, most), threshold)
