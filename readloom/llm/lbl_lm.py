"""Language-model scores: a log-bilinear neural model fitted by noise-contrastive estimation in numpy.

A symbol is the end of a text, one of the most frequent words, or the class of any other word by its
last bytes. The two symbols before predict a vector, the sum of a context matrix for each place times the symbol's
vector there; a symbol's score is that vector's product with the symbol's own, plus the symbol's bias. A word of a class takes its
share of the class by add-one counts.

Fitting goes over all training texts. In each round every task takes the documents whose ids' hash is of that round, starts
from the common model and makes steps of noise-contrastive estimation: words as they stand against drawn noise. The
tasks' models, weighed by their tokens, are averaged for the next round. So each token is learned from once, what is gathered
grows with the corpus, and nothing but models of a size given by parameters reaches the driver.

Scores are normalised: over all symbols, exp(from one place + from the other) sums to an entry of the product of two
matrices, so one product of all contexts by all contexts gives every normaliser.

Counts of frequent words, a bounded number, are broadcast; the other words of a text are joined
with their counts, and none of these is a hot key.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterable
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import cut, sliced
from readloom.llm.simhash import LOWER

END = b""
SUFFIX = 3


def held_out(id_column: str = "doc_id") -> Column:
    """Whether the remainder by 7 of the CRC-32 of the id's text is 2; false without an id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_of(batch: pa.RecordBatch) -> list[list[bytes]]:
    return [(t or b"").translate(LOWER).split() for t in batch.column("text").cast(pa.binary()).to_pylist()]


def token_counts(df: DataFrame, most: int = 300_000) -> DataFrame:
    """(token, c) over all texts, the end as an empty token. Tasks add up what they can hold first."""

    def emit(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())], ["token", "c"])

    def run(batches):
        c: Counter = Counter()
        for batch in sliced(batches):
            for w in words_of(batch):
                c.update(w)
                c[END] += 1
            if len(c) > most:
                yield emit(c)
                c = Counter()
        if c:
            yield emit(c)

    return df.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Symbols of tokens. 0 is the end; then `words` frequent words; then classes by suffix."""

    def __init__(self, words: list[bytes], classes: int):
        if 1 + len(words) + classes > 1 << 16:
            raise ValueError("symbols don't fit 16 bits")
        self.words, self.classes = words, classes
        self.symbols = {END: 0} | {w: i for i, w in enumerate(words, 1)}
        self.size = 1 + len(words) + classes

    def symbol(self, token: bytes) -> int:
        s = self.symbols.get(token)
        return 1 + len(self.words) + zlib.crc32(token[-SUFFIX:]) % self.classes if s is None else s


class Memoised(dict):
    """Symbols of tokens, those of classes for up to `most` tokens at a time."""

    def __init__(self, v: Vocabulary, most: int = 200_000):
        super().__init__(v.symbols)
        self.v, self.most = v, most

    def __missing__(self, token: bytes) -> int:
        s = self.v.symbol(token)
        if len(token) <= 64:
            if len(self) >= self.most:
                self.clear()
                self.update(self.v.symbols)
            self[token] = s
        return s


def chain(words: list[list[bytes]], symbols: Memoised) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts, each with its end, in one array; before the first are two ends. And lengths."""
    n = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    out = np.zeros(n.sum() + 2, np.uint16)
    at, of = 2, symbols.__getitem__
    for w in words:
        out[at : at + len(w)] = list(map(of, w))
        at += len(w) + 1
    return out, n


def contexts(s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbol before each of a chain, and the one before that; before a text are ends."""
    one, two = s[1:-1], s[:-2].copy()
    two[np.cumsum(n) - n] = 0
    return one, two


def summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and the sums of their rows. Two floats of a row are added at a time, as the parts of
    a complex number, since a sum's cost here is that of its start."""
    if rows.shape[1] % 2:
        at, more = summed(at, np.column_stack([rows, np.zeros(len(rows), rows.dtype)]))
        return at, more[:, :-1]
    order = np.argsort(at, kind="stable")  # of 16-bit numbers, hence in linear time
    at = at[order]
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return at[first].astype(np.intp), np.add.reduceat(rows.view(np.result_type(rows, np.complex64)).take(order, axis=0), first, axis=0).view(rows.dtype)


#: Rows of a product that stay on one thread: more threads than a task has cores only cost time.
ROWS = 64


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y by ROWS rows of x."""
    whole = len(x) // ROWS * ROWS
    out = np.empty((len(x), y.shape[1]), x.dtype)
    np.matmul(x[:whole].reshape(-1, ROWS, x.shape[1]), y, out=out[:whole].reshape(-1, ROWS, y.shape[1]))
    np.matmul(x[whole:], y, out=out[whole:])
    return out


def over(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y by ROWS rows of both."""
    whole = len(x) // ROWS * ROWS
    parts = x[:whole].reshape(-1, ROWS, x.shape[1]).transpose(0, 2, 1) @ y[:whole].reshape(-1, ROWS, y.shape[1])
    return parts.sum(0) + x[whole:].T @ y[whole:]


class LogBilinear:
    """Vectors of symbols as contexts and as words, a matrix for each of two places, and biases."""

    def __init__(self, size: int, width: int, q: np.ndarray, seed: int = 1):
        """q: the symbols' frequencies, from which noise is drawn and which the biases start from."""
        rng = np.random.default_rng(seed)
        of = lambda: rng.normal(0, 0.1, (size, width)).astype(np.float32)
        self.q = np.asarray(q, np.float32) / np.float32(np.sum(q))
        self.parts = [of(), of(), np.eye(width, dtype=np.float32), np.eye(width, dtype=np.float32) / 2, np.log(self.q)]
        self.seen = [np.full_like(p, 0.1) for p in self.parts]  # sums of squared gradients

    def move(self, k: int, at, g: np.ndarray, rate: float) -> None:
        """A step up a part's gradient, slower where there were large ones."""
        by = g * g
        by += self.seen[k][at]
        self.seen[k][at] = by
        np.sqrt(by, out=by)
        np.divide(g, by, out=by)
        by *= np.float32(rate)
        self.parts[k][at] += by

    def step(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, drawn: np.ndarray, noise: int, rate: float) -> None:
        """Words against `noise` draws each; the draws of a step are shared and weigh as many as there should be."""
        context, target, c1, c2, bias = self.parts
        r1, r2, t, d = (x.take(at, axis=0) for x, at in ((context, one), (context, two), (target, word), (target, drawn)))
        made = times(r1, c1) + times(r2, c2)
        shift = bias - np.log(noise * self.q)
        # The chance that a pair is noise, for words; that it is data, for draws.
        up = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", made, t) + shift[word], -30, 30)))
        down = times(made, -d.T)
        down -= shift[drawn]
        np.exp(np.clip(down, -30, 30, out=down), out=down)
        down += 1
        np.divide(np.float32(-noise / len(drawn)), down, out=down)
        back = up[:, None] * t + times(down, d)
        at, g = summed(np.concatenate([one, two]), np.concatenate([times(back, c1.T), times(back, c2.T)]))
        g1, g2 = over(r1, back), over(r2, back)
        n, width = made.shape
        rows = np.zeros((n + len(drawn), width + 2 - width % 2), made.dtype)  # of even length; the last is the bias's
        np.multiply(made, up[:, None], out=rows[:n, :width])
        rows[n:, :width] = over(down, made)
        rows[:n, -1], rows[n:, -1] = up, down.sum(0)
        to, h = summed(np.concatenate([word, drawn]), rows)
        self.move(0, at, g, rate)
        self.move(1, to, h[:, :width], rate)
        self.move(2, slice(None), g1, rate)
        self.move(3, slice(None), g2, rate)
        self.move(4, to, h[:, -1], rate)

    def fit(self, examples: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], rng: np.random.Generator, batch: int = 1024, noise: int = 20, draws: int = 64, rate: float = 0.1, least: int = 300) -> int:
        """Steps over chains of (one, two, word), in a random order within each. If all are fewer than `least` steps of examples,
        they are gone over again until as many were made. Gives the number of examples."""
        ladder, held, n, steps = np.cumsum(self.q, dtype=np.float64), [], 0, 0

        def go(one, two, word):
            nonlocal steps
            order = rng.permutation(len(word))
            for a in range(0, len(word), batch):
                at = order[a : a + batch]
                drawn = np.minimum(np.searchsorted(ladder, rng.random(draws) * ladder[-1]), len(ladder) - 1).astype(np.uint16)
                self.step(one[at], two[at], word[at], drawn, noise, rate)
                steps += 1

        for x in examples:
            go(*x)
            n += len(x[2])
            if steps < least:
                held.append(x)
        while n and steps < least:
            go(*map(np.concatenate, zip(*held)))
        return n

    def tables(self, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the symbol before and the one before that add to the predicted vector; and the logarithm of the sum of exp over all
        words for each two contexts, products of blocks by blocks."""
        context, target, c1, c2, bias = self.parts
        near, far = context @ c1, context @ c2

        def weights(rows: np.ndarray, more) -> tuple[np.ndarray, np.ndarray]:
            s = rows @ target.T + more
            top = s.max(1, keepdims=True)
            return np.exp(s - top), top

        z = np.empty((len(bias),) * 2, np.float32)
        for b in range(0, len(bias), block):
            w2, top2 = weights(far[b : b + block], 0)
            for a in range(0, len(bias), block):
                w1, top1 = weights(near[a : a + block], bias)
                z[a : a + block, b : b + block] = np.log(np.maximum(w1 @ w2.T, 1e-37)) + top1 + top2.T
        return near, far, z


def packed(parts: list[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(p, np.float32).tobytes() for p in parts)


def unpacked(data: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    cuts = np.cumsum([p.size for p in like])[:-1]
    return [x.reshape(p.shape) for x, p in zip(np.split(data, cuts), like)]


def fitted(training: DataFrame, v: Vocabulary, model: LogBilinear, rounds: int, tasks: int) -> LogBilinear:
    """The model after all rounds. training: (text, turn), turn a hash. Each task gives its parts times its tokens; these are added up
    in groups, so that the driver gets the square root of the number of tasks."""
    spark = training.sparkSession

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in t.column("parts"))
        return pa.table({"n": [pc.sum(t.column("n")).as_py()], "parts": pa.array([total.tobytes()], pa.binary())})

    for r in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, r=r, shared=shared):
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            mine, symbols = pickle.loads(pickle.dumps(shared.value)), Memoised(v)

            def examples():
                for batch in sliced(batches):
                    s, n = chain(words_of(batch), symbols)
                    yield *contexts(s, n), s[2:]

            n = mine.fit(examples(), np.random.default_rng([r, task]))
            if n:
                data = np.frombuffer(packed(mine.parts + mine.seen), np.float32).astype(np.float64) * n
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([n], pa.int64()), pa.array([data.tobytes()], pa.binary())], ["task", "n", "parts"])

        of_round = training.where(F.pmod("turn", F.lit(rounds)) == r).select("text").coalesce(tasks)
        made = of_round.mapInArrow(run, "task int, n long, parts binary").groupBy((F.col("task") % math.isqrt(tasks)).alias("k")).applyInArrow(add, "n long, parts binary")
        n, total = 0, 0.0
        for row in made.toLocalIterator():
            n, total = n + row.n, total + np.frombuffer(row.parts, np.float64)
        if n:
            like = model.parts + model.seen
            new = unpacked((total / n).astype(np.float32), like)
            model.parts, model.seen = new[: len(model.parts)], new[len(model.parts) :]
        shared.unpersist()
    return model


class Scorer:
    """All that a task needs to score texts: sizes are bounded by parameters, not by the corpus."""

    def __init__(self, model: LogBilinear, v: Vocabulary, frequent: dict[bytes, int], class_tokens: np.ndarray):
        self.model, self.v, self.frequent, self.class_tokens = model, v, frequent, class_tokens

    def ready(self) -> Scorer:
        if not hasattr(self, "near"):
            (self.near, self.far, self.sums), self.memo = self.model.tables(), Memoised(self.v)
            self.index = {w: i for i, w in enumerate(self.frequent)}
            self.log = np.log10(np.fromiter(self.frequent.values(), np.float64, len(self.frequent)) + 1)
            self.symbol = np.array([self.v.symbol(w) for w in self.frequent], np.int64)
            self.inner = np.concatenate([np.zeros(1 + len(self.v.words)), np.log10(self.class_tokens)])
            self.frequent = None  # its words are in the index
        return self

    def score(self, words: list[list[bytes]]):
        """For each text: tokens, known frequent ones, their sum of log10(c + 1), the sum of what the model gives
        without the counts of other words; and (text, word, times) of other words."""
        n = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        ids, at, other = np.empty(n.sum(), np.int64), 0, []
        for k, w in enumerate(words):
            ids[at : at + len(w)] = here = np.fromiter(map(self.index.get, w, repeat(-1)), np.int64, len(w))
            at += len(w) + 1
            ids[at - 1] = self.index.get(END, -1)
            if len(rare := np.flatnonzero(here < 0)):
                other += [(k, x, c) for x, c in Counter([w[i] for i in rare]).items()]
        text = np.repeat(np.arange(len(words)), n)
        ends = np.cumsum(n) - 1
        is_end = np.zeros(len(ids), bool)
        is_end[ends] = True
        known = ids >= 0
        symbols = np.empty(len(ids), np.int64)
        symbols[known] = self.symbol[ids[known]]
        lost = np.flatnonzero(~known & ~is_end)
        if len(lost):
            start = ends - n + 1
            symbols[lost] = [self.memo[words[k][i]] for k, i in zip(text[lost].tolist(), (lost - start[text[lost]]).tolist())]
        symbols[ends] = 0
        log = np.where(known, self.log[np.maximum(ids, 0)] if len(self.log) else 0.0, 0.0)
        one, two = contexts(np.concatenate([[0, 0], symbols]), n)
        classed = symbols > len(self.v.words)
        target, bias = self.model.parts[1], self.model.parts[4]
        given = np.empty(len(symbols))
        for a in range(0, len(symbols), 1 << 15):
            at = slice(a, a + (1 << 15))
            given[at] = np.einsum("ij,ij->i", self.near[one[at]] + self.far[two[at]], target[symbols[at]]) + bias[symbols[at]] - self.sums[one[at], two[at]]
        lm = given / math.log(10) + np.where(classed, log - self.inner[symbols], 0.0)
        add = lambda x: np.bincount(text, weights=x, minlength=len(words))
        return n, add(known).astype(np.int64), add(log), add(lm), other


def score_texts(df: DataFrame, training: DataFrame, words: int = 2559, classes: int = 512, width: int = 32, frequent: int = 400_000, longest: int = 64, rounds: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row of `df`, with a model of `training`.
    Null and empty texts have one token, their end. base_score: add-one counts of single tokens; score: the
    model. Repeated rows stay repeated and are learned from as often; an empty table gives no rows; further columns don't matter,
    whatever their names. Without training texts all counts are 0 and the model is that of the start.

    words, classes: symbols of the model; width: of vectors; frequent: the most words whose counts
    are broadcast, of up to `longest` bytes each; all other words are joined with theirs; rounds: averages of tasks' models.
    The model depends on how many tasks there are (spark.default.parallelism) and what each reads."""
    spark = df.sparkSession
    tasks = max(1, spark.sparkContext.defaultParallelism)
    training = training.select(F.col(text_column).alias("text"), F.xxhash64(F.col(id_column).cast("string"), F.col(text_column)).alias("turn"))
    counts = cut(token_counts(training))
    n_all, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # Bars of a histogram by the logarithm of the count: the last ones that together hold no more than `frequent` words. Long words
    # are never broadcast, so that what is has a bound in bytes. The end is in every text and never joined, so it always is.
    bar = F.when(F.length("token") <= longest, F.floor(F.ln("c") * 50)).otherwise(-1)
    least, held = 1 << 30, 0
    for c, n in sorted(counts.where(bar >= 0).groupBy(bar.alias("bar")).count().collect(), reverse=True):
        if held + n > frequent:
            break
        least, held = c, held + n
    top = counts.where((bar >= least) | (F.length("token") == 0)).orderBy(F.desc("c"), "token").toArrow()
    top = dict(zip(top.column("token").to_pylist(), top.column("c").to_pylist()))
    v = Vocabulary([w for w in islice(top, words + 1) if w != END][:words], classes)
    own = spark.createDataFrame([(bytearray(w),) for w in [END, *v.words]], "token binary")
    of_class = (F.crc32(F.expr(f"substring(token, -{SUFFIX}, {SUFFIX})")) % classes).cast("int")
    rest = counts.join(F.broadcast(own), "token", "left_anti").groupBy(of_class.alias("k")).agg(F.sum("c"), F.count("*")).collect()
    class_tokens, tokens = np.ones(classes), np.zeros(classes)
    for k, c, n in rest:
        class_tokens[k], tokens[k] = c + n + 1, c
    q = np.concatenate([[top.get(END, 0)], [top[w] for w in v.words], tokens]) + 1.0
    model = fitted(training, v, LogBilinear(v.size, width, q), rounds, tasks)
    shared = spark.sparkContext.broadcast(Scorer(model, v, top, class_tokens))

    def run(batches):
        scorer = shared.value.ready()
        for batch in sliced(batches):
            n, known, log, lm, other = scorer.score(words_of(batch))
            rows, nothing = batch.num_rows, len(other)
            # A text's own row has a token that no word equals, so that it meets no count and no hot key.
            row = batch.column("row").to_pylist()
            tokens = [b" %d" % r for r in row] + [x for _, x, _ in other]
            which = np.array([k for k, _, _ in other], np.int64)
            pad = lambda x, kind: pa.array(list(x) + [None] * nothing, kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column("row"), batch.column("row").take(pa.array(which))]),
                    pa.array(tokens, pa.binary()),
                    pa.array([0] * rows + [c for _, _, c in other], pa.int64()),
                    pad(batch.column("id").to_pylist(), batch.column("id").type),
                    pad(n, pa.int64()),
                    pad(known, pa.int64()),
                    pad(log, pa.float64()),
                    pad(lm, pa.float64()),
                ],
                ["row", "token", "times", "id", "n", "known", "log", "lm"],
            )

    source = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = f"row long, token binary, times long, id {df.schema[id_column].dataType.simpleString()}, n long, known long, log double, lm double"
    parts = source.mapInArrow(run, schema)
    rare = counts.where(bar < least)
    log = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1)
    sums = parts.join(rare, "token", "left").groupBy("row").agg(
        F.max("id").alias("id"), F.max("n").alias("n"), F.max("known").alias("known"), F.max("log").alias("log"), F.max("lm").alias("lm"),
        F.sum(log).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
    )
    one = math.log10(n_all + n_distinct + 1)
    return sums.select(
        F.col("id").alias(id_column), F.col("n").alias("n_tokens"), (F.col("known") + F.col("more_known")).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("log") + F.col("more") - F.col("n") * one).alias("base_score"), (F.col("lm") + F.col("more")).alias("score"),
    )


def scored(df: DataFrame, **options) -> DataFrame:
    """All rows of `df` scored with a model of those that aren't held out."""
    out = score_texts(df, df.where(~held_out()), **options)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
