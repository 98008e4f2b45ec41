"""Read classifiers. The default is a logistic regression over hashed pairs of k-mer and call, conditioned on the
region; any batch model can take its place."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.encode import frame_codes, frame_ids
from readloom.functions.kmer import digits_to_codes
from readloom.functions.losses import cross_entropy
from readloom.functions.vocab import sentence_to_ids
from readloom.operators.labels import accuracy, is_region_class
from readloom.sources.tables import hadoop_path, read_text, write_text

#: The weight of the positive class and the exponent of the focal loss.
ALPHA, GAMMA = 0.1, 2


def terms(df: DataFrame) -> DataFrame:
    """Adds the terms that describe a read: each k-mer with its call, and its region."""
    pairs = F.zip_with(F.split("dna_seq", " "), F.split("methyl_seq", ""), lambda t, m: F.concat_ws(":", t, m))
    return df.withColumn("terms", F.concat(F.filter(pairs, lambda x: x != ""), F.array(F.concat(F.lit("region:"), F.coalesce(F.col("dmr_label").cast("string"), F.lit(""))))))


class Scorer:
    """Probabilities of reads: P_N + P_ctype = 1 and pred, the likelier."""

    def __init__(self, model: PipelineModel):
        self.model = model

    @classmethod
    def fit(cls, train: DataFrame, features: int = 1 << 14, iterations: int = 50, penalty: float = 1e-3) -> Scorer:
        """From a read dataset; the label is whether a read's class is its region's."""
        t = terms(train).withColumn("ctype_label", is_region_class())
        lr = LogisticRegression(featuresCol="features", labelCol="ctype_label", maxIter=iterations, regParam=penalty)
        return cls(Pipeline(stages=[HashingTF(inputCol="terms", outputCol="features", numFeatures=features), lr]).fit(t))

    def transform(self, df: DataFrame) -> DataFrame:
        x = self.model.transform(terms(df))
        p = vector_to_array("probability")
        return x.withColumn("P_N", p[0]).withColumn("P_ctype", p[1]).withColumn("pred", F.col("prediction").cast("int")).drop("terms", "features", "rawPrediction", "probability", "prediction")

    def trace(self) -> list[tuple[int, float]]:
        """(step, loss) of the fit, while its summary is in memory."""
        lr = self.model.stages[-1]
        return list(enumerate(lr.summary.objectiveHistory)) if lr.hasSummary else []

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> Scorer:
        return cls(PipelineModel.load(path))


class BatchScorer:
    """A model of framed ids, codes and regions in batches: make_predict gives, once in each worker, a function of three
    arrays (rows x places, rows x places, rows) to probabilities (rows x 2)."""

    def __init__(self, make_predict: Callable[[], Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]], n: int = 150, k: int = 3):
        self.make_predict, self.n, self.k = make_predict, n, k

    def transform(self, df: DataFrame) -> DataFrame:
        make = self.make_predict

        @F.pandas_udf("array<double>")
        def predict(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            f = make()
            for ids, codes, region in batches:
                yield pd.Series(list(np.asarray(f(np.stack(ids), np.stack(codes), region.to_numpy()), float)))

        x = df.withColumn("p", predict(frame_ids(sentence_to_ids(F.col("dna_seq"), self.k), self.n), frame_codes(digits_to_codes(F.col("methyl_seq")), self.n), F.col("dmr_label")))
        return x.withColumn("P_N", F.col("p")[0]).withColumn("P_ctype", F.col("p")[1]).withColumn("pred", (F.col("P_ctype") > F.col("P_N")).cast("int")).drop("p")


class LinearScorer:
    """A weight for each of `features` hashed terms and a bias. What `train_steps` makes."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights  # the bias last

    @property
    def features(self) -> int:
        return len(self.weights) - 1

    def transform(self, df: DataFrame) -> DataFrame:
        weights = self.weights

        @F.pandas_udf("double")
        def chance(ids: pd.Series) -> pd.Series:
            return pd.Series([1 / (1 + np.exp(-np.clip(weights[np.asarray(i, np.int64)].sum() + weights[-1], -500, 500))) for i in ids])

        x = terms(df).withColumn("P_ctype", chance(term_ids(self.features))).drop("terms")
        return x.withColumn("P_N", 1 - F.col("P_ctype")).withColumn("pred", (F.col("P_ctype") > F.col("P_N")).cast("int"))

    def save(self, path: str) -> None:
        write_text(json.dumps(self.weights.tolist()), f"{path}/weights.json")

    @classmethod
    def load(cls, path: str) -> LinearScorer:
        return cls(np.array(json.loads(read_text(f"{path}/weights.json"))))


def term_ids(features: int) -> Column:
    return F.transform("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int"))


def load_scorer(path: str) -> Scorer | LinearScorer:
    """A saved scorer of either kind."""
    where, fs = hadoop_path(f"{path}/weights.json")
    return LinearScorer.load(path) if fs.exists(where) else Scorer.load(path)


def loss_and_slope(z: np.ndarray, y: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """The loss of each logit and its derivative: cross-entropy, or focal with the weights of `losses.sigmoid_focal`."""
    sign = np.where(y == 1, 1.0, -1.0)
    p = 1 / (1 + np.exp(-np.clip(sign * z, -30, 30)))  # of the true class
    if loss == "cross_entropy":
        return -np.log(p), sign * (p - 1)
    share = np.where(y == 1, ALPHA, 1 - ALPHA)
    return -share * (1 - p) ** GAMMA * np.log(p), sign * share * (1 - p) ** GAMMA * (GAMMA * p * np.log(p) + p - 1)


@dataclass(frozen=True)
class Steps:
    """How `train_steps` goes: batches are shares of the rows by a hash; the rate rises over `warmup` steps and falls to zero from
    `decrease` on; every `eval_freq` steps the test set is scored, every `save_freq` the model of the time is kept."""

    steps: int = 100
    lr: float = 0.05
    warmup: int = 10
    decrease: int = 80
    loss: str = "cross_entropy"
    batches: int = 1
    eval_freq: int = 10
    save_freq: int = 0
    features: int = 1 << 14
    penalty: float = 1e-4

    def __post_init__(self):
        if self.loss not in ("cross_entropy", "focal"):
            raise ValueError("the loss is cross_entropy or focal")
        if not 0 <= self.warmup <= self.decrease <= self.steps or self.batches < 1:
            raise ValueError("0 <= warmup <= decrease <= steps and at least one batch are needed")

    def rate(self, step: int) -> float:
        rise = min(1.0, step / self.warmup) if self.warmup else 1.0
        fall = max(0.0, (self.steps - step) / (self.steps - self.decrease)) if step >= self.decrease < self.steps else 1.0
        return self.lr * (rise if step <= self.warmup else fall)


def train_steps(train: DataFrame, test: DataFrame | None = None, how: Steps = Steps(), keep=None) -> tuple[LinearScorer, list[tuple], list[tuple]]:
    """Adam by distributed steps: every task sums the gradient of its rows of the step's batch. Gives the model that was best on the test
    set (the last without one), a row (step, loss, ctype_acc, lr) of each step, and (step, loss, ctype_acc) of each evaluation.
    keep(step, model) is called every `save_freq` steps."""
    n = how.features
    x = terms(train).select(term_ids(n).alias("ids"), is_region_class().alias("y"), F.pmod(F.xxhash64("dna_seq", "methyl_seq", "dmr_label"), F.lit(how.batches)).alias("batch")).persist()
    w, m, v = (np.zeros(n + 1) for _ in range(3))
    best, best_acc, log, evaluations = w.copy(), -1.0, [], []
    for step in range(1, how.steps + 1):

        def gradient(batches, w=w):
            g, total, right, rows = np.zeros(n + 1), 0.0, 0, 0
            for pdf in batches:
                size = pdf["ids"].map(len).to_numpy(np.int64)
                ids, row = np.concatenate([np.empty(0, np.int64), *pdf["ids"]]).astype(np.int64), np.repeat(np.arange(len(pdf)), size)
                z, y = np.bincount(row, weights=w[ids], minlength=len(pdf)) + w[-1], pdf["y"].to_numpy()
                each, slope = loss_and_slope(z, y, how.loss)
                g += np.bincount(ids, weights=slope[row], minlength=n + 1)
                g[-1] += slope.sum()
                total, right, rows = total + each.sum(), right + int(((z > 0) == (y == 1)).sum()), rows + len(pdf)
            yield pd.DataFrame([(g.tolist(), total, right, rows)], columns=["g", "loss", "n_right", "rows"])

        of_step = x if how.batches == 1 else x.where(F.col("batch") == step % how.batches)
        got = of_step.select("ids", "y").mapInPandas(gradient, "g array<double>, loss double, n_right long, rows long").where("rows > 0").collect()  # a row for each task
        rows = sum(r.rows for r in got)
        if not rows:
            continue
        g = sum(np.array(r.g) for r in got) / rows + how.penalty * w
        log.append((step, sum(r.loss for r in got) / rows, sum(r.n_right for r in got) / rows, how.rate(step)))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - how.rate(step) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if test is not None and how.eval_freq and (step % how.eval_freq == 0 or step == how.steps):
            e = evaluate(LinearScorer(w).transform(test)).first()
            evaluations.append((step, e["loss"], e["ctype_acc"]))
            if e["ctype_acc"] is not None and e["ctype_acc"] > best_acc:
                best, best_acc = w.copy(), e["ctype_acc"]
        if keep and how.save_freq and step % how.save_freq == 0:
            keep(step, LinearScorer(w))
    x.unpersist()
    return LinearScorer(w if best_acc < 0 else best), log, evaluations


def evaluate(scored: DataFrame) -> DataFrame:
    """One row (loss, ctype_acc) of scored reads with labels."""
    logit = F.ln(F.greatest("P_ctype", F.lit(1e-300))) - F.ln(F.greatest("P_N", F.lit(1e-300)))
    x = scored.withColumn("label", is_region_class())
    loss = x.agg(F.avg(cross_entropy(F.lit(0.0), logit, F.col("label"))).alias("loss"))
    return loss.crossJoin(accuracy(x).withColumnRenamed("accuracy", "ctype_acc"))  # one row by one row
