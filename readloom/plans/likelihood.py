"""Likelihoods of a mixture of two classes over a grid of shares, and of K classes.

A read adds ln((1 - t) P_N / m_N + t P_ctype / m_T) at the share t. Reads of equal probabilities add the same, so they
are counted first; the grid then meets distinct pairs, not reads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ln(x: Column) -> Column:
    """The logarithm with minus infinity at zero."""
    return F.when(x <= 0, float("-inf")).otherwise(F.ln(x))


def mixed(theta: Column, m_n: float, m_t: float, p_n: str = "P_N", p_t: str = "P_ctype") -> Column:
    return (1 - theta) * F.col(p_n) / m_n + theta * F.col(p_t) / m_t


def weighed(reads: DataFrame, *groups: str) -> DataFrame:
    """Distinct probabilities with the number of their reads."""
    return reads.groupBy(*groups, "P_N", "P_ctype").agg(F.count("*").alias("weight"))


def grid_likelihood(reads: DataFrame, m_n: float, m_t: float, n_grid: int = 10_000, groups: tuple[str, ...] = (), few: int = 20_000) -> DataFrame:
    """(groups, i, theta, ll) for theta = i / n_grid below 1. The grid is exploded beside the distinct pairs and summed in each
    task before anything moves; with more than `few` pairs each task adds whole grids as vectors."""
    theta = F.col("i") / F.lit(float(n_grid))
    w = weighed(reads, *groups)
    if w.limit(few + 1).count() > few:
        ll = grid_vectors(w, m_n, m_t, n_grid, groups).groupBy(*groups, "i").agg(F.sum("ll").alias("ll"))
        return ll.withColumn("theta", theta)
    w = w.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))))
    ll = w.groupBy(*groups, "i").agg(F.sum(F.col("weight") * ln(mixed(theta, m_n, m_t))).alias("ll"))
    return ll.withColumn("theta", theta)


def grid_vectors(w: DataFrame, m_n: float, m_t: float, n_grid: int, groups: tuple[str, ...], held: int = 1000) -> DataFrame:
    """(groups, i, ll): each task's sums, in blocks of pairs by grid. A task that meets more than `held` groups hands out what
    it has and goes on."""
    grid = np.arange(n_grid) / n_grid

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}

        def emit():
            for key, ll in sums.items():
                yield pd.DataFrame({g: [k] * n_grid for g, k in zip(groups, key)} | {"i": np.arange(n_grid, dtype=np.int32), "ll": ll})
            sums.clear()

        for pdf in batches:
            keys = pdf.groupby(list(groups), dropna=False, sort=False).indices.items() if groups else [((), np.arange(len(pdf)))]
            for key, at in keys:
                key = key if isinstance(key, tuple) else (key,)
                total = sums.setdefault(key, np.zeros(n_grid))
                for k in range(0, len(at), 64):
                    x = pdf.iloc[at[k : k + 64]]
                    p = np.outer(x["P_N"] / m_n, 1 - grid) + np.outer(x["P_ctype"] / m_t, grid)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        total += x["weight"].to_numpy() @ np.where(p <= 0, -np.inf, np.log(p))
            if len(sums) > held:
                yield from emit()
        yield from emit()

    kinds = {f.name: f.dataType.simpleString() for f in w.schema.fields}
    return w.mapInPandas(run, ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), "i int", "ll double"]))


def best_on_grid(grid: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, theta, likelihood, fi): the first share of the greatest likelihood, and the population variance of the
    likelihood's first differences. A grid has a bounded number of rows in each group."""
    by = Window.partitionBy(*groups).orderBy("i")
    g = grid.withColumn("step", F.lead("ll").over(by) - F.col("ll"))
    best = F.max_by(F.struct("theta", "ll"), F.struct(F.col("ll"), -F.col("i")))
    out = g.groupBy(*groups).agg(best.alias("b"), F.var_pop("step").alias("fi"))
    return out.select(*groups, F.col("b.theta").alias("theta"), F.col("b.ll").alias("likelihood"), "fi")


def class_likelihood(reads: DataFrame, margins: DataFrame, thetas: dict[str, float]) -> DataFrame:
    """(dmr_ctype, nll) at the classes' shares: minus the sum of ln((1 - t)(1 - p)/(1 - m) + t p/m) over the reads of each class's regions."""
    t = reads.sparkSession.createDataFrame(list(thetas.items()), "k string, theta double")
    k = margins.join(F.broadcast(t), F.col("ctype") == F.col("k")).select("k", "margin", "theta")
    x = reads.groupBy("dmr_ctype", "P_ctype").agg(F.count("*").alias("weight")).join(F.broadcast(k), F.col("dmr_ctype") == F.col("k"))
    p, m, s = F.col("P_ctype"), F.col("margin"), F.col("theta")
    return x.groupBy("dmr_ctype").agg((-F.sum(F.col("weight") * ln((1 - s) * (1 - p) / (1 - m) + s * p / m))).alias("nll"))
