"""Shares of a mixed sample: two classes on a grid, adjusted by regions, and K classes under a constraint."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators.labels import margins as margins_of
from readloom.plans.likelihood import best_on_grid, grid_likelihood


def known_margins(margins: DataFrame, classes: tuple[str, str]) -> tuple[float, float]:
    """The margins of the two classes; an error if one is missing."""
    got = {r["ctype"]: r["margin"] for r in margins.where(F.col("ctype").isin(*classes)).collect()}
    if missing := [c for c in classes if c not in got]:
        raise ValueError(f"margins lack the classes {', '.join(missing)}")
    return got[classes[0]], got[classes[1]]


def purity(reads: DataFrame, margins: DataFrame, n_grid: int = 10_000, classes: tuple[str, str] = ("N", "T")) -> tuple[DataFrame, DataFrame]:
    """(cell_type, pred) of the second class and the first, and (fi, likelihood)."""
    m_n, m_t = known_margins(margins, classes)
    best = best_on_grid(grid_likelihood(reads, m_n, m_t, n_grid))
    return as_shares(best, classes), best.select("fi", "likelihood")


def as_shares(best: DataFrame, classes: tuple[str, str]) -> DataFrame:
    pairs = F.array(F.struct(F.lit(classes[1]).alias("cell_type"), F.col("theta").alias("pred")), F.struct(F.lit(classes[0]).alias("cell_type"), (1 - F.col("theta")).alias("pred")))
    return best.select(F.explode(pairs).alias("x")).select("x.*")


def purity_by_region(reads: DataFrame, margins: DataFrame, n_grid: int = 10_000, classes: tuple[str, str] = ("N", "T")) -> DataFrame:
    """(dmr_label, theta, likelihood, fi)."""
    m_n, m_t = known_margins(margins, classes)
    return best_on_grid(grid_likelihood(reads, m_n, m_t, n_grid, ("dmr_label",)), ("dmr_label",)).orderBy("dmr_label")


def squared_skewness(x: np.ndarray, mean: float) -> float:
    d = x - mean
    m2 = (d**2).mean()
    return float("nan") if m2 <= (np.finfo(float).eps * mean) ** 2 else float(((d**3).mean() / m2**1.5) ** 2)


def quasi_newton(f, x: np.ndarray, steps: int = 200, tolerance: float = 1e-5) -> np.ndarray:
    """A minimum of f by BFGS with forward differences. The first move has a length of 1 at most; a step must lower f enough and
    leave the slope flatter (the weak Wolfe conditions), found by halving and doubling."""

    def gradient(x, fx):
        g, h = np.empty_like(x), 1.5e-8
        for i in range(len(x)):
            y = x.copy()
            y[i] += h
            g[i] = (f(y) - fx) / h
        return g

    inverse, fx = np.eye(len(x)), f(x)
    g = gradient(x, fx)
    for step in range(steps):
        if not np.isfinite(fx) or np.abs(g).max() < tolerance:
            break
        move = -inverse @ g
        slope = g @ move
        if slope >= 0:
            inverse, move = np.eye(len(x)), -g
            slope = g @ move
        t, low, high = min(1.0, 1 / np.linalg.norm(move)) if not step else 1.0, 0.0, np.inf
        for _ in range(40):
            new = x + t * move
            f_new = f(new)
            if not f_new <= fx + 1e-4 * t * slope:
                high = t
            else:
                g_new = gradient(new, f_new)
                if g_new @ move >= 0.9 * slope:
                    break
                low = t
            t = (low + high) / 2 if np.isfinite(high) else 2 * t
        else:
            if not low:
                break
            new = x + low * move
            f_new = f(new)
            g_new = gradient(new, f_new)
        s, y = new - x, g_new - g
        if (sy := s @ y) > 1e-12:
            e = np.eye(len(x)) - np.outer(s, y) / sy
            inverse = e @ inverse @ e.T + np.outer(s, s) / sy
        x, fx, g = new, f_new, g_new
    return x


def adjusted_purity(regions: DataFrame, rounds: int = 10, tolerance: float = 1e-4) -> float:
    """One share from the regions' shares: weights that start at 1 are moved so that the weighted shares are least skewed about the
    estimate, the mean of weighted shares is the new estimate, until it settles. regions: (dmr_label, theta), a row for
    each region, which is what the optimiser needs on the driver."""
    x = np.array([r["theta"] for r in regions.select("dmr_label", "theta").orderBy("dmr_label").collect()], float)
    if not len(x):
        raise ValueError("there are no regions")
    weights, estimate = np.ones(len(x)), float(x.mean())
    for _ in range(rounds):
        weights = quasi_newton(lambda w: squared_skewness(x * w, estimate), weights)
        new = float((x * weights).mean())
        done = abs(new - estimate) < tolerance
        estimate = new
        if done:
            break
    return float(np.clip(estimate, 0, 1))


def purity_adjusted(reads: DataFrame, margins: DataFrame, n_grid: int = 10_000, classes: tuple[str, str] = ("N", "T")) -> tuple[DataFrame, DataFrame]:
    """(cell_type, pred) and (dmr_label, fi, likelihood)."""
    by = purity_by_region(reads, margins, n_grid, classes)
    t = adjusted_purity(by)
    shares = reads.sparkSession.createDataFrame([(classes[1], t), (classes[0], 1 - t)], "cell_type string, pred double")
    return shares, by.select("dmr_label", "fi", "likelihood")


def mixture(reads: DataFrame, margins: DataFrame, low: float = 1e-10, rounds: int = 60, few: int = 100_000) -> DataFrame:
    """(cell_type, pred, nll) of K classes: shares of sum 1 that minimise the classes' summed likelihoods, each within
    [low, 1 - low]. The sum is convex and each share has its own term, so a multiplier l with slope_k(share_k) = -l for all k is
    bisected, and each share within. Reads are summed to distinct probabilities first. few: of how many distinct ones the driver
    takes the table; more stay where they are, and slopes at many points of each class are summed in one aggregation."""
    m = {r["ctype"]: r["margin"] for r in margins.collect()}
    x = reads.where(F.col("dmr_ctype").isin(*m)).groupBy("dmr_ctype", "P_ctype").agg(F.count("*").alias("w")).persist()
    if x.limit(few + 1).count() > few:
        got = shares_by_sections(x, m, low)
        total = sum(got.values())
        nll = summed(x, m, {k: np.array([t / total]) for k, t in got.items()}, nlls)
        rows = [(k, t / total, float(nll[k][0])) for k, t in got.items()]
        x.unpersist()
        return reads.sparkSession.createDataFrame(rows, "cell_type string, pred double, nll double")
    table = x.toPandas()
    x.unpersist()
    terms = {}
    for k, margin in m.items():
        own = table[table["dmr_ctype"] == k]
        terms[k] = (*both_terms(own["P_ctype"].to_numpy(float), margin), own["w"].to_numpy(float))

    def slope(k: str, t: float) -> float:
        return float(slopes(*terms[k], t))

    def share(k: str, l: float) -> float:
        lo, hi = low, 1 - low
        for _ in range(rounds):
            t = (lo + hi) / 2
            lo, hi = (t, hi) if slope(k, t) + l < 0 else (lo, t)
        return (lo + hi) / 2

    reach = 1.0 + sum(float(w.sum()) for _, _, w in terms.values()) / low
    lo, hi = -reach, reach
    for _ in range(200):
        l = (lo + hi) / 2
        lo, hi = (l, hi) if sum(share(k, l) for k in m) > 1 else (lo, l)
    got = {k: share(k, (lo + hi) / 2) for k in m}
    total = sum(got.values())
    rows = [(k, t / total, float(nlls(*terms[k], t / total))) for k, t in got.items()]
    return reads.sparkSession.createDataFrame(rows, "cell_type string, pred double, nll double")


def both_terms(p: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    return p / margin, (1 - p) / (1 - margin) if margin < 1 else np.zeros_like(p)


def slopes(a: np.ndarray, b: np.ndarray, w: np.ndarray, t: float) -> float:
    with np.errstate(divide="ignore", invalid="ignore"):
        return -np.nansum(w * (a - b) / ((1 - t) * b + t * a))


def nlls(a: np.ndarray, b: np.ndarray, w: np.ndarray, t: float) -> float:
    with np.errstate(divide="ignore"):
        return -np.sum(w * np.log((1 - t) * b + t * a))


def summed(x: DataFrame, m: dict[str, float], points: dict[str, np.ndarray], f) -> dict[str, np.ndarray]:
    """f of each class at its points, over (dmr_ctype, P_ctype, w): tasks send partial sums, a row for each class and point."""

    def run(batches):
        sums = {k: np.zeros(len(ts)) for k, ts in points.items()}
        for batch in batches:
            for k, own in batch.groupby("dmr_ctype"):
                a, b = both_terms(own["P_ctype"].to_numpy(float), m[k])
                w = own["w"].to_numpy(float)
                sums[k] += [f(a, b, w, t) for t in points[k]]
        yield pd.DataFrame([(k, i, float(v)) for k, s in sums.items() for i, v in enumerate(s)], columns=["k", "i", "v"])

    out = {k: np.zeros(len(ts)) for k, ts in points.items()}
    for r in x.mapInPandas(run, "k string, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        out[r["k"]][r["i"]] = r["v"]
    return out


def shares_by_sections(x: DataFrame, m: dict[str, float], low: float, points: int = 63, passes: int = 40) -> dict[str, float]:
    """The shares of `mixture` with a pass over the data for each cut of all brackets. Slopes at the points of every bracket tell in
    which section each share lies for any l; the sums of the sections' ends tell between which l the sum is 1."""
    lo, hi = dict.fromkeys(m, low), dict.fromkeys(m, 1 - low)
    for _ in range(passes):
        if all(hi[k] - lo[k] <= 4e-16 * max(1e-3, hi[k]) for k in m):
            break
        at = {k: np.linspace(lo[k], hi[k], points + 2) for k in m}
        got = summed(x, m, {k: t[1:-1] for k, t in at.items()}, slopes)
        # As l grows past minus a point's slope, that class's share falls below the point.
        got = {k: np.maximum.accumulate(s) for k, s in got.items()}
        steps = sorted((-s, -i, k) for k in m for i, s in enumerate(got[k]))
        section = dict.fromkeys(m, points)
        seen = [dict(section)]
        for _, _, k in steps:
            section[k] -= 1
            seen.append(dict(section))
        below = [sum(at[k][s[k]] for k in m) for s in seen]
        above = [sum(at[k][s[k] + 1] for k in m) for s in seen]
        last = next((i for i, u in enumerate(above) if u <= 1), len(seen) - 1)
        first = max((i for i, v in enumerate(below) if v > 1), default=0)
        first, last = min(first, last), max(first, last)
        lo, hi = {k: float(at[k][seen[last][k]]) for k in m}, {k: float(at[k][seen[first][k] + 1]) for k in m}
    return {k: (lo[k] + hi[k]) / 2 for k in m}


def deconvolve(reads: DataFrame, train: DataFrame, n_grid: int = 10_000, adjust: bool = False, classes: tuple[str, str] = ("N", "T")) -> tuple[DataFrame, DataFrame | None]:
    """Shares of a sample's classes, and the details of the two-class search. reads: (P_N, P_ctype, dmr_ctype, dmr_label, n_cpg);
    those without a call are left out. train: the training reads, whose classes give the margins. Two classes are searched on a
    grid, more are solved; fewer, or no reads, are an error."""
    called = reads.where("n_cpg > 0")
    if called.isEmpty():
        raise ValueError("no read has a call")
    m = margins_of(train)
    n = m.count()
    if n < 2:
        raise ValueError("the training reads have fewer than two classes")
    if n > 2:
        return mixture(called, m).select("cell_type", "pred"), None
    return (purity_adjusted if adjust else purity)(called, m, n_grid, classes)
