"""Rank statistics, calibration, resampling and power."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.columns import hash_index, safe_div


def auc(rows: DataFrame, group: list[str], score: str, positive: Column) -> DataFrame:
    """(group, n_pos, n_neg, auc): Mann-Whitney, ties a half; NaN without both classes.

    Scores are counted first, so that a window runs over distinct scores: with c and d positives and negatives at a score and D negatives below it,
    the wins are c * (D + d / 2).
    """
    at = rows.where(F.col(score).isNotNull()).groupBy(*group, score).agg(F.count_if(positive).alias("c"), F.count_if(~positive).alias("d"))
    below = F.coalesce(F.sum("d").over(Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = at.withColumn("won", F.col("c") * (below + F.col("d") / 2)).groupBy(*group).agg(F.sum("c").alias("n_pos"), F.sum("d").alias("n_neg"), F.sum("won").alias("won"))
    return won.select(*group, "n_pos", "n_neg", safe_div(F.col("won"), F.col("n_pos") * F.col("n_neg"), float("nan")).alias("auc"))


def spearman(rows: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(group, n, rho): correlation of average ranks."""

    def ranks(df: DataFrame, column: str) -> DataFrame:
        """Average rank of each distinct value."""
        counts = df.groupBy(*group, column).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*group).orderBy(column))
        return counts.select(*group, column, (upto - (F.col("n") - 1) / 2).alias(f"rank_{column}"))

    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = both.groupBy(*group, x, y).agg(F.count(F.lit(1)).alias("w")).join(ranks(both, x), [*group, x]).join(ranks(both, y), [*group, y])
    a, b, w = F.col(f"rank_{x}"), F.col(f"rank_{y}"), F.col("w")
    sums = cells.groupBy(*group).agg(F.sum(w).alias("n"), *(F.sum(v * w).alias(k) for k, v in (("sa", a), ("sb", b), ("saa", a * a), ("sbb", b * b), ("sab", a * b))))
    spread = lambda s, q: F.sqrt(F.col(q) - F.col(s) * F.col(s) / F.col("n"))
    return sums.select(*group, "n", safe_div(F.col("sab") - F.col("sa") * F.col("sb") / F.col("n"), spread("sa", "saa") * spread("sb", "sbb"), float("nan")).alias("rho"))


def brier_ece(rows: DataFrame, group: list[str], p: str, y: Column, bins: int = 10) -> DataFrame:
    """(group, n, brier, ece) of probabilities p and outcomes y, with bins of equal width."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    cells = rows.withColumn("_y", y.cast("double")).groupBy(*group, at.alias("bin")).agg(F.count(F.lit(1)).alias("m"), F.sum(p).alias("sp"), F.sum("_y").alias("sy"), F.sum((F.col(p) - F.col("_y")) ** 2).alias("sq"))
    n = F.sum("m")
    return cells.groupBy(*group).agg(n.alias("n"), (F.sum("sq") / n).alias("brier"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / n).alias("ece"))


def draws(spark: SparkSession, reps: int, size: Column, groups: DataFrame, seed: int = 20260528) -> DataFrame:
    """(group columns, rep, draw, idx): indices below `size` drawn with replacement, by a hash of (rep, draw, seed), so any engine and any task repeats them."""
    rep = groups.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("draw", F.explode(F.sequence(F.lit(0), (size - 1).cast("int"))))
    return rep.withColumn("idx", hash_index(F.col("rep").cast("string"), F.col("draw").cast("string"), F.lit(str(seed)), modulus=size))


def numpy_draws(reps: int, n_a: int, n_b: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same resamples as numpy's default generator gives, side a then side b in each replicate."""
    rng = np.random.default_rng(seed)
    for _ in range(reps):
        yield rng.integers(0, n_a, size=n_a), rng.integers(0, n_b, size=n_b)


def percentile_interval(metrics: DataFrame, group: list[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(group, lower, upper): exact percentiles with linear interpolation."""
    return metrics.groupBy(*group).agg(F.percentile(value, F.lit(low)).alias("lower"), F.percentile(value, F.lit(high)).alias("upper"), F.count(value).alias("n_resamples"))


def bca_lower(rng: np.random.Generator, values: np.ndarray, boots: int, percent: float) -> float:
    """Lower bound of the mean of cluster values: bias-corrected and accelerated, clusters resampled, jackknife acceleration."""
    normal, n = NormalDist(), len(values)
    means = values[rng.integers(0, n, size=(boots, n))].mean(axis=1)
    share = min(max(float((means < values.mean()).mean()), 0.5 / boots), 1 - 0.5 / boots)
    z = normal.inv_cdf(share)
    left_out = (values.sum() - values) / max(1, n - 1)
    away = left_out.mean() - left_out
    spread = 6 * float((away**2).sum()) ** 1.5
    bend = float((away**3).sum()) / spread if spread else 0.0
    shift = z + normal.inv_cdf(percent / 100)
    scale = 1 - bend * shift
    at = normal.cdf(z + shift / scale) if scale else percent / 100
    return float(np.quantile(means, min(max(at, 0.0), 1.0)))


def sample_auc(pos: np.ndarray, neg: np.ndarray) -> float:
    """AUC of two samples without ties."""
    if not len(pos) or not len(neg):
        return math.nan
    return float(np.searchsorted(np.sort(neg), pos).mean() / len(neg))


def pooled_lower(rng: np.random.Generator, pos: np.ndarray, neg: np.ndarray, boots: int, percent: float) -> float:
    """Percentile bound of pooled pairs, which takes pairs for independent."""
    won = (pos[:, None] > neg[None, :]).astype(float)
    times = [rng.multinomial(len(x), np.full(len(x), 1 / len(x)), size=boots) for x in (pos, neg)]  # how often a resample has each
    return float(np.quantile(((times[0] @ won) * times[1]).sum(axis=1) / (len(pos) * len(neg)), percent / 100))


def simulate(rng: np.random.Generator, families: int, n_pos: int, n_neg: int, mean_auc: float, tau: float) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Each family's AUC in a binormal model whose true AUCs scatter by tau on the logit scale, clipped to [0.5, 0.999]."""
    logit = math.log(mean_auc / (1 - mean_auc)) + tau * rng.standard_normal(families)
    true = np.clip(1 / (1 + np.exp(-logit)), 0.5, 0.999)
    pos, neg = [], []
    for t in true:
        pos.append(rng.standard_normal(n_pos) + math.sqrt(2) * NormalDist().inv_cdf(float(t)))
        neg.append(rng.standard_normal(n_neg))
    return np.array([sample_auc(p, n) for p, n in zip(pos, neg)]), pos, neg


def power_map(cells: DataFrame, sims: int = 2000, boots: int = 2000, percent: float = 5.0, seed: int = 20260530, naive_boots: int = 500) -> DataFrame:
    """cells(cell, families, n_pos, n_neg, mean_auc, tau, theta) to (cell, power, naive_power, lb_median, lb_p10); a task a cell, its own generator from seed and cell."""

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        c = df.iloc[0]
        rng = np.random.default_rng([seed, int(key[0])])
        bounds, pooled = [], []
        for _ in range(sims):
            aucs, pos, neg = simulate(rng, int(c.families), int(c.n_pos), int(c.n_neg), float(c.mean_auc), float(c.tau))
            bounds.append(bca_lower(rng, aucs, boots, percent))
            pooled.append(pooled_lower(rng, np.concatenate(pos), np.concatenate(neg), naive_boots, percent))
        over = lambda x: float((np.array(x) > c.theta).mean())
        return pd.DataFrame([(int(key[0]), over(bounds), over(pooled), float(np.median(bounds)), float(np.quantile(bounds, 0.1)))], columns=["cell", "power", "naive_power", "lb_median", "lb_p10"])

    return cells.groupBy("cell").applyInPandas(run, "cell int, power double, naive_power double, lb_median double, lb_p10 double")


def dose_power(seeds: int, depths: int, slope: float, noise: float, sims: int = 1000, seed: int = 20260530) -> float:
    """Power of the test that Spearman's rho of depth and score is negative: a one-sided sign test over seeds at 0.05, and a negative median."""
    rng = np.random.default_rng(seed)
    tail = [sum(math.comb(seeds, k) for k in range(n, seeds + 1)) / 2**seeds for n in range(seeds + 1)]
    x = np.arange(depths)
    hits = 0
    for _ in range(sims):
        y = 1 - slope * x + rng.standard_normal((seeds, 1)) * 0.5 + rng.standard_normal((seeds, depths)) * noise
        ranks = y.argsort(axis=1).argsort(axis=1)
        d = ((ranks - x) ** 2).sum(axis=1)
        rho = 1 - 6 * d / (depths * (depths**2 - 1))
        hits += tail[int((rho < 0).sum())] < 0.05 and np.median(rho) < 0
    return hits / sims


def calibration_spread(n: int, reps: int = 3000, bins: int = 10, seed: int = 20260530) -> dict:
    """Mean and spread of Brier score and binned calibration error of calibrated scores."""
    rng = np.random.default_rng(seed)
    brier, ece = np.empty(reps), np.empty(reps)
    for r in range(reps):
        p = rng.uniform(size=n)
        y = (rng.uniform(size=n) < p).astype(float)
        at = np.minimum((p * bins).astype(int), bins - 1)
        brier[r] = ((p - y) ** 2).mean()
        ece[r] = np.abs(np.bincount(at, p - y, bins)).sum() / n
    return {"n": n, "brier_sd": float(brier.std()), "ece_mean": float(ece.mean()), "ece_sd": float(ece.std())}
