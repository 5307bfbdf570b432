"""Permutation p-values, family-wise error rates and false discovery rates of regions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import f_upper
from .filters import log_transform
from .fstats import calculate_stats, permuted_stats
from .regions import find_regions

#: Ranges over which null areas are spread for counting.
SPLITS = 256
#: Areas that differ by this share or less are equal: rounding of the same F under two orders of the samples.
SAME = 1e-9


def permutations(n: int, times: int, seed: int = 20240101) -> list[list[int]]:
    """Row orders of the models; the same for a seed, whatever the day."""
    rng = np.random.default_rng(seed)
    return [rng.permutation(n).tolist() for _ in range(times)]


def null_regions(segs: DataFrame, mod: np.ndarray, mod0: np.ndarray, perms: Sequence[Sequence[int]], cutoff, max_region_gap: int = 0, adjust: float = 0.0, **how) -> DataFrame:
    """(perm, stat, width, area) of the regions of every permutation, found in one pass; ``how`` as for ``find_regions``.

    F is never negative, so only the upper cut-off counts.
    """
    stats = permuted_stats(segs, mod, mod0, perms, adjust)
    return find_regions(stats, "f", cutoff, max_region_gap, keys=("perm", "chr"), basic=True, directions=("up",), **how).select("perm", "stat", "width", "area")


def count_greater(values: DataFrame, value: str, others: DataFrame, other: str, name: str) -> DataFrame:
    """``values`` with the number of ``others`` strictly greater, without a sort of everything in one task.

    Both sides are cut into ranges at quantiles of the others. Counts of the ranges above are prefix sums of ``SPLITS``
    numbers; inside a range a window over its distinct values does the rest.
    """
    cuts = others.agg(F.percentile_approx(F.col(other).cast("double"), [i / SPLITS for i in range(1, SPLITS)], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    bucket = lambda c: F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda b: b < F.col(c))) if cuts else F.lit(0)
    counted = others.where(F.col(other).isNotNull()).groupBy(F.col(other).cast("double").alias("_v")).agg(F.count("*").alias("_n")).withColumn("_b", bucket("_v"))
    sizes = {r["_b"]: r["n"] for r in counted.groupBy("_b").agg(F.sum("_n").alias("n")).collect()}
    above, total = [], 0
    for b in range(len(cuts), -1, -1):
        above.append(total)
        total += sizes.get(b, 0)
    above.reverse()
    asked = values.select(F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").distinct().withColumn("_b", bucket("_v"))
    both = counted.select("_b", "_v", "_n").union(asked.select("_b", "_v", F.lit(0).cast("long")))
    distinct = both.groupBy("_b", "_v").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy("_b").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1)
    greater = F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.element_at(F.array(*[F.lit(int(x)) for x in above]), F.col("_b") + 1)
    table = distinct.select("_v", greater.alias(name))
    return values.join(table, values[value].cast("double") == table["_v"], "left").drop("_v")


def p_values(regions: DataFrame, nulls: DataFrame, area: str = "area", doubled: bool = True) -> DataFrame:
    """Empirical p-values: (number of greater null areas + 1) / (number of nulls + 1); null without nulls.

    ``doubled`` counts every null region twice, as the published analyses do. A null area equal to the region's but for
    rounding is not greater.
    """
    n = nulls.where(F.col("area").isNotNull()).count()
    if not n:
        return regions.withColumn("pvalue", F.lit(None).cast("double"))
    k = 2 if doubled else 1
    out = count_greater(regions.withColumn("_least", F.col(area) + F.abs(F.col(area)) * SAME), "_least", nulls, "area", "_greater")
    return out.withColumn("pvalue", (F.col("_greater") * k + 1) / F.lit(float(n * k + 1))).drop("_greater", "_least")


def fwer(regions: DataFrame, nulls: DataFrame, n_permute: int, cutoff_used: float, area: str = "area") -> DataFrame:
    """Share of permutations whose largest null area is greater; a permutation without regions counts the cut-off."""
    largest = {r["perm"]: r["m"] for r in nulls.groupBy("perm").agg(F.max("area").alias("m")).collect()}
    maxima = F.array(*[F.lit(float(largest.get(i, cutoff_used))) for i in range(1, n_permute + 1)])
    return regions.withColumn("fwer", (F.size(F.filter(maxima, lambda m: m > F.col(area))) + 1) / F.lit(float(n_permute + 1)))


def adjusted(rows: DataFrame, p: str, name: str, pi0: float = 1.0) -> DataFrame:
    """Benjamini-Hochberg adjustment times ``pi0``: the smallest of p * n / rank over this and larger p-values.

    Windows run over distinct p-values, of which permutation p-values have no more than nulls.
    """
    counts = rows.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    up = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_rank", F.sum("_n").over(up)).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    table = ranked.withColumn(name, F.least(F.lit(1.0), F.min(F.lit(float(pi0)) * F.col("_p") * F.col("_all") / F.col("_rank")).over(down))).select("_p", name)
    return rows.join(table, rows[p] == table["_p"], "left").drop("_p")


def last_smoothed(x: np.ndarray, df: float = 3.0) -> np.ndarray:
    """Weights of the values at ``x`` in the last value of their cubic smoothing spline with ``df`` degrees of freedom."""
    n, h = len(x), np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j:
            r[j, j - 1] = r[j - 1, j] = h[j] / 6
    rough = q @ np.linalg.solve(r, q.T)
    lo, hi = -30.0, 30.0
    for _ in range(200):
        mid = (lo + hi) / 2
        trace = np.trace(np.linalg.inv(np.eye(n) + np.exp(mid) * rough))
        lo, hi = (mid, hi) if trace > df else (lo, mid)
    return np.linalg.inv(np.eye(n) + np.exp(lo) * rough)[-1]


#: The cut-offs from which the share of true nulls is read.
LAMBDAS = [round(0.05 * k, 2) for k in range(1, 20)]


def q_values(rows: DataFrame, p: str = "pvalue", lambdas: Sequence[float] = LAMBDAS) -> DataFrame:
    """False discovery rates with the published estimate of the share of true nulls.

    For each of ``lambdas`` the share is that of p-values at least as large, over 1 - lambda; a cubic smoothing spline with 3
    degrees of freedom through them is read at the last one, and 1 is the most. All null where that is not positive.
    """
    r = rows.agg(F.count(p).alias("n"), *[F.sum((F.col(p) >= v).cast("long")).alias(f"h{i}") for i, v in enumerate(lambdas)]).first()
    if not r["n"]:
        return rows.withColumn("qvalue", F.lit(None).cast("double"))
    shares = np.array([r[f"h{i}"] / (r["n"] * (1 - v)) for i, v in enumerate(lambdas)])
    pi0 = min(1.0, float((last_smoothed(np.array(lambdas)) if len(lambdas) > 3 else np.eye(len(lambdas))[-1]) @ shares))
    if pi0 <= 0:
        return rows.withColumn("qvalue", F.lit(None).cast("double"))
    return adjusted(rows, p, "qvalue", pi0)


def region_f_test(counts: DataFrame, mod: np.ndarray, mod0: np.ndarray, scalefac: float = 32.0, adjust: float = 0.0) -> DataFrame:
    """``counts`` (with ``counts`` per region) with F of the log counts, its p-value and the Benjamini-Hochberg adjustment."""
    logged = log_transform(counts.withColumnRenamed("counts", "y"), scalefac)
    tested = calculate_stats(logged, mod, mod0, adjust).withColumnRenamed("y", "log_counts")
    d1, d2 = mod.shape[1] - mod0.shape[1], len(mod) - mod.shape[1]

    @F.pandas_udf("double")
    def upper(f: pd.Series) -> pd.Series:
        return f.map(lambda v: None if np.isnan(v) else 0.0 if np.isinf(v) else f_upper(v, d1, d2))

    return adjusted(tested.withColumn("pvalue", upper("f")), "pvalue", "padj")


def flags(rows: DataFrame, cuts: Sequence[float] = (0.05, 0.1)) -> DataFrame:
    """Whether p- and q-values are below their cut-offs, strictly."""
    return rows.withColumn("significant", F.col("pvalue") < float(cuts[0])).withColumn("significant_q", F.col("qvalue") < float(cuts[1]))
