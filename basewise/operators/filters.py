"""Filters and per-position transforms of segments (chr, tile, start, end, y)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .smoothing import smooth_segments

#: The 64ths that a number within a factor of sqrt(2) of 1 is near.
MANTISSAS = range(44, 93)


def mean_of(y: Column, n: int) -> Column:
    return F.aggregate(y, F.lit(0.0), lambda a, v: a + v) / F.lit(float(n))


def normalise(segs: DataFrame, totals: Sequence[float], target: float = 80e6) -> DataFrame:
    """Each sample divided by its total over ``target``; 0 as target leaves all as it is."""
    if not target:
        return segs
    factors = F.array(*[F.lit(float(t) / target) for t in totals])
    return segs.withColumn("y", F.zip_with("y", factors, lambda v, d: v / d))


def subset(segs: DataFrame, columns: Sequence[int]) -> DataFrame:
    return segs.withColumn("y", F.array(*[F.element_at("y", int(i) + 1) for i in columns]))


def filter_data(segs: DataFrame, n: int, cutoff: float | None = None, filter: str = "one", totals: Sequence[float] | None = None, target: float = 80e6, mean: bool = False, smooth_mean: Callable | None = None, max_cluster_gap: int = 300, **smooth_how) -> DataFrame:
    """Positions where any sample ("one") or the mean of samples ("mean") is above ``cutoff``, strictly.

    Sizes are normalised before; ``mean`` adds ``mean_cov``. Filters compose: a filtered table can be filtered again.
    ``smooth_mean``: a function of ``smoothing`` that the mean goes through before the cut-off, as which it is then kept;
    positions without any coverage take no part in it.
    """
    if filter not in ("one", "mean"):
        raise ValueError("filter must be 'one' or 'mean'")
    out = normalise(segs, totals, target) if totals is not None else segs
    if smooth_mean is not None and filter == "mean":
        out = smooth_segments(out.withColumn("mean_cov", mean_of(F.col("y"), n)), "mean_cov", smooth_mean, max_cluster_gap, **smooth_how)
        out = out.where(F.col("mean_cov") > float(cutoff)) if cutoff is not None else out
        return out if mean else out.drop("mean_cov")
    if cutoff is not None:
        c = float(cutoff)
        out = out.where(F.exists("y", lambda v: v > c) if filter == "one" else mean_of(F.col("y"), n) > c)
    return out.withColumn("mean_cov", mean_of(F.col("y"), n)) if mean else out


def group_means(segs: DataFrame, groups: Sequence[str], prefix: str = "mean_") -> DataFrame:
    """The overall mean as ``mean_cov``, and the mean of each group's samples in a column of its own."""
    out = segs.withColumn("mean_cov", mean_of(F.col("y"), len(groups)))
    for level in sorted(set(groups)):
        own = [i for i, g in enumerate(groups) if g == level]
        out = out.withColumn(f"{prefix}{level}", sum((F.element_at("y", i + 1) for i in own[1:]), F.element_at("y", own[0] + 1)) / F.lit(float(len(own))))
    return out


def log2_of(values: Column | str) -> Column:
    """log2 of an array's values as the nearest double, but for about one in a thousand.

    ``F.log2`` divides two rounded logarithms and is a unit off for every fourth number, which F-statistics of close fits
    magnify. Here the exponent and a table of 64ths in two parts leave only log1p of a small number to round.
    """
    exact = [(Decimal(k) / 64).ln() / Decimal(2).ln() for k in MANTISSAS]
    high = [round(float(v) * 2**40) / 2**40 for v in exact]  # the exponent adds to it without rounding
    low = [float(v - Decimal(h)) for v, h in zip(exact, high, strict=True)]
    entry = lambda table, k: F.element_at(F.array(*[F.lit(v) for v in table]), (k - (MANTISSAS[0] - 1)).cast("int"))
    # Null, nan, infinite and subnormal numbers and those without a logarithm are left to F.log2.
    parts = F.transform(values, lambda v: F.struct(v.alias("x"), F.when(v.between(2.0**-1022, 2.0**1023), F.rint(F.log2(v))).alias("e")))
    parts = F.transform(parts, lambda p: F.struct(p["x"].alias("x"), p["e"].alias("e"), (p["x"] / F.pow(F.lit(2.0), p["e"]) * 64).alias("m")))
    parts = F.transform(parts, lambda p: F.struct(p["x"].alias("x"), p["e"].alias("e"), p["m"].alias("m"), F.rint(p["m"]).alias("k")))
    return F.transform(parts, lambda p: F.coalesce((p["e"] + entry(high, p["k"])) + (entry(low, p["k"]) + F.log1p((p["m"] - p["k"]) / p["k"]) / math.log(2)), F.log2(p["x"])))


def log_transform(segs: DataFrame, scalefac: float = 32.0) -> DataFrame:
    # Exploded, as an alias would be written out, and worked out, at each of its uses after it.
    return segs.withColumn("y", F.explode(F.array(log2_of(F.transform("y", lambda v: v + F.lit(float(scalefac)))))))


def preprocess(segs: DataFrame, groups: Sequence[str], cutoff: float = 5.0, scalefac: float = 32.0) -> DataFrame:
    """Filtered by "one", means of unlogged values kept, values log-transformed."""
    return log_transform(group_means(filter_data(segs, len(groups), cutoff), groups), scalefac)
