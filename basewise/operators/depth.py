"""Sample depths: a weighted quantile of the non-zero values, and the log of the sum up to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quantiles(collapsed: DataFrame, probs: Sequence[float] = (0.5, 1.0), nonzero: bool = True) -> DataFrame:
    """(sample, prob, q): frequency-weighted, linearly interpolated."""
    rows = collapsed.where("value <> 0") if nonzero else collapsed
    at = F.percentile("value", F.array(*[F.lit(float(p)) for p in probs]), F.col("weight"))
    name = F.array(*[F.lit(float(p)) for p in probs])
    return rows.groupBy("sample").agg(at.alias("q")).select("sample", F.explode(F.arrays_zip(name.alias("prob"), F.col("q"))).alias("x")).select("sample", "x.prob", "x.q")


def sample_depth(collapsed: DataFrame, probs: Sequence[float] = (0.5, 1.0), scalefac: float = 32.0, nonzero: bool = True, center: bool = False) -> DataFrame:
    """(sample, prob, depth): log2 of the summed values up to the quantile plus ``scalefac``; centred over samples on demand."""
    rows = collapsed.where("value <> 0") if nonzero else collapsed
    # One aggregate per sample: its quantiles, and its distinct values with their weights.
    at = F.percentile("value", F.array(*[F.lit(float(p)) for p in probs]), F.col("weight"))
    held = rows.groupBy("sample").agg(at.alias("q"), F.collect_list(F.struct("value", "weight")).alias("h"))
    upto = lambda q: F.aggregate("h", F.lit(0.0), lambda total, x: total + F.when(x["value"] <= q, x["value"] * x["weight"]).otherwise(0.0))
    sums = F.transform("q", lambda q: F.log2(upto(q) + F.lit(float(scalefac))))
    name = F.array(*[F.lit(float(p)) for p in probs])
    out = held.select("sample", F.explode(F.arrays_zip(name.alias("prob"), sums.alias("depth"))).alias("x")).select("sample", "x.prob", "x.depth")
    if center:
        mean = out.groupBy("prob").agg(F.avg("depth").alias("mean"))
        out = out.join(mean, "prob").select("sample", "prob", (F.col("depth") - F.col("mean")).alias("depth"))
    return out
