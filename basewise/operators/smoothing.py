"""Smoothing of a signal within clusters of positions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cluster_segments(segs: DataFrame, max_gap: int = 300, keys: Sequence[str] = ("chr",)) -> DataFrame:
    """Segments with ``cluster``, the start of the run of segments at most ``max_gap`` apart that they are in.

    Runs are found within tiles; only runs that touch a tile's edge are looked at further, one row per tile and run.
    """
    keys = list(keys)
    inside = Window.partitionBy(*keys, "tile").orderBy("start")
    new = F.coalesce(F.col("start") - F.lag("end").over(inside) - 1 > max_gap, F.lit(True))
    own = segs.withColumn("_new", new).withColumn("_head", F.max(F.when(F.col("_new"), F.col("start"))).over(inside))
    runs = own.groupBy(*keys, "tile", "_head").agg(F.max("end").alias("_end"))
    order = Window.partitionBy(*keys).orderBy("_head")
    begins = F.coalesce(F.col("_head") - F.lag("_end").over(order) - 1 > max_gap, F.lit(True))
    whole = runs.withColumn("cluster", F.max(F.when(begins, F.col("_head"))).over(order)).select(*keys, "tile", "_head", "cluster")
    return own.join(whole, [*keys, "tile", "_head"]).drop("_new", "_head")


def clusters(segs: DataFrame, signal: str, max_gap: int = 300) -> DataFrame:
    """(chr, pos, signal, cluster): positions of segments at most ``max_gap`` apart share a cluster, named by its start."""
    return cluster_segments(segs, max_gap).select("chr", F.explode(F.sequence("start", "end")).alias("pos"), signal, "cluster")


def running_median(positions: DataFrame, signal: str, k: int = 5) -> DataFrame:
    """``smoothed``: the median of ``k`` neighbours within the cluster, fewer at its ends."""
    half = k // 2
    near = F.array_sort(F.collect_list(signal).over(Window.partitionBy("chr", "cluster").orderBy("pos").rowsBetween(-half, half)))
    n = F.size("_near")
    middle = (F.element_at("_near", F.floor((n + 1) / 2).cast("int")) + F.element_at("_near", F.floor((n + 2) / 2).cast("int"))) / 2
    return positions.withColumn("_near", near).withColumn("smoothed", middle).drop("_near")


def local_quadratic(y: np.ndarray, x: np.ndarray, weights: np.ndarray | None = None, span: float = 70.0, least: int = 7) -> np.ndarray:
    """Tricube-weighted local quadratic regression at whole positions ``x``, in order; nan where a cluster has too few points.

    Within ``span`` positions, the moments of all points are summed offset by offset. Points with fewer than ``least``
    neighbours there reach out to the ``least``-th nearest, one by one.
    """
    out = np.full(len(y), np.nan)
    if len(y) < least:
        return out
    w0 = np.ones(len(y)) if weights is None else weights
    moments, sums, near = np.zeros((5, len(y))), np.zeros((3, len(y))), np.zeros(len(y), dtype=int)
    for d in range(-int(span), int(span) + 1):
        if abs(d) < span:
            at = np.minimum(np.searchsorted(x, x + d), len(x) - 1)
            hit = x[at] == x + d
            near += hit
            w, u = np.where(hit, w0[at] * (1 - (abs(d) / span) ** 3) ** 3, 0.0), d / span
            moments += w * np.array([[1.0], [u], [u**2], [u**3], [u**4]])
            sums += w * y[at] * np.array([[1.0], [u], [u**2]])
    full = np.flatnonzero(near >= max(least, 4))
    normal = np.stack([np.stack([moments[i + j, full] for j in range(3)], axis=-1) for i in range(3)], axis=-2)
    fine = np.linalg.cond(normal) < 1e12 if len(full) else np.zeros(0, dtype=bool)
    out[full[fine]] = np.linalg.solve(normal[fine], sums[:, full[fine]].T[:, :, None])[:, 0, 0]
    for i in np.flatnonzero(np.isnan(out)).tolist():
        lo, hi = max(0, i - least), min(len(x), i + least + 1)
        d = np.abs(x[lo:hi] - x[i])
        h = max(span, np.partition(d, least - 1)[least - 1] + 1e-9)
        lo, hi = np.searchsorted(x, x[i] - h, side="right"), np.searchsorted(x, x[i] + h, side="left")
        d = (x[lo:hi] - x[i]) / h
        root = np.sqrt(w0[lo:hi] * (1 - np.abs(d) ** 3) ** 3)
        out[i] = np.linalg.lstsq(np.stack([np.ones(len(d)), d, d * d], axis=1) * root[:, None], y[lo:hi] * root, rcond=None)[0][0]
    return out


def running_mean(y: np.ndarray, x: np.ndarray, weights: np.ndarray | None = None, k: int = 5) -> np.ndarray:
    """Weighted mean of ``k`` neighbours, fewer at the ends of a cluster."""
    w = np.ones(len(y)) if weights is None else weights
    at, half = np.arange(len(y)), k // 2
    lo, hi = np.maximum(at - half, 0), np.minimum(at + half + 1, len(y))
    total, mass = np.append(0.0, np.cumsum(y * w)), np.append(0.0, np.cumsum(w))
    return (total[hi] - total[lo]) / (mass[hi] - mass[lo])


def finite_running_mean(y: np.ndarray, x: np.ndarray, weights: np.ndarray | None = None, k: int = 5) -> np.ndarray:
    """``running_mean`` over the finite values alone; others stay as they are."""
    fine = np.isfinite(y)
    w = fine * (1.0 if weights is None else weights)
    with np.errstate(invalid="ignore", divide="ignore"):
        got = running_mean(np.where(fine, y, 0.0), x, w, k)
    return np.where(fine, got, np.nan)


def smooth(positions: DataFrame, signal: str, function: Callable[..., np.ndarray] = local_quadratic, weights: str | None = None, keys: Sequence[str] = ("chr", "cluster"), **how) -> DataFrame:
    """``smoothed``: ``function(y, x, weights, ...)`` on each cluster; where it gives nan the signal stays as it is."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        y = pdf[signal].to_numpy(dtype=float)
        got = np.asarray(function(y, pdf["pos"].to_numpy(dtype=float), pdf[weights].to_numpy(dtype=float) if weights else None, **how), dtype=float)
        return pdf.assign(smoothed=np.where(np.isnan(got), y, got))

    return positions.groupBy(*keys).applyInPandas(run, T.StructType([*positions.schema.fields, T.StructField("smoothed", T.DoubleType())]))


def smooth_segments(segs: DataFrame, signal: str, function: Callable[..., np.ndarray] = local_quadratic, max_gap: int = 300, keys: Sequence[str] = ("chr",), weights: str | None = None, **how) -> DataFrame:
    """Segments of single positions with the smoothed signal, all other columns as they are."""
    columns = segs.columns
    place = [c for c in columns if c not in ("start", "end")]
    positions = cluster_segments(segs, max_gap, keys).select(*place, F.explode(F.sequence("start", "end")).alias("pos"), "cluster")
    done = smooth(positions, signal, function, weights, [*keys, "cluster"], **how)
    names = {"start": F.col("pos"), "end": F.col("pos"), signal: F.col("smoothed")}
    return done.select(*[names.get(c, F.col(c)).alias(c) for c in columns])


def positions_of(segs: DataFrame, signal: str) -> DataFrame:
    """(chr, pos, signal) of every position of the segments."""
    return segs.select("chr", F.explode(F.sequence("start", "end")).alias("pos"), signal)


