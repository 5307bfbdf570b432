"""Regions: contiguous positions whose signal passes a cut-off, and clusters of regions.

Islands are found in two steps: within each tile, by one window over the tile's segments, then over what the tiles found,
where an island that ends a tile joins one that begins the next. The second step sees regions, not positions. Region sums
(of the signal, and of any further columns) are additive and travel along, so no join brings them back.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import smoothing
from .coverage import TILE, width


def cutoffs(cutoff: float | Sequence[float]) -> tuple[float, float]:
    """(lower, upper): a single value c stands for (-c, c)."""
    if isinstance(cutoff, (int, float)):
        return -float(cutoff), float(cutoff)
    low, high = sorted(map(float, cutoff))
    return low, high


def islands(
    segs: DataFrame, signal: str, cutoff: float | Sequence[float], max_region_gap: int = 0, keys: Sequence[str] = ("chr",), sums: dict[str, Column] | None = None,
    directions: Sequence[str] = ("up", "dn"), pieces: str | None = None,
) -> DataFrame:
    """Maximal runs of segments at or above the upper ("up"), or at or below the lower ("dn") cut-off.

    Segments are those of the positions kept by a filter. A run ends where a kept position fails the cut-off, or where
    more than ``max_region_gap`` positions are missing, or where the column ``pieces`` is true. Gives keys, direction, start,
    end, width (of kept positions), signal_sum, index_start, index_end (places when only kept positions are counted), and a
    sum for each of ``sums``, whose columns are per position.
    """
    keys, sums = list(keys), sums or {}
    low, high = cutoffs(cutoff)
    hits = {"up": F.col(signal) >= high, "dn": F.col(signal) <= low}
    numbered = F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), F.coalesce(hits[d], F.lit(False)).alias("hit")) for d in directions]))
    carried = {name: (c * width()) for name, c in sums.items()}
    piece = F.col(pieces) if pieces else F.lit(False)
    rows = segs.select(*keys, "tile", "start", "end", piece.alias("_piece"), (F.col(signal) * width()).alias("_s"), *[c.alias(n) for n, c in carried.items()], numbered.alias("_d")).select("*", "_d.direction", "_d.hit").drop("_d")
    inside = Window.partitionBy(*keys, "direction", "tile").orderBy("start")
    apart = (F.col("start") - F.lag("end").over(inside) - 1 > max_region_gap) | F.col("_piece")
    rows = rows.withColumn("_new", (~F.coalesce(F.lag("hit").over(inside), F.lit(False)) | apart).cast("long"))
    rows = rows.withColumn("_first", F.lag("start").over(inside).isNull()).withColumn("_last", F.lead("start").over(inside).isNull()).withColumn("_at", F.sum(width()).over(inside))
    # The last segment of a tile stays, too: it tells how many positions the tile has.
    rows = rows.withColumn("_island", F.sum(F.when(F.col("hit"), F.col("_new")).otherwise(0)).over(inside)).where("hit OR _last")
    parts = rows.groupBy(*keys, "direction", "tile", "hit", "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum(width()).alias("width"), F.sum("_s").alias("signal_sum"), F.min(F.col("_at") - width() + 1).alias("_index"),
        F.max("_first").alias("_first"), F.max("_last").alias("_last"), F.max(F.when(F.col("_last"), F.col("_at"))).alias("_kept"), F.min_by("_piece", "start").alias("_piece"), *[F.sum(n).alias(n) for n in sums],
    )
    before = Window.partitionBy(*keys, "direction").orderBy("tile").rangeBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("index_start", F.col("_index") + F.coalesce(F.sum("_kept").over(before), F.lit(0))).where("hit")
    # A tile without any kept position lies between two tiles only if it is a gap, which the positions tell.
    order = Window.partitionBy(*keys, "direction").orderBy("start")
    joins = F.col("_first") & F.lag("_last").over(order) & (F.col("start") - F.lag("end").over(order) - 1 <= max_region_gap) & ~F.col("_piece")
    stitched = parts.withColumn("_join", (~F.coalesce(joins, F.lit(False))).cast("long")).withColumn("_run", F.sum("_join").over(order))
    return (
        stitched.groupBy(*keys, "direction", "_run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("width").alias("width"), F.sum("signal_sum").alias("signal_sum"), F.min("index_start").alias("index_start"), *[F.sum(n).alias(n) for n in sums])
        .drop("_run")
        .withColumn("index_end", F.col("index_start") + F.col("width") - 1)
    )


def split_at(segs: DataFrame, intervals: DataFrame, name: str = "piece") -> DataFrame:
    """Segments cut at the edges of ``intervals`` (chr, start, end), with whether an edge precedes each as ``name``.

    For ``islands(..., pieces=name)``: regions then end where an interval begins or ends. An edge among missing positions
    counts for the segment after them, if that is in the edge's tile.
    """
    tile = F.floor((F.col("pos") - 1) / F.lit(TILE)).cast("long")
    edges = intervals.select("chr", F.explode(F.array(F.col("start"), F.col("end") + 1)).alias("pos")).distinct().withColumn("tile", tile)
    by_tile = edges.groupBy("chr", "tile").agg(F.array_sort(F.collect_set("pos")).alias("_edges"))
    out = segs.join(by_tile, ["chr", "tile"], "left").withColumn("_edges", F.coalesce("_edges", F.array().cast("array<long>")))
    before = F.coalesce(F.lag("end").over(Window.partitionBy("chr", "tile").orderBy("start")), F.lit(0))
    out = out.withColumn("_near", F.filter("_edges", lambda x: (x > before) & (x <= F.col("end"))))
    starts = F.array_distinct(F.concat(F.array("start"), F.filter("_near", lambda x: x > F.col("start"))))
    cut = out.withColumn("_starts", starts).withColumn(name, F.exists("_near", lambda x: x <= F.col("start")))
    cut = cut.select(*[c for c in segs.columns if c not in ("start", "end")], name, "_starts", F.col("end").alias("_end"), F.posexplode("_starts").alias("_k", "start"))
    return cut.withColumn("end", F.coalesce(F.get("_starts", F.col("_k") + 1) - 1, F.col("_end"))).withColumn(name, F.col(name) | (F.col("_k") > 0)).select(*segs.columns, name)


def find_regions(
    segs: DataFrame, signal: str, cutoff: float | Sequence[float], max_region_gap: int = 0, max_cluster_gap: int = 300, keys: Sequence[str] = ("chr",), basic: bool = False, sums: dict[str, Column] | None = None,
    directions: Sequence[str] = ("up", "dn"), smooth: Callable | None = None, weights: str | None = None, within: DataFrame | None = None, **smooth_how,
) -> DataFrame:
    """Regions with value (mean signal), area, index coordinates, cluster and cluster length; ``basic``: stat, width, area.

    ``smooth``: a function of ``smoothing`` that replaces the signal within clusters of kept positions at most
    ``max_cluster_gap`` apart, before the cut-off. ``within``: intervals at whose edges regions are cut.
    """
    if max_cluster_gap < max_region_gap:
        warnings.warn("max_cluster_gap is less than max_region_gap", stacklevel=2)
    if smooth is not None:
        segs = smoothing.smooth_segments(segs, signal, smooth, max_cluster_gap, keys, weights, **smooth_how)
    pieces = None
    if within is not None:
        segs, pieces = split_at(segs, within, "_cut"), "_cut"
    found = islands(segs, signal, cutoff, max_region_gap, keys, sums, directions, pieces)
    value, area = F.col("signal_sum") / F.col("width"), F.abs("signal_sum")
    if basic:
        return found.select(*keys, "direction", value.alias("stat"), "width", area.alias("area"))
    found = found.withColumn("value", value).withColumn("area", area).drop("signal_sum", "width")
    return cluster_regions(found, max_cluster_gap, [*keys, "direction"])


def cluster_regions(regions: DataFrame, max_gap: int = 300, keys: Sequence[str] = ("chr",)) -> DataFrame:
    """``cluster`` (numbered from 1 within the keys) and ``cluster_length``: regions at most ``max_gap`` apart share one."""
    order = Window.partitionBy(*keys).orderBy("start")
    new = F.coalesce((F.col("start") - F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) - 1 > max_gap), F.lit(True))
    out = regions.withColumn("_new", new.cast("long")).withColumn("cluster", F.sum("_new").over(order)).drop("_new")
    whole = Window.partitionBy(*keys, "cluster")
    return out.withColumn("cluster_length", F.max("end").over(whole) - F.min("start").over(whole) + 1)


def region_means(sums: dict[str, str]) -> list[Column]:
    """Per-position means of summed columns, named as given."""
    return [(F.col(s) / (F.col("index_end") - F.col("index_start") + 1)).alias(name) for s, name in sums.items()]


def regions_with_groups(segs: DataFrame, signal: str, cutoff: float | Sequence[float], levels: Sequence[str], **how) -> DataFrame:
    """Regions with the mean coverage, the mean of each group, and log2 fold changes against the first group."""
    columns = {"mean_coverage": "mean_cov"} | {f"mean_{g}": f"mean_{g}" for g in levels}
    out = find_regions(segs, signal, cutoff, sums={f"_{k}": F.col(c) for k, c in columns.items()}, **how)
    kept = [c for c in out.columns if c not in {f"_{k}" for k in columns}]
    out = out.select(*kept, *region_means({f"_{k}": k for k in columns}))
    for g in levels[1:]:
        ratio = F.try_divide(f"mean_{g}", f"mean_{levels[0]}")
        out = out.withColumn(f"log2_fold_{g}_vs_{levels[0]}", F.when(ratio > 0, F.log2(ratio)))
    return out
