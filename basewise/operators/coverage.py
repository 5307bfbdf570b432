"""Pile-up of reads, run-length tables and multi-sample segments.

Intervals are 1-based and inclusive. Positions are cut into tiles, so that a chromosome spreads over many tasks: an interval
is clipped to the tiles that it touches, windows run within a tile, and only what touches a tile's edge is stitched after.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions per tile.
TILE = 1 << 11


def width() -> Column:
    return F.col("end") - F.col("start") + 1


def tiled(intervals: DataFrame, tile: int = TILE) -> DataFrame:
    """Intervals clipped to tiles, with a ``tile`` column."""
    number = lambda c: F.floor((F.col(c) - 1) / F.lit(tile)).cast("long")
    out = intervals.where("start <= end").withColumn("tile", F.explode(F.sequence(number("start"), number("end"))))
    return out.withColumn("start", F.greatest("start", F.col("tile") * tile + 1)).withColumn("end", F.least("end", (F.col("tile") + 1) * tile))


def _events(intervals: DataFrame, value: Column, *keys: str) -> DataFrame:
    """The change of the pile-up at each start and after each end, in one scan."""
    edge = F.explode(F.array(F.struct(F.col("start").alias("pos"), value.alias("d")), F.struct((F.col("end") + 1).alias("pos"), (-value).alias("d"))))
    return intervals.select("chr", "tile", *keys, edge.alias("e")).select("chr", "tile", *keys, "e.pos", "e.d")


def pileup(reads: DataFrame, tile: int = TILE) -> DataFrame:
    """Depth as runs (chr, sample, start, end, score), score > 0, equal neighbours merged."""
    # Reads are dealt by tile once; events, their sums and the running sum all stay where they are.
    dealt = tiled(reads, tile).select("chr", "tile", "sample", "start", "end").repartition("chr", "tile", "sample")
    changes = _events(dealt, F.lit(1).cast("long"), "sample").groupBy("chr", "tile", "sample", "pos").agg(F.sum("d").alias("d")).where("d <> 0")
    order = Window.partitionBy("chr", "tile", "sample").orderBy("pos")
    runs = changes.select("chr", "sample", F.col("pos").alias("start"), (F.lead("pos").over(order) - 1).alias("end"), F.sum("d").over(order).alias("score"))
    return merge_runs(runs.where("score > 0"), tile)


def merge_runs(runs: DataFrame, tile: int | None = None) -> DataFrame:
    """Adjacent runs of equal score joined; with ``tile``, only those at tile edges need to be looked at."""
    if tile:
        at_edge = ((F.col("start") - 1) % tile == 0) | (F.col("end") % tile == 0)
        return runs.where(~at_edge).unionByName(merge_runs(runs.where(at_edge)))
    order = Window.partitionBy("chr", "sample").orderBy("start")
    new = F.coalesce(((F.lag("end").over(order) + 1) != F.col("start")) | (F.lag("score").over(order) != F.col("score")), F.lit(True))
    return (
        runs.withColumn("new", new.cast("long"))
        .withColumn("island", F.sum("new").over(order))
        .groupBy("chr", "sample", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("score").alias("score"))
        .drop("island")
    )


def dense(runs: DataFrame) -> DataFrame:
    """(chr, sample, pos, score), a row per position."""
    return runs.select("chr", "sample", F.explode(F.sequence("start", "end")).alias("pos"), "score")


def segments(reads: DataFrame, samples: Sequence[str], tile: int = TILE) -> DataFrame:
    """(chr, tile, start, end, y): stretches where the depth of every sample is constant and some depth isn't 0."""
    d = [F.sum(F.when(F.col("sample") == s, F.col("d")).otherwise(0)).alias(f"d{i}") for i, s in enumerate(samples)]
    dealt = tiled(reads, tile).select("chr", "tile", "sample", "start", "end").repartition("chr", "tile")
    changes = _events(dealt, F.lit(1).cast("long"), "sample").groupBy("chr", "tile", "pos").agg(*d)
    changes = changes.where(" OR ".join(f"d{i} <> 0" for i in range(len(samples))))
    order = Window.partitionBy("chr", "tile").orderBy("pos")
    y = F.array(*[F.sum(f"d{i}").over(order).cast("double") for i in range(len(samples))])
    out = changes.select("chr", "tile", F.col("pos").alias("start"), (F.lead("pos").over(order) - 1).alias("end"), y.alias("y"))
    return out.where(F.col("end").isNotNull() & F.exists("y", lambda v: v != 0))


def run_segments(runs: DataFrame, samples: Sequence[str], tile: int = TILE) -> DataFrame:
    """As ``segments``, from runs (chr, sample, start, end, score) that don't overlap within a sample."""
    edges = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("begins"), F.col("score").cast("double").alias("v")), F.struct((F.col("end") + 1).alias("pos"), F.lit(0).alias("begins"), F.lit(0.0).alias("v"))))
    events = tiled(runs, tile).select("chr", "tile", "sample", edges.alias("e")).select("chr", "tile", "sample", "e.*")
    v = [F.max_by(F.when(F.col("sample") == s, F.col("v")), F.when(F.col("sample") == s, F.col("begins"))).alias(f"v{i}") for i, s in enumerate(samples)]
    order = Window.partitionBy("chr", "tile").orderBy("pos")
    held = events.groupBy("chr", "tile", "pos").agg(*v)
    y = F.array(*[F.coalesce(F.last(f"v{i}", ignorenulls=True).over(order), F.lit(0.0)) for i in range(len(samples))])
    out = held.select("chr", "tile", F.col("pos").alias("start"), (F.lead("pos").over(order) - 1).alias("end"), y.alias("y"))
    return out.where(F.col("end").isNotNull() & F.exists("y", lambda x: x != 0))


def full_coverage(
    runs: DataFrame, samples: Sequence[str], chrs: Sequence[str] | None = None, cutoff: float | None = None, filter: str = "one", totals: Sequence[float] | None = None, target: float = 80e6,
    which: DataFrame | None = None, protect: int = 0, tile: int = TILE,
) -> DataFrame:
    """Segments of all samples, from their runs: chromosomes, regions, alignment, sizes and cut-off in one call.

    ``which``: intervals (chr, start, end) that alone are kept, each ``protect`` positions wider about its centre. With a
    cut-off segments are filtered and hold ``mean_cov``.
    """
    from .filters import filter_data

    own = runs.where(F.col("sample").isin(list(samples)))
    if chrs is not None:
        own = own.where(F.col("chr").isin(list(chrs)))
    if which is not None:
        own = restricted(own, which, protect)
    segs = run_segments(own, samples, tile)
    if cutoff is None and totals is None:
        return segs
    return filter_data(segs, len(samples), cutoff, filter, totals, target, mean=cutoff is not None)


def restricted(runs: DataFrame, which: DataFrame, protect: int = 0) -> DataFrame:
    """The parts of runs inside the intervals ``which``, which are widened about their centres and merged before."""
    from .intervals import overlaps, reduce_intervals

    shift = F.floor(F.lit(-protect) / 2).cast("long")
    wide = which.select("chr", (F.col("start") + shift).alias("start"), (F.col("end") + shift + protect).alias("end"))
    pairs = overlaps(runs, reduce_intervals(wide))
    place = {"start": F.greatest("a.start", "b.start").alias("start"), "end": F.least("a.end", "b.end").alias("end")}
    return pairs.select(*[place.get(c, F.col(f"a.{c}").alias(c)) for c in runs.columns])


def segment_runs(segs: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Segments back to runs per sample, score > 0."""
    names = F.array(*[F.lit(s) for s in samples])
    long = segs.select("chr", "start", "end", F.posexplode("y").alias("i", "score")).where("score > 0")
    return merge_runs(long.select("chr", F.element_at(names, F.col("i") + 1).alias("sample"), "start", "end", "score"))


def total_mapped(reads: DataFrame, chrs: Sequence[str] | None = None) -> DataFrame:
    """(sample, total_mapped): reads per sample.

    Rows are reads, or, with a column ``read`` (and ``file``, where a sample has several), the blocks of reads, which count
    once for each read.
    """
    rows = reads.where(F.col("chr").isin(list(chrs))) if chrs else reads
    if "read" in reads.columns:
        rows = rows.select("sample", *[c for c in ("file", "read") if c in reads.columns]).distinct()
    return rows.groupBy("sample").agg(F.count("*").alias("total_mapped"))


def area_under_coverage(runs: DataFrame, chrs: Sequence[str] | None = None) -> DataFrame:
    """(sample, auc): score times width, summed."""
    rows = runs.where(F.col("chr").isin(list(chrs))) if chrs else runs
    return rows.groupBy("sample").agg(F.sum(width() * F.col("score")).alias("auc"))


def export_ranges(runs: DataFrame) -> DataFrame:
    """Ranges with signal, unstranded, as they go to a signal file."""
    return runs.where("score > 0").select("chr", "sample", "start", "end", F.lit("*").alias("strand"), F.col("score").cast("double").alias("score"))


def collapse(runs: DataFrame) -> DataFrame:
    """(sample, value, weight): how many positions have each value."""
    return runs.groupBy("sample", F.col("score").cast("double").alias("value")).agg(F.sum(width()).alias("weight"))
