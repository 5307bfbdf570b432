"""Coverage of reads that keep arriving: counts of depth changes, kept up to date by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.coverage import TILE, _events, merge_runs, tiled


def depth_changes(reads: DataFrame, tile: int = TILE) -> DataFrame:
    """(chr, tile, sample, pos, d): a streaming aggregate for complete or update mode; changes add up over batches."""
    return _events(tiled(reads, tile), F.lit(1).cast("long"), "sample").groupBy("chr", "tile", "sample", "pos").agg(F.sum("d").alias("d"))


def runs_of(changes: DataFrame, tile: int = TILE) -> DataFrame:
    """Runs (chr, sample, start, end, score) of a stored table of changes, the same as of all its reads at once."""
    order = Window.partitionBy("chr", "tile", "sample").orderBy("pos")
    runs = changes.where("d <> 0").select("chr", "sample", F.col("pos").alias("start"), (F.lead("pos").over(order) - 1).alias("end"), F.sum("d").over(order).alias("score"))
    return merge_runs(runs.where("score > 0"), tile)
