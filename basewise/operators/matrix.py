"""Region by sample, exon by sample and per-position coverage matrices, in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import filter_data, normalise
from .intervals import overlap_width, overlaps
from .regions import find_regions


def _per_sample(values: Sequence[float] | float, samples: Sequence[str]) -> dict[str, float]:
    if isinstance(values, (int, float)):
        return {s: float(values) for s in samples}
    if len(values) not in (1, len(samples)):
        raise ValueError("give one value, or one for each sample")
    return dict(zip(samples, map(float, list(values) * (len(samples) if len(values) == 1 else 1)), strict=True))


def region_matrix(segs: DataFrame, samples: Sequence[str], cutoff: float, read_length: Sequence[float] | float = 1.0, totals: Sequence[float] | None = None, target: float = 80e6, max_region_gap: int = 0, max_cluster_gap: int = 300, filtered: bool = False) -> DataFrame:
    """Regions of the mean coverage over ``cutoff``, with ``counts``: coverage summed per sample over read length.

    The sums are made while regions are found, so that coverage is read once and never joined. ``filtered`` says that
    the segments have been filtered by their mean and hold it as ``mean_cov``.
    """
    kept = segs if filtered else filter_data(segs, len(samples), cutoff, "mean", totals, target, mean=True)
    lengths = _per_sample(read_length, samples)
    sums = {f"_c{i}": F.element_at("y", i + 1) for i in range(len(samples))}
    found = find_regions(kept, "mean_cov", cutoff, max_region_gap, max_cluster_gap, sums=sums, directions=("up",))
    counts = F.array(*[F.col(f"_c{i}") / F.lit(lengths[s]) for i, s in enumerate(samples)])
    return found.withColumn("counts", counts).drop(*sums)


def long_counts(matrix: DataFrame, samples: Sequence[str], keys: Sequence[str] = ("chr", "start", "end")) -> DataFrame:
    """(keys, sample, value) from a matrix with ``counts``."""
    name = F.array(*[F.lit(s) for s in samples])
    return matrix.select(*keys, F.posexplode("counts").alias("_i", "value")).select(*keys, F.element_at(name, F.col("_i") + 1).alias("sample"), "value")


def wide(long: DataFrame, samples: Sequence[str], keys: Sequence[str] = ("chr", "start", "end")) -> DataFrame:
    return long.groupBy(*keys).pivot("sample", list(samples)).agg(F.first("value"))


def overlap_counts(regions: DataFrame, runs: DataFrame, samples: Sequence[str], read_length: Sequence[float] | float = 1.0, keys: Sequence[str] = ("chr", "start", "end"), bin: int = 256) -> DataFrame:
    """(keys, counts): coverage of runs inside each region over read length, an entry per sample, 0 without coverage.

    Regions go into the aggregation of the overlapping pairs as empty rows, so that one without runs keeps its zeros.
    """
    lengths = _per_sample(read_length, samples)
    pairs = overlaps(regions, runs, bin=bin).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("b.sample").alias("_sample"), (F.col("b.score") * overlap_width()).cast("double").alias("_v"))
    pairs = pairs.unionByName(regions.select(*keys, F.lit(None).cast("string").alias("_sample"), F.lit(None).cast("double").alias("_v")))
    sums = [F.sum(F.when(F.col("_sample") == s, F.col("_v"))).alias(f"_c{i}") for i, s in enumerate(samples)]
    counts = F.array(*[F.coalesce(F.col(f"_c{i}"), F.lit(0.0)) / F.lit(lengths[s]) for i, s in enumerate(samples)])
    return pairs.groupBy(*keys).agg(*sums).select(*keys, counts.alias("counts"))


def rail_matrix(summary: DataFrame, runs: DataFrame, samples: Sequence[str], cutoff: float, read_length: Sequence[float] | float, totals: Sequence[float] | None = None, target: float = 40e6, max_cluster_gap: int = 300) -> DataFrame:
    """(chr, start, end, sample, value): regions from a summary of mean coverage, counted on the samples' own runs.

    ``summary``: segments with ``mean_cov``. Unlike ``region_matrix`` the whole genomic span of a region counts.
    """
    regions = find_regions(summary.where(F.col("mean_cov") > float(cutoff)), "mean_cov", cutoff, 0, max_cluster_gap, directions=("up",)).select("chr", "start", "end")
    counts = overlap_counts(regions, runs, samples, read_length)
    if totals is not None:
        factor = _per_sample([t / target for t in totals], samples)
        counts = counts.withColumn("counts", F.zip_with("counts", F.array(*[F.lit(factor[s]) for s in samples]), lambda v, d: v / d))
    return long_counts(counts, samples)


def region_coverage(regions: DataFrame, runs: DataFrame, keys: Sequence[str] = ("chr", "start", "end")) -> DataFrame:
    """(keys, pos, sample, score): coverage at each covered position of each region."""
    pairs = overlaps(regions, runs)
    pos = F.explode(F.sequence(F.greatest("a.start", "b.start"), F.least("a.end", "b.end"))).alias("pos")
    return pairs.select(*[F.col(f"a.{k}").alias(k) for k in keys], pos, F.col("b.sample").alias("sample"), F.col("b.score").cast("double").alias("score"))


def region_coverage_matrix(regions: DataFrame, segs: DataFrame, n: int, totals: Sequence[float] | None = None, target: float = 80e6, keys: Sequence[str] = ("chr", "start", "end")) -> DataFrame:
    """(keys, pos, y): a row for every position of each region, uncovered ones with zeros, sizes normalised on demand."""
    own = normalise(segs, totals, target) if totals is not None else segs
    pairs = overlaps(regions, own.select("chr", "start", "end", "y"))
    covered = pairs.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.explode(F.sequence(F.greatest("a.start", "b.start"), F.least("a.end", "b.end"))).alias("pos"), F.col("b.y").alias("y"))
    every = regions.select(*keys, F.explode(F.sequence("start", "end")).alias("pos"), F.array_repeat(F.lit(0.0), n).alias("y"))
    # A zero row for every position joins those with coverage in one aggregation; the larger array is the covered one.
    both = every.unionByName(covered)
    return both.groupBy(*keys, "pos").agg(F.max_by("y", F.aggregate("y", F.lit(0.0), lambda a, v: a + v)).alias("y"))


def exon_coverage(exons: DataFrame, runs: DataFrame, samples: Sequence[str], read_length: Sequence[float] | float, keys: Sequence[str] = ("tx_id", "rank")) -> DataFrame:
    """(keys, sample, value): coverage summed over each exon, over read length; zeros included."""
    return long_counts(overlap_counts(exons, runs, samples, read_length, keys), samples, keys)


def rpkm(counts: DataFrame, exons: DataFrame, totals: DataFrame, keys: Sequence[str] = ("tx_id", "rank")) -> DataFrame:
    """Counts per thousand positions and million counted reads of the sample; ``totals``: (sample, reads)."""
    widths = exons.select(*keys, (F.col("end") - F.col("start") + 1).alias("_w"))
    out = counts.join(widths, list(keys)).join(totals, "sample")
    return out.select(*keys, "sample", (F.col("value") / (F.col("_w") / 1000.0) / (F.col("reads") / 1e6)).alias("value"))


def top_regions(regions: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` regions of largest area, ties by place."""
    return regions.orderBy(F.desc("area"), "chr", "start").limit(n)


def numbered(regions: DataFrame) -> DataFrame:
    """Regions numbered from 1 on each chromosome."""
    return regions.withColumn("region_id", F.row_number().over(Window.partitionBy("chr").orderBy("start")).cast("long"))
