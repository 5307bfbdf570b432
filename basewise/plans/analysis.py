"""From segments to annotated regions with significance: all chromosomes and permutations in one plan."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from ..operators import annotation, filters, fstats, matrix, regions, significance


def analyze(segs: DataFrame, groups: Sequence[str], mod: np.ndarray, mod0: np.ndarray, perms: Sequence[Sequence[int]], states: DataFrame | None = None, cutoff_pre: float = 5.0, cutoff_kind: str = "empirical", cutoff_value: float = 0.95, max_region_gap: int = 0, max_cluster_gap: int = 300, significant: Sequence[float] = (0.05, 0.1), method: str | None = None, adjust: float = 0.0, **smooth_how) -> DataFrame:
    """Regions by F-statistic, with group means and fold changes, p-, q-values, family-wise error rates and state counts.

    Nulls are pooled over chromosomes, so that nothing is merged afterwards. ``method`` and ``adjust`` are those of
    ``calculate_stats``; further arguments (``smooth``, ``weights``, ...) go to ``find_regions``, for nulls, too.
    """
    prepared = filters.preprocess(segs, groups, cutoff_pre)
    stats = fstats.calculate_stats(prepared, mod, mod0, adjust, method)
    cutoff = fstats.fstat_cutoff(stats, cutoff_kind, cutoff_value, mod, mod0)
    found = regions.regions_with_groups(stats, "f", cutoff, sorted(set(groups)), max_region_gap=max_region_gap, max_cluster_gap=max_cluster_gap, directions=("up",), **smooth_how)
    found = matrix.numbered(found)
    nulls = significance.null_regions(prepared, mod, mod0, perms, cutoff, max_region_gap, adjust, **smooth_how).persist()
    out = significance.flags(significance.q_values(significance.p_values(found, nulls)), significant)
    out = significance.fwer(out, nulls, len(perms), cutoff)
    if states is None:
        return out
    names = [*annotation.FULL, "intergenic"]
    counts = annotation.annotate_counts(out.select("region_id", "chr", "start", "end"), states, names, min_overlap=20)
    return out.join(counts, ["region_id", "chr"])


def expressed_regions(segs: DataFrame, samples: Sequence[str], cutoff: float, read_length: Sequence[float] | float = 1.0, **how) -> DataFrame:
    """Regions of mean coverage with their counts per sample: (chr, start, end, sample, value)."""
    return matrix.long_counts(matrix.region_matrix(segs, samples, cutoff, read_length, **how), samples)
