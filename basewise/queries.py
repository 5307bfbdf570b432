"""Registered queries of the region-analytics operators, each with the SQL that must give the same rows.

The SQL works position by position on expanded reads, independently of the segment representation used by the engine.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names
from .functions.stats import make_models, projection
from .operators import annotation, coverage, depth, filters, fstats, intervals, matrix, regions, significance, smoothing
from .plans import analysis
from .sources import fixtures as fx

N = len(fx.SAMPLES)
CUT = 20.0
MOD, MOD0 = make_models(None, fx.GROUPS, [fx.ADJUST])
F_CUT = 4.0
#: No mean of a few means of samples is at this cut-off, so that rounding doesn't decide.
SMOOTH_CUT = 20.01
LENGTHS = [30.0, 31.0, 32.0, 33.0, 34.0, 35.0]
TOTALS = [9000.0, 9500.0, 10000.0, 10500.0, 11000.0, 11500.0]

Query = Callable[[SparkSession, str], DataFrame]


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 places, as in the SQL."""
    return df.select(*[(F.round(F.col(f"`{c}`"), 6) if t == "double" else F.col(f"`{c}`")).alias(c) for c, t in df.dtypes])


def _segs(spark, sf):
    return coverage.segments(fx.reads(spark, sf), fx.SAMPLES)


def _runs(spark, sf):
    return coverage.pileup(fx.reads(spark, sf))


def _mean(spark, sf):
    return filters.filter_data(_segs(spark, sf), N, CUT, "mean", mean=True)


def _positions(segs, *columns):
    """One row per position; rounding as in the SQL."""
    return r6(segs.select("chr", F.explode(F.sequence("start", "end")).alias("pos"), *columns))


def _flat_y(segs):
    return segs.select("*", *[F.element_at("y", i + 1).alias(f"y{i}") for i in range(N)])


def _logged(spark, sf):
    return filters.preprocess(_segs(spark, sf), fx.GROUPS, 5.0)


def _stats(spark, sf):
    return fstats.calculate_stats(_logged(spark, sf), MOD, MOD0)


def _nulls(spark, sf):
    return significance.null_regions(_logged(spark, sf), MOD, MOD0, fx.PERMUTATIONS, F_CUT)


def _regions(spark, sf, **how):
    return regions.find_regions(_mean(spark, sf), "mean_cov", CUT, directions=("up",), **how)


def _f_regions(spark, sf):
    return regions.find_regions(_stats(spark, sf), "f", F_CUT, directions=("up",))


def _numbered(spark, sf):
    return matrix.numbered(_regions(spark, sf).select("chr", "start", "end", "area"))


def _exon_regions(spark, sf):
    return fx.exons(spark, sf).select((F.col("tx_id") * 10 + F.col("rank")).alias("region_id"), "chr", "start", "end", "strand")


def _stranded(asked, features):
    """Chromosomes by strand, so that regions meet features of the other strand."""
    other = F.when(F.col("strand") == "-", "+").otherwise("-")
    return asked.withColumn("chr", F.concat("chr", other)), features.withColumn("chr", F.concat("chr", "strand"))


def _states(spark, sf, kind):
    return annotation.genomic_state(fx.transcripts(spark, sf), fx.exons(spark, sf), fx.chrom_sizes(spark, sf), kind, fx.cds(spark, sf), 20, 5)


def _f_bounds(df):
    return df.withColumnRenamed("start", "start_pos").withColumnRenamed("end", "end_pos")


def queries() -> dict[str, Query]:
    y = [f"y{i}" for i in range(N)]
    out: dict[str, Query] = {
        "coverage_runs": lambda s, d: _runs(s, d),
        "coverage_dense": lambda s, d: coverage.dense(_runs(s, d)),
        "segment_positions": lambda s, d: _positions(_flat_y(_segs(s, d)), *y),
        "run_segment_positions": lambda s, d: _positions(_flat_y(coverage.run_segments(_runs(s, d), fx.SAMPLES)), *y),
        "total_mapped": lambda s, d: coverage.total_mapped(fx.reads(s, d)),
        "auc": lambda s, d: coverage.area_under_coverage(_runs(s, d)),
        "coverage_export": lambda s, d: coverage.export_ranges(_runs(s, d)),
        "filter_one": lambda s, d: _positions(_flat_y(filters.filter_data(_segs(s, d), N, 25.0)), *y),
        "filter_mean": lambda s, d: _positions(_mean(s, d), "mean_cov"),
        "filter_normalized": lambda s, d: _positions(_flat_y(filters.filter_data(_segs(s, d), N, 20.0, "one", TOTALS, 10000.0)), *y),
        "filter_refilter": lambda s, d: _positions(filters.filter_data(filters.filter_data(_segs(s, d), N, 22.0), N, 19.0, "mean", mean=True), "mean_cov"),
        "filter_subset": lambda s, d: _positions(filters.filter_data(filters.subset(_segs(s, d), [0, 2, 4]), 3, 20.0, "mean", mean=True), "mean_cov"),
        "collapse_hist": lambda s, d: coverage.collapse(_runs(s, d)),
        "sample_quantile": lambda s, d: r6(depth.quantiles(coverage.collapse(_runs(s, d)))),
        "sample_depth": lambda s, d: r6(depth.sample_depth(coverage.collapse(_runs(s, d)))),
        "mean_group": lambda s, d: _positions(filters.group_means(_segs(s, d), fx.GROUPS), "mean_cov", "mean_A", "mean_B"),
        "log_transform": lambda s, d: _positions(_flat_y(_logged(s, d)), *y),
        "fstats": lambda s, d: _positions(_stats(s, d), "f"),
        "fstats_matrix": lambda s, d: _positions(fstats.calculate_stats(_logged(s, d), MOD, MOD0, method="matrix"), "f"),
        "fstat_cutoff_empirical": lambda s, d: r6(_stats(s, d).where("f IS NOT NULL").agg(F.percentile("f", F.lit(0.9), F.col("end") - F.col("start") + 1).alias("cutoff"))),
        "segments_up": lambda s, d: regions.islands(_stats(s, d), "f", (0.001, F_CUT)).where("direction = 'up'").select("chr", "start", "end", "index_start", "index_end"),
        "segments_dn": lambda s, d: regions.islands(_stats(s, d), "f", (0.001, F_CUT)).where("direction = 'dn'").select("chr", "start", "end", "index_start", "index_end"),
        "cluster_positions": lambda s, d: intervals.reduce_intervals(_mean(s, d).select("chr", "start", "end"), min_gap=11),
        "regions": lambda s, d: r6(_regions(s, d).select("chr", "start", "end", "value", "area", "index_start", "index_end")),
        "regions_gap": lambda s, d: r6(_regions(s, d, max_region_gap=10).select("chr", "start", "end", "value", "area", "index_start", "index_end")),
        "regions_clustered": lambda s, d: _regions(s, d, max_cluster_gap=30).select("chr", "start", "end", "cluster", "cluster_length"),
        "regions_basic": lambda s, d: r6(_regions(s, d, basic=True).select("chr", "stat", "width", "area")),
        "region_group_fc": lambda s, d: r6(regions.regions_with_groups(filters.group_means(filters.filter_data(_segs(s, d), N, CUT, "mean"), fx.GROUPS), "mean_cov", CUT, ["A", "B"]).where("direction = 'up'").select("chr", "start", "end", "mean_coverage", "mean_A", "mean_B", "log2_fold_B_vs_A")),
        "null_regions": lambda s, d: r6(_nulls(s, d)),
        "pvalues": lambda s, d: r6(significance.p_values(_f_regions(s, d).select("chr", "start", "end", "area"), _nulls(s, d)).select("chr", "start", "end", "pvalue")),
        "fwer": lambda s, d: r6(significance.fwer(_f_regions(s, d).select("chr", "start", "end", "area"), _nulls(s, d), len(fx.PERMUTATIONS), F_CUT).select("chr", "start", "end", "fwer")),
        "qvalues": lambda s, d: r6(significance.q_values(significance.p_values(_f_regions(s, d).select("chr", "start", "end", "area"), _nulls(s, d))).select("chr", "start", "end", "qvalue")),
        "bh_adjust": lambda s, d: r6(significance.adjusted(significance.p_values(_f_regions(s, d).select("chr", "start", "end", "area"), _nulls(s, d)), "pvalue", "padj").select("chr", "start", "end", "padj")),
        "region_matrix": lambda s, d: r6(matrix.long_counts(matrix.region_matrix(_segs(s, d), fx.SAMPLES, CUT, LENGTHS), fx.SAMPLES)),
        "rail_matrix": lambda s, d: r6(matrix.rail_matrix(_mean(s, d), _runs(s, d), fx.SAMPLES, CUT, LENGTHS)),
        "region_coverage": lambda s, d: matrix.region_coverage(_regions(s, d).select("chr", "start", "end"), _runs(s, d)),
        "exon_coverage": lambda s, d: r6(matrix.exon_coverage(fx.exons(s, d), _runs(s, d), fx.SAMPLES, LENGTHS)),
        "exon_rpkm": lambda s, d: r6(matrix.rpkm(matrix.exon_coverage(fx.exons(s, d), _runs(s, d), fx.SAMPLES, LENGTHS), fx.exons(s, d), coverage.total_mapped(fx.reads(s, d)).select("sample", F.col("total_mapped").cast("double").alias("reads")))),
        "interval_reduce": lambda s, d: intervals.reduce_intervals(fx.exons(s, d), ("chr", "strand")),
        "interval_disjoin": lambda s, d: intervals.disjoin(fx.exons(s, d)).select("chr", "start", "end", F.col("n").cast("long").alias("n")),
        "interval_gaps": lambda s, d: intervals.gaps(fx.exons(s, d).select("chr", "start", "end"), fx.chrom_sizes(s, d)),
        "interval_resize": lambda s, d: intervals.resize(fx.transcripts(s, d).select("tx_id", "chr", "start", "end"), 21).select("tx_id", "start", "end"),
        "interval_promoters": lambda s, d: intervals.promoters(fx.transcripts(s, d).select("tx_id", "strand", "start", "end"), 20, 5).select("tx_id", "start", "end"),
        "genome_tiles": lambda s, d: intervals.tile_genome(fx.chrom_sizes(s, d), 100),
        "genomic_state_full": lambda s, d: _states(s, d, "full"),
        "genomic_state_coding": lambda s, d: _states(s, d, "coding"),
        "genomic_state_genes": lambda s, d: annotation.with_transcripts(_states(s, d, "full"), fx.transcripts(s, d)).select("chr", "start", "end", "strand", "state", F.concat_ws(",", "gene").alias("genes"), F.size("tx_id").cast("long").alias("n_tx")),
        "annotate_counts": lambda s, d: annotation.annotate_counts(_numbered(s, d), _states(s, d, "full"), ["exon", "intron", "intergenic"]),
        "annotate_hits": lambda s, d: annotation.annotate_hits(_numbered(s, d), _states(s, d, "coding"), 3),
        "nearest_gene": lambda s, d: annotation.nearest_genes(_exon_regions(s, d), fx.transcripts(s, d)),
        "nearest_opposite": lambda s, d: intervals.nearest(*_stranded(_exon_regions(s, d), fx.transcripts(s, d))),
        "filter_smooth_mean": lambda s, d: _positions(filters.filter_data(_segs(s, d), N, SMOOTH_CUT, "mean", mean=True, smooth_mean=smoothing.running_mean, max_cluster_gap=30, k=5), "mean_cov"),
        "regions_smoothed": lambda s, d: r6(_regions(s, d, smooth=smoothing.running_mean, max_cluster_gap=30, k=5).select("chr", "start", "end", "value", "area", "index_start", "index_end")),
        "null_regions_smoothed": lambda s, d: r6(significance.null_regions(_logged(s, d), MOD, MOD0, fx.PERMUTATIONS, F_CUT, smooth=smoothing.finite_running_mean, max_cluster_gap=30, k=3)),
        "regions_split": lambda s, d: r6(_regions(s, d, within=fx.transcripts(s, d).where("tx_id % 5 = 0")).select("chr", "start", "end", "value", "area", "index_start", "index_end")),
        "region_f_test": lambda s, d: r6(significance.region_f_test(matrix.region_matrix(_segs(s, d), fx.SAMPLES, CUT, LENGTHS), MOD, MOD0).select("chr", "start", "end", "f", F.col("pvalue").between(0, 1).alias("is_p"))),
        "region_coverage_matrix": lambda s, d: r6(_flat_y(matrix.region_coverage_matrix(fx.exons(s, d).select("tx_id", "rank", "chr", "start", "end"), _segs(s, d), N, TOTALS, 10000.0, ("tx_id", "rank"))).select("tx_id", "rank", "pos", *y)),
        "full_coverage": lambda s, d: _positions(_flat_y(coverage.full_coverage(_runs(s, d), fx.SAMPLES, ["chr1", "chr3"], cutoff=20.0, filter="mean", totals=TOTALS, target=10000.0)), "mean_cov", *y),
        "coverage_which": lambda s, d: coverage.full_coverage(_runs(s, d), fx.SAMPLES, which=fx.transcripts(s, d).where("tx_id % 40 = 0"), protect=10).select("chr", F.explode(F.sequence("start", "end")).alias("pos")),
        "running_median": lambda s, d: r6(smoothing.running_median(smoothing.clusters(_mean(s, d), "mean_cov", 30), "mean_cov", 5).select("chr", "pos", "smoothed")),
        "seqname_map": lambda s, d: fx.reads(s, d).groupBy("chr").agg(F.count("*").alias("n")).withColumn("ncbi", names.map_names(F.col("chr"), "NCBI", "UCSC")),
        "top_regions": lambda s, d: r6(matrix.top_regions(_regions(s, d).select("chr", "start", "end", F.round("area", 6).alias("area")))),
        "local_smoothing": lambda s, d: smoothing.smooth(smoothing.clusters(_mean(s, d), "mean_cov", 30), "mean_cov").select("chr", "pos", "mean_cov", "smoothed"),
        "full_analysis": lambda s, d: analysis.analyze(_segs(s, d), fx.GROUPS, MOD, MOD0, fx.PERMUTATIONS, _states(s, d, "full")).select("chr", "start", "end", "value", "area", "pvalue", "qvalue", "fwer", "exon", "intron", "intergenic"),
    }
    bounds = lambda q: lambda s, d: _f_bounds(q(s, d))
    return {k: bounds(q) for k, q in out.items()}


# ------------------------------------------------------------------------- SQL

_READS = """reads AS (SELECT 'chr' || l_linenumber AS chr, 's' || (l_suppkey % 6) AS sample, l_partkey + 1 AS a, l_partkey + l_quantity::BIGINT AS b FROM lineitem),
cell AS (SELECT chr, sample, pos, count(*)::BIGINT AS score FROM (SELECT chr, sample, unnest(range(a, b + 1)) AS pos FROM reads) GROUP BY chr, sample, pos)"""
_BASE = _READS + ",\nbase AS (SELECT chr, pos, " + ", ".join(f"sum(CASE WHEN sample = 's{i}' THEN score ELSE 0 END)::DOUBLE AS y{i}" for i in range(N)) + " FROM cell GROUP BY chr, pos)"
_YS = ", ".join(f"y{i}" for i in range(N))
_MEAN_Y = "(" + " + ".join(f"y{i}" for i in range(N)) + f") / {N}"
_MEAN = _BASE + f",\nmc AS (SELECT chr, pos, {_MEAN_Y} AS x, {_YS} FROM base WHERE {_MEAN_Y} > {CUT})"
_LOG = _BASE + ",\nlg AS (SELECT chr, pos, " + ", ".join(f"log2(y{i} + 32) AS y{i}" for i in range(N)) + " FROM base WHERE greatest(" + _YS + ") > 5)"


def _rss(m) -> str:
    p = projection(m)
    return " + ".join("power(" + " + ".join(f"({v:.17g}) * y{j}" for j, v in enumerate(row)) + ", 2)" for row in p.tolist())


def _f_sql(mod, mod0) -> str:
    n, d1, d0 = N, mod.shape[1], mod0.shape[1]
    r1, r0, total = _rss(mod), _rss(mod0), " + ".join(f"y{i} * y{i}" for i in range(N))
    return f"CASE WHEN ({r1}) <= 1e-12 * ({total}) AND ({r0}) <= 1e-12 * ({total}) THEN NULL WHEN ({r1}) <= 1e-12 * ({total}) THEN 'Infinity'::DOUBLE ELSE ((({r0}) - ({r1})) / {d1 - d0}) / (({r1}) / {n - d1}) END"


def _islands(source: str, hit: str, gap: int = 0, keys: str = "chr", prefix: str = "") -> str:
    """CTEs over ``source`` (keys, pos, x): numbered positions and islands of those where ``hit`` holds."""
    return f"""{prefix}k AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS idx, COALESCE({hit}, false) AS hit FROM {source}),
{prefix}b AS (SELECT *, CASE WHEN COALESCE(lag(hit) OVER w, false) AND pos - lag(pos) OVER w - 1 <= {gap} THEN 0 ELSE 1 END AS new FROM {prefix}k WINDOW w AS (PARTITION BY {keys} ORDER BY pos)),
{prefix}i AS (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY pos) AS g FROM {prefix}b WHERE hit)"""


_REGION = "chr, min(pos)::BIGINT AS start_pos, max(pos)::BIGINT AS end_pos"
_FSTAT = _LOG + f",\nfs AS (SELECT chr, pos, {_f_sql(MOD, MOD0)} AS x FROM lg)"
_NULLS = ",\nnp AS (" + " UNION ALL ".join(f"SELECT {k + 1} AS perm, chr, pos, {_f_sql(MOD[p], MOD0[p])} AS x FROM lg" for k, p in enumerate(fx.PERMUTATIONS)) + "),\n"
_NULL_REGIONS = "nr AS (SELECT perm, avg(x) AS stat, count(*)::BIGINT AS width, abs(sum(x)) AS area FROM (SELECT perm, chr, g, x, 'up' AS d FROM nui UNION ALL SELECT perm, chr, g, x, 'dn' FROM ndi) GROUP BY perm, chr, d, g)"
_NULL = _FSTAT + _NULLS + _islands("np", f"x >= {F_CUT}", keys="perm, chr", prefix="nu") + ",\n" + _islands("np", f"x <= -{F_CUT}", keys="perm, chr", prefix="nd") + ",\n" + _NULL_REGIONS
_F_REGIONS = _NULL + ",\n" + _islands("fs", f"x >= {F_CUT}", prefix="o") + f",\nobs AS (SELECT {_REGION}, abs(sum(x)) AS area FROM oi GROUP BY chr, g)"
_PV = _F_REGIONS + ",\npv AS (SELECT chr, start_pos, end_pos, (2 * (SELECT count(*) FROM nr WHERE nr.area > obs.area) + 1)::DOUBLE / (SELECT 2 * count(*) + 1 FROM nr) AS p FROM obs)"
_TX = """tx AS (SELECT p_partkey AS tx_id, p_name AS tx_name, p_brand AS gene_id, 'chr' || (p_partkey % 7 + 1) AS chr, p_partkey + 1 AS a, p_partkey + p_size AS b, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, p_size::BIGINT AS n FROM part),
ex AS (SELECT tx_id, 1 AS rank, chr, a, CASE WHEN n < 3 THEN b ELSE a + n // 3 - 1 END AS b, strand FROM tx UNION ALL SELECT tx_id, 2, chr, b - n // 3 + 1, b, strand FROM tx WHERE n >= 3)"""
_SIZES = _READS + ",\n" + _TX + ",\nsz AS (SELECT chr, max(b)::BIGINT AS length FROM (SELECT chr, b FROM reads UNION ALL SELECT chr, b FROM tx) GROUP BY chr)"


def _states_sql(kind: str) -> str:
    kinds = list(annotation.FULL if kind == "full" else annotation.CODING)
    parts = ["SELECT chr, strand, unnest(range(a, b + 1)) AS pos, " + str(kinds.index("exon")) + " AS k FROM ex", f"SELECT t.chr, t.strand, unnest(range(t.a + t.n // 3, t.b - t.n // 3 + 1)), {kinds.index('intron')} FROM tx t WHERE n >= 3 AND t.b - t.n // 3 >= t.a + t.n // 3"]
    if kind == "coding":
        parts.append(f"SELECT chr, strand, unnest(range(greatest(CASE WHEN strand = '-' THEN b - 4 ELSE a - 20 END, 1), CASE WHEN strand = '-' THEN b + 21 ELSE a + 5 END)), {kinds.index('promoter')} FROM tx")
        for side, part in (("e.a < t.a + 2", "range(e.a, least(e.b, t.a + 1) + 1)"), ("e.b > t.b - 2", "range(greatest(e.a, t.b - 1), e.b + 1)")):
            five = "e.strand <> '-'" if "t.a" in side else "e.strand = '-'"
            parts.append(f"SELECT e.chr, e.strand, unnest({part}), CASE WHEN {five} THEN {kinds.index('fiveUTR')} ELSE {kinds.index('threeUTR')} END FROM ex e JOIN tx t ON t.tx_id = e.tx_id WHERE t.n >= 8 AND {side}")
    names_ = "CASE k " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds)) + " END"
    return _SIZES + f""",
sp AS (SELECT chr, strand, pos, max(k) AS k FROM ({" UNION ALL ".join(parts)}) GROUP BY chr, strand, pos),
gp AS (SELECT sz.chr, '*' AS strand, p.pos, -1 AS k FROM (SELECT chr, unnest(range(1, length + 1)) AS pos FROM sz) p JOIN sz ON sz.chr = p.chr WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.chr = p.chr AND sp.pos = p.pos)),
ap AS (SELECT * FROM sp UNION ALL SELECT * FROM gp),
sg AS (SELECT *, pos - row_number() OVER (PARTITION BY chr, strand, k ORDER BY pos) AS g FROM ap),
st AS (SELECT chr, min(pos)::BIGINT AS a, max(pos)::BIGINT AS b, strand, CASE WHEN k = -1 THEN 'intergenic' ELSE {names_} END AS state FROM sg GROUP BY chr, strand, k, g)"""


_M = _MEAN + ",\n" + _islands("mc", f"x >= {CUT}")
_NUMBERED = ",\nmz AS (SELECT chr, pos, " + _MEAN_Y + f" AS x FROM base WHERE {_MEAN_Y} > {CUT}),\n" + _islands("mz", f"x >= {CUT}", prefix="m") + f",\nrg0 AS (SELECT {_REGION} FROM mi GROUP BY chr, g),\nrg AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY start_pos) AS region_id FROM rg0)"
_BASE_ONLY = "base AS (SELECT chr, pos, " + ", ".join(f"sum(CASE WHEN sample = 's{i}' THEN score ELSE 0 END)::DOUBLE AS y{i}" for i in range(N)) + " FROM cell GROUP BY chr, pos)"
_LEN = "CASE sample " + " ".join(f"WHEN 's{i}' THEN {v}" for i, v in enumerate(LENGTHS)) + " END"
_GRID = "gr AS (SELECT DISTINCT 's' || unnest(range(0, 6)) AS sample)"


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


def oracle_sql() -> dict[str, str]:
    ys = ", ".join(_r(f"y{i}", f"y{i}") for i in range(N))
    exon_counts = "xc AS (SELECT e.tx_id, e.rank, g.sample, COALESCE(sum(c.score), 0)::DOUBLE / (" + _LEN.replace("sample", "g.sample") + ") AS value, e.b - e.a + 1 AS w FROM ex e CROSS JOIN gr g LEFT JOIN cell c ON c.chr = e.chr AND c.sample = g.sample AND c.pos BETWEEN e.a AND e.b GROUP BY e.tx_id, e.rank, g.sample, e.a, e.b)"
    out = {
        "coverage_runs": _with(_READS + ", k AS (SELECT *, CASE WHEN lag(pos) OVER w + 1 = pos AND lag(score) OVER w = score THEN 0 ELSE 1 END AS new FROM cell WINDOW w AS (PARTITION BY chr, sample ORDER BY pos)), i AS (SELECT *, sum(new) OVER (PARTITION BY chr, sample ORDER BY pos) AS g FROM k)", "SELECT chr, sample, min(pos)::BIGINT AS start_pos, max(pos)::BIGINT AS end_pos, min(score) AS score FROM i GROUP BY chr, sample, g"),
        "coverage_dense": _with(_READS, "SELECT chr, sample, pos, score FROM cell"),
        "segment_positions": _with(_BASE, f"SELECT chr, pos, {ys} FROM base"),
        "run_segment_positions": _with(_BASE, f"SELECT chr, pos, {ys} FROM base"),
        "total_mapped": _with(_READS, "SELECT sample, count(*)::BIGINT AS total_mapped FROM reads GROUP BY sample"),
        "auc": _with(_READS, "SELECT sample, sum(b - a + 1)::BIGINT AS auc FROM reads GROUP BY sample"),
        "filter_one": _with(_BASE, f"SELECT chr, pos, {ys} FROM base WHERE greatest({_YS}) > 25"),
        "filter_mean": _with(_MEAN, f"SELECT chr, pos, {_r('x', 'mean_cov')} FROM mc"),
        "filter_normalized": _with(_BASE, "SELECT chr, pos, " + ", ".join(_r(f"y{i} / {t / 10000.0}", f"y{i}") for i, t in enumerate(TOTALS)) + " FROM base WHERE greatest(" + ", ".join(f"y{i} / {t / 10000.0}" for i, t in enumerate(TOTALS)) + ") > 20"),
        "filter_refilter": _with(_BASE, f"SELECT chr, pos, {_r(_MEAN_Y, 'mean_cov')} FROM base WHERE greatest({_YS}) > 22 AND {_MEAN_Y} > 19"),
        "filter_subset": _with(_BASE, f"SELECT chr, pos, {_r('(y0 + y2 + y4) / 3', 'mean_cov')} FROM base WHERE (y0 + y2 + y4) / 3 > 20"),
        "collapse_hist": _with(_READS, "SELECT sample, score::DOUBLE AS value, count(*)::BIGINT AS weight FROM cell GROUP BY sample, score"),
        "sample_quantile": _with(_READS, " UNION ALL ".join(f"SELECT sample, {p}::DOUBLE AS prob, {_r(f'quantile_cont(score::DOUBLE, {p})', 'q')} FROM cell GROUP BY sample" for p in (0.5, 1.0))),
        "sample_depth": _with(_READS + ", q AS (" + " UNION ALL ".join(f"SELECT sample, {p}::DOUBLE AS prob, quantile_cont(score::DOUBLE, {p}) AS q FROM cell GROUP BY sample" for p in (0.5, 1.0)) + ")", f"SELECT sample, prob, {_r('log2(sum(CASE WHEN score <= q THEN score ELSE 0 END) + 32)', 'depth')} FROM cell JOIN q USING (sample) GROUP BY sample, prob"),
        "mean_group": _with(_BASE, f"SELECT chr, pos, {_r(_MEAN_Y, 'mean_cov')}, {_r('(y0 + y2 + y4) / 3', 'mean_A')}, {_r('(y1 + y3 + y5) / 3', 'mean_B')} FROM base"),
        "log_transform": _with(_LOG, f"SELECT chr, pos, {ys} FROM lg"),
        "fstats": _with(_FSTAT, f"SELECT chr, pos, {_r('x', 'f')} FROM fs"),
        "fstats_matrix": _with(_FSTAT, f"SELECT chr, pos, {_r('x', 'f')} FROM fs"),
        "fstat_cutoff_empirical": _with(_FSTAT, f"SELECT {_r('quantile_cont(x, 0.9)', 'cutoff')} FROM fs WHERE x IS NOT NULL"),
        "segments_up": _with(_FSTAT + ",\n" + _islands("fs", f"x >= {F_CUT}"), f"SELECT {_REGION}, min(idx)::BIGINT AS index_start, max(idx)::BIGINT AS index_end FROM i GROUP BY chr, g"),
        "segments_dn": _with(_FSTAT + ",\n" + _islands("fs", "x <= 0.001"), f"SELECT {_REGION}, min(idx)::BIGINT AS index_start, max(idx)::BIGINT AS index_end FROM i GROUP BY chr, g"),
        "cluster_positions": _with(_MEAN + ",\n" + _islands("mc", "true", 10), f"SELECT {_REGION} FROM i GROUP BY chr, g"),
        "regions": _with(_M, f"SELECT {_REGION}, {_r('avg(x)', 'value')}, {_r('abs(sum(x))', 'area')}, min(idx)::BIGINT AS index_start, max(idx)::BIGINT AS index_end FROM i GROUP BY chr, g"),
        "regions_gap": _with(_MEAN + ",\n" + _islands("mc", f"x >= {CUT}", 10), f"SELECT {_REGION}, {_r('avg(x)', 'value')}, {_r('abs(sum(x))', 'area')}, min(idx)::BIGINT AS index_start, max(idx)::BIGINT AS index_end FROM i GROUP BY chr, g"),
        "regions_clustered": _with(_M + f",\nr AS (SELECT {_REGION} FROM i GROUP BY chr, g), c AS (SELECT *, CASE WHEN start_pos - lag(end_pos) OVER (PARTITION BY chr ORDER BY start_pos) - 1 <= 30 THEN 0 ELSE 1 END AS nw FROM r), d AS (SELECT *, sum(nw) OVER (PARTITION BY chr ORDER BY start_pos)::BIGINT AS cluster FROM c)", "SELECT chr, start_pos, end_pos, cluster, (max(end_pos) OVER (PARTITION BY chr, cluster) - min(start_pos) OVER (PARTITION BY chr, cluster) + 1)::BIGINT AS cluster_length FROM d"),
        "regions_basic": _with(_M, f"SELECT chr, {_r('avg(x)', 'stat')}, count(*)::BIGINT AS width, {_r('abs(sum(x))', 'area')} FROM i GROUP BY chr, g"),
        "region_group_fc": _with(_M, f"SELECT {_REGION}, {_r('avg(x)', 'mean_coverage')}, {_r('avg((y0 + y2 + y4) / 3)', 'mean_A')}, {_r('avg((y1 + y3 + y5) / 3)', 'mean_B')}, {_r('log2(avg((y1 + y3 + y5) / 3) / avg((y0 + y2 + y4) / 3))', 'log2_fold_B_vs_A')} FROM i GROUP BY chr, g"),
        "null_regions": _with(_NULL, f"SELECT perm::INTEGER AS perm, {_r('stat', 'stat')}, width, {_r('area', 'area')} FROM nr"),
        "pvalues": _with(_PV, f"SELECT chr, start_pos, end_pos, {_r('p', 'pvalue')} FROM pv"),
        "fwer": _with(_F_REGIONS + f",\nmx AS (SELECT p.perm, COALESCE(max(area), {F_CUT}) AS m FROM (SELECT unnest(range(1, 4)) AS perm) p LEFT JOIN nr ON nr.perm = p.perm GROUP BY p.perm)", f"SELECT chr, start_pos, end_pos, {_r('((SELECT count(*) FROM mx WHERE m > obs.area) + 1) / 4.0::DOUBLE', 'fwer')} FROM obs"),
        "bh_adjust": _with(_PV + ",\nrk AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS n FROM pv)", f"SELECT chr, start_pos, end_pos, {_r('least(1, min(p * n / k) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))', 'padj')} FROM rk"),
        "qvalues": _with(_PV + ",\nt AS (SELECT count(*) AS n FROM pv), s0 AS (SELECT least(1, " + " + ".join(f"({w!r}) * count(*) FILTER (p >= {v}) / ({1 - v!r} * count(*))" for v, w in zip(significance.LAMBDAS, significance.last_smoothed(np.array(significance.LAMBDAS)).tolist(), strict=True)) + ") AS pi0 FROM pv), rk AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS n FROM pv CROSS JOIN s0)", f"SELECT chr, start_pos, end_pos, {_r('CASE WHEN pi0 > 0 THEN least(1, min(pi0 * p * n / k) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END', 'qvalue')} FROM rk"),
        "region_matrix": _with(_M + f",\nr AS (SELECT {_REGION}, " + ", ".join(f"sum(y{i}) AS y{i}" for i in range(N)) + " FROM i GROUP BY chr, g)", " UNION ALL ".join(f"SELECT chr, start_pos, end_pos, 's{i}' AS sample, {_r(f'y{i} / {LENGTHS[i]}', 'value')} FROM r" for i in range(N))),
        "rail_matrix": _with(_M + f",\n{_GRID}, r AS (SELECT {_REGION} FROM i GROUP BY chr, g)", f"SELECT r.chr, r.start_pos, r.end_pos, gr.sample, {_r('COALESCE(sum(c.score), 0)::DOUBLE / (' + _LEN.replace('sample', 'gr.sample') + ')', 'value')} FROM r CROSS JOIN gr LEFT JOIN cell c ON c.chr = r.chr AND c.sample = gr.sample AND c.pos BETWEEN r.start_pos AND r.end_pos GROUP BY r.chr, r.start_pos, r.end_pos, gr.sample"),
        "region_coverage": _with(_M + f",\nr AS (SELECT {_REGION} FROM i GROUP BY chr, g)", "SELECT r.chr, r.start_pos, r.end_pos, c.pos, c.sample, c.score::DOUBLE AS score FROM r JOIN cell c ON c.chr = r.chr AND c.pos BETWEEN r.start_pos AND r.end_pos"),
        "exon_coverage": _with(_READS + ",\n" + _TX + ",\n" + _GRID + ",\n" + exon_counts, f"SELECT tx_id, rank::INTEGER AS rank, sample, {_r('value', 'value')} FROM xc"),
        "exon_rpkm": _with(_READS + ",\n" + _TX + ",\n" + _GRID + ",\n" + exon_counts + ", t AS (SELECT sample, count(*) AS n FROM reads GROUP BY sample)", f"SELECT tx_id, rank::INTEGER AS rank, sample, {_r('value / (w / 1000.0) / (n / 1e6)', 'value')} FROM xc JOIN t USING (sample)"),
        "interval_reduce": _with(_TX + ", p AS (SELECT DISTINCT chr, strand, unnest(range(a, b + 1)) AS pos FROM ex), g AS (SELECT *, pos - row_number() OVER (PARTITION BY chr, strand ORDER BY pos) AS g FROM p)", "SELECT chr, strand, min(pos)::BIGINT AS start_pos, max(pos)::BIGINT AS end_pos FROM g GROUP BY chr, strand, g"),
        "interval_disjoin": _with(_TX + ", e AS (SELECT chr, a AS p FROM ex UNION SELECT chr, b + 1 FROM ex), s AS (SELECT chr, p AS a, lead(p) OVER (PARTITION BY chr ORDER BY p) - 1 AS b FROM e)", "SELECT s.chr, s.a::BIGINT AS start_pos, s.b::BIGINT AS end_pos, count(*)::BIGINT AS n FROM s JOIN ex ON ex.chr = s.chr AND ex.a <= s.a AND s.b <= ex.b WHERE s.b IS NOT NULL GROUP BY s.chr, s.a, s.b"),
        "interval_gaps": _with(_SIZES + ", u AS (SELECT DISTINCT chr, unnest(range(a, b + 1)) AS pos FROM ex), p AS (SELECT chr, unnest(range(1, length + 1)) AS pos FROM sz), f AS (SELECT p.chr, p.pos FROM p LEFT JOIN u ON u.chr = p.chr AND u.pos = p.pos WHERE u.pos IS NULL), g AS (SELECT *, pos - row_number() OVER (PARTITION BY chr ORDER BY pos) AS g FROM f)", "SELECT chr, min(pos)::BIGINT AS start_pos, max(pos)::BIGINT AS end_pos FROM g GROUP BY chr, g"),
        "interval_resize": _with(_TX, "SELECT tx_id, (a + floor((n - 21) / 2.0))::BIGINT AS start_pos, (a + floor((n - 21) / 2.0) + 20)::BIGINT AS end_pos FROM tx"),
        "interval_promoters": _with(_TX, "SELECT tx_id, greatest(CASE WHEN strand = '-' THEN b - 4 ELSE a - 20 END, 1)::BIGINT AS start_pos, (CASE WHEN strand = '-' THEN b + 20 ELSE a + 4 END)::BIGINT AS end_pos FROM tx"),
        "genome_tiles": _with(_SIZES, "SELECT chr, (k * 100 + 1)::BIGINT AS start_pos, least((k + 1) * 100, length)::BIGINT AS end_pos FROM (SELECT chr, length, unnest(range(0, (length - 1) // 100 + 1)) AS k FROM sz)"),
        "genomic_state_full": _with(_states_sql("full"), "SELECT chr, a AS start_pos, b AS end_pos, strand, state FROM st"),
        "genomic_state_coding": _with(_states_sql("coding"), "SELECT chr, a AS start_pos, b AS end_pos, strand, state FROM st"),
        "genomic_state_genes": _with(_states_sql("full"), "SELECT st.chr, st.a AS start_pos, st.b AS end_pos, st.strand, st.state, COALESCE(string_agg(DISTINCT tx.gene_id, ',' ORDER BY tx.gene_id), '') AS genes, count(DISTINCT tx.tx_id)::BIGINT AS n_tx FROM st LEFT JOIN tx ON tx.chr = st.chr AND tx.strand = st.strand AND tx.a <= st.b AND st.a <= tx.b GROUP BY st.chr, st.a, st.b, st.strand, st.state"),
        "annotate_counts": _with(_states_sql("full") + ",\n" + _BASE_ONLY + _NUMBERED, "SELECT rg.region_id, rg.chr, " + ", ".join(f"count(CASE WHEN st.state = '{s}' THEN 1 END)::BIGINT AS {s}" for s in ("exon", "intron", "intergenic")) + " FROM rg LEFT JOIN st ON st.chr = rg.chr AND st.a <= rg.end_pos AND rg.start_pos <= st.b GROUP BY rg.region_id, rg.chr"),
        "annotate_hits": _with(_states_sql("coding") + ",\n" + _BASE_ONLY + _NUMBERED, "SELECT rg.region_id, rg.chr, rg.start_pos, rg.end_pos, st.state, st.a AS state_start, st.b AS state_end, st.strand FROM rg JOIN st ON st.chr = rg.chr AND least(st.b, rg.end_pos) - greatest(st.a, rg.start_pos) + 1 >= 3"),
        "nearest_gene": _with(_TX + ", p AS (SELECT e.tx_id * 10 + e.rank AS region_id, e.strand, e.a AS ea, e.b AS eb, f.tx_id, f.gene_id, f.a, f.b, f.strand AS fs, greatest(0, f.a - e.b, e.a - f.b) AS distance FROM ex e JOIN tx f ON f.chr = e.chr), k AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY distance, tx_id) AS n FROM p)", "SELECT region_id, tx_id, gene_id, distance::BIGINT AS distance, CASE WHEN distance > 0 THEN CASE WHEN (eb < a) = (fs <> '-') THEN 'upstream' ELSE 'downstream' END WHEN a <= ea AND eb <= b THEN 'inside' WHEN ea <= a AND b <= eb THEN 'covers' WHEN (ea < a) = (fs <> '-') THEN 'overlaps 5 prime' ELSE 'overlaps 3 prime' END AS description FROM k WHERE n = 1"),
        "nearest_opposite": _with(_TX + ", p AS (SELECT e.tx_id * 10 + e.rank AS region_id, f.tx_id, greatest(0, f.a - e.b, e.a - f.b) AS distance FROM ex e JOIN tx f ON f.chr = e.chr AND f.strand <> e.strand), k AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY distance, tx_id) AS n FROM p)", "SELECT region_id, tx_id, distance::BIGINT AS distance FROM k WHERE n = 1"),
        "filter_smooth_mean": _with(_BASE + f",\nab AS (SELECT chr, pos, {_MEAN_Y} AS x FROM base),\n" + _islands("ab", "true", 30) + ", sm AS (SELECT chr, pos, avg(x) OVER (PARTITION BY chr, g ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM i)", f"SELECT chr, pos, {_r('v', 'mean_cov')} FROM sm WHERE v > {SMOOTH_CUT}"),
        "regions_smoothed": _with(_MEAN + ",\n" + _islands("mc", "true", 30, prefix="c") + ", sm AS (SELECT chr, pos, avg(x) OVER (PARTITION BY chr, g ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS x FROM ci),\n" + _islands("sm", f"x >= {CUT}"), f"SELECT {_REGION}, {_r('avg(x)', 'value')}, {_r('abs(sum(x))', 'area')}, min(idx)::BIGINT AS index_start, max(idx)::BIGINT AS index_end FROM i GROUP BY chr, g"),
        "null_regions_smoothed": _with(_FSTAT + _NULLS + _islands("np", "true", 30, keys="perm, chr", prefix="c") + ", sm AS (SELECT perm, chr, pos, CASE WHEN x IS NULL OR isinf(x) THEN x ELSE avg(CASE WHEN NOT isinf(x) THEN x END) OVER (PARTITION BY perm, chr, g ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS x FROM ci),\n" + _islands("sm", f"x >= {F_CUT}", keys="perm, chr"), f"SELECT perm::INTEGER AS perm, {_r('avg(x)', 'stat')}, count(*)::BIGINT AS width, {_r('abs(sum(x))', 'area')} FROM i GROUP BY perm, chr, g"),
        "regions_split": _with(_MEAN + ",\n" + _TX + ", eg AS (SELECT DISTINCT chr, unnest([a, b + 1]) AS pos FROM tx WHERE tx_id % 5 = 0), mk AS (SELECT mc.*, (eg.pos IS NOT NULL) AS cut FROM mc LEFT JOIN eg ON eg.chr = mc.chr AND eg.pos = mc.pos), ix AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY pos) AS idx, CASE WHEN cut OR lag(pos) OVER (PARTITION BY chr ORDER BY pos) + 1 IS DISTINCT FROM pos THEN 1 ELSE 0 END AS new FROM mk), i AS (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY pos) AS g FROM ix)", f"SELECT {_REGION}, {_r('avg(x)', 'value')}, {_r('abs(sum(x))', 'area')}, min(idx)::BIGINT AS index_start, max(idx)::BIGINT AS index_end FROM i GROUP BY chr, g"),
        "region_f_test": _with(_M + f",\nr AS (SELECT {_REGION}, " + ", ".join(f"log2(sum(y{i}) / {LENGTHS[i]} + 32) AS y{i}" for i in range(N)) + " FROM i GROUP BY chr, g)", f"SELECT chr, start_pos, end_pos, {_r(_f_sql(MOD, MOD0), 'f')}, CASE WHEN {_f_sql(MOD, MOD0)} IS NOT NULL THEN true END AS is_p FROM r"),
        "region_coverage_matrix": _with(_BASE + ",\n" + _TX + ", ps AS (SELECT tx_id, rank, chr, unnest(range(a, b + 1)) AS pos FROM ex)", "SELECT tx_id, rank::INTEGER AS rank, ps.pos::BIGINT AS pos, " + ", ".join(_r(f"COALESCE(y{i}, 0) / {t / 10000.0}", f"y{i}") for i, t in enumerate(TOTALS)) + " FROM ps LEFT JOIN base ON base.chr = ps.chr AND base.pos = ps.pos"),
        "full_coverage": _with(_BASE + ", nz AS (SELECT chr, pos, " + ", ".join(f"y{i} / {t / 10000.0} AS y{i}" for i, t in enumerate(TOTALS)) + " FROM base WHERE chr IN ('chr1', 'chr3'))", f"SELECT chr, pos, {_r(_MEAN_Y, 'mean_cov')}, {ys} FROM nz WHERE {_MEAN_Y} > 20"),
        "coverage_which": _with(_BASE + ",\n" + _TX + ", wh AS (SELECT chr, a + floor((n - (n + 10)) / 2.0)::BIGINT AS a, a + floor((n - (n + 10)) / 2.0)::BIGINT + n + 9 AS b FROM tx WHERE tx_id % 40 = 0)", "SELECT chr, pos FROM base WHERE EXISTS (SELECT 1 FROM wh WHERE wh.chr = base.chr AND base.pos BETWEEN wh.a AND wh.b)"),
        "running_median": _with(_MEAN + ",\n" + _islands("mc", "true", 30), f"SELECT chr, pos, {_r('median(x) OVER (PARTITION BY chr, g ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 'smoothed')} FROM i"),
        "seqname_map": _with(_READS, "SELECT chr, count(*)::BIGINT AS n, substr(chr, 4) AS ncbi FROM reads GROUP BY chr"),
        "top_regions": _with(_M, f"SELECT {_REGION}, {_r('abs(sum(x))', 'area')} FROM i GROUP BY chr, g ORDER BY round(abs(sum(x)), 6) DESC, chr, start_pos LIMIT 100"),
    }
    out["coverage_export"] = out["coverage_runs"].replace("min(score) AS score", "'*' AS strand, min(score)::DOUBLE AS score")
    return out
