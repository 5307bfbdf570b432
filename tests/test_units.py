"""Published micro-cases and properties of the operators."""

import collections
import decimal
import random

import numpy as np
import pytest

from basewise.functions import names, stats
from basewise.operators import annotation, coverage, depth, filters, fstats, intervals, matrix, regions, significance, smoothing
from basewise.sources import files


def segs(spark, rows):
    """Segments from (start, end, values) on one chromosome."""
    return spark.createDataFrame([("c", (s - 1) // coverage.TILE, s, e, [float(v) for v in y]) for s, e, y in rows], "chr string, tile long, start long, end long, y array<double>")


def signal(spark, rows):
    return filters.filter_data(segs(spark, [(s, e, [v]) for s, e, v in rows]), 1, -1e9, "mean", mean=True)


def test_cluster_positions(spark):
    runs = spark.createDataFrame([("c", 1, 1000), ("c", 2001, 3000), ("c", 3201, 4200)], "chr string, start long, end long")
    widths = lambda gap: sorted(r["end"] - r["start"] + 1 for r in intervals.reduce_intervals(runs, min_gap=gap + 1).collect())
    assert widths(300) == [1000, 2200] and widths(999) == [1000, 2200] and len(widths(1000)) == 1


def test_segments_up_and_down(spark):
    rows = [(1, 1000, -1), (1001, 2000, 0), (2001, 3000, 1), (3001, 4000, 2)]
    found = lambda x, c: {(r["direction"], r["start"], r["end"]) for r in regions.islands(signal(spark, x), "mean_cov", c).collect()}
    assert found(rows, 0.5) == {("up", 2001, 4000), ("dn", 1, 1000)}
    assert found([(s, e, v + 3) for s, e, v in rows], (1, 1)) == {("up", 1, 4000)}


def test_islands_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(3)
    at, rows = 1, []
    for _ in range(300):
        at += int(rng.choice([0, 0, 0, 1, 3, 12]))
        w = int(rng.integers(1, 9))
        rows.append((at, at + w - 1, float(rng.integers(0, 6))))
        at += w
    base = signal(spark, rows)
    for gap in (0, 3, 10):
        want = None
        for tile in (1 << 20, 64, 17):
            cut = coverage.tiled(base.drop("tile"), tile).select("chr", "tile", "start", "end", "mean_cov")
            got = sorted(tuple(r) for r in regions.islands(cut, "mean_cov", 3.0, gap).select("direction", "start", "end", "width", "signal_sum", "index_start", "index_end").collect())
            assert want is None or got == want
            want = got


def test_pileup_does_not_depend_on_tiles(spark):
    reads = spark.createDataFrame([("c", "s", 5, 30), ("c", "s", 10, 20), ("c", "s", 21, 40), ("c", "t", 1, 3)], "chr string, sample string, start long, end long")
    want = sorted(map(tuple, coverage.pileup(reads).collect()))
    assert want == [("c", "s", 5, 9, 1), ("c", "s", 10, 30, 2), ("c", "s", 31, 40, 1), ("c", "t", 1, 3, 1)]
    assert sorted(map(tuple, coverage.pileup(reads, 7).collect())) == want
    assert sorted(map(tuple, coverage.segment_runs(coverage.segments(reads, ["s", "t"], 7), ["s", "t"]).select("chr", "sample", "start", "end", "score").collect())) == [(a, b, c, d, float(e)) for a, b, c, d, e in want]


def test_p_values_and_fwer(spark):
    areas = spark.createDataFrame([(1.0,), (2.0,)], "area double")
    nulls = spark.createDataFrame([(1, 1.0), (1, 2.0), (3, 3.0), (3, 4.0)], "perm int, area double")
    p = significance.p_values(areas, nulls, doubled=False).orderBy("area").collect()
    assert [round(r["pvalue"], 6) for r in p] == [0.8, 0.6]
    maxima = significance.fwer(areas, nulls, 3, 10.0).orderBy("area").collect()
    assert [r["fwer"] for r in maxima] == [1.0, 0.75]
    lower = significance.fwer(areas, spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)], "perm int, area double"), 3, 10.0).orderBy("area").collect()
    assert [r["fwer"] for r in lower] == [1.0, 0.75]
    assert significance.p_values(areas, nulls.limit(0)).where("pvalue IS NULL").count() == 2


def test_p_values_do_not_depend_on_rounding(spark):
    """At these counts two orders of the samples have the same F, but for rounding; a clearly greater area still counts."""
    mod, mod0 = stats.make_models(None, ["A", "B"] * 3, [[1.0, 1.0, 1.0, 0.0, 0.0, 0.0]])
    logged = filters.log_transform(segs(spark, [(990, 990, (17, 18, 18, 20, 18, 20))]))
    tied = fstats.permuted_stats(logged, mod, mod0, [[0, 1, 2, 3, 4, 5], [2, 4, 1, 5, 0, 3]]).withColumnRenamed("f", "area")
    a, b = [r["area"] for r in tied.collect()]
    assert a == pytest.approx(b, rel=1e-12) and {r["pvalue"] for r in significance.p_values(tied, tied).collect()} == {1 / 5}
    apart = tied.withColumn("area", tied["area"] * (1 + 1e-6))
    assert {r["pvalue"] for r in significance.p_values(tied, apart).collect()} == {1.0}


def test_count_greater_against_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 200, 300).astype(float), rng.integers(0, 200, 2000).astype(float)
    out = significance.count_greater(spark.createDataFrame([(float(x),) for x in a], "x double"), "x", spark.createDataFrame([(float(x),) for x in b], "y double"), "y", "n").collect()
    assert len(out) == 300 and all(r["n"] == int((b > r["x"]).sum()) for r in out)


def test_models_and_f(spark):
    mod, mod0 = stats.make_models([1.0, 2.0, 1.5, 3.0, 2.2, 2.8], ["A", "A", "B", "B", "C", "C"])
    assert mod.shape == (6, 4) and mod0.shape == (6, 2)
    with pytest.warns(UserWarning):
        assert stats.make_models([1.0] * 6, ["A", "A", "B", "B", "C", "C"])[0].shape == (6, 3)
    with pytest.raises(ValueError):
        stats.make_models([1.0], ["A", "B"])
    alone, none = stats.make_models([1.0, 2.0, 4.0], ["A", "B", "A"], test_intercept=True)
    assert alone.shape == (3, 2) and none.shape == (3, 1)
    y = np.random.default_rng(0).normal(5, 1, (50, 6))
    p1, p0 = stats.projection(mod), stats.projection(mod0)
    rss = lambda p: ((y @ p.T) ** 2).sum(axis=1)
    want = ((rss(p0) - rss(p1)) / 2) / (rss(p1) / 2)
    assert np.allclose(fstats.f_values(y, mod, mod0), want)
    rows = segs(spark, [(10 * i + 1, 10 * i + 2, v) for i, v in enumerate(y)])
    for method in ("expression", "matrix"):
        assert np.allclose([r["f"] for r in fstats.calculate_stats(rows, mod, mod0, method=method).orderBy("start").collect()], want)
    assert fstats.calculate_stats(segs(spark, [(1, 2, [3.0] * 6)]), mod, mod0).first()["f"] is None


def test_close_fits_keep_their_digits(spark):
    """F of counts that the model fits closely, against 60-digit arithmetic: each place of 6 is right, whichever way it is summed."""
    mod, mod0 = stats.make_models(None, ["A", "B"] * 3, [[1.0, 1.0, 1.0, 0.0, 0.0, 0.0]])
    counts = [(21, 27, 21, 17, 12, 17), (15, 23, 15, 22, 14, 22), (19, 18, 19, 19, 20, 19)]
    logged = filters.log_transform(segs(spark, [(i + 1, i + 1, c) for i, c in enumerate(counts)]))
    found = [[r["f"] for r in fstats.calculate_stats(logged, mod, mod0, method=m).orderBy("start").collect()] for m in ("expression", "matrix")]
    assert found[0] == found[1] and [round(f, 6) for f in found[0]] == [933844.372361, 30347.189406, 31207.999667]


def test_log2_is_the_nearest_double(spark):
    numbers = [float(v) for v in range(1, 1000)] + [0.3, 0.75, 1 - 1e-10, 1e-300]
    odd = [0.0, -1.0, None, float("inf"), 2.0**-1074, 2.0**1000]
    got = spark.createDataFrame([(numbers, odd)], "a array<double>, b array<double>").select(filters.log2_of("a").alias("a"), filters.log2_of("b").alias("b")).first()
    two = decimal.Decimal(2).ln()
    assert got["a"] == [float(decimal.Decimal(v).ln() / two) for v in numbers]
    assert got["b"] == [None, None, None, float("inf"), -1074.0, 1000.0]


def test_depths_far_from_0_span_the_same_models():
    depths, group = [1.0, 2.0, 1.5, 3.0, 2.5, 3.5], ["A", "B", "A", "B", "B", "A"]
    near, far = (stats.make_models([d + shift for d in depths], group) for shift in (-2.25, 1e5))
    y = np.random.default_rng(0).normal(5, 1, (50, 6))
    assert np.allclose(fstats.f_values(y, *near), fstats.f_values(y, *far), rtol=1e-6)


def test_cutoffs(spark):
    f = segs(spark, [(1, 10, [1.0]), (11, 20, [2.0])]).selectExpr("*", "y[0] AS f")
    assert fstats.fstat_cutoff(f, "empirical", 0.5) == 1.5 and fstats.fstat_cutoff(f, "manual", 1) == 1.0
    assert abs(stats.f_quantile(0.05, 1, 27) - 4.210008) < 1e-5 and abs(stats.f_upper(4.210008, 1, 27) - 0.05) < 1e-6


def test_filters(spark):
    base = segs(spark, [(1, 3, [0, 0]), (4, 9, [1, 5]), (10, 12, [6, 6])])
    assert filters.filter_data(base, 2, -1).count() == 3 and filters.filter_data(base, 2, 5).count() == 1
    assert filters.filter_data(base, 2, 3, "mean").count() == 1
    assert filters.filter_data(filters.filter_data(base, 2, 4), 2, 4).count() == filters.filter_data(base, 2, 4).count()
    with pytest.raises(ValueError):
        filters.filter_data(base, 2, 1, "median")


def test_depth(spark):
    c = spark.createDataFrame([("s", 1.0, 10), ("s", 2.0, 5), ("s", 0.0, 99)], "sample string, value double, weight long")
    rows = {r["prob"]: r["depth"] for r in depth.sample_depth(c, [0.5, 1.0]).collect()}
    assert abs(rows[1.0] - np.log2(20 + 32)) < 1e-12 and abs(rows[0.5] - np.log2(10 + 32)) < 1e-12
    assert abs(depth.sample_depth(c, [1.0], center=True).first()["depth"]) < 1e-12


def test_larger_cluster_gap_gives_fewer_clusters(spark):
    rows = signal(spark, [(1 + 50 * i + i * i, 10 + 50 * i + i * i, 5.0) for i in range(30)])
    n = [regions.find_regions(rows, "mean_cov", 1.0, max_cluster_gap=g).select("cluster").distinct().count() for g in (10, 60, 90, 10_000)]
    assert n == sorted(n, reverse=True) and n[-1] == 1
    with pytest.warns(UserWarning):
        regions.find_regions(rows, "mean_cov", 1.0, max_region_gap=5, max_cluster_gap=1)


def test_overlaps_against_brute_force(spark):
    rng = np.random.default_rng(8)
    make = lambda n: [("c", int(s), int(s + w)) for s, w in zip(rng.integers(1, 3000, n), rng.integers(0, 300, n), strict=True)]
    a, b = make(80), make(90)
    frames = [spark.createDataFrame(x, "chr string, start long, end long") for x in (a, b)]
    want = sorted((x, y) for x in a for y in b if min(x[2], y[2]) - max(x[1], y[1]) + 1 >= 5)
    got = sorted((tuple(r["a"]), tuple(r["b"])) for r in intervals.overlaps(*frames, min_overlap=5, bin=128).collect())
    assert got == want
    within = intervals.overlaps(*frames, type="within", bin=128).count()
    assert within == sum(y[1] <= x[1] and x[2] <= y[2] for x in a for y in b)


def test_matrix_checks(spark):
    base = segs(spark, [(1, 10, [5, 7]), (11, 20, [6, 6])])
    row = matrix.region_matrix(base, ["a", "b"], 5.0, [10, 5]).first()
    assert row["counts"] == [11.0, 26.0]
    with pytest.raises(ValueError):
        matrix.region_matrix(base, ["a", "b"], 5.0, [1, 2, 3])


def test_names():
    assert names.map_name("2") == "chr2" and names.map_name("2", "ucsc") == "chr2" and names.map_name("MT") == "chrM"
    assert names.map_name("2", None) == "2" and names.map_name("2", "UCSC", "felis_catus") == "2" and names.map_name("19", "UCSC", "mus_musculus") == "chr19" and names.map_name("2L", "UCSC", "drosophila_melanogaster") == "chr2L" and names.map_name("2", "else") == "2"
    assert names.map_name("chr77", "NCBI", current="UCSC") is None


def test_smoothing_keeps_short_clusters(spark):
    y = np.array([1.0, 5.0, 2.0])
    assert np.isnan(smoothing.local_quadratic(y, np.arange(3.0))).all()
    x = np.arange(50.0)
    assert np.allclose(smoothing.local_quadratic(x * x, x), x * x, atol=1e-6)


def test_files(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s2").mkdir()
    found = files.raw_files(spark, str(tmp_path), samplepatt="^s")
    assert found["s1"].endswith("s1/accepted_hits.bam") and len(found) == 2
    with pytest.raises(ValueError):
        files.raw_files(spark)
    assert files.input_type(["a.BW", "b.bigwig"]) == "bigwig" and files.input_type(["a.bam"]) == "bam"
    runs = spark.createDataFrame([("c", "s1", 1, 5, 2.0), ("c", "s2", 3, 4, 1.0)], files.RUNS)
    files.write_runs(runs, str(tmp_path / "runs"))
    assert files.read_runs(spark, str(tmp_path / "runs"), ["c"]).count() == 2
    files.write_bedgraph(runs, str(tmp_path / "bg"))
    back = files.read_bedgraph(spark, {"s1": str(tmp_path / "bg" / "sample=s1"), "s2": str(tmp_path / "bg" / "sample=s2")})
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, runs.collect()))


def test_total_mapped_counts_reads_once(spark):
    blocks = spark.createDataFrame([("c", "s", 1, 5, 1), ("c", "s", 20, 25, 1), ("c", "s", 3, 9, 2), ("d", "t", 1, 2, 1)], "chr string, sample string, start long, end long, read long")
    assert {r["sample"]: r["total_mapped"] for r in coverage.total_mapped(blocks).collect()} == {"s": 2, "t": 1}
    assert {r["sample"]: r["total_mapped"] for r in coverage.total_mapped(blocks.drop("read"), ["c"]).collect()} == {"s": 3}


def test_bedgraph_headers_and_names_with_t(spark, tmp_path):
    (tmp_path / "a.bedGraph").write_text("browser position c:1-9\ntrack type=bedGraph\n# note\ntig1\t0\t5\t2.5\nc 5 6 0\nc 6 9 1\n")
    got = files.read_bedgraph(spark, {"s": str(tmp_path / "a.bedGraph")}).collect()
    assert sorted(map(tuple, got)) == [("c", "s", 7, 9, 1.0), ("tig1", "s", 1, 5, 2.5)]


def test_regions_are_cut_at_edges_and_not_at_tiles(spark):
    tile = coverage.TILE
    base = signal(spark, [(tile - 9, tile, 2.0), (tile + 1, tile + 10, 3.0)])
    edges = lambda rows: spark.createDataFrame(rows, "chr string, start long, end long")
    find = lambda within: sorted((r["start"], r["end"], r["index_start"]) for r in regions.find_regions(base, "mean_cov", 1.0, within=within, directions=("up",)).collect())
    assert find(edges([("c", tile - 4, tile - 2)])) == [(tile - 9, tile - 5, 1), (tile - 4, tile - 2, 6), (tile - 1, tile + 10, 9)]
    assert find(edges([("c", tile + 1, tile + 99)])) == [(tile - 9, tile, 1), (tile + 1, tile + 10, 11)]
    assert find(edges([("d", 1, 5)])) == [(tile - 9, tile + 10, 1)]


def test_smoothing_against_plain_regression(spark):
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 400, 180)).astype(float)
    y, w = rng.normal(size=len(x)), rng.uniform(0.5, 2, len(x))
    got = smoothing.local_quadratic(y, x, w, span=30.0)
    for i in range(len(x)):
        d = np.abs(x - x[i])
        h = max(30.0, np.sort(d)[6] + 1e-9)
        near = d < h
        root = np.sqrt(w[near] * (1 - (d[near] / h) ** 3) ** 3)
        u = (x[near] - x[i]) / h
        want = np.linalg.lstsq(np.stack([np.ones(len(u)), u, u * u], axis=1) * root[:, None], y[near] * root, rcond=None)[0][0]
        assert abs(got[i] - want) < 1e-6
    assert np.allclose(smoothing.running_mean(np.arange(5.0), np.arange(5.0), None, 3), [0.5, 1, 2, 3, 3.5])
    # Clusters don't depend on tiles.
    rows = signal(spark, [(1 + 700 * i, 300 + 700 * i, 1.0) for i in range(12)] + [(20_000, 20_010, 1.0)])
    for gap, n in ((399, 13), (400, 2)):
        assert smoothing.clusters(rows, "mean_cov", gap).select("cluster").distinct().count() == n


def test_spline_weights_keep_lines():
    x = np.array(significance.LAMBDAS)
    w = significance.last_smoothed(x)
    assert abs(w.sum() - 1) < 1e-9 and abs(w @ x - x[-1]) < 1e-9 and w[-1] > w[0]


def test_cutoff_slip_warns(spark):
    f = segs(spark, [(1, 10, [1.0]), (11, 20, [2.0])]).selectExpr("*", "y[0] AS f")
    with pytest.warns(UserWarning):
        assert fstats.fstat_cutoff(f, "empirical", 1e-8) == 2.0


def test_empty_tables(spark):
    none = signal(spark, [(1, 5, 1.0)]).where("start > 9")
    assert regions.find_regions(none, "mean_cov", 1.0).count() == 0 and regions.find_regions(none, "mean_cov", 1.0, smooth=smoothing.running_mean).count() == 0
    assert regions.find_regions(signal(spark, [(1, 5, 1.0)]), "mean_cov", 2.0).count() == 0


def test_sweeps_against_brute_force(spark):
    r = random.Random(8)
    rows = []
    for i in range(120):
        a = r.randint(1, 4000)
        rows.append((i, r.choice(["c", "d"]), a, a + r.choice([0, 3, 40, 900]), r.choice("+-"), r.choice(["intron", "exon"])))
    table = spark.createDataFrame(rows, "id long, chr string, start long, end long, strand string, kind string")
    covered = {c: collections.Counter(p for _, k, a, b, *_ in rows if k == c for p in range(a, b + 1)) for c in "cd"}
    lengths = spark.createDataFrame([("c", 5500), ("d", 5500), ("e", 7)], "chr string, length long")
    asked = spark.createDataFrame([(i, r.choice(["c", "d"]), a, a + 5) for i, a in enumerate(range(1, 5000, 70))], "region_id long, chr string, start long, end long")
    few = table.where("id % 12 = 0").withColumnRenamed("id", "tx_id")
    sort = lambda d: sorted(map(tuple, d.collect()))
    whole = {
        "reduced": sort(intervals.reduce_intervals(table, min_gap=3, members="id")),
        "pieces": sort(intervals.disjoin(table)),
        "gaps": sort(intervals.gaps(table, lengths)),
        "states": sort(annotation.state_tiling(table, annotation.FULL)),
        "nearest": sort(intervals.nearest(asked, few)),
        "numbers": sort(matrix.numbered(few.select("chr", "start", "end"))),
    }
    assert {(c, p): n for c, a, b, n in whole["pieces"] for p in range(a, b + 1)} == {(c, p): n for c in "cd" for p, n in covered[c].items()}
    assert {(c, p) for c, a, b in whole["gaps"] for p in range(a, b + 1)} == {(c, p) for c, n in (("c", 5500), ("d", 5500), ("e", 7)) for p in range(1, n + 1) if not covered.get(c, {}).get(p)}
    state = {(c, s, p): k for c, s, a, b, k in whole["states"] for p in range(a, b + 1)}
    best = {}
    for _, c, a, b, s, k in rows:
        for p in range(a, b + 1):
            best[c, s, p] = max(k, best.get((c, s, p), ""), key=("", *annotation.FULL).index)
    assert state == best
    for x, y in zip(whole["states"], whole["states"][1:]):
        assert x[:2] != y[:2] or x[3] + 1 < y[2] or x[4] != y[4]
    kept = [(x["tx_id"], x["chr"], x["start"], x["end"]) for x in few.collect()]
    for i, c, a, b in sort(asked):
        near = min(((max(0, s - b, a - e), t) for t, k, s, e in kept if k == c))
        assert (i, near[1], near[0]) in whole["nearest"]
    assert all(x[1] - y[2] > 3 for y, x in zip(whole["reduced"], whole["reduced"][1:]) if x[0] == y[0])
    assert [x[:3] for x in sorted(whole["numbers"], key=lambda x: (x[0], x[3]))] == sorted(k[1:] for k in kept)
