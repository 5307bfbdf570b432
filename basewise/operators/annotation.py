"""Genomic states of a transcript annotation, and regions annotated with them.

A state tiling is a sweep: each kind of feature adds and takes away one where it starts and ends, so that a running sum
per kind tells which kinds cover a stretch. The strongest kind present is the stretch's state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import gaps, nearest, overlaps, promoters

#: Kinds of the two tilings, the strongest last.
FULL = ("intron", "exon")
CODING = ("intron", "promoter", "exon", "fiveUTR", "threeUTR")


def introns(exons: DataFrame) -> DataFrame:
    """What lies between the exons of each transcript."""
    order = Window.partitionBy("tx_id").orderBy("start")
    out = exons.select("tx_id", "chr", "strand", (F.lag("end").over(order) + 1).alias("_from"), (F.col("start") - 1).alias("end"))
    return out.where("_from <= end").select("tx_id", "chr", "strand", F.col("_from").alias("start"), "end")


def untranslated(exons: DataFrame, cds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """5' and 3' parts of exons outside of the coding span (tx_id, cds_start, cds_end)."""
    both = exons.join(cds, "tx_id")
    left = both.where("start < cds_start").select("tx_id", "chr", "strand", "start", F.least("end", F.col("cds_start") - 1).alias("end"))
    right = both.where("end > cds_end").select("tx_id", "chr", "strand", F.greatest("start", F.col("cds_end") + 1).alias("start"), "end")
    ahead = F.col("strand") != "-"
    return left.where(ahead).unionByName(right.where(~ahead)), right.where(ahead).unionByName(left.where(~ahead))


def state_tiling(features: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(chr, strand, start, end, state) from (kind, chr, strand, start, end): later kinds win, equal neighbours merged."""
    edge = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("d"))))
    events = features.select("kind", "chr", "strand", edge.alias("e")).groupBy("chr", "strand", F.col("e.pos").alias("pos"))
    at = events.agg(*[F.sum(F.when(F.col("kind") == k, F.col("e.d")).otherwise(0)).alias(f"_{k}") for k in kinds])
    order = Window.partitionBy("chr", "strand").orderBy("pos")
    state = F.coalesce(*[F.when(F.sum(f"_{k}").over(order) > 0, F.lit(k)) for k in reversed(kinds)])
    pieces = at.select("chr", "strand", F.col("pos").alias("start"), (F.lead("pos").over(order) - 1).alias("end"), state.alias("state")).where("state IS NOT NULL")
    inside = Window.partitionBy("chr", "strand").orderBy("start")
    new = F.coalesce((F.lag("state").over(inside) != F.col("state")) | (F.lag("end").over(inside) + 1 != F.col("start")), F.lit(True))
    runs = pieces.withColumn("_new", new.cast("long")).withColumn("_run", F.sum("_new").over(inside))
    return runs.groupBy("chr", "strand", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("state").alias("state")).drop("_run")


def genomic_state(transcripts: DataFrame, exons: DataFrame, lengths: DataFrame, kind: str = "full", cds: DataFrame | None = None, upstream: int = 2000, downstream: int = 200) -> DataFrame:
    """(chr, start, end, strand, state): tiling of ``kind`` "full" or "coding", with what no feature covers on either strand."""
    of = lambda rows, k: rows.select(F.lit(k).alias("kind"), "chr", "strand", "start", "end")
    features = of(introns(exons), "intron").unionByName(of(exons, "exon"))
    if kind == "coding":
        features = features.unionByName(of(promoters(transcripts, upstream, downstream), "promoter"))
        if cds is not None:
            five, three = untranslated(exons, cds)
            features = features.unionByName(of(five, "fiveUTR")).unionByName(of(three, "threeUTR"))
    elif kind != "full":
        raise ValueError("kind must be 'full' or 'coding'")
    states = state_tiling(features, CODING if kind == "coding" else FULL)
    between = gaps(states, lengths).select("chr", "start", "end", F.lit("*").alias("strand"), F.lit("intergenic").alias("state"))
    return states.select("chr", "start", "end", "strand", "state").unionByName(between)


def with_transcripts(states: DataFrame, transcripts: DataFrame) -> DataFrame:
    """States with sorted lists of the transcripts, their names and genes on the strand; empty for intergenic."""
    pairs = overlaps(states.where("state <> 'intergenic'"), transcripts, ignore_strand=False)
    lists = pairs.groupBy("a.chr", "a.start", "a.end", "a.strand", "a.state").agg(*[F.array_sort(F.collect_set(f"b.{s}")).alias(n) for s, n in (("tx_id", "tx_id"), ("tx_name", "tx_name"), ("gene_id", "gene"))])
    out = states.join(lists, ["chr", "start", "end", "strand", "state"], "left")
    for n, t in (("tx_id", "array<long>"), ("tx_name", "array<string>"), ("gene", "array<string>")):
        out = out.withColumn(n, F.coalesce(n, F.array().cast(t)))
    return out


def annotate_hits(regions: DataFrame, states: DataFrame, min_overlap: int = 1, ignore_strand: bool = True) -> DataFrame:
    """(region_id, chr, start, end, state, state_start, state_end, strand): a row per region and overlapping state."""
    pairs = overlaps(regions, states, min_overlap, ignore_strand=ignore_strand)
    return pairs.select("a.region_id", "a.chr", "a.start", "a.end", "b.state", F.col("b.start").alias("state_start"), F.col("b.end").alias("state_end"), "b.strand")


def annotate_counts(regions: DataFrame, states: DataFrame, names: Sequence[str], min_overlap: int = 1, ignore_strand: bool = True) -> DataFrame:
    """(region_id, chr, one column per state): how many intervals of each state overlap the region, zeros included."""
    hits = annotate_hits(regions, states, min_overlap, ignore_strand)
    counts = hits.groupBy("region_id", "chr").agg(*[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in names])
    return regions.select("region_id", "chr").join(counts, ["region_id", "chr"], "left").fillna(0, list(names))


def nearest_genes(regions: DataFrame, transcripts: DataFrame, id: str = "region_id") -> DataFrame:
    """(id, tx_id, gene_id, distance, description) of the nearest transcript of each region on its chromosome.

    ``description``, along the transcript's strand: the region is "inside" it, "covers" it, "overlaps 5 prime" or "overlaps
    3 prime", or lies "upstream" or "downstream".
    """
    found = nearest(regions, transcripts, id).alias("n")
    t, r = transcripts.alias("t"), regions.alias("r")
    both = found.join(t, F.col("n.tx_id") == F.col("t.tx_id")).join(r, F.col(f"n.{id}") == F.col(f"r.{id}"))
    ahead = F.col("t.strand") != "-"
    a, b, ra, rb = (F.col(c) for c in ("t.start", "t.end", "r.start", "r.end"))
    apart = F.when((rb < a) == ahead, "upstream").otherwise("downstream")
    partly = F.when((ra < a) == ahead, "overlaps 5 prime").otherwise("overlaps 3 prime")
    description = F.when(F.col("distance") > 0, apart).when((a <= ra) & (rb <= b), "inside").when((ra <= a) & (b <= rb), "covers").otherwise(partly)
    return both.select(F.col(f"n.{id}").alias(id), "t.tx_id", "t.gene_id", "distance", description.alias("description"))
