"""Interval algebra and overlap joins on (chr, start, end[, strand]) tables, 1-based and inclusive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions per bin of the overlap join.
BIN = 1 << 10


def reduce_intervals(rows: DataFrame, keys: Sequence[str] = ("chr",), min_gap: int = 1, members: str | None = None) -> DataFrame:
    """Merged intervals; those fewer than ``min_gap`` positions apart are one. ``members``: a column to collect, sorted."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") - reach - 1 >= min_gap, F.lit(True)).cast("long")
    out = rows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order)).groupBy(*keys, "_island")
    more = [F.array_sort(F.collect_set(members)).alias(members)] if members else []
    return out.agg(F.min("start").alias("start"), F.max("end").alias("end"), *more).drop("_island")


def disjoin(rows: DataFrame, keys: Sequence[str] = ("chr",)) -> DataFrame:
    """The covered pieces between all starts and ends, with the number of intervals that cover each."""
    edges = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("d"))))
    ends = rows.select(*keys, edges.alias("e")).groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))
    order = Window.partitionBy(*keys).orderBy("pos")
    out = ends.select(*keys, F.col("pos").alias("start"), (F.lead("pos").over(order) - 1).alias("end"), F.sum("d").over(order).alias("n"))
    return out.where("n > 0")


def gaps(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """What the intervals leave of each chromosome of ``lengths`` (chr, length); one without intervals is all gap."""
    beyond = lengths.select("chr", (F.col("length") + 1).alias("start"), (F.col("length") + 1).alias("end"))
    merged = reduce_intervals(rows).unionByName(beyond)
    order = Window.partitionBy("chr").orderBy("start", "end")
    left = F.coalesce(F.lag("end").over(order), F.lit(0)) + 1
    return merged.select("chr", left.alias("_from"), (F.col("start") - 1).alias("end")).where("_from <= end").select("chr", F.col("_from").alias("start"), "end")


def resize(rows: DataFrame, width: int, fix: str = "center") -> DataFrame:
    """Intervals of ``width`` positions about the centre, or from the start or end."""
    old = F.col("end") - F.col("start") + 1
    start = {"start": F.col("start"), "end": F.col("end") - width + 1, "center": F.col("start") + F.floor((old - width) / 2).cast("long")}[fix]
    return rows.withColumn("start", start).withColumn("end", F.col("start") + width - 1)


def promoters(rows: DataFrame, upstream: int = 2000, downstream: int = 200) -> DataFrame:
    """Around the first position on the strand."""
    back = F.col("strand") == "-"
    start = F.when(back, F.col("end") - downstream + 1).otherwise(F.col("start") - upstream)
    end = F.when(back, F.col("end") + upstream).otherwise(F.col("start") + downstream - 1)
    return rows.select(*[c for c in rows.columns if c not in ("start", "end")], F.greatest(start, F.lit(1)).cast("long").alias("start"), end.cast("long").alias("end"))


def tile_genome(lengths: DataFrame, width: int) -> DataFrame:
    out = lengths.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / width).cast("long"))))
    return out.select("chr", (F.col("_k") * width + 1).alias("start"), F.least((F.col("_k") + 1) * width, "length").alias("end"))


def overlap_condition(a: str, b: str, min_overlap: int = 1, type: str = "any") -> Column:
    s1, e1, s2, e2 = (F.col(f"{x}.{c}") for x in (a, b) for c in ("start", "end"))
    if type == "within":
        return (s2 <= s1) & (e1 <= e2)
    return F.least(e1, e2) - F.greatest(s1, s2) + 1 >= min_overlap


def overlaps(left: DataFrame, right: DataFrame, min_overlap: int = 1, type: str = "any", ignore_strand: bool = True, bin: int = BIN) -> DataFrame:
    """Pairs of overlapping rows as structs ``a`` and ``b``.

    Both sides are put in the bins that they touch and joined on chromosome and bin; a pair is kept in the first bin that
    both are in. The plan is a hash or sort-merge join, whatever the sizes, never a nested loop.
    """

    def binned(rows: DataFrame, name: str) -> DataFrame:
        lo, hi = (F.floor((F.col(c) - 1) / F.lit(bin)).cast("long") for c in ("start", "end"))
        return rows.select(F.col("chr").alias("_chr"), F.struct("*").alias(name), lo.alias(f"_{name}"), F.explode(F.sequence(lo, hi)).alias("_bin"))

    one, two = binned(left, "a"), binned(right, "b").withColumnRenamed("_chr", "_chr2").withColumnRenamed("_bin", "_bin2")
    on = (F.col("_chr") == F.col("_chr2")) & (F.col("_bin") == F.col("_bin2")) & (F.col("_bin") == F.greatest("_a", "_b")) & overlap_condition("a", "b", min_overlap, type)
    if not ignore_strand:
        on &= (F.col("a.strand") == F.col("b.strand")) | (F.col("a.strand") == "*") | (F.col("b.strand") == "*")
    pairs = one.join(two, on)
    return pairs.select("a", "b")


def overlap_width() -> Column:
    return F.least("a.end", "b.end") - F.greatest("a.start", "b.start") + 1


def nearest(regions: DataFrame, features: DataFrame, id: str = "region_id", name: str = "tx_id") -> DataFrame:
    """(id, name, distance) of the nearest feature on the chromosome: 0 if it overlaps; ties to the smallest name.

    The nearest feature is one that overlaps, or that with the last end before, or that with the first start after: an
    overlap join and two ordered windows, no pair of everything.
    """
    hit = overlaps(regions, features).groupBy(F.col(f"a.{id}").alias(id)).agg(F.min(f"b.{name}").alias(name)).withColumn("distance", F.lit(0).cast("long"))
    asked = regions.select("chr", "start", "end", F.col(id).alias("_id"))

    def side(before: bool) -> DataFrame:
        at = "end" if before else "start"
        own = features.groupBy("chr", F.col(at).alias("pos")).agg(F.min(name).alias(name)).select("chr", "pos", F.lit(0).alias("kind"), F.struct("pos", name).alias("f"), F.lit(None).cast(asked.schema["_id"].dataType).alias("_id"))
        q = asked.select("chr", F.col("start" if before else "end").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast(own.schema["f"].dataType).alias("f"), "_id")
        # Features at the region's own edge overlap it and come after it in this order.
        order = Window.partitionBy("chr").orderBy(F.col("pos") if before else F.desc("pos"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
        found = own.unionByName(q).withColumn("f", F.last("f", ignorenulls=True).over(order)).where("kind = 1 AND f IS NOT NULL")
        return found.select(F.col("_id").alias(id), F.col(f"f.{name}").alias(name), F.abs(F.col("pos") - F.col("f.pos")).alias("distance"))

    every = hit.unionByName(side(True)).unionByName(side(False))
    return every.groupBy(id).agg(F.min(F.struct("distance", name)).alias("m")).select(id, f"m.{name}", "m.distance")
