"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Every row has a 36-bit hash of its id and text. For each source the tokens are summed by the leading hash bits, the bucket
in which the running sum passes the source's budget is found, and only that bucket is summed again by its next bits,
until the threshold is exact. A document is then taken when its hash lies below its source's threshold: no sort, no
row-level join, and the same choice on every run. What the first document that doesn't fit leaves of the budget is filled
by further thresholds (``ROUNDS`` in all) over the documents beyond that are no larger than what is left, so that a source
ends within a small document of its target, as far as it has small documents.

Rows that repeat an id and text are told apart by their rank among themselves, which is part of their hash. Ranks are dealt
by input partition, so that a row that is repeated very often doesn't meet in one task; such rows are alike, so it makes no
difference to the mix which has which rank.

Defined cases: documents of equal hash are taken or left together; null text has size 0; null source is a source of its own, ordered last; a null doc_id hashes as the
empty string; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, free_name

#: Hash bits told apart by one histogram, and how many histograms are nested.
BITS, LEVELS = 12, 3
#: Thresholds of each source.
ROUNDS = 3
#: Up to so many sources the table of thresholds is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def identity(docs: DataFrame) -> Column:
    """Id and text of a row in one string."""
    return F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(" "), F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))


def hash36(key: Column, rank: Column) -> Column:
    """The first 36 bits of the MD5 of a row's identity and rank."""
    digest = F.md5(F.concat(key, F.lit(" "), rank.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 9), 16, 10).cast("long")


def hashed(rows: DataFrame, key: str, h: str) -> DataFrame:
    """``rows`` with the hash ``h`` in place of the identity ``key``, rows of equal identity being ranked."""
    rows = durable(rows)
    repeated = rows.groupBy(key).agg(F.count("*").alias(h)).where(F.col(h) > 1).select(key)
    if repeated.isEmpty():
        return rows.withColumn(h, hash36(F.col(key), F.lit(0))).drop(key)
    part, before, rank = (free_name(rows, f"{key}_{x}") for x in ("part", "before", "rank"))
    repeated = durable(repeated)
    several = durable(rows.join(repeated, key, "left_semi").withColumn(part, F.spark_partition_id()))
    order = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = several.groupBy(key, part).agg(F.count("*").alias(rank)).select(key, part, F.coalesce(F.sum(rank).over(order), F.lit(0)).alias(before))
    ranked = several.join(counts, [key, part]).withColumn(rank, F.col(before) + F.row_number().over(Window.partitionBy(key, part).orderBy(F.lit(0))) - 1)
    one = rows.join(repeated, key, "left_anti").withColumn(rank, F.lit(0).cast("long"))
    both = one.unionByName(ranked.drop(part, before))
    return both.withColumn(h, hash36(F.col(key), F.col(rank))).drop(key, rank)


def source_targets(sizes: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat over the sources in code-point order.

    A source's target stops at ``cap`` times its size; what it can't use is shared by weight among the rest. That is a
    common level: target = min(cap * size, level * weight).
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_full = Window.orderBy("full_at", F.col("n"))
    before = by_full.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("n", F.row_number().over(order))
        .withColumn("w", w)
        .withColumn("full", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("full_at", F.col("full") / F.col("w"))
        .withColumn("left", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.when(F.col("full_at") > F.col("left") / F.col("w_left"), F.col("left") / F.col("w_left")))
        .withColumn("level", F.first("level", ignorenulls=True).over(by_full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("source", "source_size", F.least("full", F.coalesce(F.col("level") * F.col("w"), F.col("full"))).alias("target"))
    )


def _by_source(left: DataFrame, right: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    right = right.withColumnRenamed("source", "_source")
    right = F.broadcast(right) if small else right
    return left.join(right, left["source"].eqNullSafe(right["_source"]), how).drop("_source")


def thresholds(sized: DataFrame, **how) -> tuple[DataFrame, bool]:
    """(source, source_size, target, base, limits) for (source, size, h), and whether it is small enough to broadcast.

    Each document is taken ``base`` times, and once more when in one of the ``limits`` its size is at most ``most`` and its
    hash below ``threshold``. A threshold is the hash of the first document whose running size passes what is left.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("long")
    limit = "array<struct<most:double,threshold:bigint>>"
    state = durable(
        source_targets(sizes, **how)
        .withColumn("base", base)
        .withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
        .withColumn("start", F.lit(0).cast("long"))
        .withColumn("most", F.lit(float("inf")))
        .withColumn("limits", F.array().cast(limit))
    )
    small = state.count() <= BROADCAST_SOURCES
    for _ in range(ROUNDS):
        state = _threshold(sized, state.withColumn("lo", F.lit(0).cast("long")).withColumn("open", F.lit(True)), small)
        found = F.array(F.struct(F.col("most"), F.col("lo").alias("threshold"))).cast(limit)
        state = state.select("source", "source_size", "target", "base", "budget", F.col("lo").alias("start"), F.col("budget").alias("most"), F.concat("limits", found).alias("limits"))
    return state.select("source", "source_size", "target", "base", "limits"), small


def _threshold(sized: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """``state`` with the threshold as ``lo``, and what is left of the budget below it."""
    columns = state.columns
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        limits = state.where("open").select("source", "budget", "lo", "start", "most")
        inside = _by_source(sized, limits, small).where((F.col("h") >= F.col("start")) & (F.col("size") <= F.col("most")))
        if level:
            inside = inside.where(F.shiftright("h", shift + BITS) == F.shiftright("lo", shift + BITS))
        histogram = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("tokens"), F.first("budget").alias("budget"))
        running = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
        summed = histogram.withColumn("upto", running).withColumn("over", F.col("upto") > F.col("budget"))
        edge = summed.groupBy("source").agg(F.min(F.when(F.col("over"), F.col("bucket"))).alias("edge"), F.max(F.when(~F.col("over"), F.col("upto"))).alias("below"))
        # Without an edge every bucket of the source fits, and the threshold lies above all hashes.
        now = {
            "budget": F.col("budget") - F.coalesce("below", F.lit(0)),
            "lo": F.coalesce(F.shiftleft("edge", shift), F.when(F.col("open"), F.lit(1 << (BITS * LEVELS))).otherwise(F.col("lo"))),
            "open": F.col("open") & F.col("edge").isNotNull(),
        }
        state = durable(_by_source(state, edge, small, "left").select(*[now[c].alias(c) if c in now else F.col(c) for c in columns]))
    return state


def copies(size: Column, h: Column, base: Column, limits: Column) -> Column:
    return base + F.exists(limits, lambda x: (size <= x["most"]) & (h < x["threshold"])).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    return hashed(docs.select("doc_id", "source", word_count(docs["text"]).alias("size"), identity(docs).alias("key")), "key", "h")


def mix(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``; ``how`` as for ``source_targets``."""
    sized = _sized(docs)
    limits, small = thresholds(sized, **how)
    taken = F.col("size") * copies(F.col("size"), F.col("h"), F.col("base"), F.col("limits"))
    return _by_source(sized, limits, small).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    names = docs.columns
    key, h, size, limit = (free_name(docs, f"mix_{x}") for x in ("key", "h", "size", "limit"))
    rows = hashed(docs.withColumn(size, word_count(docs["text"])).withColumn(key, identity(docs)), key, h)
    limits, small = thresholds(rows.select("source", F.col(size).alias("size"), F.col(h).alias("h")), **how)
    limits = limits.select(F.col("source").alias(key), F.struct("base", "limits").alias(limit))
    limits = F.broadcast(limits) if small else limits
    joined = rows.join(limits, rows["source"].eqNullSafe(limits[key]))
    n = copies(F.col(size), F.col(h), F.col(limit)["base"], F.col(limit)["limits"])
    return joined.select(*[F.col(f"`{c}`") for c in names], F.explode(F.array_repeat(F.lit(0), n.cast("int"))).alias(size)).select(*[F.col(f"`{c}`") for c in names])


ORACLE = """
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '') || ' ' || md5(COALESCE(text, '')) || ' ' || (row_number() OVER (PARTITION BY doc_id, COALESCE(text, '')) - 1)::VARCHAR), 1, 9))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS f FROM n),
c AS (SELECT *, f / w AS full_at,
        1.5::DOUBLE * sum(source_size) OVER () - COALESCE(sum(f) OVER (ORDER BY f / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
        sum(w) OVER () - COALESCE(sum(w) OVER (ORDER BY f / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left FROM w),
l AS (SELECT arg_min(room / w_left, full_at) AS level FROM c WHERE full_at > room / w_left),
t AS (SELECT source, source_size, least(f, COALESCE(level * w, f)) AS target FROM c LEFT JOIN l ON true),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 1 END AS base FROM t),
r0 AS (SELECT doc_id, d.source, size, source_size, target, base, h, target - base * source_size AS room FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
r1 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= room AS t1 FROM r0),
q1 AS (SELECT *, room - COALESCE(sum(size) FILTER (t1) OVER (PARTITION BY source), 0) AS room1 FROM r1),
r2 AS (SELECT *, NOT t1 AND size <= room1 AND sum(CASE WHEN NOT t1 AND size <= room1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= room1 AS t2 FROM q1),
q2 AS (SELECT *, room1 - COALESCE(sum(size) FILTER (t2) OVER (PARTITION BY source), 0) AS room2 FROM r2),
r3 AS (SELECT *, NOT t1 AND NOT t2 AND size <= room2 AND sum(CASE WHEN NOT t1 AND NOT t2 AND size <= room2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= room2 AS t3 FROM q2)
SELECT doc_id, size, source_size, target, (size * (base + CASE WHEN t1 OR t2 OR t3 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r3
"""
