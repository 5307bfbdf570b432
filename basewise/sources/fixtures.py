"""Genomic tables derived from a TPC-H-like star schema, so that every operator has data at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = [f"s{i}" for i in range(6)]
GROUPS = ["A" if i % 2 == 0 else "B" for i in range(6)]
ADJUST = [float(i < 3) for i in range(6)]
#: Fixed row orders of the models.
PERMUTATIONS = [[1, 0, 3, 2, 5, 4], [2, 4, 1, 5, 0, 3], [5, 3, 4, 1, 2, 0]]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    return _table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("chr"), "l_linenumber").alias("chr"), F.concat(F.lit("s"), F.col("l_suppkey") % 6).alias("sample"), (part + 1).alias("start"), (part + F.col("l_quantity").cast("long")).alias("end")
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    strand = F.when(F.col("p_size") % 2 == 0, "+").otherwise("-")
    return _table(spark, sf_dir, "part").select(
        key.alias("tx_id"), F.col("p_name").alias("tx_name"), F.col("p_brand").alias("gene_id"), F.concat(F.lit("chr"), key % 7 + 1).alias("chr"), (key + 1).alias("start"), (key + F.col("p_size")).alias("end"), strand.alias("strand")
    )


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last third of each transcript, or the whole of one under 3 positions."""
    t = transcripts(spark, sf_dir).withColumn("n", F.col("end") - F.col("start") + 1).withColumn("k", F.floor(F.col("n") / 3))
    one = F.array(F.struct(F.lit(1).alias("rank"), F.col("start").alias("start"), F.col("end").alias("end")))
    two = F.array(F.struct(F.lit(1).alias("rank"), F.col("start").alias("start"), (F.col("start") + F.col("k") - 1).alias("end")), F.struct(F.lit(2).alias("rank"), (F.col("end") - F.col("k") + 1).alias("start"), F.col("end").alias("end")))
    return t.withColumn("e", F.explode(F.when(F.col("n") < 3, one).otherwise(two))).select("tx_id", "e.rank", "chr", "e.start", "e.end", "strand")


def cds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coding spans: transcripts of 8 positions and more, without the outer two on each side."""
    return transcripts(spark, sf_dir).where("end - start + 1 >= 8").select("tx_id", (F.col("start") + 2).alias("cds_start"), (F.col("end") - 2).alias("cds_end"))


def chrom_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = reads(spark, sf_dir).select("chr", "end").unionByName(transcripts(spark, sf_dir).select("chr", "end"))
    return both.groupBy("chr").agg(F.max("end").alias("length"))
