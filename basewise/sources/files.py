"""Finding sample files, and reading and writing run tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "chr string, sample string, start long, end long, score double"


#: Lines of bedGraph text that hold no data.
HEADER = r"^(track|browser)\s|^#|^\s*$"


def _listing(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(x.getPath().getName() for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))


def raw_files(spark: SparkSession, datadir: str | None = None, sampledirs: Sequence[str] | None = None, samplepatt: str | None = None, fileterm: str | None = "accepted_hits.bam") -> dict[str, str]:
    """Sample name to path: from named folders, or from those of ``datadir`` that match a pattern; the former win."""
    if sampledirs is None and samplepatt is None:
        raise ValueError("give sampledirs or samplepatt")
    names = list(sampledirs) if sampledirs is not None else [x for x in _listing(spark, datadir or ".") if re.search(samplepatt, x)]
    join = lambda *parts: "/".join(p.rstrip("/") for p in parts if p)
    return {PurePosixPath(n).name: join(datadir or "", n, fileterm or "") if fileterm else join(datadir or "", n) for n in names}


def input_type(paths: Sequence[str]) -> str:
    """"bigwig" if all names end in bw or bigwig, else "bam"."""
    return "bigwig" if paths and all(re.search(r"(bw|bigwig)$", p.lower()) for p in paths) else "bam"


def read_runs(spark: SparkSession, path: str, chrs: Sequence[str] | None = None) -> DataFrame:
    """A run table written by ``write_runs``; chromosomes prune partitions."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("chr").isin(list(chrs))) if chrs else rows


def write_runs(runs: DataFrame, path: str) -> None:
    """Parquet by chromosome, sorted, so that row groups skip by position."""
    runs.repartition("chr", (F.col("start") / F.lit(1 << 24)).cast("long")).sortWithinPartitions("chr", "start").write.mode("overwrite").partitionBy("chr").parquet(path)


def read_bedgraph(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Runs from bedGraph text (0-based, half open), one file or folder per sample; zero scores are left out."""
    out = None
    for sample, path in files.items():
        lines = spark.read.text(path).where(~F.col("value").rlike(HEADER))
        part = F.split("value", r"\s+")
        rows = lines.select(part[0].alias("chr"), F.lit(sample).alias("sample"), (part[1].cast("long") + 1).alias("start"), part[2].cast("long").alias("end"), part[3].cast("double").alias("score")).where("score <> 0")
        out = rows if out is None else out.unionByName(rows)
    return out


def write_bedgraph(runs: DataFrame, path: str) -> None:
    """A folder per sample of bedGraph text, range-sorted."""
    line = F.concat_ws("\t", "chr", F.col("start") - 1, "end", F.col("score").cast("string"))
    ordered = runs.where("score > 0").repartitionByRange("sample", "chr", "start").sortWithinPartitions("sample", "chr", "start")
    ordered.select("sample", line.alias("value")).write.mode("overwrite").partitionBy("sample").text(path)
