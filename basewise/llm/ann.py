"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order of its nearest pivots, and is filed under the nearest one, its home. A query goes to
the files of the ``visit`` share of pivots that are nearest to it, and to no others. Files are kept in blocks: small files
of similar pivots share one, a large file is dealt over several. In a block every pivot has an inverted file with the
weight (``prefix`` less the pivot's rank) that each filed vector gives it; a query walks the files of its own first pivots
and adds up the smaller of both weights, which is a constant less half the footrule distance of the two orders. Vectors
whose footrule distance is within the query's radius are reranked by inner product on the original vectors in double
precision. The radius is that which takes in rows ** ``effort`` vectors, told from a sample of indexed vectors, so that it
is the same for all blocks and what is found doesn't depend on how rows are dealt; orders that are nearly equal to the
query's are always within it, so that a group of near copies is reranked as a whole.

Pivots (``pivots``, none a near copy of another) and the sample for radii (``SAMPLE``) are bounded samples, by hash of id and vector; every row is
indexed. Block numbers are worked out from the number of rows filed under each pivot, so that what the driver holds is
bounded by the pivots. A query that finds fewer than it should, because its files are nearly empty, is compared with all
rows in blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with
null vec_id; vectors of different length are no neighbours; all rows with the query's vec_id are its own, and a query in
several rows is asked with each; ties go to the smaller vec_id; with fewer than ``k`` candidates all are returned; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable
from .vectors import matrix, usable

BLOCK_ROWS, BLOCK_QUERIES, SAMPLE = 8192, 16384, 4096
#: The share of a vector's weight with itself from which another is within every radius: all of a large group of near copies.
ALIKE = 0.8
OUT = "query_id long, rank int, vec_id long, score double"


def pivot_order(x: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` pivots nearest to each row, nearest first, by inner product with unit pivots."""
    far = -(x @ pivots.T)
    if n < len(pivots):
        near = np.argpartition(far, n - 1, axis=1)[:, :n]
        return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable"), axis=1).astype(np.uint16)
    return np.argsort(far, axis=1, kind="stable").astype(np.uint16)


def spread(sample: np.ndarray, n: int, least: float = 0.9) -> np.ndarray:
    """Unit vectors of the first ``n`` rows that are no near copies (cosine ``least``) of one taken before."""
    unit = sample / np.sqrt((sample * sample).sum(axis=1))[:, None]
    taken = [0]
    for i in range(1, len(unit)):
        if len(taken) < n and (unit[taken] @ unit[i]).max() < least:
            taken.append(i)
    return unit[taken]


def weights(order: np.ndarray, pivots: int, prefix: int) -> np.ndarray:
    """A row per pivot: the weight that each vector gives it, 0 beyond the prefix."""
    out = np.zeros((pivots, len(order)), dtype=np.uint16)
    out[order[:, :prefix].T, np.arange(len(order))[None]] = (prefix - np.arange(order[:, :prefix].shape[1], dtype=np.uint16))[:, None]
    return out


def footrule(files: np.ndarray, order: np.ndarray, prefix: int) -> np.ndarray:
    """Shared weight of one query with every filed vector: the larger, the smaller the footrule distance."""
    total, part = np.zeros(files.shape[1], dtype=np.uint16), np.empty(files.shape[1], dtype=np.uint16)
    for rank, p in enumerate(order[:prefix].tolist()):
        np.minimum(files[p], np.uint16(prefix - rank), out=part)
        total += part
    return total


def best(x: np.ndarray, ids: np.ndarray, vector: np.ndarray, own: int, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the ``k`` best of the rows ``at``."""
    at = at[ids[at] != own]
    score = (x[at] * vector).sum(axis=1)
    if len(at) > 4 * k:
        near = score >= np.partition(score, len(score) - k)[len(score) - k]
        at, score = at[near], score[near]
    top = np.lexsort((ids[at], -score))[:k]
    return ids[at[top]], score[top]


def blocks(filed: np.ndarray, pivots: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each pivot's file; files of similar pivots share a block while they fit."""
    first, parts = np.zeros(len(filed), dtype=np.int64), np.maximum(1, -(-filed // limit))
    centred = pivots - pivots.mean(axis=0)
    along = np.linalg.svd(centred, full_matrices=False)[2][0]
    at, held = 0, 0
    for p in np.argsort(centred @ along, kind="stable").tolist():
        if held and held + filed[p] > limit:
            at, held = at + 1, 0
        first[p] = at
        if parts[p] > 1:
            at, held = at + int(parts[p]), 0
        else:
            held += int(filed[p])
    return first, parts


def search(rows: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 20, **how) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``rows`` where ``is_query`` holds, against all rows."""
    own = rows.where(usable(F.col(vector)) & F.col(id).isNotNull())
    own = own.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    out = None
    for r in own.where("q").select(F.size("v").alias("d")).distinct().orderBy("d").collect():
        part = _search(own.where(F.size("v") == r["d"]), r["d"], k, **how)
        out = part if out is None else out.unionByName(part)
    return rows.sparkSession.createDataFrame([], OUT) if out is None else out


def _search(own: DataFrame, size: int, k: int, pivots: int = 512, prefix: int = 96, visit: float = 0.8, effort: float = 0.78) -> DataFrame:
    spark = own.sparkSession
    sample = np.array([r["v"] for r in own.select("v").orderBy(F.xxhash64("id", "v"), "id").limit(max(pivots, SAMPLE)).collect()])
    points = spread(sample, min(pivots, max(1, len(sample) // 2)))
    prefix, visited = min(prefix, max(1, len(points) // 4)), int(np.ceil(visit * len(points)))
    seen = weights(pivot_order(sample[:SAMPLE], points, prefix), len(points), prefix)
    shared = spark.sparkContext.broadcast((points, seen))

    def index(batches):
        points = shared.value[0]
        for batch in batches:
            order = pivot_order(matrix(batch.column(1), size), points, prefix)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order[:, 0].astype(np.int32)), pa.array([x.tobytes() for x in order], pa.binary())], names=["id", "v", "q", "home", "ranks"])

    indexed = durable(own.mapInArrow(index, "id long, v array<double>, q boolean, home int, ranks binary"))
    filed, queries = np.zeros(len(points), dtype=np.int64), 0
    for r in indexed.groupBy("home").agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("m")).collect():
        filed[r["home"]] = r["n"]
        queries += r["m"]
    n = int(filed.sum())
    share = min(1.0, max(n**effort, 4.0 * (k + 1)) / n)
    alike = int(ALIKE * prefix * (prefix + 1) / 2)
    first, parts = blocks(filed, points, BLOCK_ROWS)
    query_blocks = -(-queries // BLOCK_QUERIES)
    plan = spark.sparkContext.broadcast((first, parts))
    spot = F.xxhash64("id", "v")
    number = lambda name: F.element_at(F.array(*[F.lit(int(x)) for x in name]), F.col("home") + 1)
    block = number(first) + F.pmod(spot, number(parts))
    candidates = indexed.select("id", "v", "home", "ranks", block.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("o"))

    def ask(everywhere: bool):
        def run(batches):
            (points, seen), (first, parts) = shared.value, plan.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    order = pivot_order(matrix(part.column(1), size), points, len(points) if everywhere else visited)
                    at, to, flags, radius = [], [], [], []
                    for i, o in enumerate(order):
                        of = parts[o]
                        goes = np.unique(np.repeat(first[o] - np.cumsum(of) + of, of) + np.arange(of.sum()))
                        allowed = np.zeros(len(points), dtype=bool)
                        allowed[o] = True
                        # The weight that the wanted share of the sample reaches; where few are near, those that share a pivot.
                        least = 0 if everywhere else max(1, min(int(np.quantile(footrule(seen, o, prefix), 1 - share, method="lower")), alike))
                        at += [i] * len(goes)
                        to.append(goes)
                        flags += [np.packbits(allowed).tobytes()] * len(goes)
                        radius += [least] * len(goes)
                    rows_ = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*rows_.columns, pa.array(flags, pa.binary()), pa.array(radius, pa.int32()), pa.array(np.concatenate(to))], names=["id", "v", "ranks", "o", "files", "least", "b"])

        return run

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        pivot_count = len(shared.value[0])
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            x, ids, home = matrix(left.column("v"), size), left.column("id").to_numpy(), left.column("home").to_numpy()
            order = np.frombuffer(b"".join(left.column("ranks").to_pylist()), dtype=np.uint16).reshape(len(x), prefix)
            files = weights(order, pivot_count, prefix)
            asked = zip(right.column("id").to_pylist(), matrix(right.column("v"), size), right.column("ranks").to_pylist(), right.column("files").to_pylist(), right.column("least").to_pylist(), strict=True)
            for own_id, vector, ranks, flags, least in asked:
                near = footrule(files, np.frombuffer(ranks, dtype=np.uint16), prefix) >= least
                near &= np.unpackbits(np.frombuffer(flags, dtype=np.uint8), count=pivot_count).astype(bool)[home]
                i, s = best(x, ids, vector, own_id, np.flatnonzero(near), k)
                found.append((np.full(len(i), own_id), i, s))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[], [], []]
        return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    def found(asking: DataFrame, everywhere: bool) -> DataFrame:
        asked = asking.mapInArrow(ask(everywhere), "id long, v array<double>, ranks binary, o int, files binary, least int, b long")
        pairs = candidates.groupBy("b", "o").cogroup(asked.groupBy("b", "o")).applyInArrow(meet, "query_id long, vec_id long, score double")
        # Rows of one id that are asked for twice find the same.
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return pairs.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asking = indexed.where("q").select("id", "v", "ranks", F.pmod(spot, F.lit(query_blocks)).cast("int").alias("o"))
    near = durable(found(asking, False))
    wanted = min(k, n - 1)
    met = near.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= wanted).select(F.col("query_id").alias("id"))
    short = durable(asking.join(met, "id", "left_anti"))
    if short.isEmpty():
        return near
    rest = found(short, True)
    return near.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
