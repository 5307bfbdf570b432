"""Shared pieces of the corpus operators: durable intermediates and vectorised word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; where none is set, one in the warehouse, which executors share, too."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the cluster's shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the value written as text, modulo ``modulus``; null stays null."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that clashes with none of ``df``, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


# ---------------------------------------------------------------- word hashing

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MULT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        m = 1 << int(n - 1).bit_length()
        inverse = pow(int(_BASE), -1, 1 << 64)
        for key, base in (("up", int(_BASE)), ("down", inverse)):
            out = np.empty(m, dtype=np.uint64)
            out[0] = 1
            filled = 1
            while filled < m:
                step = np.uint64(pow(base, filled, 1 << 64))
                out[filled : 2 * filled] = out[:filled] * step
                filled *= 2
            _powers[key] = out
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of a sequence of 64-bit codes."""
    up, down = _power_tables(len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULT[-1])


def words_of(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, ...]:
    """Words of several texts: (hash per word, first word index per text + end, start, end, the joined texts' bytes).

    Texts are joined by one newline, which is no part of any word; null counts as empty.
    """
    joined = np.frombuffer(b"\n".join([x or b"" for x in texts]) + b"\n", dtype=np.uint8)
    lengths = np.fromiter((len(x or b"") for x in texts), dtype=np.int64, count=len(texts))
    if lower:
        joined = _LOWER[joined]
    space = _SPACE[joined]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    text_end = np.cumsum(lengths + 1)
    first[1:] = np.searchsorted(starts, text_end, side="left")
    return span_hashes(_BYTE_CODE[joined], starts, ends), first, starts, ends, joined


def window_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes; mixed with the place within the run."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, np.uint64(width * 2 + 1 + salt))
    for k in range(width):
        out = mix_step(out, words[k : k + n])
    return out


def mix_step(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (state ^ word) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def even_labels(spark: SparkSession, n: int, partitions: int) -> list[int]:
    """``n`` distinct integers that hash partitioning deals evenly over ``partitions``."""
    want, tries = -(-n // partitions), 12
    while True:
        rows = spark.range(partitions * want * tries + 64).select(F.col("id").cast("int").alias("i"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(partitions)).alias("p"))
        found: list[list[int]] = [[] for _ in range(partitions)]
        for r in rows.collect():
            if len(found[r["p"]]) < want:
                found[r["p"]].append(r["i"])
        if all(len(x) == want for x in found):
            return [x[k] for k in range(want) for x in found][:n]
        tries *= 2


def label_table(spark: SparkSession, n: int, partitions: int) -> DataFrame:
    """(slot, label): ``n`` slots from 0 with distinct integers that hash partitioning deals evenly over ``partitions``.

    Nothing passes through the driver; for slots of a fixed amount of data the table is small enough to broadcast.
    """
    want = -(-n // partitions)
    label = F.col("id").cast("int")
    tried = spark.range(partitions * (4 * want + 64)).select(label.alias("label"), F.pmod(F.hash(label), F.lit(partitions)).alias("p"))
    ranked = tried.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("label")) - 1)
    return ranked.select((F.col("k") * partitions + F.col("p")).alias("slot"), "label").where(F.col("slot") < n)


def range_of(value: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    at, n = F.array(*[F.lit(b) for b in bounds]), len(bounds)
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    further = lambda done, step: F.when((done + step <= n) & F.coalesce(F.get(at, done + step - 1) <= value, F.lit(False)), done + step).otherwise(done)
    return F.aggregate(steps, F.lit(0), further)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def byte_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of Arrow batches holding about ``limit`` bytes of text (one row at least), with those texts as bytes."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 512):  # so that few texts are held twice
            batch = whole.slice(lo, 512)
            column = batch.column(batch.schema.get_field_index(text))
            if isinstance(column, pa.StringArray):
                column = column.cast(pa.binary())
            values = column.to_pylist()
            at, size = 0, 0
            for i, v in enumerate(values):
                n = len(v) if v else 0
                if i > at and size + n > limit:
                    yield batch.slice(at, i - at), values[at:i]
                    at, size = i, 0
                size += n
            if len(values) > at:
                yield batch.slice(at), values[at:]


def hold_memory() -> None:
    """Let this worker keep freed memory for its next arrays until ``give_back``, instead of mapping pages for each anew."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 32 << 20)  # fixed values: M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
        libc.mallopt(-1, 128 << 20)
    except (OSError, AttributeError):  # another C library
        pass


def give_back() -> None:
    """Return freed memory of this worker to the system; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
