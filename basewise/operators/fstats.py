"""F-statistics of nested linear models at every position, and their cut-offs."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import f_quantile, projection

#: Up to so many samples the statistic is one generated expression; beyond, a matrix product over Arrow batches.
EXPRESSION_SAMPLES = 24
#: A residual sum below this share of the sum of squares is rounding error of 0.
NOTHING = 1e-12


def _sum_of_squares(rows: np.ndarray, names: Sequence[str]) -> str:
    squares = ["power(" + " + ".join(f"({v!r}D * {c})" for v, c in zip(row.tolist(), names, strict=True)) + ", 2)" for row in rows]
    return " + ".join(squares) or "0D"


def _sums_of_squares(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The same for many positions, a column each.

    Added up in the same order, so that every bit is the same; of many samples, where that takes 10 times as long and more,
    by a matrix product, whose order is its own.
    """
    if len(columns) > EXPRESSION_SAMPLES:
        return np.square(rows @ columns).sum(axis=0)
    out, along, term = (np.zeros(columns.shape[1]) for _ in range(3))
    for row in rows.tolist():
        along[:] = 0
        for v, c in zip(row, columns, strict=True):
            along += np.multiply(c, v, out=term)
        out += np.square(along, out=along)
    return out


def f_expression(mod: np.ndarray, mod0: np.ndarray, names: Sequence[str], adjust: float = 0.0) -> Column:
    """F from one column per sample; null where both models fit a constant position, infinite where only the full one does."""
    n, df1, df0 = len(mod), mod.shape[1], mod0.shape[1]
    r1, r0 = _sum_of_squares(projection(mod), names), _sum_of_squares(projection(mod0), names)
    total = " + ".join(f"{c} * {c}" for c in names)
    zero1 = f"({r1}) <= {NOTHING}D * ({total})"
    zero0 = f"({r0}) <= {NOTHING}D * ({total})"
    value = f"((({r0}) - ({r1})) / {df1 - df0}D) / ({float(adjust)!r}D + ({r1}) / {n - df1}D)"
    return F.expr(f"CASE WHEN {zero1} AND {zero0} THEN NULL WHEN {zero1} AND {float(adjust)!r}D = 0 THEN double('Infinity') ELSE {value} END")


def f_values(y: np.ndarray, mod: np.ndarray, mod0: np.ndarray, adjust: float = 0.0) -> np.ndarray:
    """The same for rows of a matrix; nan for null."""
    n, df1, df0 = len(mod), mod.shape[1], mod0.shape[1]
    columns = np.ascontiguousarray(y.T)
    r1, r0 = (_sums_of_squares(projection(m), columns) for m in (mod, mod0))
    total = (columns * columns).sum(axis=0)
    zero1, zero0 = r1 <= NOTHING * total, r0 <= NOTHING * total
    with np.errstate(divide="ignore", invalid="ignore"):
        f = ((r0 - r1) / (df1 - df0)) / (adjust + r1 / (n - df1))
    f[zero1 & (adjust == 0)] = np.inf
    f[zero1 & zero0] = np.nan
    return f


def calculate_stats(segs: DataFrame, mod: np.ndarray, mod0: np.ndarray, adjust: float = 0.0, method: str | None = None) -> DataFrame:
    """Segments with a column ``f``. ``method``: "expression" or "matrix"; by the number of samples where not given."""
    n = len(mod)
    if (method or ("expression" if n <= EXPRESSION_SAMPLES else "matrix")) == "expression":
        # Columns are drawn out of the array once, in a projection of their own.
        names = [f"_y{i}" for i in range(n)]
        flat = segs.select("*", *[F.element_at("y", i + 1).alias(c) for i, c in enumerate(names)])
        return flat.withColumn("f", f_expression(mod, mod0, names, adjust)).drop(*names)
    at = segs.columns.index("y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.asarray(b.column(at).flatten(), dtype=float).reshape(b.num_rows, n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(f_values(y, mod, mod0, adjust), from_pandas=True)], names=[*b.schema.names, "f"])

    return segs.mapInArrow(run, T.StructType([*segs.schema.fields, T.StructField("f", T.DoubleType())]))


def permuted_stats(segs: DataFrame, mod: np.ndarray, mod0: np.ndarray, permutations: Sequence[Sequence[int]], adjust: float = 0.0) -> DataFrame:
    """(perm, chr, tile, start, end, f) of every permutation in one scan; the rows of both models are permuted together."""
    n = len(mod)
    names = [f"_y{i}" for i in range(n)]
    flat = segs.select("chr", "tile", "start", "end", *[F.element_at("y", i + 1).alias(c) for i, c in enumerate(names)])
    values = F.array(*[f_expression(mod[list(p)], mod0[list(p)], names, adjust) for p in permutations])
    return flat.select("chr", "tile", "start", "end", values.alias("fs")).select(F.posexplode("fs").alias("perm", "f"), "chr", "tile", "start", "end").withColumn("perm", F.col("perm") + 1)


def fstat_cutoff(segs: DataFrame, kind: str, value: float, mod: np.ndarray | None = None, mod0: np.ndarray | None = None) -> float:
    """The cut-off: "empirical" quantile over positions, "theoretical" upper quantile, or "manual".

    An empirical quantile of 1e-8, the usual theoretical probability, is taken for a slip: 0.99 is used, with a warning.
    """
    if kind == "empirical":
        if value == 1e-8:
            warnings.warn("an empirical cut-off needs a quantile, not 1e-8; using 0.99", stacklevel=2)
            value = 0.99
        row = segs.where("f IS NOT NULL").agg(F.percentile("f", F.lit(float(value)), F.col("end") - F.col("start") + 1).alias("q")).first()
        return row["q"]
    if kind == "theoretical":
        return f_quantile(value, mod.shape[1] - mod0.shape[1], len(mod) - mod.shape[1])
    if kind == "manual":
        return float(value)
    raise ValueError("kind must be 'empirical', 'theoretical' or 'manual'")
