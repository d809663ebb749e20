"""Least squares from one distributed pass: moments are aggregated, only (p + 1)-sized matrices reach the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: From so many columns on, cross-products are summed in matrices rather than as one expression a pair.
WIDE = 32
#: Numbers of one block that is sent to be summed, and rows that a task multiplies at once.
BLOCK, ROWS_AT_ONCE = 1 << 16, 1000


@dataclass
class Moments:
    """Count, means and centred cross-products of complete rows."""

    columns: list[str]
    n: int
    mean: np.ndarray
    cross: np.ndarray

    def take(self, names: list[str]) -> Moments:
        at = [self.columns.index(c) for c in names]
        return Moments(list(names), self.n, self.mean[at], self.cross[np.ix_(at, at)])

    def corr(self) -> np.ndarray:
        size = np.sqrt(np.diag(self.cross))
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.cross / np.outer(size, size)


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without null or NaN in `columns`, as doubles."""
    return df.select(*[F.nanvl(F.expr(f"try_cast(`{c}` as double)"), F.lit(None).cast("double")).alias(c) for c in columns]).dropna()


def _points(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.array(*[F.nanvl(F.expr(f"try_cast(`{c}` as double)"), F.lit(None).cast("double")) for c in columns]).alias("x"))


def gram(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sums [4, i, j], shift): for every pair, over the rows that have both, how many there are, the sums of i and of its
    squares, and of i times j, all of values less `shift`, which is near the data, so that little is lost.

    One job: each task multiplies its rows as matrices with gaps as zeros, and sends blocks of one fixed size, which are
    summed in two steps, so that no task holds more than about the root of all tasks' blocks at once.
    """
    p = len(columns)
    points = _points(df, columns)
    one = points.first()
    shift = np.array([v or 0.0 for v in one["x"]]) if one else np.zeros(p)
    lots = max(1, round(max(points.rdd.getNumPartitions(), 1) ** 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, p, p))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p)
            for k in range(0, len(x), ROWS_AT_ONCE):
                part = x[k : k + ROWS_AT_ONCE]
                there = ~np.isnan(part)
                z, m = np.where(there, part - shift, 0.0), there.astype(float)
                for q, (a, b) in enumerate(((m, m), (z, m), (z * z, m), (z, z))):
                    total[q] += a.T @ b
        flat = total.ravel()
        starts = list(range(0, len(flat), BLOCK))
        yield pa.RecordBatch.from_arrays([pa.array(starts), pa.array([flat[s : s + BLOCK].tobytes() for s in starts], pa.binary())], names=["start", "part"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, float) for b in group["part"])
        return pd.DataFrame({c: [group[c].iloc[0]] for c in group.columns if c != "part"} | {"part": [total.tobytes()]})

    made = points.mapInArrow(run, "start bigint, part binary").select("start", F.pmod(F.spark_partition_id(), F.lit(lots)).alias("lot"), "part")
    made = made.groupBy("start", "lot").applyInPandas(add, "start bigint, lot int, part binary")
    rows = made.select("start", "part").groupBy("start").applyInPandas(add, "start bigint, part binary").collect()  # 4 p^2 numbers
    flat = np.concatenate([np.frombuffer(r["part"], float) for r in sorted(rows, key=lambda r: r["start"])]) if rows else np.zeros(4 * p * p)
    return flat.reshape(4, p, p), shift


def pairwise_correlations(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(r, n) of all pairs over the rows that have both; NaN where a side is constant or there are no rows."""
    (n, s, q, c), _ = gram(df, columns)
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = c - s * s.T / n
        spread = np.maximum(q - s * s / n, 0)
        floor = 1e-12 * np.maximum(q, 1e-300)
        r = np.where((spread > floor) & (spread.T > floor.T), cross / np.sqrt(spread * spread.T), np.nan)
    np.fill_diagonal(r, 1.0)
    return np.clip(r, -1, 1), n.astype(np.int64)


def moments(df: DataFrame, columns: list[str]) -> Moments:
    if len(columns) > WIDE:
        whole = _points(df, columns).filter(~F.exists("x", lambda v: v.isNull()))
        names = [f"c{k}" for k in range(len(columns))]
        (n, s, _, c), shift = gram(whole.select(*[F.col("x")[k].alias(m) for k, m in enumerate(names)]), names)
        rows, sums = int(n[0, 0]), np.diag(s)
        return Moments(list(columns), rows, shift + sums / max(rows, 1), c - np.outer(sums, sums) / max(rows, 1))
    rows = complete(df, columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    got = rows.agg(F.count("*").alias("n"), *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_pop(f"`{columns[i]}`", f"`{columns[j]}`").alias(f"c{i}_{j}") for i, j in pairs]).first()
    cross = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        cross[i, j] = cross[j, i] = (got[f"c{i}_{j}"] or 0.0) * got["n"]
    return Moments(list(columns), got["n"], np.array([got[f"m{i}"] or 0.0 for i in range(len(columns))], float), cross)


@dataclass
class Fit:
    dependent: str
    predictors: list[str]
    coefficients: list[float]
    intercept: float
    n: int
    r_squared: float | None
    adjusted_r_squared: float | None
    mse: float | None
    rmse: float | None
    note: str | None = None
    vif: dict[str, float] = field(default_factory=dict)

    def predict(self) -> Column:
        return sum((F.col(f"`{p}`").cast("double") * F.lit(b) for p, b in zip(self.predictors, self.coefficients, strict=True)), F.lit(self.intercept))


def ridge_strength(p: int) -> float:
    return 1.0 if p > 5 else 1e-3


def ols(m: Moments, dependent: str, predictors: list[str], ridge: float = 0.0) -> Fit:
    """Least squares of `dependent` on `predictors`; a singular system falls back to ridge."""
    own = m.take([*predictors, dependent])
    p = len(predictors)
    a, b, syy = own.cross[:p, :p], own.cross[:p, p], float(own.cross[p, p])
    note = None
    if ridge == 0 and p and np.linalg.matrix_rank(a, hermitian=True) < p:
        ridge = ridge_strength(p)
        note = f"collinear predictors: ridge penalty {ridge:g}"
    w = np.linalg.solve(a + ridge * np.eye(p), b) if p else np.zeros(0)
    sse = max(float(syy - 2 * w @ b + w @ a @ w), 0.0)
    r2 = 1 - sse / syy if syy > 0 else None
    adjusted = 1 - (1 - r2) * (own.n - 1) / (own.n - p - 1) if r2 is not None and own.n > p + 1 else None
    mse = sse / own.n if own.n else None
    return Fit(dependent, list(predictors), w.tolist(), float(own.mean[p] - w @ own.mean[:p]), own.n, r2, adjusted, mse, None if mse is None else mse**0.5, note)


def vif(m: Moments, predictors: list[str]) -> dict[str, float]:
    """Variance inflation of each predictor: 1 for one alone, 10000 where the others explain it wholly."""
    if len(predictors) < 2:
        return {p: 1.0 for p in predictors}
    out = {}
    for p in predictors:
        r2 = ols(m, p, [q for q in predictors if q != p], ridge=0.0).r_squared
        out[p] = 1.0 if r2 is None else 10000.0 if r2 >= 1 - 1e-10 else min(1 / (1 - r2), 10000.0)
    return out
