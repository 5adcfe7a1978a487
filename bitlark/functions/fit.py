"""Offline fit of a residual model: greedy sign atoms, ridge decoder, norm calibration.

Rows reach the driver up to ``max_rows`` (the least by hash of the id when there are more), which is the
documented size of a fit; the arithmetic is one pass of 500 atoms over that matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, InvalidModel
from .residual import MAX_COEFFICIENT, MAX_NORM_CODE, SIGNS, Model, normalize
from .rng import SplitMix64

POWER_ITERATIONS = 8
RIDGE_RATE = 1e-4


@dataclass(frozen=True)
class Fit:
    model: Model
    rows: int
    clipped: int


def atoms(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs [n, 500] (+1, -1) and float32 atoms [500, d] of unit float64 rows."""
    n, d = x.shape
    cov = x.T @ x
    rest = x.copy()
    rng = SplitMix64(seed)
    codes, encoder = np.zeros((n, SIGNS)), np.zeros((SIGNS, d), np.float32)
    for s in range(SIGNS):
        axis = rng.normals(d).astype(np.float64)
        size = np.sqrt((axis * axis).sum())
        if not size or not np.isfinite(size):
            raise InvalidModel("the random start has no finite positive norm")
        axis /= size
        for _ in range(POWER_ITERATIONS):
            axis = cov @ axis
            axis /= max(np.sqrt((axis * axis).sum()), 1e-20)
        signs = np.where(rest @ axis >= 0, 1.0, -1.0)
        atom = signs @ rest / n
        if not np.isfinite(atom).all() or not atom.any():
            raise InvalidModel(f"the residual collapsed at atom {s}; fit on more or more varied rows")
        rest -= signs[:, None] * atom
        cov -= n * np.outer(atom, atom)
        cov = (cov + cov.T) / 2
        codes[:, s], encoder[s] = signs, atom
    return codes, encoder


def ridge(codes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """int16 decoder [500, d], scaled so that the largest coefficient is 2047."""
    gram = codes.T @ codes + len(x) * RIDGE_RATE * np.eye(SIGNS)
    lower = np.linalg.cholesky(gram)
    solved = np.linalg.solve(lower.T, np.linalg.solve(lower, codes.T @ x)).astype(np.float32)
    largest = float(np.abs(solved).max())
    if not largest or not np.isfinite(largest):
        raise InvalidModel("the decoder has no finite coefficient but 0")
    return np.rint(solved.astype(np.float64) * (MAX_COEFFICIENT / largest)).astype(np.int16)


def calibrate(inverse: np.ndarray) -> tuple[int, float, int]:
    """Norm offset, step and number of clipped rows from 1/|decoded| of the fit rows."""
    low, high = float(inverse.min()), float(inverse.max())
    step = (high - low) / (MAX_NORM_CODE - 1.0)
    if not np.isfinite(step) or step <= 0:
        raise InvalidModel("the fit rows span no usable range of norms")
    offset = int(np.rint(low / step))
    raw = np.rint(inverse / step) - offset
    return offset, step, int(((raw < 0) | (raw > MAX_NORM_CODE)).sum())


def fit_rows(rows: np.ndarray, seed: int = 42) -> Fit:
    x = normalize(rows, rows.shape[1]).astype(np.float64)
    codes, encoder = atoms(x, seed)
    decoder = ridge(codes, x)
    decoded = (codes @ decoder.astype(np.float64)).astype(np.int64)
    square = (decoded * decoded).sum(axis=1)
    if (square == 0).any():
        raise InvalidModel("a fit row decodes to zero")
    offset, step, clipped = calibrate(1.0 / np.sqrt(square.astype(np.float64)))
    return Fit(Model(rows.shape[1], offset, step, encoder, decoder), len(rows), clipped)


def fit(df: DataFrame, dims: int, seed: int = 42, id_col: str = "doc_id", vector_col: str = "embedding", max_rows: int = 50_000) -> Fit:
    picked = df.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v")).orderBy(F.xxhash64("i"), "i").limit(max_rows)
    got = sorted((r.i, r.v) for r in picked.collect())
    if not got:
        raise InvalidArgument("no rows to fit on")
    rows = np.array([v for _, v in got], np.float32)
    if rows.ndim != 2 or rows.shape[1] != dims:
        raise InvalidArgument("rows don't have the stated width")
    return fit_rows(rows, seed)


def norm_range(df: DataFrame) -> DataFrame:
    """One row (norm_offset long, norm_step double, clipped long) by aggregates over a column ``inverse``.

    The distributed form of ``calibrate``.
    """
    r = df.agg(F.min("inverse").alias("lo"), F.max("inverse").alias("hi"))
    r = r.withColumn("norm_step", (F.col("hi") - F.col("lo")) / (MAX_NORM_CODE - 1.0)).withColumn("norm_offset", F.rint(F.col("lo") / F.col("norm_step")).cast("long"))
    raw = F.rint(F.col("inverse") / F.col("norm_step")) - F.col("norm_offset")
    met = df.crossJoin(F.broadcast(r))  # one row
    return met.groupBy("norm_offset", "norm_step").agg(F.count_if((raw < 0) | (raw > MAX_NORM_CODE)).alias("clipped"))
