"""Resampling of tracks: linear grids, factors, anti-aliased decimation by weight tables."""

from __future__ import annotations

from math import cos, cosh, pi, sinh

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kinematics import TRACK


def linear_grid(tracks: DataFrame, time: str, step: float, values=("x", "y"), keys=TRACK) -> DataFrame:
    """Values on the grid of multiples of ``step`` within each track's span; tracks of one point are dropped.

    A row emits the grid points from its own time up to the next row's, so no track is ever gathered.
    """
    w = W.partitionBy(*keys).orderBy(time)
    nxt = tracks.withColumns({"_t1": F.lead(time).over(w), "_n": F.count("*").over(W.partitionBy(*keys)), **{f"_{v}1": F.lead(v).over(w) for v in values}})
    nxt = nxt.where("_n > 1")
    t0, t1 = F.col(time), F.col("_t1")
    low = F.ceil(t0 / step)
    high = F.when(t1.isNull(), F.floor(t0 / step)).otherwise(F.ceil(t1 / step) - 1)
    cells = nxt.where(low <= high).withColumn("_g", F.explode(F.sequence(low, high)))
    at = F.col("_g") * F.lit(step)
    part = F.when(t1.isNull(), F.lit(0.0)).otherwise((at - t0) / (t1 - t0))
    out = {v: F.when(t1.isNull(), F.col(v)).otherwise(F.col(v) + (F.col(f"_{v}1") - F.col(v)) * part) for v in values}
    return cells.select(*keys, F.col("_g").cast("int").alias("grid"), *(c.alias(v) for v, c in out.items()))


def islands(rows: DataFrame, keys, order: str = "frame", valid: Column | None = None) -> DataFrame:
    """Adds ``run``: a number for each stretch of consecutive (valid) steps."""
    ok = rows if valid is None else rows.where(valid)
    return ok.withColumn("run", (F.col(order) - F.row_number().over(W.partitionBy(*keys).orderBy(order))).cast("int"))


def upsample(tracks: DataFrame, factor: int, values=("x", "y"), keys=TRACK) -> DataFrame:
    """Runs of consecutive frames upsampled by a factor: frame k lands at ``k * f + f - 1``.

    Between frames values are interpolated; the f - 1 steps before a run's first frame are extrapolated
    backwards from its first two, or repeat it where the run has one frame.
    """
    runs = islands(tracks, keys)
    w = W.partitionBy(*keys, "run").orderBy("frame")
    prev = runs.withColumns({f"_{v}0": F.lag(v).over(w) for v in values} | {f"_{v}1": F.lead(v).over(w) for v in values})
    fine = prev.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    part = (F.col("_j") + 1) / F.lit(float(factor))
    out = {}
    for v in values:
        here, before, after = F.col(v), F.col(f"_{v}0"), F.col(f"_{v}1")
        slope = F.coalesce(here - before, after - here, F.lit(0.0))
        out[v] = here - slope * (1 - part)
    return fine.select(*keys, "run", (F.col("frame") * factor + F.col("_j")).cast("int").alias("frame"), *(c.alias(v) for v, c in out.items()))


def decimate_lazy(rows: DataFrame, factor: int, keys, order: str = "t", valid: Column | None = None) -> DataFrame:
    """Every ``factor``-th valid step counted from the last, so the last is kept; ``pick`` numbers those kept from 0."""
    ok = rows if valid is None else rows.where(valid)
    back = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc())) - 1
    kept = ok.withColumn("_b", back).where(F.col("_b") % factor == 0)
    return kept.withColumn("pick", (F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1).cast("int")).drop("_b")


def _chebyshev(order: int, ripple: float, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Digital Chebyshev-I low-pass (numerator, denominator); ``cut`` as a part of the Nyquist frequency."""
    eps = np.sqrt(10 ** (ripple / 10) - 1)
    mu = np.arcsinh(1 / eps) / order
    warped = 4 * np.tan(pi * cut / 2)
    angles = [pi * (2 * k + 1) / (2 * order) for k in range(order)]
    poles = np.array([complex(-sinh(mu) * np.sin(a), cosh(mu) * cos(a)) for a in angles]) * warped
    gain = np.prod(-poles).real / (np.sqrt(1 + eps**2) if order % 2 == 0 else 1.0)
    digital = (4 + poles) / (4 - poles)
    gain = gain / np.prod(4 - poles).real
    return np.real(np.poly(-np.ones(order)) * gain), np.real(np.poly(digital))


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    out, z = np.empty_like(x), state.copy()
    for i, v in enumerate(x):
        out[i] = b[0] * v + z[0]
        z[:-1] = b[1:-1, None] * v + z[1:] - a[1:-1, None] * out[i] if x.ndim > 1 else b[1:-1] * v + z[1:] - a[1:-1] * out[i]
        z[-1] = b[-1] * v - a[-1] * out[i]
    return out


def _zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering with odd extension at both ends."""
    n = len(b) - 1
    pad = min(3 * (n + 1), len(x) - 1)
    companion = np.zeros((n, n))
    companion[:, 0], companion[:-1, 1:] = -a[1:], np.eye(n - 1)
    rest = np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        long = _filter(b, a, long, rest[:, None] * long[0][None, :])[::-1]
    return long[pad : len(long) - pad]


def decimation_weights(length: int, factor: int, order: int = 8, ripple: float = 0.05) -> np.ndarray:
    """The matrix of zero-phase decimation of ``length`` samples that keeps the last one: the filter is linear."""
    b, a = _chebyshev(order, ripple, 0.8 / factor)
    return _zero_phase(b, a, np.eye(length)[::-1])[::factor][::-1]


def rational_weights(length: int, up: int, down: int, beta: float = 5.0) -> np.ndarray:
    """The matrix of polyphase resampling by up / down with a Kaiser-windowed low-pass."""
    most = max(up, down)
    half = 10 * most
    t = np.arange(-half, half + 1)
    h = np.sinc(t / most) / most * np.kaiser(2 * half + 1, beta)
    h *= up / h.sum()
    n_out = -(-length * up // down)
    at = np.arange(n_out)[:, None] * down - np.arange(length)[None, :] * up + half
    return np.where((at >= 0) & (at <= 2 * half), h[np.clip(at, 0, 2 * half)], 0.0)


def weight_table(spark: SparkSession, matrices: dict[int, np.ndarray]) -> DataFrame:
    """``len, out_t, in_t, w`` of matrices by input length; a few thousand rows set by the horizon, not by data."""
    rows = [(n, i, j, float(m[i, j])) for n, m in matrices.items() for i in range(m.shape[0]) for j in range(m.shape[1])]
    return spark.createDataFrame(rows, "len int, out_t int, in_t int, w double")


def apply_weights(series: DataFrame, weights: DataFrame, keys, values=("x", "y")) -> DataFrame:
    """``keys, out_t, values``: each series (``in_t`` from 0) times the matrix for its length.

    The table is broadcast: its rows depend on lengths and factors only.
    """
    n = F.count("*").over(W.partitionBy(*keys)).cast("int")
    both = series.withColumn("len", n).join(F.broadcast(weights), ["len", "in_t"])
    return both.groupBy(*keys, "out_t").agg(*(F.sum(F.col("w") * F.col(v)).alias(v) for v in values))
