"""Ego-centric transforms of sample steps, and motion-model roll-outs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import rotate, wrap
from .sampling import SAMPLE


def pose(rows: DataFrame, history: int) -> DataFrame:
    """The target's place and heading at the last history step, one row per sample."""
    last = rows.where((F.col("track_id") == F.col("target_id")) & (F.col("t") == history - 1))
    return last.select(*SAMPLE, F.col("x").alias("_x0"), F.col("y").alias("_y0"), F.col("psi").alias("_h"))


def ego_frame(rows: DataFrame, history: int, turn: bool = True) -> DataFrame:
    """Positions about the target's last place; with ``turn``, axes along its heading too.  Missing steps stay null."""
    out = rows.join(pose(rows, history), list(SAMPLE))
    x, y = F.col("x") - F.col("_x0"), F.col("y") - F.col("_y0")
    if not turn:
        return out.withColumns({"x": x, "y": y}).drop("_x0", "_y0", "_h")
    new = dict(zip(("x", "y"), rotate(x, y, F.col("_h")), strict=True))
    for a, b in (("vx", "vy"), ("ax", "ay")):
        if a in rows.columns:
            new |= dict(zip((a, b), rotate(F.col(a), F.col(b), F.col("_h")), strict=True))
    new["psi"] = wrap(F.col("psi") - F.col("_h"))
    return out.withColumns(new).drop("_x0", "_y0", "_h")


def clamp(u: Column, limit: float) -> Column:
    return F.greatest(F.least(u, F.lit(float(limit))), F.lit(-float(limit)))


# Stages and weights of explicit Runge-Kutta steppers (a lower triangle, then b).
STEPPERS = {
    "ef": ([[]], [1.0]),
    "mp": ([[], [0.5]], [0.0, 1.0]),
    "heun": ([[], [1.0]], [0.5, 0.5]),
    "rk3": ([[], [0.5], [-1.0, 2.0]], [1 / 6, 2 / 3, 1 / 6]),
    "ssprk3": ([[], [1.0], [0.25, 0.25]], [1 / 6, 1 / 6, 2 / 3]),
    "rk4": ([[], [0.5], [0.0, 0.5], [0.0, 0.0, 1.0]], [1 / 6, 1 / 3, 1 / 3, 1 / 6]),
}


def step(state: dict[str, Column], rate, dt: float, method: str) -> dict[str, Column]:
    """One step of ``method``; ``rate`` maps a state to its derivative, both dicts of columns."""
    stages: list[dict[str, Column]] = []
    table, weights = STEPPERS[method]
    for row in table:
        at = {k: v + sum((s[k] * (a * dt) for a, s in zip(row, stages, strict=True) if a), F.lit(0.0)) for k, v in state.items()}
        stages.append(rate(at))
    return {k: v + sum((s[k] * (b * dt) for b, s in zip(weights, stages, strict=True) if b), F.lit(0.0)) for k, v in state.items()}


def double_integrator(state: dict[str, Column], ux: Column, uy: Column) -> dict[str, Column]:
    return {"x": state["vx"], "y": state["vy"], "vx": ux, "vy": uy}


def single_integrator(state: dict[str, Column], ux: Column, uy: Column) -> dict[str, Column]:
    return {"x": ux, "y": uy}


def rollout(df: DataFrame, horizon: int, dt: float, ux: Column, uy: Column, limit: float = 8.0, method: str = "rk4") -> DataFrame:
    """``t, x, y`` for t = 1..horizon from each row's x, y, vx, vy under constant, clamped acceleration."""
    ax, ay = clamp(ux, limit), clamp(uy, limit)

    def fold(acc, t):
        s = acc["s"]
        new = step({k: s[k] for k in ("x", "y", "vx", "vy")}, lambda z: double_integrator(z, ax, ay), dt, method)
        packed = F.struct(*(v.alias(k) for k, v in new.items()))
        return F.struct(packed.alias("s"), F.concat(acc["o"], F.array(F.struct(t.alias("t"), new["x"].alias("x"), new["y"].alias("y")))).alias("o"))

    start = F.struct(F.struct("x", "y", "vx", "vy").alias("s"), F.array().cast("array<struct<t:int,x:double,y:double>>").alias("o"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, fold, lambda acc: acc["o"])
    kept = [c for c in df.columns if c not in ("x", "y", "vx", "vy")]
    return df.withColumn("_p", path).select(*kept, F.explode("_p").alias("_p")).select(*kept, "_p.t", "_p.x", "_p.y")


def process_noise(s1: Column, s2: Column, rho: Column) -> tuple[Column, Column, Column]:
    """The covariance of two inputs with deviations s1, s2 and correlation rho."""
    return s1 * s1, rho * s1 * s2, s2 * s2


def propagate(p: tuple[Column, ...], f: tuple[float, ...], q: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    """``F P F' + Q`` of a 2x2 covariance (p11, p12, p22), with F given as (f11, f12, f21, f22)."""
    p11, p12, p22 = p
    a, b, c, d = (F.lit(float(v)) for v in f)
    n11 = a * a * p11 + 2 * a * b * p12 + b * b * p22 + q[0]
    n12 = a * c * p11 + (a * d + b * c) * p12 + b * d * p22 + q[1]
    n22 = c * c * p11 + 2 * c * d * p12 + d * d * p22 + q[2]
    return n11, n12, n22
