"""Prediction metrics and losses over long tables.

``truth(scenario_id, agent_id, t, x, y, valid)``, ``pred(scenario_id, agent_id, mode, t, x, y)`` and
``prob(scenario_id, agent_id, mode, prob)``.  Every metric is an average over agents with a valid step;
sums and counts are Spark's partial aggregates, so batches and processes need no merging of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import distance, sigmoid
from ..session import written
from .neighbors import within

AGENT = ("scenario_id", "agent_id")


def meet(left: DataFrame, right: DataFrame, keys: list[str], outer: bool = False) -> DataFrame:
    """The join by equal keys, made by grouping both tables together; ``outer`` keeps rows of the left one that meet none.

    A join deals both tables by all of its keys again; a grouping takes tables that are dealt by some of them as they are, so
    predictions and truths that lie by agent are not moved.  A group is the rows of one step or one mode of an agent.
    """
    a, b = ([c for c in df.columns if c not in keys] for df in (left, right))
    sides = left.select(*keys, F.struct(*a).alias("_a")), right.select(*keys, F.struct(*b).alias("_b"))
    both = sides[0].unionByName(sides[1], allowMissingColumns=True)
    both = both if outer else both.dropna(subset=keys)
    groups = both.groupBy(*keys).agg(F.collect_list("_a").alias("_a"), F.collect_list("_b").alias("_b"))
    return groups.select(*keys, "_a", (F.inline_outer if outer else F.inline)("_b")).select(*keys, *b, F.inline("_a")).select(*keys, *a, *b)


def errors(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Distance of every predicted step to the truth, at valid steps only."""
    t = truth.where("valid").select(*AGENT, "t", F.col("x").alias("tx"), F.col("y").alias("ty"))
    return meet(pred, t, [*AGENT, "t"]).withColumn("d", distance(F.col("x"), F.col("y"), F.col("tx"), F.col("ty")))


def mode_errors(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """``ade, fde`` of every mode of agents with a valid step: the mean, and the one at the last valid step."""
    return errors(pred, truth).groupBy(*AGENT, "mode").agg(F.avg("d").alias("ade"), F.max_by("d", "t").alias("fde"))


def best_mode(scored: DataFrame, criterion: str, prob: DataFrame | None = None, best: DataFrame | None = None) -> DataFrame:
    """The chosen mode of each agent, from mode_errors(): least FDE or ADE, or the most likely (ML); first on ties.

    ``best(scenario_id, agent_id, mode)`` are modes chosen before; the criterion is not looked at then.
    """
    if best is not None:
        return scored.join(best.select(*AGENT, "mode"), [*AGENT, "mode"])
    if criterion in ("FDE", "ADE"):
        key = F.struct(F.col(criterion.lower()), F.col("mode"))
        return scored.groupBy(*AGENT).agg(F.min_by("mode", key).alias("mode"), F.min_by("ade", key).alias("ade"), F.min_by("fde", key).alias("fde"))
    if criterion != "ML":
        raise ValueError(f"unknown criterion: {criterion}")
    if prob is None:
        raise ValueError("criterion ML needs probabilities")
    both = meet(scored, prob, [*AGENT, "mode"])
    key = F.struct(-F.col("prob"), F.col("mode"))
    return both.groupBy(*AGENT).agg(F.min_by("mode", key).alias("mode"), F.min_by("ade", key).alias("ade"), F.min_by("fde", key).alias("fde"))


def mean(values: DataFrame, column: str | Column, name: str) -> DataFrame:
    """``sum / count`` of a per-agent value; null where there is no agent."""
    return values.agg(F.avg(column).alias(name), F.count(column).alias("n_agents"))


def min_ade(pred, truth, criterion="FDE", prob=None, best=None) -> DataFrame:
    return mean(best_mode(mode_errors(pred, truth), criterion, prob, best), "ade", "min_ade")


def min_fde(pred, truth, criterion="FDE", prob=None, best=None) -> DataFrame:
    return mean(best_mode(mode_errors(pred, truth), criterion, prob, best), "fde", "min_fde")


def miss_rate(pred, truth, criterion="FDE", prob=None, threshold: float = 2.0, best=None) -> DataFrame:
    chosen = best_mode(mode_errors(pred, truth), criterion, prob, best)
    return mean(chosen, (F.col("fde") > threshold).cast("double"), "miss_rate")


def chosen_paths(pred, truth, criterion="FDE", prob=None, best=None) -> DataFrame:
    """``scenario_id, agent_id, path``: the chosen mode's steps (array of ``t, x, y``) of every agent with a prediction.

    Agents without a valid step are kept: their FDE is that of the last step, their ADE is 0 for all modes.
    ``best(scenario_id, agent_id, mode)`` are modes chosen before, instead of a criterion.
    """
    steps = F.collect_list(F.struct("t", "x", "y")).alias("path")
    if best is not None:
        return pred.join(best.select(*AGENT, "mode"), [*AGENT, "mode"]).groupBy(*AGENT).agg(steps)
    if criterion == "ML":
        if prob is None:
            raise ValueError("criterion ML needs probabilities")
        modes = meet(pred.groupBy(*AGENT, "mode").agg(steps), prob, [*AGENT, "mode"]).withColumn("_e", -F.col("prob"))
    elif criterion in ("FDE", "ADE"):
        t = truth.select(*AGENT, "t", F.col("x").alias("_tx"), F.col("y").alias("_ty"), F.col("valid").alias("_ok"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        both = meet(pred, t, [*AGENT, "t"], outer=True).withColumn("_d", distance(F.col("x"), F.col("y"), zero("_tx"), zero("_ty")))
        ok = F.coalesce("_ok", F.lit(False))
        last = F.max_by("_d", F.struct(ok, F.col("t")))  # valid steps come after all others
        error = last if criterion == "FDE" else F.coalesce(F.sum(F.when(ok, F.col("_d"))), F.lit(0.0))
        modes = both.groupBy(*AGENT, "mode").agg(steps, error.alias("_e"))
    else:
        raise ValueError(f"unknown criterion: {criterion}")
    return modes.groupBy(*AGENT).agg(F.min_by("path", F.struct("_e", "mode")).alias("path"))


def _chosen(pred, truth, criterion, prob, best=None) -> DataFrame:
    """The chosen mode's steps of every agent, a row for each."""
    return chosen_paths(pred, truth, criterion, prob, best).select(*AGENT, F.inline("path"))


def min_apde(pred, truth, criterion="FDE", prob=None, best=None) -> DataFrame:
    """Mean over predicted valid steps of the least distance to any valid step of the truth."""
    t = truth.where("valid").select(*AGENT, F.col("t"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    seen = t.groupBy(*AGENT).agg(F.collect_list(F.struct("t", "tx", "ty")).alias("seen"))
    p = meet(chosen_paths(pred, truth, criterion, prob, best), seen, list(AGENT))

    def nearest(step: Column) -> Column:
        return F.array_min(F.transform("seen", lambda q: distance(step["x"], step["y"], q["tx"], q["ty"])))

    valid = F.filter("path", lambda s: F.exists("seen", lambda q: q["t"] == s["t"]))
    each = p.select(*AGENT, F.transform(valid, nearest).alias("d")).where(F.size("d") > 0)
    total = F.aggregate("d", F.lit(0.0), lambda acc, d: acc + d)
    return mean(each.select((total / F.size("d")).alias("apde")), "apde", "min_apde")


def collision_rate(pred, truth, criterion="FDE", prob=None, threshold: float = 1.0, best=None) -> DataFrame:
    """Pairs of agents of a scenario nearer than the threshold (but not at one place), over all steps and pairs.

    Hits and pairs are summed over all scenarios and divided once, so a scenario of one agent adds nothing;
    the mask decides on the mode only.  ``collision_rate`` is null where there is no pair.
    """
    paths = written(chosen_paths(pred, truth, criterion, prob, best), "paths")  # pairs and their count both read it
    size = paths.groupBy("scenario_id").agg(F.count("*").alias("n"), F.max(F.size("path")).alias("steps"))
    pairs = size.select(F.lit(0).cast("long").alias("hits"), (F.col("steps") * F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))
    c = paths.select(*AGENT, F.inline("path"))
    a = c.select("scenario_id", "t", F.col("agent_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = c.select("scenario_id", "t", F.col("agent_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = within(a, b, threshold, ("scenario_id", "t")).where((F.col("a") < F.col("b")) & (F.col("d") > 0) & (F.col("d") < threshold))
    hits = near.agg(F.count("*").alias("hits")).withColumn("pairs", F.lit(0).cast("long"))
    both = hits.unionByName(pairs).agg(F.sum("hits").alias("n_hits"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"))
    return both.select(F.try_divide("n_hits", "n_pairs").alias("collision_rate"), "n_hits", "n_pairs")


def min_brier(pred, truth, prob, criterion="FDE", logits: bool = False, best=None) -> DataFrame:
    """``(1 - p) * FDE`` of the chosen mode; logits become probabilities by the logistic function."""
    if prob is None:
        raise ValueError("probabilities are needed")
    p = prob.withColumn("prob", sigmoid(F.col("prob"))) if logits else prob
    chosen = meet(best_mode(mode_errors(pred, truth), criterion, prob, best), p, [*AGENT, "mode"])
    return mean(chosen, (1 - F.col("prob")) * F.col("fde"), "min_brier")


def softmax(prob: DataFrame) -> DataFrame:
    w = W.partitionBy(*AGENT)
    e = F.exp(F.col("prob") - F.max("prob").over(w))
    return prob.withColumn("_e", e).withColumn("prob", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def exp_de(pred, truth, prob=None, criterion="FDE", logits: bool = False) -> DataFrame:
    """The expected error over modes; equal weights where no probabilities are given."""
    scored = mode_errors(pred, truth).withColumn("err", F.col(criterion.lower()))
    if prob is None:
        each = scored.groupBy(*AGENT).agg(F.avg("err").alias("v"))
    else:
        each = meet(scored, softmax(prob) if logits else prob, [*AGENT, "mode"]).groupBy(*AGENT).agg(F.sum(F.col("err") * F.col("prob")).alias("v"))
    return mean(each, "v", "exp_de")


LOG_2PI = math.log(2 * math.pi)


def log_density(dx: Column, dy: Column, family: str, scale: dict[str, Column]) -> Column:
    """Log-density of an offset: independent ``normal`` or ``laplace`` (sx, sy), or ``mvn`` (s11, s12, s22)."""
    if family == "normal":
        return -(dx * dx / (scale["sx"] * scale["sx"]) + dy * dy / (scale["sy"] * scale["sy"])) / 2 - F.log(scale["sx"]) - F.log(scale["sy"]) - F.lit(LOG_2PI)
    if family == "laplace":
        return -F.abs(dx) / scale["sx"] - F.abs(dy) / scale["sy"] - F.log(2 * scale["sx"]) - F.log(2 * scale["sy"])
    if family == "mvn":
        det = scale["s11"] * scale["s22"] - scale["s12"] * scale["s12"]
        square = (scale["s22"] * dx * dx - 2 * scale["s12"] * dx * dy + scale["s11"] * dy * dy) / det
        return -square / 2 - F.log(det) / 2 - F.lit(LOG_2PI)
    raise ValueError(f"unknown distribution: {family}")


def nll(pred, truth, family: str, scale: dict[str, Column], prob=None, masked: bool = True) -> DataFrame:
    """Negative log-likelihood of a mixture over modes at each valid step, averaged over steps, then over agents.

    ``masked=False`` sums the values of all steps, valid or not, and divides by the number of valid ones.
    """
    if not masked:
        count = truth.groupBy(*AGENT).agg(F.count_if("valid").alias("_n"))
        every = _step_likelihood(pred, truth.withColumn("valid", F.lit(True)), family, scale, prob)
        summed = every.groupBy(*AGENT).agg(F.sum("l").alias("_s"))
        summed = meet(summed, count, list(AGENT)).where("_n > 0")
        return mean(summed.select((-F.col("_s") / F.col("_n")).alias("nll")), "nll", "nll")
    steps = _step_likelihood(pred, truth, family, scale, prob)
    return mean(steps.groupBy(*AGENT).agg((-F.avg("l")).alias("nll")), "nll", "nll")


def _step_likelihood(pred, truth, family, scale, prob) -> DataFrame:
    """``l``: the mixture's log-likelihood at each valid step of each agent."""
    e = errors(pred, truth)
    e = e.withColumn("_l", log_density(F.col("tx") - F.col("x"), F.col("ty") - F.col("y"), family, scale))
    if prob is None:
        step = W.partitionBy(*AGENT, "t")
        e = e.withColumn("_l", e["_l"] - F.log(F.count("*").over(step)))
    else:
        e = meet(e.select(*AGENT, "mode", "t", "_l"), prob, [*AGENT, "mode"]).withColumn("_l", F.col("_l") + F.log("prob"))
    top = F.max("_l").over(W.partitionBy(*AGENT, "t"))
    return e.withColumn("_top", top).groupBy(*AGENT, "t").agg((F.max("_top") + F.log(F.sum(F.exp(F.col("_l") - F.col("_top"))))).alias("l"))


def ewta(pred, truth, winners: int, kind: str = "norm", delta: float = 1.0) -> DataFrame:
    """Mean over agents of the mean of the ``winners`` least summed errors of modes: norm, mse or huber."""
    e = errors(pred, truth)
    part = {
        "norm": F.col("d"),
        "mse": F.col("d") * F.col("d"),
        "huber": sum((F.when(F.abs(u) <= delta, u * u / 2).otherwise(delta * (F.abs(u) - delta / 2)) for u in (F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))), F.lit(0.0)),
    }[kind]
    modes = e.groupBy(*AGENT, "mode").agg(F.sum(part).alias("e"))
    rank = F.row_number().over(W.partitionBy(*AGENT).orderBy("e", "mode"))
    kept = modes.withColumn("_r", rank).where(F.col("_r") <= winners)
    return mean(kept.groupBy(*AGENT).agg(F.avg("e").alias("v")), "v", "ewta")


def masked_ade(pred, truth) -> DataFrame:
    """The distance averaged over all valid steps of all agents and modes at once."""
    return errors(pred, truth).agg(F.avg("d").alias("loss"), F.count("d").alias("n_steps"))


def last_valid(truth: DataFrame) -> DataFrame:
    """``last``: the last valid step of each agent, its last step where none is valid."""
    return truth.groupBy(*AGENT).agg(F.coalesce(F.max(F.when(F.col("valid"), F.col("t"))), F.max("t")).alias("last"))


class Running:
    """A metric over batches: ``update`` adds a batch's sum and count of a per-agent value, ``compute`` divides them.

    ``each(pred, truth, ...)`` gives a row for each agent with the value.  A batch is one small row; nothing else is kept.
    """

    def __init__(self, each, value: str):
        self.each, self.value = each, value
        self.parts: list[DataFrame] = []

    def update(self, *tables: DataFrame) -> None:
        self.parts.append(self.each(*tables).agg(F.sum(self.value).alias("s"), F.count(self.value).alias("n")))

    def compute(self) -> DataFrame:
        whole = self.parts[0]
        for part in self.parts[1:]:
            whole = whole.unionByName(part)
        return whole.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("value"), F.sum("n").alias("n"))

    def reset(self) -> None:
        self.parts = []
