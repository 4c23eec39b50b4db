"""Sliding windows, their agents, steps and masks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import distance
from ..session import pieces
from .kinematics import TRACK


@dataclass(frozen=True)
class Windows:
    """Frames of history and future, and the stride between starts (by position in the track)."""

    history: int
    future: int
    stride: int

    @property
    def last(self) -> int:
        return self.history + self.future


def starts(tracks: DataFrame, spec: Windows, keys=TRACK, prefix: bool = True, strict: bool = False) -> DataFrame:
    """Window starts of every track: ``keys.., start, pred_frame``.

    A start needs its final frame in the track.  prefix: starts after the first that lacks it are lost too.
    strict: all frames between are needed as well.
    """
    by = W.partitionBy(*keys).orderBy("frame")
    frames = tracks.select(*keys, "frame")
    seen = frames.withColumns(
        {
            "_pos": F.row_number().over(by) - 1,
            "_has": F.max(F.col("frame")).over(by.rangeBetween(spec.last, spec.last)).isNotNull(),
            "_whole": F.count("*").over(by.rangeBetween(0, spec.last)) == spec.last + 1,
        }
    )
    seen = seen.where(F.col("_pos") % spec.stride == 0)
    if prefix:
        seen = seen.withColumn("_has", F.min("_has").over(by.rowsBetween(W.unboundedPreceding, 0)))
    ok = F.col("_has") & F.col("_whole") if strict else F.col("_has")
    return seen.where(ok).select(*keys, F.col("frame").alias("start"), (F.col("frame") + spec.history).alias("pred_frame"))


def agents(windows: DataFrame, tracks: DataFrame, same_direction: bool = False) -> DataFrame:
    """The target (agent_idx 0) and the agents present at the last history frame, nearest ids first."""
    target = windows.withColumn("frame", F.col("pred_frame") - 1).withColumnRenamed("track_id", "target_id")
    here = tracks.select("rec_id", "frame", F.col("track_id"), *(["driving_direction"] if same_direction else []))
    if same_direction:
        own = tracks.select("rec_id", "frame", F.col("track_id").alias("target_id"), "driving_direction")
        target = target.join(own, ["rec_id", "frame", "target_id"])
    on = ["rec_id", "frame"] + (["driving_direction"] if same_direction else [])
    near = target.join(here, on).where(F.col("track_id") != F.col("target_id")).select("rec_id", "target_id", "start", "pred_frame", "track_id")
    own = target.select("rec_id", "target_id", "start", "pred_frame", F.col("target_id").alias("track_id"))
    order = W.partitionBy("rec_id", "target_id", "start").orderBy(F.col("track_id") != F.col("target_id"), "track_id")
    return own.unionByName(near).withColumn("agent_idx", (F.row_number().over(order) - 1).cast("int"))


def track_arrays(tracks: DataFrame, features=("x", "y")) -> DataFrame:
    """``rec_id, track_id, first, path``: one row per track; ``path`` has a struct for each frame from ``first`` on.

    Frames that a track lacks are null; of rows with equal frames the least counts.  A track is one row: some tens
    of bytes for each of its frames.
    """
    whole = tracks.groupBy(*TRACK).agg(F.array_sort(F.collect_list(F.struct("frame", *features))).alias("_rows"))
    whole = whole.withColumn("_rows", F.filter("_rows", lambda r, i: (i == 0) | (F.get("_rows", i - 1)["frame"] < r["frame"])))
    kinds = {f.name: f.dataType.simpleString() for f in tracks.schema.fields}
    none = F.lit(None).cast(f"struct<{','.join(f'{f}:{kinds[f]}' for f in features)}>")

    def filled(r, i):
        gap = F.coalesce(F.get("_rows", i + 1)["frame"] - r["frame"] - 1, F.lit(0)).cast("int")
        return F.concat(F.array(F.struct(*(r[f].alias(f) for f in features))), F.array_repeat(none, gap))

    return whole.select(*TRACK, F.col("_rows")[0]["frame"].alias("first"), F.flatten(F.transform("_rows", filled)).alias("path"))


def agent_steps(members: DataFrame, tracks: DataFrame, spec: Windows, features=("x", "y")) -> DataFrame:
    """Members with ``steps``: an array of ``spec.last`` structs of features, null where the agent is missing.

    Members meet whole tracks by an equality of ids; steps are cut out by their place and never exploded.
    """
    at = lambda t: F.get("path", (F.col("start") + t - F.col("first")).cast("int"))
    grid = F.sequence(F.lit(0), F.lit(spec.last - 1))
    whole, n = track_arrays(tracks, features), pieces(members, 4)
    if n > members.sparkSession.sparkContext.defaultParallelism:
        members, whole = members.repartition(n, *TRACK), whole.repartition(n, *TRACK)
    return members.join(whole, list(TRACK)).withColumn("steps", F.transform(grid, at)).drop("path", "first")


def long(rows: DataFrame, spec: Windows, features=("x", "y")) -> DataFrame:
    """One row for each agent and step, ``t`` and ``part``; arrays of masks become columns."""
    masks = [c for c in MASKS if c in rows.columns]
    keep = [c for c in rows.columns if c not in ("steps", *masks)]
    flat = rows.select(*keep, F.posexplode(F.arrays_zip("steps", *masks)).alias("t", "_s"))
    part = F.when(F.col("t") < spec.history, "inp").otherwise("trg")
    return flat.select(*keep, "t", part.alias("part"), *(F.col("_s.steps")[f].alias(f) for f in features), *(F.col("_s")[m].alias(m) for m in masks))


def steps(members: DataFrame, tracks: DataFrame, spec: Windows, features=("x", "y")) -> DataFrame:
    """One row for each agent and step of each window; features are null where the agent is missing."""
    return long(agent_steps(members, tracks, spec, features), spec, features)


SAMPLE = ("rec_id", "target_id", "start")
AGENT = (*SAMPLE, "track_id")
MASKS = ("mask", "sa_mask", "ma_mask")


def with_masks(rows: DataFrame, spec: Windows, least_future: int, k: int = 8, threshold: int = 3, features=("x", "y"), category: str | None = None, skip_static: bool = False) -> DataFrame:
    """Masks of agent_steps() as arrays by step: ``mask`` (all features there), ``sa_mask`` (of the target), ``ma_mask``.

    An agent can be scored if it has ``least_future`` valid future steps and moves: more than ``threshold`` distinct x,
    those of history and future added up, each missing one counting as distinct.  Of those that can, the k nearest to
    the target at the last history step are, the target included; missing places are farthest and ties go by id.
    With ``category``, agents of a category above 1 are scored instead.  ``skip_static`` leaves out the samples whose
    target does not move.  Rows are ranked by sample, one for each agent, whatever the number of steps.
    """

    def present(s):
        ok = s[features[0]].isNotNull()
        for f in features[1:]:
            ok = ok & s[f].isNotNull()
        return F.coalesce(ok, F.lit(False))

    def spread(part):
        xs = F.transform(part, lambda s: s["x"])
        return F.size(F.array_distinct(F.filter(xs, lambda x: x.isNotNull()))) + F.size(F.filter(xs, lambda x: x.isNull()))

    history, future = F.slice("steps", 1, spec.history), F.slice("steps", spec.history + 1, spec.future)
    own = F.col("track_id") == F.col("target_id")
    last = F.get("steps", F.lit(spec.history - 1))
    out = rows.withColumns({"mask": F.transform("steps", present), "_moves": spread(history) + spread(future) > threshold, "_x": last["x"], "_y": last["y"]})
    if category is None:
        seen = F.size(F.filter(F.slice("mask", spec.history + 1, spec.future), lambda m: m))
        out = out.withColumn("_can", (seen >= least_future) & F.col("_moves"))
    else:
        out = out.withColumn("_can", F.coalesce(F.col(category) > 1, F.lit(False)))
    sample = W.partitionBy(*SAMPLE)
    of_target = lambda c: F.max(F.when(own, F.col(c))).over(sample)
    out = out.withColumns({"_tx": of_target("_x"), "_ty": of_target("_y")} | ({"_tm": of_target("_moves")} if skip_static else {}))
    if skip_static:
        out = out.where("_tm").drop("_tm")
    scored = F.col("_can")
    if category is None:
        away = distance(F.col("_x"), F.col("_y"), F.col("_tx"), F.col("_ty"))
        rank = F.row_number().over(sample.orderBy(F.col("_can").desc(), away.asc_nulls_last(), F.col("track_id")))
        out = out.withColumn("_r", rank)
        scored = scored & (F.col("_r") <= k)
    chosen = out.withColumn("_s", scored)
    chosen = chosen.withColumns({"sa_mask": F.transform("mask", lambda m: m & own), "ma_mask": F.transform("mask", lambda m: m & F.col("_s"))})
    return chosen.drop("_moves", "_x", "_y", "_can", "_tx", "_ty", "_r", "_s")


def balanced_starts(windows: DataFrame, maneuver: Column, keys=TRACK, keep_code: int = 3) -> DataFrame:
    """All lane-change starts and as many evenly spread lane-keep starts (five at most where there is no change)."""
    by = W.partitionBy(*keys)
    kept = maneuver == keep_code
    n_lk, n_lc = F.count_if(kept).over(by), F.count_if(~kept).over(by)
    out = windows.withColumns({"_lk": kept, "_nlk": n_lk, "_nlc": n_lc})
    keep = F.when(F.col("_nlc") > 0, F.least("_nlc", "_nlk")).otherwise(F.least(F.col("_nlk"), F.lit(5)))
    k = F.greatest(F.ceil(F.col("_nlk") / (keep + 1)), F.lit(1))
    pos = F.row_number().over(W.partitionBy(*keys, "_lk").orderBy("start")) - 1
    return out.withColumns({"_k": k, "_pos": pos}).where(~F.col("_lk") | (F.col("_pos") % F.col("_k") == 0)).drop("_lk", "_nlk", "_nlc", "_k", "_pos")


def lane_keep_targets(meta: DataFrame, seed: int = 42) -> DataFrame:
    """All tracks with lane changes, and max(n // 10, 5) of the others by a hash of the id."""
    by = W.partitionBy("rec_id")
    changes = F.count_if(F.col("num_lane_changes") > 0).over(by)
    out = meta.withColumns({"_n": changes, "_h": F.crc32(F.concat_ws(":", F.lit(seed), F.col("track_id")).cast("binary")), "_lc": F.col("num_lane_changes") > 0})
    rank = F.row_number().over(W.partitionBy("rec_id", "_lc").orderBy("_h", "track_id"))
    return out.withColumn("_r", rank).where(F.col("_lc") | (F.col("_r") <= F.greatest(F.floor(F.col("_n") / 10), F.lit(5)))).drop("_n", "_h", "_lc", "_r")


def longest_target(tracks: DataFrame, case: str, time: str = "frame") -> DataFrame:
    """The track of longest duration in each case, the first to appear on ties; none if no duration is positive."""
    spans = tracks.groupBy(case, "track_id").agg((F.max(time) - F.min(time)).alias("duration"), F.min(time).alias("first"))
    best = spans.where("duration > 0").groupBy(case).agg(F.min_by("track_id", F.struct(-F.col("duration"), "first", "track_id")).alias("target_id"))
    return best


def pedestrian_windows(tracks: DataFrame, observe: int, predict: int, skip: int = 1, least: int = 1, all_valid: bool = False, many: bool = True, scene: str = "rec_id") -> DataFrame:
    """``scene, start, target_id, n_agents``: windows with enough agents valid at the prediction step and a whole one."""
    span = observe + predict
    top = F.max("frame").over(W.partitionBy(scene))
    at = tracks.select(scene, "track_id", "frame", top.alias("_top"))
    low = F.greatest(F.ceil((F.col("frame") - span + 1) / skip).cast("int"), F.lit(0))
    high = F.floor(F.least(F.col("frame"), F.col("_top") - span + 1) / skip).cast("int")
    grid = at.where(low <= high).withColumn("start", F.explode(F.sequence(low, high)) if skip == 1 else F.explode(F.transform(F.sequence(low, high), lambda i: i * skip)))
    each = grid.groupBy(scene, "start", "track_id").agg(F.count("*").alias("n"), F.bool_or(F.col("frame") == F.col("start") + observe - 1).alias("now"))
    ok = F.col("now") & (F.col("n") == span) if all_valid else F.col("now")
    sample = W.partitionBy(scene, "start")
    each = each.withColumns({"n_agents": F.count_if(ok).over(sample).cast("int"), "_whole": F.col("n") == span})
    out = each.where((F.col("n_agents") >= least) & F.col("_whole"))
    if not many:
        out = out.withColumn("_r", F.row_number().over(sample.orderBy("track_id"))).where("_r = 1")
    return out.select(scene, "start", F.col("track_id").alias("target_id"), "n_agents")


def nested(rows: DataFrame, spec: Windows, features=("x", "y"), extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per sample of with_masks() rows: agents in the order of their index, the target first.

    ``num_nodes, ta_index, ids``, then for each feature ``inp_<feature>`` and ``trg_<feature>`` (arrays by agent and
    step, missing values as zeros), ``input_mask``, ``valid_mask``, ``sa_mask`` and ``ma_mask`` (the last three of future
    steps), and an array by agent of each of ``extra`` (such as agent types or intentions).
    """
    last = (spec.history + 1, spec.future)
    filled_with = lambda f: F.transform("steps", lambda s: F.coalesce(s[f], F.lit(0.0)))
    cut = {}
    for f in features:
        filled = filled_with(f)
        cut |= {f"inp_{f}": F.slice(filled, 1, spec.history), f"trg_{f}": F.slice(filled, *last)}
    cut |= {"input_mask": F.slice("mask", 1, spec.history), "valid_mask": F.slice("mask", *last), "sa_mask": F.slice("sa_mask", *last), "ma_mask": F.slice("ma_mask", *last)}
    member = F.struct("agent_idx", "track_id", *(c.alias(n) for n, c in cut.items()), *extra)
    whole = rows.groupBy(*SAMPLE).agg(F.array_sort(F.collect_list(member)).alias("_a"))
    return whole.select(*SAMPLE, F.size("_a").alias("num_nodes"), F.lit(0).alias("ta_index"), F.col("_a.track_id").alias("ids"), *(F.col("_a")[c].alias(c) for c in (*cut, *extra)))


def with_map(samples: DataFrame, nodes: DataFrame, edges: DataFrame, key: str = "map_id") -> DataFrame:
    """Samples with their map: ``map_points`` (``x, y, node_type`` in the order of node_idx) and ``map_edges`` (``src, dst, edge_type``).

    A sample whose map is missing has empty arrays.
    """
    points = nodes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("node_idx", "x", "y", "node_type"))).alias("_p"))
    points = points.select(key, F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["node_type"].alias("node_type"))).alias("map_points"))
    lines = edges.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("src", "dst", "edge_type"))).alias("map_edges"))
    both = samples.join(points.join(lines, key, "left"), key, "left")
    return both.withColumns({"map_points": F.coalesce("map_points", F.array()), "map_edges": F.coalesce("map_edges", F.array())})


@dataclass(frozen=True)
class Sampling:
    """How a kind of recording is sampled: rate (Hz), seconds of history and future, strides in frames."""

    rate: float
    downsample: float
    history: float
    future: float
    stride: int
    keep_stride: int | None = None
    ego_only: bool = False
    more_history: int = 0

    def windows(self, keep: bool = False) -> Windows:
        """The windows; with ``keep`` the stride of lane-keeping targets."""
        stride = self.keep_stride if keep and self.keep_stride else self.stride
        return Windows(int(self.rate * self.history) + self.more_history, int(self.rate * self.future), stride)


# Sampling of each kind of recording (a stride of 1 where there is one window for each case, file or scene).
SAMPLING = {
    "rounD": Sampling(25, 5, 3, 5, 12), "inD": Sampling(25, 5, 3, 5, 25), "uniD": Sampling(25, 5, 3, 5, 25), "SIND": Sampling(10, 2, 3, 5, 25),
    "highD": Sampling(25, 5, 2, 5, 12, 25), "exiD": Sampling(25, 5, 2, 5, 12, 25), "A43": Sampling(10, 2, 2, 5, 10, 25), "i80": Sampling(10, 2, 2, 5, 10, 40),
    "us101": Sampling(10, 2, 2, 5, 10, 40), "ad4che": Sampling(30, 6, 2, 5, 30, 45), "interact": Sampling(10, 2, 1, 3, 1), "argoverse": Sampling(10, 2, 2, 3, 1),
    "av2": Sampling(10, 2, 5, 6, 1), "waymo": Sampling(10, 2, 1, 8, 1, more_history=1), "nuscenes": Sampling(5, 1, 2, 6, 1), "vod": Sampling(10, 2, 0.5, 3, 5),
    "lyft": Sampling(10, 2, 2, 5, 20, ego_only=True), "openDD": Sampling(30, 6, 2, 5, 75), "apollo": Sampling(5, 1, 2, 3, 10),
}


def fixed_windows(targets: DataFrame, spec: Windows, start: Column | int = 0) -> DataFrame:
    """One window for each target (``rec_id, track_id``), from a fixed frame or a column such as the target's first frame."""
    first = F.lit(start) if isinstance(start, int) else start
    return targets.select(*TRACK, first.cast("int").alias("start"), (first + spec.history).cast("int").alias("pred_frame"))


def present_agents(windows: DataFrame, tracks: DataFrame) -> DataFrame:
    """The target (agent_idx 0) and every other agent of its recording that appears before the prediction frame, by id."""
    first = tracks.groupBy(*TRACK).agg(F.min("frame").alias("_f")).select("rec_id", F.col("track_id"), "_f")
    target = windows.withColumnRenamed("track_id", "target_id")
    both = target.join(first, "rec_id").where((F.col("_f") < F.col("pred_frame")) | (F.col("track_id") == F.col("target_id")))
    order = W.partitionBy("rec_id", "target_id", "start").orderBy(F.col("track_id") != F.col("target_id"), "track_id")
    return both.select("rec_id", "target_id", "start", "pred_frame", "track_id").withColumn("agent_idx", (F.row_number().over(order) - 1).cast("int"))


def only_ego(targets: DataFrame, ego_only: bool, ego: int = 0) -> DataFrame:
    """The ego vehicle alone, or all targets."""
    return targets.where(F.col("track_id") == ego) if ego_only else targets
