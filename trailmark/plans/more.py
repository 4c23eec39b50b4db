"""Queries of stores, streams and the smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, geometry
from ..operators import filters as P
from ..operators import lanes as L
from ..operators import metrics as M
from ..functions import grouped as U
from ..operators import sampling as S
from ..session import fresh as scratch
from ..sources import sinks
from ..sources import trajectories as T
from ..streaming import metrics as stream
from .motion import _r
from .views import LANES, PRED, TR, on_lanes, prediction_tables, query, table, tracks


@query("src_whitespace_text", f"WITH {TR} SELECT frame, track_id, CASE WHEN y < 50 THEN 'car' ELSE 'pedestrian' END AS agent_type, x, y FROM tr")
def src_whitespace_text(spark, sf_dir):
    """Tracks written as blank-separated text and read again."""
    path = scratch(spark, "text")
    kind = F.when(F.col("y") < 50, 1).otherwise(3)
    zero = [F.lit("0.5")] * 5
    tracks(spark, sf_dir).select(F.concat_ws(" ", "frame", "track_id", kind, "x", "y", *zero).alias("value")).write.text(path)
    return T.whitespace_text(spark, path).select("frame", "track_id", "agent_type", "x", "y")


@query("src_cases_csv", f"WITH {TR} SELECT rec_id AS case_id, track_id, frame, CASE WHEN event_type = 'click' THEN 'pedestrian' ELSE 'car' END AS agent_type, x FROM tr")
def src_cases_csv(spark, sf_dir):
    path = scratch(spark, "cases")
    kind = F.when(F.col("event_type") == "click", "pedestrian/bicycle").otherwise("car")
    rows = tracks(spark, sf_dir).select(F.col("rec_id").cast("double").alias("case_id"), "track_id", F.col("frame").alias("frame_id"), (F.col("frame") * 100).alias("timestamp_ms"), kind.alias("agent_type"), "x", "y", F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"))
    rows.write.option("header", True).csv(path)
    return T.cases(spark, path).select("case_id", "track_id", "frame", "agent_type", "x")


@query("src_staged_csv", f"WITH {TR} SELECT 'scene-' || rec_id AS scene_name, frame, track_id::VARCHAR AS track_id, x, y FROM tr WHERE rec_id % 7 <> 6 AND event_type <> 'error'")
def src_staged_csv(spark, sf_dir):
    """Scenes of published lists staged as CSV, read again without second ego vehicles."""
    path = scratch(spark, "scenes")
    category = F.when(F.col("event_type") == "error", "vehicle.ego").otherwise("vehicle.car")
    none = [F.lit("u").alias(c) for c in ("agent_type", "status", "full_status", "map")]
    t = tracks(spark, sf_dir)
    rows = t.select("frame", F.col("track_id").cast("string").alias("track_id"), "x", "y", none[0], category.alias("full_category"), *none[1:], F.concat(F.lit("scene-"), "rec_id").alias("scene_name"))
    every = sorted(r[0] for r in t.select("rec_id").distinct().collect())  # published lists name each scene
    named = [f"scene-{i}" for i in every if i % 7 != 6]
    sinks.stage_scenes(rows, {"train": named[::2] + named[:1], "val": named[1::2]}, path)
    return T.staged_scenes(spark, f"{path}/*/*", ego=False).select("scene_name", "frame", "track_id", "x", "y")


@query("sample_store", f"WITH {TR} SELECT CASE WHEN track_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n, sum(start)::BIGINT AS s FROM (SELECT track_id, min(frame) AS start FROM tr GROUP BY 1) GROUP BY 1")
def sample_store(spark, sf_dir):
    """Samples written by split and read again."""
    path = scratch(spark, "samples")
    meta = P.meta(tracks(spark, sf_dir)).select("rec_id", F.col("track_id").alias("target_id"), F.col("initial_frame").alias("start"))
    sinks.write_samples(meta.withColumn("split", F.when(F.col("target_id") % 5 == 0, "val").otherwise("train")), path)
    parts = [sinks.read_samples(spark, path, s) for s in ("train", "val")]
    return parts[0].unionByName(parts[1]).groupBy("split").agg(F.count("*").alias("n"), F.sum("start").alias("s"))


@query("metrics_store", f"WITH {PRED} SELECT round(avg(ade), 6) AS min_ade, count(*)::INTEGER AS n_agents FROM best")
def metrics_store(spark, sf_dir):
    path = scratch(spark, "metrics")
    truth, pred, _ = prediction_tables(spark, sf_dir)
    sinks.write_metrics(M.min_ade(pred, truth).select(F.round("min_ade", 6).alias("min_ade"), "n_agents"), path)
    return spark.read.option("header", True).schema("min_ade double, n_agents int").csv(path)


@query("stream_metrics", f"WITH {PRED} SELECT scenario_id, agent_id, mode, round(ade, 6) AS ade, round(fde, 6) AS fde FROM me")
def stream_metrics(spark, sf_dir):
    """Errors per step, streamed from a folder: the sums of its batches equal the batch metric."""
    path, sums = scratch(spark, "steps"), scratch(spark, "sums")
    truth, pred, _ = prediction_tables(spark, sf_dir)
    M.errors(pred, truth).select("scenario_id", "agent_id", "mode", F.col("t").cast("int").alias("t"), "d").write.parquet(path)
    stream.run_to_folder(stream.step_stream(spark, path), sums, scratch(spark, "stream"))
    return stream.errors_so_far(spark, sums).select("scenario_id", "agent_id", "mode", *_r("ade", "fde"))


@query("enu_ecef", "SELECT event_id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM (SELECT event_id, value AS e, event_id % 50 AS n, 1.5::DOUBLE AS u, radians(37.0) AS p, radians(-122.0) AS q, 0.0066943799901413165::DOUBLE AS e2 FROM events), LATERAL (SELECT 6378137.0::DOUBLE / sqrt(1 - e2 * sin(p) * sin(p)) AS c), LATERAL (SELECT c * cos(p) * cos(q) - e * sin(q) - n * sin(p) * cos(q) + u * cos(p) * cos(q) AS x, c * cos(p) * sin(q) + e * cos(q) - n * sin(p) * sin(q) + u * cos(p) * sin(q) AS y, c * (1 - e2) * sin(p) + n * cos(p) + u * sin(p) AS z)")
def enu_ecef(spark, sf_dir):
    x, y, z = geometry.enu_to_ecef(F.col("value"), F.col("event_id") % 50, F.lit(1.5), 37.0, -122.0)
    return table(spark, sf_dir, "events").select("event_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(z, 4).alias("z"))


@query("world_transform", "SELECT event_id, round(value * 2 - event_id % 7 + 0.5 * 3 + 10, 6) AS x, round(value + (event_id % 7) * 4 - 20, 6) AS y FROM events")
def world_transform(spark, sf_dir):
    m = [[2, -1, 0.5, 10], [1, 4, 0, -20], [0, 0, 1, 0], [0, 0, 0, 1]]
    x, y, _ = geometry.transform4(F.col("value"), F.col("event_id") % 7, F.lit(3.0), m)
    return table(spark, sf_dir, "events").select("event_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("loss_gmm_nll", f"""WITH {PRED}, lp AS (SELECT scenario_id, agent_id, mode, prob - ln(sum(exp(prob)) OVER (PARTITION BY scenario_id, agent_id)) AS lp FROM prob),
l AS (SELECT scenario_id, agent_id, t, -(0.7 * (tx - x) * (tx - x) - 0.4 * (tx - x) * (ty - y) + 0.5 * (ty - y) * (ty - y)) / 0.31 / 2 - ln(0.31) / 2 - 1.8378770664093453 + lp AS l FROM err JOIN lp USING (scenario_id, agent_id, mode)),
s AS (SELECT scenario_id, agent_id, t, max(l) + ln(sum(exp(l - m))) AS v FROM (SELECT *, max(l) OVER (PARTITION BY scenario_id, agent_id, t) AS m FROM l) GROUP BY ALL)
SELECT round(avg(a), 6) AS nll, count(*) AS n_agents FROM (SELECT -avg(v) AS a FROM s GROUP BY scenario_id, agent_id)""")  # fmt: skip
def loss_gmm_nll(spark, sf_dir):
    """The mixture loss from logits: a softmax, then the mixture's likelihood, masked."""
    truth, pred, prob = prediction_tables(spark, sf_dir)
    scale = {"s11": F.lit(0.5), "s12": F.lit(0.2), "s22": F.lit(0.7)}
    return M.nll(pred, truth, "mvn", scale, M.softmax(prob)).select(F.round("nll", 6).alias("nll"), "n_agents")


@query("fixed_windows", f"WITH {TR} SELECT track_id, 1 AS start, 7 AS pred_frame FROM tr GROUP BY track_id HAVING min(frame) = 1 AND max(frame) >= 60")
def fixed_windows(spark, sf_dir):
    """One window per track at a fixed place: history 1..6, prediction from 7, final frame 60."""
    spec = S.Windows(6, 53, 1_000_000)
    return S.starts(tracks(spark, sf_dir), spec).where("start = 1").select("track_id", F.col("start").cast("int").alias("start"), "pred_frame")


@query("any_all_predicates", f"WITH {TR} SELECT track_id, bool_or(y > 98) AS some, bool_and(y < 99) AS every, count_if(event_type = 'click')::BIGINT AS n FROM tr GROUP BY 1")
def any_all_predicates(spark, sf_dir):
    return tracks(spark, sf_dir).groupBy("track_id").agg(F.bool_or(F.col("y") > 98).alias("some"), F.bool_and(F.col("y") < 99).alias("every"), F.count_if(F.col("event_type") == "click").alias("n"))


@query("last_valid_step", f"WITH {PRED} SELECT scenario_id, agent_id, coalesce(max(t) FILTER (valid AND t < 3), 9)::INTEGER AS last FROM truth GROUP BY ALL")
def last_valid_step(spark, sf_dir):
    truth = prediction_tables(spark, sf_dir)[0]
    return M.last_valid(truth.withColumn("valid", F.col("valid") & (F.col("t") < 3))).select("scenario_id", "agent_id", F.col("last").cast("int").alias("last"))


@query("category_mask", f"WITH {PRED} SELECT scenario_id, agent_id, t::INTEGER AS t, (agent_id % 4 > 1 AND valid) AS mask FROM truth")
def category_mask(spark, sf_dir):
    truth = prediction_tables(spark, sf_dir)[0]
    return truth.select("scenario_id", "agent_id", F.col("t").cast("int").alias("t"), codes.category_mask(F.col("agent_id") % 4, F.col("valid")).alias("mask"))


@query("direction_map_choice", f"WITH {LANES} SELECT track_id, frame, CASE WHEN driving_direction = 1 THEN 'upper' ELSE 'lower' END AS map_id, track_id + 1 AS shifted FROM ln")
def direction_map_choice(spark, sf_dir):
    return on_lanes(spark, sf_dir).select("track_id", "frame", L.map_of_direction(F.col("driving_direction")).alias("map_id"), (F.col("track_id") + 1).alias("shifted"))


@query("configuration_filter", f"WITH {TR} SELECT rec_id, count(*) AS n FROM tr WHERE rec_id % 3 <> 1 GROUP BY 1")
def configuration_filter(spark, sf_dir):
    """Recordings that a configuration, which names them all, includes."""
    t = tracks(spark, sf_dir)
    recordings = {r[0]: {"include": r[0] % 3 != 1} for r in t.select("rec_id").distinct().collect()}
    return P.included(t, "rec_id", recordings).groupBy("rec_id").agg(F.count("*").alias("n"))


@query("column_selection", f"WITH {TR} SELECT track_id, frame, 0.0::DOUBLE AS ax, 1 AS driving_direction, lower(upper(event_type)) AS kind, split_part(event_type || '_x', '_', 1) AS head, starts_with(event_type, 'c') AS c FROM tr")
def column_selection(spark, sf_dir):
    t = tracks(spark, sf_dir).drop("first_type", "not_there")
    return t.select("track_id", "frame", F.lit(0.0).alias("ax"), F.lit(1).alias("driving_direction"), F.lower(F.upper("event_type")).alias("kind"), F.substring_index(F.concat("event_type", F.lit("_x")), "_", 1).alias("head"), F.startswith("event_type", F.lit("c")).alias("c"))


@query("distinct_classes", f"WITH {TR} SELECT DISTINCT track_id, event_type FROM tr")
def distinct_classes(spark, sf_dir):
    return tracks(spark, sf_dir).select("track_id", "event_type").distinct()


@query("recording_bounds", f"WITH {TR} SELECT rec_id, min(x) AS lo, max(x) AS hi, max(frame) AS last FROM tr GROUP BY 1")
def recording_bounds(spark, sf_dir):
    return tracks(spark, sf_dir).groupBy("rec_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("frame").alias("last"))


@query("zero_filled", f"WITH {TR} SELECT track_id, frame, coalesce(CASE WHEN y > 50 THEN x END, 0) AS x, y > 50 AS mask FROM tr")
def zero_filled(spark, sf_dir):
    x = F.when(F.col("y") > 50, F.col("x"))
    return tracks(spark, sf_dir).select("track_id", "frame", F.coalesce(x, F.lit(0.0)).alias("x"), x.isNotNull().alias("mask"))


@query("track_filter_udf", f"WITH {TR} SELECT track_id, frame, round(x - avg(x) OVER (PARTITION BY track_id), 6) AS dx FROM tr QUALIFY max(y) OVER (PARTITION BY track_id) > 98")
def track_filter_udf(spark, sf_dir):
    """Per-track transform and filter, as windows instead of functions of groups."""
    t = U.transform_groups(tracks(spark, sf_dir), ["track_id"], {"dx": F.col("x") - F.avg("x").over(U.group("track_id"))})
    return U.filter_groups(t, ["track_id"], F.max("y") > 98).select("track_id", "frame", F.round("dx", 6).alias("dx"))


@query("user_functions", f"WITH {TR} SELECT track_id, frame, round(sum(x) OVER (PARTITION BY track_id ORDER BY frame), 4) AS total, (frame * 2)::BIGINT AS twice FROM tr QUALIFY count(*) OVER (PARTITION BY track_id) % 2 = 0")
def user_functions(spark, sf_dir):
    """Functions of one's own on columns, groups, and frames of groups."""
    t = U.filter_with(tracks(spark, sf_dir).select("track_id", "frame", "x"), ["track_id"], lambda pdf: len(pdf) % 2 == 0)
    t = U.transform_with(t, ["track_id"], "frame", "x", lambda x: x.cumsum(), "total")
    return U.scalar(t, "frame", lambda f: f * 2, "twice", "bigint").select("track_id", "frame", F.round("total", 4).alias("total"), "twice")


@query("user_table_function", f"WITH {TR} SELECT track_id, i::INTEGER AS i, repeat('x', i::INTEGER) AS s FROM (SELECT track_id, unnest(range(0, (track_id % 4)::BIGINT)) AS i FROM (SELECT DISTINCT track_id FROM tr))")
def user_table_function(spark, sf_dir):
    """A generator of rows as a table function, joined laterally."""
    from ..sources.rows import register

    register(spark, "upward", lambda n: ((i, "x" * i) for i in range(n)), "i int, s string")
    tracks(spark, sf_dir).select("track_id").distinct().createOrReplaceTempView("track_ids")
    return spark.sql("SELECT track_id, i, s FROM track_ids, LATERAL upward(track_id % 4)")


@query("accumulated_metric", f"WITH {PRED} SELECT round(avg(ade), 6) AS value, count(*)::BIGINT AS n FROM best")
def accumulated_metric(spark, sf_dir):
    """A metric updated batch by batch and computed once."""
    truth, pred, _ = prediction_tables(spark, sf_dir)
    running = M.Running(lambda p, t: M.best_mode(M.mode_errors(p, t), "FDE"), "ade")
    for part in range(2):
        running.update(*(d.where(F.pmod("scenario_id", F.lit(2)) == part) for d in (pred, truth)))
    return running.compute().select(F.round("value", 6).alias("value"), "n")


@query("plugin_transforms", f"WITH {LANES} SELECT track_id, frame, round(vx, 6) AS vx, round(sqrt(x * x + y * y), 6) AS rho FROM ln")
def plugin_transforms(spark, sf_dir):
    """Transforms named in a configuration, composed."""
    from .. import operators
    from ..functions.plugins import load, pipeline

    spec = [{"module": f"{operators.__name__}.kinematics", "name": "with_velocity", "dt": 0.04}, {"module": f"{operators.__name__}.kinematics", "name": "with_polar", "x0": 0.0, "y0": 0.0}]
    assert callable(load(spec[0]["module"], spec[0]["name"]))
    return pipeline(tracks(spark, sf_dir), spec).select("track_id", "frame", *_r("vx", "rho"))

