"""Queries of motion features, lanes, directions and maneuvers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, geometry
from ..operators import kinematics as K
from ..operators import lanes as L
from .views import LANES, MV, TR, moving, on_lanes, query, tracks


def _r(*names: str, digits: int = 6) -> list:
    return [F.round(n, digits).alias(n) for n in names]


@query("kin_velocity", f"WITH {MV} SELECT track_id, frame, round(vx, 6) AS vx, round(vy, 6) AS vy FROM mv")
def kin_velocity(spark, sf_dir):
    return K.with_velocity(tracks(spark, sf_dir), 0.04).select("track_id", "frame", *_r("vx", "vy"))


@query("kin_acceleration", f"WITH {MV} SELECT track_id, frame, round(ax, 4) AS ax, round(ay, 4) AS ay FROM mv")
def kin_acceleration(spark, sf_dir):
    return moving(spark, sf_dir).select("track_id", "frame", *_r("ax", "ay", digits=4))


@query("kin_heading", f"WITH {MV} SELECT track_id, frame, round(psi, 6) AS psi, round(atan2(sin(radians(y * 7)), cos(radians(y * 7))), 6) AS wrapped FROM mv")
def kin_heading(spark, sf_dir):
    return moving(spark, sf_dir).withColumn("wrapped", geometry.heading_from_degrees(F.col("y") * 7)).select("track_id", "frame", *_r("psi", "wrapped"))


@query("kin_polar", f"WITH {TR} SELECT track_id, frame, round(sqrt((x - 3) * (x - 3) + (y - 50) * (y - 50)), 6) AS rho, round(atan2(y - 50, x - 3), 6) AS theta FROM tr")
def kin_polar(spark, sf_dir):
    return K.with_polar(tracks(spark, sf_dir), 3.0, 50.0).select("track_id", "frame", *_r("rho", "theta"))


@query("kin_speed_stats", f"""WITH {MV} SELECT first_type AS agent_type, round(max(sqrt(vx * vx + vy * vy)), 4) AS max_speed, round(avg(sqrt(vx * vx + vy * vy)), 4) AS mean_speed,
  round(median(sqrt(vx * vx + vy * vy)), 4) AS median_speed, count(DISTINCT track_id) AS n_tracks FROM mv GROUP BY 1""")  # fmt: skip
def kin_speed_stats(spark, sf_dir):
    out = K.speed_stats(moving(spark, sf_dir), "first_type")
    return out.select(F.col("first_type").alias("agent_type"), *_r("max_speed", "mean_speed", "median_speed", digits=4), "n_tracks")


@query("kin_turn_rate", f"WITH {MV} SELECT track_id, frame, round((vx * ay - vy * ax) / (sqrt(vx * vx + vy * vy) + 1e-6), 3) AS turn FROM mv")
def kin_turn_rate(spark, sf_dir):
    turn = geometry.angular_velocity(*(F.col(c) for c in ("vx", "vy", "ax", "ay")))
    return moving(spark, sf_dir).select("track_id", "frame", F.round(turn, 3).alias("turn"))


@query("origin_and_rebase", f"WITH {TR} SELECT track_id, frame, round(x - 2.5 - min(x - 2.5) OVER (PARTITION BY rec_id), 6) AS x, round(y - 10, 6) AS y FROM tr")
def origin_and_rebase(spark, sf_dir):
    moved = K.origin_shift(tracks(spark, sf_dir), F.lit(2.5), F.lit(10.0))
    return K.rebase(moved, "x").select("track_id", "frame", *_r("x", "y"))


@query("unit_axes", f"WITH {TR} SELECT track_id, frame, round(y * 0.3048, 6) AS x, round(-(x * 0.3048), 6) AS y FROM tr")
def unit_axes(spark, sf_dir):
    return K.unit_axes(tracks(spark, sf_dir)).select("track_id", "frame", *_r("x", "y"))


@query("seconds_to_frame", f"WITH {TR} SELECT track_id, frame, round_even(ceil(x * 10) / 10 / 0.1, 0)::INTEGER AS f FROM tr")
def seconds_to_frame(spark, sf_dir):
    return tracks(spark, sf_dir).select("track_id", "frame", geometry.seconds_to_frame(F.col("x")).alias("f"))


@query("class_codes", f"""WITH {TR} SELECT track_id, frame, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 5 ELSE 8 END AS code FROM tr""")
def class_codes(spark, sf_dir):
    name = codes.lookup({"view": "Car", "click": "truck", "purchase": "pedestrian", "signup": "tram"}, F.col("event_type"))
    return tracks(spark, sf_dir).select("track_id", "frame", codes.class_code(name).alias("code"))


@query("value_replacement", f"WITH {TR} SELECT track_id, frame, CASE event_type WHEN 'view' THEN 'vehicle' WHEN 'error' THEN 'static' ELSE event_type END AS kind FROM tr")
def value_replacement(spark, sf_dir):
    return tracks(spark, sf_dir).na.replace({"view": "vehicle", "error": "static"}, subset=["event_type"]).select("track_id", "frame", F.col("event_type").alias("kind"))


@query("dotted_category", f"""WITH {TR} SELECT track_id, frame, CASE WHEN event_type IN ('view', 'click') THEN CASE WHEN y % 3 = 0 THEN 'car' WHEN y % 3 = 1 THEN 'bus' ELSE 'undefined' END
  WHEN event_type = 'purchase' THEN 'pedestrian' ELSE 'undefined' END AS category FROM tr""")  # fmt: skip
def dotted_category(spark, sf_dir):
    first = F.when(F.col("event_type").isin("view", "click"), "vehicle").when(F.col("event_type") == "purchase", "human").otherwise("thing")
    name = F.concat_ws(".", first, codes.lookup({"0": "car", "1": "bus", "2": "ufo"}, (F.col("y") % 3).cast("int").cast("string")), F.lit("x"))
    table = {"vehicle": {"car": "car", "bus": "bus"}, "human": "pedestrian"}
    return tracks(spark, sf_dir).select("track_id", "frame", codes.dotted_category(name, table).alias("category"))


@query("first_status", f"WITH {TR} SELECT track_id, frame, CASE WHEN y < 50 THEN 'unknown' ELSE event_type END AS status FROM tr")
def first_status(spark, sf_dir):
    tokens = F.when(F.col("y") < 50, F.array().cast("array<string>")).otherwise(F.array("event_type", F.lit("later")))
    return tracks(spark, sf_dir).select("track_id", "frame", codes.first_status(tokens).alias("status"))


@query("scoring_category", f"""WITH {TR}, c AS (SELECT rec_id, track_id, CASE WHEN bool_or(event_type = 'purchase' AND y > 90) THEN 3 ELSE 0 END AS category FROM tr GROUP BY ALL)
SELECT track_id, category FROM (SELECT *, sum(category) OVER (PARTITION BY rec_id) AS s FROM c) WHERE s > 3""")  # fmt: skip
def scoring_category(spark, sf_dir):
    from pyspark.sql import Window as W

    of_interest = F.bool_or((F.col("event_type") == "purchase") & (F.col("y") > 90))
    each = tracks(spark, sf_dir).groupBy("rec_id", "track_id").agg(codes.scoring_category(of_interest).alias("category"))
    return each.withColumn("_s", codes.scored_categories(F.col("category"), ["rec_id"], W)).where("_s").select("track_id", "category")


@query("edge_type_codes", f"""WITH {TR} SELECT track_id, frame, CASE event_type WHEN 'view' THEN CASE WHEN y < 50 THEN 7 ELSE 6 END WHEN 'click' THEN CASE WHEN y < 50 THEN 9 ELSE 8 END
  WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 1 END AS edge_type FROM tr""")  # fmt: skip
def edge_type_codes(spark, sf_dir):
    kind = codes.lookup({"view": "line_thin", "click": "line_thick", "error": "fence", "signup": "curbstone"}, F.col("event_type"), "grass")
    sub = F.when(F.col("y") < 50, "dashed")
    return tracks(spark, sf_dir).select("track_id", "frame", codes.edge_type(kind, sub).alias("edge_type"))


@query("lane_change_count", f"""WITH {LANES} SELECT track_id, coalesce(sum(s), 0)::INTEGER AS num_lane_changes
FROM (SELECT track_id, abs(lane_id - lag(lane_id) OVER (PARTITION BY rec_id, track_id ORDER BY frame)) AS s FROM ln) GROUP BY 1""")  # fmt: skip
def lane_change_count(spark, sf_dir):
    return L.lane_changes(on_lanes(spark, sf_dir)).select("track_id", "num_lane_changes")


@query("lane_assign_fill", f"""WITH {TR}, a AS (SELECT *, CASE WHEN ceil(y / 20) BETWEEN 1 AND 3 THEN ceil(y / 20)::INTEGER END AS lane FROM tr),
z AS (SELECT *, last_value(lane) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final,
  last_value(lane IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f,
  first_value(lane IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM a)
SELECT track_id, frame, CASE WHEN final IS NULL THEN f ELSE b END AS lane_id FROM z""")  # fmt: skip
def lane_assign_fill(spark, sf_dir):
    t = tracks(spark, sf_dir).withColumn("lane_id", L.assign_lane(F.col("y"), 20.0, 3))
    return L.fill_lane(t).select("track_id", "frame", "lane_id")


@query("driving_direction", f"WITH {LANES} SELECT track_id, driving_direction FROM dir")
def driving_direction(spark, sf_dir):
    return L.driving_direction(tracks(spark, sf_dir)).select("track_id", "driving_direction")


_LABEL = """CASE WHEN g IS NULL THEN 3 ELSE (CASE WHEN g <= 4 THEN 0 WHEN g <= 14 THEN 1 ELSE 2 END) + (CASE WHEN side > 0 THEN 0 ELSE 4 END) END"""


def _maneuver_sql(source: str, event: str) -> str:
    """Rows joined to the events ahead of them; the last one within 5 s decides (fz = 5)."""
    return f"""e AS (SELECT *, row_number() OVER g AS p, {event} AS ev FROM {source} WINDOW g AS (PARTITION BY rec_id, track_id ORDER BY frame)),
lab AS (SELECT a.track_id, a.frame, max(b.p) - a.p AS g, arg_max(b.ev, b.p) AS side FROM e a LEFT JOIN e b
  ON a.track_id = b.track_id AND b.ev IS NOT NULL AND b.p > a.p AND b.p <= a.p + 24 GROUP BY a.track_id, a.frame, a.p)
SELECT track_id, frame, {_LABEL} AS maneuver FROM lab"""


_STEP = "lane_id - lag(lane_id) OVER g"


@query("maneuver_labels", f"WITH {LANES}, {_maneuver_sql('ln', f'CASE WHEN {_STEP} <> 0 THEN sign({_STEP}) * CASE WHEN driving_direction = 2 THEN -1 ELSE 1 END END')}")
def maneuver_labels(spark, sf_dir):
    return L.maneuvers(on_lanes(spark, sf_dir), 5).select("track_id", "frame", "maneuver")


_EXIT = "CASE WHEN lane_change = 1 AND coalesce(lag(lane_change) OVER g, 0) = 0 THEN coalesce(sign(x - lag(x) OVER g), 0) END"


@query("exit_maneuvers", f"WITH {TR}, ex AS (SELECT *, (y > 80)::INTEGER AS lane_change FROM tr), {_maneuver_sql('ex', _EXIT)}")
def exit_maneuvers(spark, sf_dir):
    t = tracks(spark, sf_dir).withColumns({"lane_change": (F.col("y") > 80).cast("int"), "lane_offset": F.col("x")})
    return L.exit_maneuvers(t, 5).select("track_id", "frame", "maneuver")


@query("lane_change_flags", f"WITH {TR} SELECT track_id, sum((y > 80)::INTEGER)::BIGINT AS n FROM tr GROUP BY 1")
def lane_change_flags(spark, sf_dir):
    return tracks(spark, sf_dir).groupBy("track_id").agg(F.sum((F.col("y") > 80).cast("int")).alias("n"))


@query("lane_model_fit", f"""WITH {LANES}, c AS (SELECT rec_id, count(DISTINCT lane_id) AS n FROM ln GROUP BY 1),
m AS (SELECT rec_id, lane_id, median(y) AS m FROM ln JOIN c USING (rec_id) WHERE lane_id BETWEEN 1 AND n - 1 GROUP BY ALL),
f AS (SELECT rec_id, regr_slope(m, lane_id) AS w, regr_intercept(m, lane_id) AS b FROM m GROUP BY 1)
SELECT rec_id, bound::INTEGER AS bound, round((b + w) - w / 2 + w * bound, 4) AS y FROM (SELECT c.rec_id, w, b, unnest(range(0, n)) AS bound FROM c LEFT JOIN f USING (rec_id))""")  # fmt: skip
def lane_model_fit(spark, sf_dir):
    return L.lane_model(on_lanes(spark, sf_dir)).select("rec_id", "bound", F.round("y", 4).alias("y"))


@query("lane_displacement", f"""WITH {LANES} SELECT track_id, frame, round((2.0 * (y - (lane_id - 1) * 25) / 25 - 1) * CASE WHEN driving_direction = 2 THEN -1 ELSE 1 END, 6) AS lane_disp,
  round((2.0 * y / 100 - 1) * CASE WHEN driving_direction = 2 THEN -1 ELSE 1 END, 6) AS road_disp FROM ln""")  # fmt: skip
def lane_displacement(spark, sf_dir):
    lines = L.markings(F.lit("0;25;50;75;100"))
    t = on_lanes(spark, sf_dir)
    lane = L.lane_displacement(F.col("y"), F.col("lane_id") + 1, F.col("driving_direction"), lines)
    road = L.road_displacement(F.col("y"), F.col("driving_direction"), lines)
    return t.select("track_id", "frame", F.round(lane, 6).alias("lane_disp"), F.round(road, 6).alias("road_disp"))


@query("direction_normalized", f"""WITH {LANES}, z AS (SELECT *, min(x) OVER (PARTITION BY rec_id) AS lo, max(x) OVER (PARTITION BY rec_id) AS hi FROM ln)
SELECT track_id, frame, round(CASE WHEN driving_direction = 1 THEN hi - x ELSE x - lo END, 6) AS x, round(CASE WHEN driving_direction = 1 THEN y - 1 ELSE 99 - y END, 6) AS y,
  round(CASE WHEN driving_direction = 1 THEN -vx ELSE vx END, 6) AS vx, round(CASE WHEN driving_direction = 1 THEN vy ELSE -vy END, 6) AS vy FROM z""")  # fmt: skip
def direction_normalized(spark, sf_dir):
    return L.normalize_direction(on_lanes(spark, sf_dir), 1.0, 99.0).select("track_id", "frame", *_r("x", "y", "vx", "vy"))


@query("box_centroid", f"WITH {LANES} SELECT track_id, frame, round(CASE WHEN driving_direction = 2 THEN x + 2.25 ELSE x - 2.25 END, 6) AS x, round(y + 0.9, 6) AS y FROM ln")
def box_centroid(spark, sf_dir):
    x, y = L.centroid(F.col("x"), F.col("y"), F.lit(4.5), F.lit(1.8), F.col("driving_direction"))
    return on_lanes(spark, sf_dir).select("track_id", "frame", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("ped_bike_rule", f"WITH {MV} SELECT track_id, frame, CASE WHEN event_type <> 'click' THEN event_type WHEN max(sqrt(vx * vx + vy * vy)) OVER (PARTITION BY track_id) < 3000 THEN 'pedestrian' ELSE 'bicycle' END AS agent_type FROM mv")
def ped_bike_rule(spark, sf_dir):
    t = moving(spark, sf_dir).withColumn("agent_type", F.col("event_type"))
    return K.two_wheeler_rule(t, 3000.0, joint="click").select("track_id", "frame", "agent_type")


@query("ped_bike_motion_rule", f"""WITH {MV}, s AS (SELECT track_id, max(sqrt(vx * vx + vy * vy)) AS v, max(sqrt(ax * ax + ay * ay)) AS a, max((vx * ay - vy * ax) / (sqrt(vx * vx + vy * vy) + 1e-6)) AS w FROM mv GROUP BY 1)
SELECT track_id, CASE WHEN v > 3000 OR a <= 60000 OR w <= 40000 THEN 'bicycle' ELSE 'pedestrian' END AS agent_type FROM s""")  # fmt: skip
def ped_bike_motion_rule(spark, sf_dir):
    return K.motion_rule(moving(spark, sf_dir), 3000.0, 60000.0, 40000.0).select("track_id", "agent_type")
