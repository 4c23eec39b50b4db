"""Views that map the driver's tables onto the engine's schemas, for Spark and (as SQL) for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import kinematics as K
from ..operators import sampling as S
from ..session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) and its SQL."""

    def take(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return take


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rec_id, track_id, frame (from 1), x, y, agent_type``, one track for each user."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "props", "event_type")
    e = spread(e, 0.4, "user_id")  # 20,000 to 40,000 events: queries make up to 250 rows of each
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.floor(F.col("user_id") / 10).cast("long").alias("rec_id"), F.col("user_id").alias("track_id"), F.row_number().over(w).cast("int").alias("frame"),
        F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), "event_type",
        F.first("event_type").over(w).alias("first_type"),
    )


TR = """tr AS (SELECT floor(user_id / 10)::BIGINT AS rec_id, user_id AS track_id,
  (row_number() OVER w)::INTEGER AS frame, value AS x, json_extract(props, '$.k')::DOUBLE AS y, event_type,
  first_value(event_type) OVER w AS first_type
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""

DT = 0.04


def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.with_motion(tracks(spark, sf_dir), DT)


def gradient_sql(c: str, dt: float = DT) -> str:
    return f"""CASE WHEN lag({c}) OVER g IS NULL AND lead({c}) OVER g IS NULL THEN 0.0
    WHEN lag({c}) OVER g IS NULL THEN (lead({c}) OVER g - {c}) / {dt} WHEN lead({c}) OVER g IS NULL THEN ({c} - lag({c}) OVER g) / {dt}
    ELSE (lead({c}) OVER g - lag({c}) OVER g) / {2 * dt} END"""


MV = f"""{TR}, v AS (SELECT *, {gradient_sql("x")} AS vx, {gradient_sql("y")} AS vy FROM tr WINDOW g AS (PARTITION BY rec_id, track_id ORDER BY frame)),
mv AS (SELECT *, {gradient_sql("vx")} AS ax, {gradient_sql("vy")} AS ay, atan2(vy, vx) AS psi FROM v WINDOW g AS (PARTITION BY rec_id, track_id ORDER BY frame))"""

#: Tracks on lanes: the lane is 1 + floor(y / 25), the direction the sign of the way from first to last x.
LANES = f"""{MV}, dir AS (SELECT rec_id, track_id, CASE WHEN arg_min(x, frame) < arg_max(x, frame) THEN 2 ELSE 1 END AS driving_direction FROM tr GROUP BY ALL),
ln AS (SELECT mv.*, (1 + floor(y / 25))::INTEGER AS lane_id, driving_direction FROM mv JOIN dir USING (rec_id, track_id))"""


def on_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("rec_id", "track_id").orderBy("frame").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    way = F.when(F.first("x").over(w) < F.last("x").over(w), 2).otherwise(1)
    return moving(spark, sf_dir).withColumns({"lane_id": (F.floor(F.col("y") / 25) + 1).cast("int"), "driving_direction": way})


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``map_id, line_id, pos, node, x, y, edge_type`` from lineitem: a line for each order, a map for 100 orders."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", *order), 4, "l_orderkey")
    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)).cast("int")
    out = li.select(
        F.floor(F.col("l_orderkey") / 100).cast("long").alias("map_id"), F.col("l_orderkey").alias("line_id"), pos.alias("pos"),
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"),
    )
    return out.withColumns({"node": F.col("line_id") * 1000 + F.col("pos"), "edge_type": (F.pmod(F.col("line_id"), F.lit(15)) + 1).cast("int")})


POLY = """poly AS (SELECT floor(l_orderkey / 100)::BIGINT AS map_id, l_orderkey AS line_id, pos, l_quantity AS x, l_extendedprice / 1000 AS y,
  l_orderkey * 1000 + pos AS node, (l_orderkey % 15 + 1)::INTEGER AS edge_type FROM (SELECT *, (row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))::INTEGER AS pos FROM lineitem))"""

LONG = S.Windows(6, 10, 4)
MODES = 6


def prediction_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``truth, pred, prob``: windows of 6 + 10 frames, and six modes that drift from the truth.

    A start emits nothing; each row joins the windows that cover it by its own frame, so windows are cut
    without a join: row k lies in the windows that start at k-15 .. k-6.
    """
    t = tracks(spark, sf_dir).withColumn("_n", F.max("frame").over(W.partitionBy("track_id")))
    low = F.greatest(F.ceil((F.col("frame") - 16) / 4).cast("int"), F.lit(0))
    high = F.floor(F.least(F.col("frame") - 7, F.col("_n") - 17) / 4).cast("int")
    rows = t.where(low <= high).withColumn("_s", F.explode(F.sequence(low, high))).withColumn("start", F.col("_s") * 4 + 1)
    truth = rows.select(
        (F.col("rec_id") * 1000 + F.col("start")).alias("scenario_id"), F.col("track_id").alias("agent_id"), (F.col("frame") - F.col("start") - 6).alias("t"),
        "x", "y", ((F.col("frame") + F.col("track_id")) % 4 != 0).alias("valid"),
    )
    m = F.explode(F.sequence(F.lit(0), F.lit(MODES - 1)))
    pred = truth.select("scenario_id", "agent_id", m.alias("mode"), "t", "x", "y").withColumns(
        {"x": F.col("x") + (F.col("mode") - 2) * F.lit(0.1) * (F.col("t") + 1), "y": F.col("y") - (F.col("mode") - 3) * F.lit(0.05) * (F.col("t") + 1)}
    )
    ids = truth.select("scenario_id", "agent_id").distinct()
    prob = ids.select("scenario_id", "agent_id", m.alias("mode")).withColumn("prob", (F.col("mode") + 1) / F.lit(21.0))
    return truth, pred, prob


PRED = f"""{TR}, len AS (SELECT track_id, max(frame) AS n FROM tr GROUP BY 1),
st AS (SELECT track_id, unnest(range(1, n - 15, 4))::INTEGER AS start FROM len WHERE n >= 17),
truth AS (SELECT tr.rec_id * 1000 + start AS scenario_id, tr.track_id AS agent_id, frame - start - 6 AS t, x, y, (frame + tr.track_id) % 4 <> 0 AS valid
  FROM tr JOIN st ON tr.track_id = st.track_id AND tr.frame BETWEEN st.start + 6 AND st.start + 15),
modes AS (SELECT unnest(range(0, 6))::INTEGER AS mode),
pred AS (SELECT scenario_id, agent_id, mode, t, x + (mode - 2) * 0.1::DOUBLE * (t + 1) AS x, y - (mode - 3) * 0.05::DOUBLE * (t + 1) AS y FROM truth, modes),
prob AS (SELECT DISTINCT scenario_id, agent_id, mode, (mode + 1) / 21.0::DOUBLE AS prob FROM truth, modes),
err AS (SELECT p.*, q.x AS tx, q.y AS ty, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS d
  FROM pred p JOIN truth q USING (scenario_id, agent_id, t) WHERE q.valid),
me AS (SELECT scenario_id, agent_id, mode, avg(d) AS ade, arg_max(d, t) AS fde FROM err GROUP BY ALL),
best AS (SELECT scenario_id, agent_id, mode, ade, fde FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, agent_id ORDER BY fde, mode) AS r FROM me) WHERE r = 1)"""
