"""Text and JSON recordings as ``rec_id, track_id, frame, x, y, ...`` tracks.

Every reader declares its schema, so Spark neither infers nor reads columns that are not asked for.
"""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codes, geometry
from ..operators.lanes import driving_direction, lane_changes

MOTION = "xVelocity double, yVelocity double, xAcceleration double, yAcceleration double"
# Column names of raw files and what they are called here.
RENAMES = {
    "trackId": "track_id", "id": "track_id", "ID": "track_id", "frame_id": "frame", "xVelocity": "vx", "yVelocity": "vy", "xAcceleration": "ax",
    "yAcceleration": "ay", "xCenter": "x", "yCenter": "y", "laneId": "lane_id", "laneChange": "lane_change", "latLaneCenterOffset": "lane_offset",
    "initialFrame": "initial_frame", "finalFrame": "final_frame", "numLaneChanges": "num_lane_changes", "drivingDirection": "driving_direction",
    "class": "agent_type", "yaw_rad": "psi",
}


def canonicalize(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rename what has another name here (unless the name is taken) and drop what is not wanted, where it is there."""
    names = {a: b for a, b in RENAMES.items() if a in df.columns and b not in df.columns}
    return df.withColumnsRenamed(names).drop(*drop)


def recording_of(pattern: str | Column) -> Column:
    """The recording's name, taken from the file's by a pattern with one group, or any expression of the file."""
    if isinstance(pattern, Column):
        return pattern
    return F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)


def _csv(spark: SparkSession, path: str, schema: str, glob: str | None = None, sep: str = ",", header: bool = True) -> DataFrame:
    reader = spark.read.schema(schema).option("header", header).option("sep", sep).option("enforceSchema", False)
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return reader.csv(path)


def headers(spark: SparkSession, path: str, glob: str) -> dict[tuple[str, ...], list[str]]:
    """The distinct headers of CSV files, each with its files.

    The first line of a file is the first row of the piece that begins at 0; each piece keeps one line for a file, so
    what moves is a header for each file.
    """
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    first = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")).where("at = 0")
    found = first.groupBy("file").agg(F.first("value").alias("line"))
    out: dict[tuple[str, ...], list[str]] = {}
    for row in found.groupBy("line").agg(F.collect_list("file").alias("files")).collect():  # a row for each distinct header
        names = tuple(c.strip().removeprefix("\ufeff") for c in next(csv.reader([row.line])))
        out.setdefault(names, []).extend(unquote(f) for f in row.files)
    return out


def _named_csv(spark: SparkSession, path: str, glob: str, pattern: str | Column, columns: dict[str, str]) -> DataFrame:
    """Columns by name, whatever others a file has and in whatever order (all read as text, then cast).

    Files are read together where they have one header, else a group for each header.  A column that a file lacks is null.
    """
    groups = headers(spark, path, glob)
    out = None
    for names, files in sorted(groups.items()):
        plain = ", ".join(f"`c{i}` string" for i in range(len(names)))
        reader = spark.read.schema(plain).option("header", True)
        raw = reader.csv(sorted(files)) if len(groups) > 1 else reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True).csv(path)
        have = {n.lower(): f"c{i}" for i, n in reversed(list(enumerate(names)))}
        picked = [(F.col(have[c.lower()]) if c.lower() in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]
        each = raw.select(recording_of(pattern).alias("rec_id"), *picked)
        out = each if out is None else out.unionByName(each)
    if out is None:
        out = spark.createDataFrame([], "rec_id string, " + ", ".join(f"`{c}` {t}" for c, t in columns.items()))
    return out


def _columns(schema: str) -> dict[str, str]:
    return {a: b for a, b in (c.strip().split(" ") for c in schema.split(","))}


def urban(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``NN_tracks.csv``, ``NN_tracksMeta.csv``, ``NN_recordingMeta.csv``: (tracks, meta, recordings); heading to radians."""
    t = _named_csv(spark, path, "*_tracks.csv", r"([^/]*)_tracks\.csv", _columns(f"trackId bigint, frame int, xCenter double, yCenter double, heading double, {MOTION}"))
    t = canonicalize(t.withColumn("psi", geometry.heading_from_degrees(F.col("heading"))), ("heading",))
    m = canonicalize(_named_csv(spark, path, "*_tracksMeta.csv", r"([^/]*)_tracksMeta\.csv", _columns("trackId bigint, class string, initialFrame int, finalFrame int")))
    r = _named_csv(spark, path, "*_recordingMeta.csv", r"([^/]*)_recordingMeta\.csv", _columns("xUtmOrigin double, yUtmOrigin double"))
    return t, m.withColumn("agent_type", F.lower("agent_type")), r


def highway(spark: SparkSession, path: str, exits: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As urban(), with lanes and markings; ``exits``: with the lane-change flag and the offset from the lane's centre."""
    more = ", laneChange int, latLaneCenterOffset double" if exits else ", laneId int, width double, height double"
    place = "trackId bigint, frame int, xCenter double, yCenter double, heading double" if exits else "id bigint, frame int, x double, y double"
    t = _named_csv(spark, path, "*_tracks.csv", r"([^/]*)_tracks\.csv", _columns(f"{place}, {MOTION}{more}"))
    if exits:
        t = t.withColumn("psi", geometry.heading_from_degrees(F.col("heading"))).drop("heading")
    key = "trackId" if exits else "id"
    m = _named_csv(spark, path, "*_tracksMeta.csv", r"([^/]*)_tracksMeta\.csv", _columns(f"{key} bigint, class string, initialFrame int, finalFrame int, drivingDirection int, numLaneChanges int"))
    r = _named_csv(spark, path, "*_recordingMeta.csv", r"([^/]*)_recordingMeta\.csv", _columns("upperLaneMarkings string, lowerLaneMarkings string"))
    return canonicalize(t), canonicalize(m).withColumn("agent_type", F.lower("agent_type")), r


def intersection(spark: SparkSession, path: str, full: bool = False, x0: float = 0.0, y0: float = 0.0, dt: float = 0.1, polar: bool = False) -> DataFrame:
    """Vehicle and pedestrian files of recordings, as one set of tracks; a recording's pedestrian ids follow its vehicles'.

    The recording is the folder below ``data`` (in any case): the files' own folder with ``full``, else one above it;
    files elsewhere belong to a recording without a name.  Headings follow velocities, pedestrians' accelerations are
    derivatives, and places are relative to (x0, y0), with ``rho`` and ``theta`` about it if ``polar``.
    """
    from ..operators.kinematics import with_acceleration, with_polar
    from ..operators.relations import union_with_offset

    where = F.regexp_extract(F.col("_metadata.file_path"), r"(?i)/data/([^/]+)/" + ("" if full else r"(?:[^/]+/)*") + r"[^/]+$", 1)
    motion = "track_id string, frame_id int, agent_type string, x double, y double, vx double, vy double"
    v = _named_csv(spark, path, "[Vv][Ee][Hh]_[Ss]moothed_[Tt]racks.csv", where, _columns(f"{motion}, ax double, ay double"))
    p = _named_csv(spark, path, "[Pp][Ee][Dd]_[Ss]moothed_[Tt]racks.csv", where, _columns(motion))
    v, p = (canonicalize(d).withColumn("track_id", F.regexp_extract("track_id", r"(\d+)", 1).cast("bigint")) for d in (v, p))
    both = union_with_offset(v, with_acceleration(p, dt), key="rec_id").withColumn("psi", geometry.heading(F.col("vx"), F.col("vy")))
    moved = both.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})
    return with_polar(moved, 0.0, 0.0) if polar else moved


# Class names of the recordings with one file each, which differ from the classes here.
ROAD_CLASSES = {"Passenger Car": "car", "Truck": "truck", "Van": "van", "Bus": "bus", "Motorcycle": "motorcycle", "Semi-trailer truck": "truck"}


def single_csv(spark: SparkSession, path: str, lane_markings: dict[str, str] | None = None, lane_width: float = 3.75, lanes: int = 4, fps: float = 10.0) -> DataFrame:
    """One file per recording with a column of seconds; frames, x and ids are rebased, headings derived, the direction is 1.

    ``lane_markings`` gives each recording's markings (``"-3.75;0;3.75"``): y is counted from the first one, and lanes
    are assigned by width and filled; a recording without markings keeps its y.
    """
    from ..operators.lanes import assign_lane, fill_lane, markings

    t = _named_csv(spark, path, "*.csv", r"(.*)\.csv", _columns("ID bigint, VehicleCategory string, tseconds double, x double, y double, vx double, vy double, ax double, ay double"))
    t = t.withColumn("frame", geometry.seconds_to_frame(F.col("tseconds"), 1 / fps)).withColumnRenamed("VehicleCategory", "agent_type")
    by = W.partitionBy("rec_id")
    t = canonicalize(t, ("tseconds",))
    t = t.withColumns({c: F.col(c) - F.min(c).over(by) for c in ("frame", "x", "track_id")})
    kind = F.coalesce(codes.lookup(ROAD_CLASSES, F.col("agent_type")), F.lower("agent_type"))
    t = t.withColumns({"agent_type": kind, "psi": geometry.heading(F.col("vx"), F.col("vy")), "driving_direction": F.lit(1)})
    if lane_markings is None:
        return t
    first = codes.lookup({k: float(v.split(";")[0]) for k, v in lane_markings.items()}, F.col("rec_id"), 0.0)
    t = t.withColumn("y", F.col("y") - first)
    return fill_lane(t.withColumn("lane_id", assign_lane(F.col("y"), lane_width, lanes)))


# Classes of the feet-based freeway recordings.
FREEWAY_CLASSES = {1: "motorcycle", 2: "car", 3: "truck"}


def freeway_feet(spark: SparkSession, path: str) -> DataFrame:
    """``trajectories*.csv`` in feet, any case of header; axes swapped to metres along and across the road.

    x begins at the recording's least, y at the first bound of its lane model; velocities, accelerations and headings
    are not in the files and are 0.  A recording of fewer than three lanes has no model and keeps its y.
    """
    from ..operators.lanes import lane_model

    raw = _named_csv(spark, path, "trajectories*.csv", r"(.*)\.csv", _columns("vehicle_id bigint, frame_id int, local_x double, local_y double, v_class int, lane_id int"))
    kind = F.lit("undefined")
    for k, v in FREEWAY_CLASSES.items():
        kind = F.when(F.col("v_class") == k, v).otherwise(kind)
    zero = {c: F.lit(0.0) for c in ("vx", "vy", "ax", "ay", "psi")}
    x = geometry.feet(F.col("local_y"))
    t = raw.select("rec_id", F.col("vehicle_id").alias("track_id"), F.col("frame_id").alias("frame"), (x - F.min(x).over(W.partitionBy("rec_id"))).alias("x"), (-geometry.feet(F.col("local_x"))).alias("y"), "lane_id", kind.alias("agent_type"), F.lit(1).alias("driving_direction"))
    low = lane_model(t).groupBy("rec_id").agg(F.min("y").alias("_y0"))  # a row for each recording
    return t.join(low, "rec_id", "left").withColumn("y", F.col("y") - F.coalesce("_y0", F.lit(0.0))).drop("_y0").withColumns(zero)


def derived_meta(tracks: DataFrame) -> DataFrame:
    """Tracks' metadata where a source has none: frames, class, lane changes and direction."""
    keys = ["rec_id", "track_id"]
    base = tracks.groupBy(*keys).agg(F.min("frame").alias("initial_frame"), F.max("frame").alias("final_frame"), F.min_by("agent_type", "frame").alias("agent_type"))
    if "lane_id" in tracks.columns:
        base = base.join(lane_changes(tracks), keys)
    return base.join(driving_direction(tracks), keys)


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Per-split files of short cases; the recording is the file's name without its last ``_part``."""
    t = _named_csv(spark, path, "*.csv", r"(.*)\.csv", _columns("case_id double, track_id bigint, frame_id int, timestamp_ms bigint, agent_type string, x double, y double, vx double, vy double"))
    t = canonicalize(t).withColumns({"rec_id": F.regexp_replace("rec_id", "_[^_]*$", ""), "case_id": F.col("case_id").cast("bigint")})
    return t.withColumn("agent_type", F.when(F.col("agent_type") == "pedestrian/bicycle", "pedestrian").otherwise(F.col("agent_type")))


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """One file per sequence with text track ids; times become frames, and AV and AGENT are cars."""
    t = _csv(spark, path, "TIMESTAMP double, TRACK_ID string, OBJECT_TYPE string, X double, Y double, CITY_NAME string", "*.csv").select("*", recording_of(r"(.*)\.csv").alias("rec_id"))
    frame = (F.dense_rank().over(W.partitionBy("rec_id").orderBy("TIMESTAMP")) - 1).cast("int")
    kind = F.when(F.col("OBJECT_TYPE").isin("AV", "AGENT"), "car").otherwise("undefined")
    return t.select("rec_id", F.col("TRACK_ID").alias("track_id"), frame.alias("frame"), F.col("X").alias("x"), F.col("Y").alias("y"), F.col("CITY_NAME").alias("city"), F.col("OBJECT_TYPE").alias("role"), kind.alias("agent_type"))


# Type names of the scenario files that differ from the classes here.
SCENARIO_CLASSES = {"vehicle": "car", "motorcyclist": "motorcycle", "cyclist": "bicycle", "unknown": "undefined"}


def scenario_parquet(spark: SparkSession, path: str) -> DataFrame:
    """One Parquet file per scenario folder."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)
    rename = {"position_x": "x", "position_y": "y", "velocity_x": "vx", "velocity_y": "vy", "heading": "psi", "timestep": "frame", "object_category": "category"}
    t = t.withColumn("rec_id", recording_of(r"(.*)\.parquet")).withColumnsRenamed(rename)
    kind = F.coalesce(codes.lookup(SCENARIO_CLASSES, F.col("object_type")), F.col("object_type"))
    return t.withColumn("agent_type", kind)


def whitespace_text(spark: SparkSession, path: str) -> DataFrame:
    """Ten blank-separated columns, of which five are kept."""
    # Object types of this source.
    kinds = {"1": "car", "2": "truck", "3": "pedestrian", "4": "bicycle", "5": "undefined"}
    p = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).where(F.trim("value") != "").select("value", recording_of(r"(.*?)(?:\.txt)?$").alias("rec_id"))
    return t.select("rec_id", p[0].cast("int").alias("frame"), p[1].cast("bigint").alias("track_id"), codes.lookup(kinds, p[2], "undefined").alias("agent_type"), p[3].cast("double").alias("x"), p[4].cast("double").alias("y"))


def pedestrian_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated frame, id, x, y; frames in tens, rebased to 0."""
    t = _csv(spark, path, "frame double, id double, x double, y double", sep="\t", header=False).select("*", recording_of(r"(.*?)(?:\.txt)?$").alias("rec_id"))
    frame = F.floor(F.col("frame") / 10).cast("int")
    t = t.select("rec_id", F.col("id").cast("bigint").alias("track_id"), frame.alias("frame"), "x", "y", F.lit("pedestrian").alias("agent_type"))
    return t.withColumn("frame", F.col("frame") - F.min("frame").over(W.partitionBy("rec_id")))


# Two-level categories of the token tables.
TOKEN_CATEGORIES = {
    "vehicle": {"car": "car", "van": "van", "construction": "van", "motorcycle": "motorcycle", "bicycle": "bicycle", "bus": "bus", "truck": "truck", "trailer": "trailer", "ego": "car"},
    "human": "pedestrian", "static": "static_object", "static_object": "static_object", "movable_object": "movable_object", "animal": "animal",
}


# Two-level statuses of the token tables.
TOKEN_STATUSES = {
    "vehicle": {"moving": "moving", "stopped": "stopped", "parked": "parked"},
    "pedestrian": {"moving": "moving", "standing": "stopped", "sitting_lying_down": "stopped"},
    "cycle": {"with_rider": "moving", "without_rider": "stopped"},
}


def token_tables(spark: SparkSession, path: str, ego: bool = True) -> DataFrame:
    """Token-linked JSON tables: annotated agents, and the ego vehicle as track ``ego``, by scene and sample ordinal.

    A scene's samples are ranked by time, which is the order of their links.  The ego vehicle is where the first row of
    a sample's data, in the order of the file, says.
    """
    read = lambda name, schema: spark.read.schema(schema).option("multiLine", True).json(f"{path}/{name}.json")
    scene = read("scene", "token string, log_token string, name string, first_sample_token string")
    sample = read("sample", "token string, timestamp bigint, prev string, next string, scene_token string")
    data = read("sample_data", "token string, sample_token string, ego_pose_token string, timestamp bigint")
    pose = read("ego_pose", "token string, translation array<double>")
    notes = read("sample_annotation", "token string, sample_token string, instance_token string, attribute_tokens array<string>, translation array<double>")
    instance, category = read("instance", "token string, category_token string"), read("category", "token string, name string")
    attribute, log = read("attribute", "token string, name string"), read("log", "token string, location string")
    frame = (F.row_number().over(W.partitionBy("scene_token").orderBy("timestamp")) - 1).cast("int")
    at = sample.select(F.col("token").alias("sample_token"), "scene_token", frame.alias("frame"), "timestamp")
    at = at.join(scene.select(F.col("token").alias("scene_token"), F.col("name").alias("scene_name"), "log_token"), "scene_token")
    at = at.join(log.select(F.col("token").alias("log_token"), F.col("location").alias("map")), "log_token")
    named = instance.join(category.select(F.col("token").alias("category_token"), F.col("name").alias("full_category")), "category_token")
    named = named.select(F.col("token").alias("instance_token"), "full_category")
    status = attribute.select(F.col("token").alias("_a"), F.col("name").alias("full_status"))
    agents = notes.join(named, "instance_token").withColumn("_a", F.get("attribute_tokens", F.lit(0))).join(status, "_a", "left").join(at, "sample_token")
    columns = ["scene_name", "frame", "track_id", F.col("translation")[0].alias("x"), F.col("translation")[1].alias("y"), "full_category", F.coalesce("full_status", F.lit("unknown")).alias("full_status"), "map"]
    out = agents.withColumn("track_id", F.col("instance_token")).select(*columns)
    if ego:
        placed = data.withColumn("_row", F.monotonically_increasing_id())  # one file, read in one piece: its order
        first = placed.groupBy("sample_token").agg(F.min_by("ego_pose_token", "_row").alias("pose"))
        own = at.join(first, "sample_token").join(pose.withColumnRenamed("token", "pose"), "pose")
        out = out.unionByName(own.withColumns({"track_id": F.lit("ego"), "full_category": F.lit("vehicle.ego"), "full_status": F.lit("unknown")}).select(*columns))
    return out.withColumns({"agent_type": codes.dotted_category(F.col("full_category"), TOKEN_CATEGORIES), "status": codes.dotted_category(F.col("full_status"), TOKEN_STATUSES, "unknown")})


def staged_scenes(spark: SparkSession, path: str, ego: bool = True) -> DataFrame:
    """Scenes staged as CSV; without ``ego``, a second ego vehicle is left out."""
    columns = "frame int, track_id string, x double, y double, agent_type string, full_category string, status string, full_status string, map string, scene_name string"
    t = _named_csv(spark, path, "*.csv", "()", _columns(columns)).drop("rec_id")
    return t if ego else t.where(F.col("full_category") != "vehicle.ego")


# Labels of the probability vector, by index.
LABELS = ("undefined", "undefined", "undefined", "car", "van", "tram", "bus", "truck", "emergency_vehicle", "undefined", "bicycle", "motorcycle", "bicycle", "motorcycle", "pedestrian", "animal", "undefined")


def indexed_scenes(scenes: DataFrame, frames: DataFrame, agents: DataFrame) -> DataFrame:
    """Scene, frame and agent tables that point to ranges of each other: ``scene, frame, track_id, x, y, vx, vy, psi, agent_type``.

    Tables have their row number in ``pos``; ranges are half open.
    """
    from ..operators.relations import interval_join

    s = scenes.select(F.col("pos").alias("scene"), F.col("frame_index_interval")[0].alias("f0"), F.col("frame_index_interval")[1].alias("f1"))
    f = frames.select(F.col("pos").alias("frame_pos"), F.col("agent_index_interval")[0].alias("a0"), F.col("agent_index_interval")[1].alias("a1"), "ego_translation")
    at = interval_join(s, f, "f0", "f1", "frame_pos").withColumn("frame", (F.col("frame_pos") - F.col("f0")).cast("int"))
    a = agents.withColumnRenamed("pos", "agent_pos")
    kind = F.element_at(F.array(*map(F.lit, LABELS)), codes.argmax(F.col("label_probabilities")) + 1)
    rows = interval_join(at, a, "a0", "a1", "agent_pos").select("scene", "frame", F.col("track_id").cast("bigint").alias("track_id"), F.col("centroid")[0].alias("x"), F.col("centroid")[1].alias("y"), F.col("velocity")[0].cast("double").alias("vx"), F.col("velocity")[1].cast("double").alias("vy"), F.col("yaw").cast("double").alias("psi"), kind.alias("agent_type"))
    none = F.lit(None).cast("double")
    own = at.select("scene", "frame", F.lit(-1).cast("bigint").alias("track_id"), F.col("ego_translation")[0].alias("x"), F.col("ego_translation")[1].alias("y"), none.alias("vx"), none.alias("vy"), none.alias("psi"), F.lit("car").alias("agent_type"))
    return rows.unionByName(own)
