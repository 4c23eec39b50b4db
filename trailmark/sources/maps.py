"""Map files as polyline points, and whole lane graphs from them.

Readers give ``map_id, line_id, pos, x, y, edge_type``: the type is that of the edge from a point to the next one of its
line, and polygons end with their first point again.  ``mapgraph.graph`` makes nodes and edges of such points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codes, geometry
from ..operators import mapgraph as G
from ..session import written
from .binary import sqlite_tables

POINTS = "map_id string, line_id string, pos int, x double, y double, edge_type int"
_E = codes.EDGE_TYPES


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The map of data without one."""
    return (
        spark.createDataFrame([], "map_id string, node bigint, x double, y double, node_type int"),
        spark.createDataFrame([], "map_id string, src bigint, dst bigint, edge_type int"),
    )


def _tag(name: str) -> Column:
    return F.get(F.filter("tag", lambda t: t["_k"] == name), F.lit(0))["_v"]


def osm(spark: SparkSession, path: str, x0: float = 0.0, y0: float = 0.0, zone: int | None = None, map_id: str = "map") -> tuple[DataFrame, DataFrame]:
    """A lanelet map: nodes in local metres, and edges both ways with the types of ways and regulatory relations.

    Two nodes have one edge, of the type of the last way (by id) that joins them.  A node has the type of its first
    way that has one.  Reference lines of regulatory elements and stop lines override both; of several relations the
    last one (by id) does.
    """
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    nodes = read("node", "_id bigint, _lat double, _lon double")
    tags = "tag array<struct<_k:string,_v:string>>"
    ways = read("way", f"_id bigint, nd array<struct<_ref:bigint>>, {tags}")
    relations = read("relation", f"_id bigint, member array<struct<_type:string,_ref:bigint,_role:string>>, {tags}")
    points = ways.select(F.lit(map_id).alias("map_id"), F.col("_id").alias("line_id"), F.posexplode("nd").alias("pos", "nd"), codes.edge_type(_tag("type"), _tag("subtype")).alias("edge_type"))
    edges = G.line_edges(points.withColumn("node", F.col("nd._ref")).drop("nd"))
    rule = F.when(_tag("type") == "regulatory_element", _E["REGULATORY"]).when(_tag("type") == "stop_line", _E["STOP"])
    ruled = relations.withColumn("_rule", rule).where("_rule IS NOT NULL").select("_id", "_rule", F.explode("member").alias("m")).where("m._type = 'way' AND m._role = 'ref_line'")
    ruled = ruled.select(F.col("m._ref").alias("line_id"), F.struct("_id", "_rule").alias("_r"))
    both = edges.join(ruled.groupBy("line_id").agg(F.max("_r").alias("_r")), "line_id", "left")
    one = both.groupBy("map_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max_by("edge_type", "line_id").alias("edge_type"), F.max("_r")["_rule"].alias("_rule"))
    joined = one.select("map_id", F.col("a").alias("src"), F.col("b").alias("dst"), F.coalesce("_rule", "edge_type").alias("edge_type"))
    ends = both.where("_r IS NOT NULL").select("map_id", F.explode(F.array("src", "dst")).alias("node"), "_r")
    ends = ends.groupBy("map_id", "node").agg(F.max("_r")["_rule"].alias("_rule"))
    east, north = geometry.utm(F.col("_lat"), F.col("_lon"), F.lit(zone) if zone else None)
    placed = nodes.select(F.lit(map_id).alias("map_id"), F.col("_id").alias("node"), (east - x0).alias("x"), (north - y0).alias("y"))
    placed = placed.join(G.node_types(edges), ["map_id", "node"], "left").join(ends, ["map_id", "node"], "left")
    kind = F.coalesce("_rule", "node_type", F.lit(_E["NONE"]))
    return placed.withColumn("node_type", kind).drop("_rule"), G.both_ways(joined).select("map_id", "src", "dst", "edge_type")


def vector_xml(spark: SparkSession, path: str, map_id: str = "map") -> DataFrame:
    """Centre lines of a vector map: points with ``lane attributes, successors, predecessors`` and the neighbours' ids."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id bigint, _x double, _y double").load(path)
    ways = spark.read.format("xml").option("rowTag", "way").schema("_lane_id bigint, nd array<struct<_ref:bigint>>, tag array<struct<_k:string,_v:string>>").load(path)
    every = lambda k: F.transform(F.filter("tag", lambda t: t["_k"] == k), lambda t: t["_v"].cast("bigint"))
    flag = lambda k: F.coalesce(_tag(k) == "True", F.lit(False)).alias(k)
    side = lambda k: F.when(_tag(k) != "None", _tag(k)).cast("bigint").alias(k)
    lanes = ways.select(
        F.col("_lane_id").alias("line_id"), F.posexplode("nd").alias("pos", "nd"), flag("is_intersection"), flag("has_traffic_control"),
        F.coalesce(_tag("turn_direction"), F.lit("NONE")).alias("turn_direction"), side("l_neighbor_id"), side("r_neighbor_id"),
        every("successor").alias("successors"), every("predecessor").alias("predecessors"),
    )
    at = nodes.select(F.col("_id").alias("node"), F.col("_x").alias("x"), F.col("_y").alias("y"))
    return lanes.withColumn("node", F.col("nd._ref")).drop("nd").join(at, "node").withColumn("map_id", F.lit(map_id))


def vector_graph(lanes: DataFrame, interpolate: bool = False, interp_distance: float | None = None, most: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The graph of vector_xml() lanes: both borders of every lane, and edges to the borders of its successors.

    Borders lie 1.9 m from the centre line.  They are curbs where the lane has no neighbour on that side, else (and in
    intersections) virtual.  A lane of an intersection with traffic control that does not turn, and no successor of
    which is such a lane, is a polygon whose ends are regulatory.  Borders are linked from end to start where these are
    nearer than ``most``; the type is that of the lane that is left.
    """
    first = G.first_occurrence(lanes)
    ruled = F.col("is_intersection") & F.col("has_traffic_control")
    facts = first.groupBy("map_id", "line_id").agg(
        F.first(ruled).alias("ruled"), F.first("turn_direction").alias("turn"), F.first("successors").alias("successors"), F.first("predecessors").alias("predecessors"),
        F.first(F.when(F.col("is_intersection") | F.col("l_neighbor_id").isNotNull(), _E["VIRTUAL"]).otherwise(_E["CURB"])).alias("l_type"),
        F.first(F.when(F.col("is_intersection") | F.col("r_neighbor_id").isNotNull(), _E["VIRTUAL"]).otherwise(_E["CURB"])).alias("r_type"),
    )
    follow = facts.select("map_id", "line_id", F.explode("successors").alias("to"))
    back = facts.select("map_id", F.explode("predecessors").alias("line_id"), F.col("line_id").alias("to"))
    other = facts.select("map_id", F.col("line_id").alias("to"), F.col("ruled").alias("_next"))
    after = follow.join(other, ["map_id", "to"]).groupBy("map_id", "line_id").agg(F.bool_or("_next").alias("_next"))
    facts = facts.join(after, ["map_id", "line_id"], "left")
    facts = facts.withColumn("closed", F.col("ruled") & (F.upper("turn") == "NONE") & ~F.coalesce("_next", F.lit(False)))
    whole = G.lane_borders(first.select("map_id", "line_id", "pos", "x", "y")).groupBy("map_id", "line_id").agg(F.array_sort(F.collect_list(F.struct("pos", "left_x", "left_y", "right_x", "right_y"))).alias("p"))
    whole = whole.join(facts, ["map_id", "line_id"])

    def border(side: str, kind: Column, last: Column | None = None) -> Column:
        def point(q, i):
            own = kind if last is None else F.when(i == F.size("p") - 1, last).otherwise(kind)
            return F.struct(q[f"{side}_x"].alias("x"), q[f"{side}_y"].alias("y"), own.cast("int").alias("edge_type"))

        return F.transform(F.reverse("p") if side == "right" and last is not None else F.col("p"), point)

    rule = F.lit(_E["REGULATORY"])
    ring = F.concat(border("left", F.col("l_type"), rule), border("right", F.col("r_type"), rule))
    ring = F.concat(ring, F.slice(ring, 1, 1))
    shapes = F.when(F.col("closed"), F.array(ring)).otherwise(F.array(border("left", F.col("l_type")), border("right", F.col("r_type"))))
    lines = whole.select("map_id", "line_id", F.posexplode(shapes).alias("side", "s")).select("map_id", F.concat_ws("-", "line_id", "side").alias("line_id"), F.posexplode("s").alias("pos", "q"))
    nodes, edges = G.graph(lines.select("map_id", "line_id", "pos", "q.x", "q.y", "q.edge_type"), interpolate, interp_distance)
    spot = lambda at, side: F.struct(at[f"{side}_x"].alias("x"), at[f"{side}_y"].alias("y"))
    ends = {f"{side}_{end}": spot(F.element_at("p", n), side) for side in ("left", "right") for end, n in (("from", 1), ("to", -1))}
    tips = whole.select("map_id", "line_id", "l_type", "r_type", *(c.alias(n) for n, c in ends.items()))
    pairs = follow.unionByName(back).distinct().join(tips.drop("left_from", "right_from"), ["map_id", "line_id"])
    pairs = pairs.join(tips.select("map_id", F.col("line_id").alias("to"), "left_from", "right_from"), ["map_id", "to"])
    two = F.explode(F.array(*(F.struct(F.col(f"{s}_to").alias("a"), F.col(f"{s}_from").alias("b"), F.col(f"{s[0]}_type").alias("edge_type")) for s in ("left", "right"))))
    near = pairs.select("map_id", two.alias("e")).where(geometry.distance(F.col("e.a.x"), F.col("e.a.y"), F.col("e.b.x"), F.col("e.b.y")) < most)
    links = near.select("map_id", G.place(F.col("e.a.x"), F.col("e.a.y")).alias("src"), G.place(F.col("e.b.x"), F.col("e.b.y")).alias("dst"), "e.edge_type").where("src <> dst")
    return nodes, edges.unionByName(links).distinct()


# Marks of lane boundaries and their edge types.
LANE_MARKS = {
    "NONE": "NONE", "UNKNOWN": "NONE", "SOLID_WHITE": "LINE_THIN", "SOLID_YELLOW": "LINE_THIN", "DOUBLE_SOLID_WHITE": "LINE_THIN_DOUBLE",
    "DOUBLE_SOLID_YELLOW": "LINE_THIN_DOUBLE", "DASHED_WHITE": "LINE_THIN_DASHED", "DASHED_YELLOW": "LINE_THIN_DASHED", "DOUBLE_DASH_WHITE": "LINE_THIN_DOUBLE_DASHED",
    "DOUBLE_DASH_YELLOW": "LINE_THIN_DOUBLE_DASHED", "DASH_SOLID_WHITE": "LINE_THIN_DASHED", "DASH_SOLID_YELLOW": "LINE_THIN_DASHED",
    "SOLID_DASH_WHITE": "LINE_THIN_DASHED", "SOLID_DASH_YELLOW": "LINE_THIN_DASHED", "SOLID_BLUE": "LINE_THICK",
}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _lane_json(spark: SparkSession, path: str) -> DataFrame:
    point = "array<struct<x:double,y:double,z:double>>"
    lane = f"struct<id:bigint,left_lane_boundary:{point},right_lane_boundary:{point},left_lane_mark_type:string,right_lane_mark_type:string,successors:array<bigint>>"
    crossing = f"struct<id:bigint,edge1:{point},edge2:{point}>"
    area = f"struct<id:bigint,area_boundary:{point}>"
    raw = spark.read.schema(f"lane_segments map<string,{lane}>, pedestrian_crossings map<string,{crossing}>, drivable_areas map<string,{area}>").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return raw.select("*", F.regexp_extract("_metadata.file_name", r"(.*)\.json", 1).alias("map_id"))


def lane_json(spark: SparkSession, path: str, none_as: str = "VIRTUAL") -> DataFrame:
    """Both boundaries of lane segments and both edges of crossings of a map JSON keyed by ids; marks of type NONE are ``none_as``."""
    raw = _lane_json(spark, path)
    marks = {k: _E[none_as if v == "NONE" else v] for k, v in LANE_MARKS.items()}
    line = lambda name, of, points, kind: F.struct(F.concat(F.lit(f"{name}-"), of["id"]).alias("line_id"), of[points].alias("points"), kind.cast("int").alias("edge_type"))
    sides = lambda s: F.array(*(line(n, s, f"{n}_lane_boundary", codes.lookup(marks, s[f"{n}_lane_mark_type"], _E[none_as])) for n in ("left", "right")))
    edges = lambda c: F.array(*(line(n, c, n, F.lit(_E["PEDESTRIAN_MARKING"])) for n in ("edge1", "edge2")))
    each = (F.flatten(F.transform(F.map_values(c), f)) for c, f in (("lane_segments", sides), ("pedestrian_crossings", edges)))
    lines = raw.select("map_id", F.explode(F.concat(*(F.coalesce(e, F.array()) for e in each))).alias("l"))  # all lines of a file in one reading of it
    points = lines.select("map_id", "l.line_id", F.posexplode("l.points").alias("pos", "p"), "l.edge_type")
    return points.select("map_id", "line_id", "pos", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "edge_type")


def drivable_areas(spark: SparkSession, path: str) -> DataFrame:
    """Outlines of the drivable areas of a map JSON (``map_id, area_id, pos, x, y``), which are not part of its graph."""
    areas = _lane_json(spark, path).select("map_id", F.explode(F.map_values("drivable_areas")).alias("a"))
    return areas.select("map_id", F.col("a.id").alias("area_id"), F.posexplode("a.area_boundary").alias("pos", "p")).select("map_id", "area_id", "pos", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


# Types of divider segments and their edge types; others are VIRTUAL.
SEGMENT_TYPES = {
    "NIL": "VIRTUAL", "SINGLE_SOLID_WHITE": "LINE_THIN", "SINGLE_SOLID_YELLOW": "LINE_THIN", "SINGLE_ZIGZAG_WHITE": "REGULATORY",
    "DOUBLE_SOLID_WHITE": "LINE_THIN_DOUBLE", "DOUBLE_DASHED_WHITE": "LINE_THIN_DOUBLE_DASHED",
}
# Layers of the token-based map that have one edge type, by the names by which they are ignored, with their table.
LAYERS = {
    "road_divider": ("road_divider", "LINE_THICK"), "walkway": ("walkway", "CURB"), "pedestrian_crossing": ("ped_crossing", "PEDESTRIAN_MARKING"),
    "traffic_light": ("traffic_light", "REGULATORY"), "stop_line": ("stop_line", "STOP"), "carpark": ("carpark_area", "VIRTUAL"),
}


def valid_stop_line(kind: Column, lights: Column, crossings: Column, allow_crossings: bool = False) -> Column:
    """Stop lines that belong to a light or a crossing, are no turn stops, and (unless allowed) not those of crossings."""
    tied = (F.coalesce(F.size(lights), F.lit(0)) > 0) | (F.coalesce(F.size(crossings), F.lit(0)) > 0)
    kind = F.coalesce(kind, F.lit("TURN_STOP"))
    return tied & (kind != "TURN_STOP") & (F.lit(allow_crossings) | (kind != "PEDESTRIAN_CROSSING"))


def layered_json(spark: SparkSession, path: str, ignore: tuple[str, ...] = (), lane_polygons: str | None = None, map_id: str = "map") -> DataFrame:
    """Layers of a token-based map JSON as polyline points; rows that point to nothing are skipped.

    Lane dividers and the dividers of lanes have the type of each segment; ``lane_polygons`` is the type of lanes'
    outlines, which are left out without it.  ``ignore`` names layers: those of LAYERS, ``lane_divider`` and ``lane``.
    """
    segment = "array<struct<node_token:string,segment_type:string>>"
    shape = f"array<struct<token:string,line_token:string,polygon_token:string,stop_line_type:string,ped_crossing_tokens:array<string>,traffic_light_tokens:array<string>,lane_divider_segments:{segment},left_lane_divider_segments:{segment},right_lane_divider_segments:{segment}>>"
    schema = "node array<struct<token:string,x:double,y:double>>, line array<struct<token:string,node_tokens:array<string>>>, polygon array<struct<token:string,exterior_node_tokens:array<string>>>"
    tables = {n: t for n, (t, _) in LAYERS.items()} | {"lane_divider": "lane_divider", "lane": "lane"}
    raw = spark.read.schema(schema + "".join(f", {t} {shape}" for t in tables.values())).option("multiLine", True).json(path)
    raw = written(raw, "layers")  # parsed once, then read a layer at a time
    nodes = raw.select(F.explode("node").alias("n")).select(F.col("n.token").alias("node"), F.col("n.x").alias("x"), F.col("n.y").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    lines = raw.select(F.explode("line").alias("l")).select(F.concat(F.lit("line "), F.col("l.token")).alias("shape"), F.col("l.node_tokens").alias("tokens"))
    rings = raw.select(F.explode("polygon").alias("l")).select(F.concat(F.lit("polygon "), F.col("l.token")).alias("shape"), F.concat("l.exterior_node_tokens", F.slice("l.exterior_node_tokens", 1, 1)).alias("tokens"))
    rows = lambda t: raw.select(F.explode(t).alias("r"))
    outline = lambda kind: F.concat(F.lit(f"{kind} "), F.col(f"r.{kind}_token")).alias("shape")
    plain, typed = [], []
    for name, (layer, kind) in LAYERS.items():
        if name not in ignore:
            each = rows(layer)
            if name == "stop_line":
                each = each.where(valid_stop_line(F.col("r.stop_line_type"), F.col("r.traffic_light_tokens"), F.col("r.ped_crossing_tokens")))
            plain.append(each.select(F.concat(F.lit(f"{name}-"), F.col("r.token")).alias("line_id"), outline("line" if name in ("road_divider", "traffic_light") else "polygon"), F.lit(_E[kind]).alias("edge_type")))
    dividers = [] if "lane_divider" in ignore else [("lane_divider", "lane_divider_segments")]
    if "lane" not in ignore:
        dividers += [("lane", "left_lane_divider_segments"), ("lane", "right_lane_divider_segments")]
        if lane_polygons:
            plain.append(rows("lane").select(F.concat(F.lit("lane-"), F.col("r.token")).alias("line_id"), outline("polygon"), F.lit(_E[lane_polygons]).alias("edge_type")))
    kinds = {k: _E[v] for k, v in SEGMENT_TYPES.items()}
    for layer, column in dividers:
        each = rows(layer).select(F.concat(F.lit(f"{column}-"), F.col("r.token")).alias("line_id"), F.posexplode(f"r.{column}").alias("pos", "s"))
        typed.append(each.select("line_id", codes.lookup(kinds, F.col("s.segment_type"), _E["VIRTUAL"]).cast("int").alias("edge_type"), "pos", F.col("s.node_token").alias("node")))
    if plain:
        typed.append(_union(plain).join(lines.unionByName(rings), "shape").select("line_id", "edge_type", F.posexplode("tokens").alias("pos", "node")))
    return _union(typed).join(nodes, "node").select(F.lit(map_id).alias("map_id"), "line_id", "pos", "x", "y", "edge_type")


def polygon_lanes_json(spark: SparkSession, path: str, ignore: tuple[str, ...] = (), map_id: str = "map") -> DataFrame:
    """As layered_json(), for maps without a layer of lane dividers, whose lanes have outlines."""
    return layered_json(spark, path, (*ignore, "lane_divider"), "LINE_THIN", map_id)


# Markings of the WKT map and their edge types; a line without marking is VIRTUAL.
WKT_MARKS = {
    "CURB": "CURB", "CURB_TRAVERSABLE": "CURB", "SHORT_DASHED_LINE": "LINE_THIN_DASHED", "SINGLE_SOLID_LINE": "LINE_THIN", "LONG_DASHED_LINE": "LINE_THIN_DASHED",
    "NO_MARKING": "VIRTUAL", "SHADED_AREA_MARKING": "VIRTUAL", "GUARDRAIL": "GUARD_RAIL",
}
# Areas that are not part of the map.
WKT_UNUSED = ("COMPLETE", "NEVER", "EMERGENCY")


def wkt_lines(rows: DataFrame, unknown: str = "NONE") -> DataFrame:
    """Points of rows ``map_id, id, geometry, marking_type, area_type``; rows without a line or ring, and unused areas, are skipped."""
    t = rows.where(F.col("geometry").rlike("^(LINESTRING|POLYGON)") & ~F.coalesce(F.col("area_type"), F.lit("")).isin(*WKT_UNUSED))
    known = codes.lookup({k: _E[v] for k, v in WKT_MARKS.items()}, F.col("marking_type"), _E[unknown])
    kind = F.when(F.col("marking_type").isNull(), _E["VIRTUAL"]).otherwise(known).cast("int")
    p = t.select("map_id", F.col("id").cast("string").alias("line_id"), kind.alias("edge_type"), F.explode(G.wkt_points(F.col("geometry"))).alias("q"))
    return p.select("map_id", "line_id", "q.pos", "q.x", "q.y", "edge_type")


def wkt_sqlite(spark: SparkSession, path: str, table: str = "") -> DataFrame:
    """Lines and polygon rings of the map tables (by a prefix of their names) of SQLite files with WKT."""
    t = sqlite_tables(spark, path, table, "id bigint, type string, geometry string, marking_type string, area_type string")
    return wkt_lines(t.withColumnRenamed("table_name", "map_id"))


# Kinds of scenario map features, the numbers of their types, and the edge types of those.
ROAD_LINES = {0: "VIRTUAL", 1: "LINE_THIN_DASHED", 2: "LINE_THIN", 3: "LINE_THIN_DOUBLE", 4: "LINE_THIN_DASHED", 5: "LINE_THIN_DOUBLE_DASHED", 6: "LINE_THIN", 7: "LINE_THIN_DOUBLE", 8: "LINE_THIN_DOUBLE"}
ROAD_EDGES = {0: "VIRTUAL", 1: "ROAD_BORDER", 2: "GUARD_RAIL"}
FEATURES = {"lane": "VIRTUAL", "crosswalk": "PEDESTRIAN_MARKING", "driveway": "VIRTUAL", "speed_bump": "REGULATORY", "stop_sign": "NONE"}
_RINGS = ("crosswalk", "driveway", "speed_bump")


def scenario_lines(points: DataFrame) -> DataFrame:
    """Typed polylines of scenario map points (``map_id, line_id, kind, type, pos, x, y``); rings are closed, stop signs are single points."""
    by = lambda table: codes.lookup({str(k): _E[v] for k, v in table.items()}, F.col("type").cast("string"), _E["VIRTUAL"])
    kind = F.when(F.col("kind") == "road_line", by(ROAD_LINES)).when(F.col("kind") == "road_edge", by(ROAD_EDGES)).otherwise(codes.lookup({k: _E[v] for k, v in FEATURES.items()}, F.col("kind")))
    typed = points.select("map_id", F.col("line_id").cast("string").alias("line_id"), "pos", "x", "y", kind.cast("int").alias("edge_type"), "kind")
    w = W.partitionBy(*G.LINE)
    first = typed.where(F.col("kind").isin(*_RINGS)).withColumns({"_least": F.min("pos").over(w), "_n": F.max("pos").over(w) + 1})
    closing = first.where("pos = _least").withColumn("pos", F.col("_n").cast("int")).drop("_least", "_n")
    return typed.unionByName(closing).drop("kind")


def centimetre_deltas(segments: DataFrame) -> DataFrame:
    """Lane boundaries stored as centimetre deltas (``map_id, line_id, dx array, dy array``) as points."""
    each = segments.select("map_id", "line_id", F.posexplode(F.arrays_zip("dx", "dy")).alias("pos", "d")).select("map_id", "line_id", "pos", F.col("d.dx").alias("dx"), F.col("d.dy").alias("dy"))
    return G.delta_decode(each).drop("dx", "dy")


def world_file(spark: SparkSession, path: str) -> tuple[float, float]:
    """The origin in a world file: its last two lines that are not empty."""
    lines = [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip()]  # six lines
    return float(lines[-2]), float(lines[-1])


def translated(nodes: DataFrame, origin: tuple[float, float] | None = None) -> DataFrame:
    """Nodes moved so that a given origin, or each map's lower median place, is 0."""
    if origin is None:
        from ..operators.relations import translate_by_median

        return translate_by_median(nodes)
    return nodes.withColumns({"x": F.col("x") - float(origin[0]), "y": F.col("y") - float(origin[1])})
