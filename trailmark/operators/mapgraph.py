"""Typed lane graphs: ``nodes(map_id, node_idx, x, y, node_type)`` and ``edges(map_id, src, dst, edge_type)``.

Polylines come as ``points(map_id, line_id, pos, x, y, edge_type)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codes import EDGE_TYPES
from ..functions.geometry import distance
from ..session import spread

LINE = ("map_id", "line_id")


def interpolation(interpolate: bool, interp_distance: float | None) -> float | None:
    """The distance to interpolate to, or None; both or neither of the settings must be given."""
    if interpolate and interp_distance is None:
        raise ValueError("a distance is needed to interpolate")
    if not interpolate and interp_distance is not None:
        raise ValueError("a distance without interpolation")
    return interp_distance


def place(x: Column, y: Column, key: str = "map_id") -> Column:
    """A node's number from its map and place: points at one place are one node."""
    return F.xxhash64(F.col(key), x + F.lit(0.0), y + F.lit(0.0))  # adding 0 makes -0.0 and 0.0 one


def graph(points: DataFrame, interpolate: bool = False, interp_distance: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``nodes(map_id, node, x, y, node_type)`` and ``edges(map_id, src, dst, edge_type)`` of polylines.

    ``points(map_id, line_id, pos, x, y, edge_type)``: a point's type is that of the edge to the next point of its line;
    polygons end with their first point again, and a line of one point is a node without edges.  Edges run one way,
    are distinct by ends and type, and none joins a place to itself.  Edges longer than the distance are cut into equal
    pieces.  Node types are NONE.  Points without coordinates are left out before lines are joined.
    """
    target = interpolation(interpolate, interp_distance)
    spots = _known(points).select("map_id", "x", "y")
    if target is not None:
        spots = spots.unionByName(interpolate_edges(_lines(points), target).select("map_id", "x", "y"))
    nodes = spots.withColumn("node", place(F.col("x"), F.col("y"))).groupBy("map_id", "node").agg(F.first("x").alias("x"), F.first("y").alias("y"))
    edges = placed_edges(points, interpolate, interp_distance)
    edges = edges.select("map_id", place(F.col("x0"), F.col("y0")).alias("src"), place(F.col("x1"), F.col("y1")).alias("dst"), "edge_type")
    return nodes.withColumn("node_type", F.lit(EDGE_TYPES["NONE"])), edges


def _known(points: DataFrame) -> DataFrame:
    return points.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def _lines(points: DataFrame) -> DataFrame:
    """``map_id, edge_type, x0, y0, x1, y1`` of consecutive points at different places."""
    w = W.partitionBy(*LINE).orderBy("pos")
    ends = _known(points).select("map_id", "edge_type", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    return ends.where(F.col("x1").isNotNull() & ((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1"))))


def placed_edges(points: DataFrame, interpolate: bool = False, interp_distance: float | None = None, at=lambda c: c) -> DataFrame:
    """The edges of graph() by the places of their ends: ``map_id, x0, y0, x1, y1, edge_type``, each once.

    ``at`` gives the coordinate of a place, such as a rounded one; edges are distinct by those.  Equal pieces begin at one
    place, so they meet in its tile: whole edges are sent to the tiles in which their pieces begin, and cut there.
    """
    target = interpolation(interpolate, interp_distance)
    lines, ends = _lines(points), ("x0", "y0", "x1", "y1")
    if target is None:
        return lines.select("map_id", *(at(F.col(c)).alias(c) for c in ends), "edge_type").distinct()
    tile = lambda x, y: F.struct(*(F.floor(at(c) / F.lit(100.0 * target)).alias(n) for n, c in (("i", x), ("j", y))))
    start = lambda i: tile(*(F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * ((i - 1) / _pieces(target)) for c in ("x", "y")))
    near, far = tile(F.col("x0"), F.col("y0")), tile(F.col("x1"), F.col("y1"))
    tiles = F.when(near == far, F.array(near)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), _pieces(target)), start)))
    sent = spread(lines.withColumn("_t", F.explode(tiles)), 16, "map_id", "_t")
    cut = interpolate_edges(sent, target).where(F.col("_t") == tile(F.col("xa"), F.col("ya")))
    own = zip(ends, ("xa", "ya", "x", "y"), strict=True)
    return cut.select("map_id", "_t", *(at(F.col(c)).alias(n) for n, c in own), "edge_type").distinct().drop("_t")


def interpolate_edges(edges: DataFrame, target: float) -> DataFrame:
    """interpolate() with both ends of each piece: ``xa, ya`` to ``x, y``; the last piece ends exactly at the far node."""
    cut = interpolate(edges, target)
    part = (F.col("piece") - 1) / F.col("pieces")
    last = F.col("piece") == F.col("pieces")
    out = {"xa": F.col("x0") + (F.col("x1") - F.col("x0")) * part, "ya": F.col("y0") + (F.col("y1") - F.col("y0")) * part}
    return cut.withColumns(out | {"x": F.when(last, F.col("x1")).otherwise(F.col("x")), "y": F.when(last, F.col("y1")).otherwise(F.col("y"))})


def normalized(nodes: DataFrame, edges: DataFrame, return_if_empty: bool = True) -> tuple[DataFrame, DataFrame]:
    """Maps with nodes and edges; a map that lacks either is empty.  Without any map left: an error, or empty tables."""
    whole = nodes.join(edges.select("map_id").distinct(), "map_id", "left_semi")
    lines = edges.join(nodes.select("map_id").distinct(), "map_id", "left_semi")
    if not return_if_empty and whole.isEmpty():
        raise ValueError("a map has no nodes or no edges")
    return whole, lines


def renamed_types(edges: DataFrame, table: dict[int, int]) -> DataFrame:
    """Edges whose types have other numbers by a table; those not in it stay."""
    kind = F.col("edge_type")
    for old, new in table.items():
        kind = F.when(F.col("edge_type") == old, new).otherwise(kind)
    return edges.withColumn("edge_type", kind.cast("int"))


def box_subgraph(nodes: DataFrame, edges: DataFrame, center: tuple[float, float] | None = None, width: float | None = None, height: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The part of each map within a box, borders included; by default about its nodes' mean place, a tenth of its extent."""
    ext = nodes.groupBy("map_id").agg(
        (F.avg("x") if center is None else F.lit(float(center[0]))).alias("_cx"), (F.avg("y") if center is None else F.lit(float(center[1]))).alias("_cy"),
        ((F.max("x") - F.min("x")) * 0.1 if width is None else F.lit(float(width))).alias("_w"), ((F.max("y") - F.min("y")) * 0.1 if height is None else F.lit(float(height))).alias("_h"),
    )
    at = nodes.join(ext, "map_id")
    inside = in_box(F.col("x"), F.col("y"), F.col("_cx"), F.col("_cy"), F.col("_w") / 2, F.col("_h") / 2)
    kept, lines = subgraph(at, edges, inside)
    return kept.drop("_cx", "_cy", "_w", "_h"), lines


def line_edges(points: DataFrame, closed: bool = False, node: str = "node") -> DataFrame:
    """``map_id, line_id, src, dst, edge_type``: consecutive points of each line; closed adds last to first."""
    w = W.partitionBy(*LINE).orderBy("pos")
    nxt = F.lead(node).over(w)
    if closed:
        nxt = F.coalesce(nxt, F.first(node).over(w))
    return points.withColumn("dst", nxt).where(F.col("dst").isNotNull()).select(*LINE, F.col(node).alias("src"), "dst", "edge_type")


def both_ways(edges: DataFrame) -> DataFrame:
    keep = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(*keep, "src", "dst").unionByName(edges.select(*keep, F.col("dst").alias("src"), F.col("src").alias("dst")))


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("map_id", "src", "dst", "edge_type").distinct()


def first_occurrence(points: DataFrame, keys=LINE) -> DataFrame:
    """Points of a line without later repeats of a place."""
    again = F.row_number().over(W.partitionBy(*keys, "x", "y").orderBy("pos"))
    return points.withColumn("_r", again).where("_r = 1").drop("_r")


def every_nth(points: DataFrame, n: int, keys=LINE) -> DataFrame:
    pos = F.row_number().over(W.partitionBy(*keys).orderBy("pos")) - 1
    return points.withColumn("_r", pos).where(F.col("_r") % n == 0).drop("_r")


def thin(points: DataFrame, least: float, keys=LINE) -> DataFrame:
    """Points at least ``least`` from the last point kept; a fold over each line, which holds one line at a time."""
    lines = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))

    def fold(acc, p):
        last = F.element_at(acc, -1)
        return F.when(distance(p["x"], p["y"], last["x"], last["y"]) >= least, F.concat(acc, F.array(p))).otherwise(acc)

    kept = F.aggregate(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1), fold)
    return lines.select(*keys, F.explode(kept).alias("q")).select(*keys, "q.pos", "q.x", "q.y")


def delta_decode(points: DataFrame, scale: float = 0.01, columns=("dx", "dy"), names=("x", "y"), keys=LINE) -> DataFrame:
    """Running sums of deltas, scaled."""
    w = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return points.withColumns({n: F.sum(c).over(w) * F.lit(scale) for c, n in zip(columns, names, strict=True)})


def _pieces(target: float) -> Column:
    d = distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return F.greatest(F.ceil(d / F.lit(float(target))), F.lit(1)).cast("int")


def interpolate(edges: DataFrame, target: float) -> DataFrame:
    """Edges (``.., x0, y0, x1, y1``) cut into ``ceil(length / target)`` equal pieces that end at the far node: ``piece, x, y``."""
    cut = edges.withColumn("pieces", _pieces(target)).withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("pieces"))))
    part = F.col("piece") / F.col("pieces")
    return cut.withColumns({"x": F.col("x0") + (F.col("x1") - F.col("x0")) * part, "y": F.col("y0") + (F.col("y1") - F.col("y0")) * part})


def node_types(edges: DataFrame, order: str = "line_id") -> DataFrame:
    """``map_id, node, node_type``: the first type other than NONE of the lines at a node, else NONE."""
    none = EDGE_TYPES["NONE"]
    ends = edges.select("map_id", F.col("src").alias("node"), order, "edge_type").unionByName(edges.select("map_id", F.col("dst").alias("node"), order, "edge_type"))
    real = F.when(F.col("edge_type") != none, F.struct(F.col(order), F.col("edge_type")))
    return ends.groupBy("map_id", "node").agg(F.coalesce(F.min(real)["edge_type"], F.lit(none)).alias("node_type"))


def index_nodes(nodes: DataFrame, order: str = "node") -> DataFrame:
    """Dense numbers from 0 in each map, in the order of a key."""
    return nodes.withColumn("node_idx", (F.row_number().over(W.partitionBy("map_id").orderBy(order)) - 1).cast("int"))


def subgraph(nodes: DataFrame, edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The nodes (``map_id, node, x, y``) that satisfy a condition, numbered anew, and the edges with both ends among them."""
    kept = index_nodes(nodes.where(keep))
    a = kept.select("map_id", F.col("node").alias("src"), F.col("node_idx").alias("_s"))
    b = kept.select("map_id", F.col("node").alias("dst"), F.col("node_idx").alias("_d"))
    inside = edges.join(a, ["map_id", "src"]).join(b, ["map_id", "dst"])
    return kept, inside.select("map_id", F.col("_s").alias("src"), F.col("_d").alias("dst"), "edge_type")


def in_radius(x: Column, y: Column, x0, y0, r) -> Column:
    return distance(x, y, x0, y0) <= r


def in_box(x: Column, y: Column, x0, y0, half_x, half_y) -> Column:
    return x.between(x0 - half_x, x0 + half_x) & y.between(y0 - half_y, y0 + half_y)


def highway_grid(spark: SparkSession, markings: list[float], x_min: float, x_max: float, spacing: float, buffer: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Nodes every ``spacing`` along each marking over the aligned range, tied to the next one both ways.

    The outer markings are road borders, the inner ones dashed thin lines.
    """
    low, high = int((x_min - buffer) // spacing), int(-(-(x_max + buffer) // spacing))
    lines = spark.createDataFrame(list(enumerate(map(float, markings))), "line_id int, y double")
    n, outer = high - low + 1, F.col("line_id").isin(0, len(markings) - 1)
    kind = F.when(outer, EDGE_TYPES["ROAD_BORDER"]).otherwise(EDGE_TYPES["LINE_THIN_DASHED"])
    nodes = lines.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    nodes = nodes.select((F.col("line_id") * n + F.col("i")).alias("node"), ((F.col("i") + low) * F.lit(float(spacing))).alias("x"), "y", kind.alias("node_type"), "i")
    ahead = nodes.where(F.col("i") < n - 1).select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst"), F.col("node_type").alias("edge_type"))
    back = ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type")
    return nodes.drop("i"), ahead.unionByName(back)


def lane_borders(points: DataFrame, half: float = 1.9, keys=LINE, exchange: bool = True) -> DataFrame:
    """Left and right borders of a centre line: its points moved along the normal of the local direction.

    ``exchange``: where the line runs exactly along the positive x or y axis the two sides change places, as they do
    in the border files that samples are compared with; without it left is always left.
    """
    w = W.partitionBy(*keys).orderBy("pos")

    def slope(c: str) -> Column:
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        return F.coalesce((after - before) / 2, after - F.col(c), F.col(c) - before, F.lit(0.0))

    way = points.withColumns({"_dx": slope("x"), "_dy": slope("y")}).withColumn("_h", F.atan2("_dy", "_dx"))
    along_axis = ((F.col("_dy") == 0) & (F.col("_dx") > 0)) | ((F.col("_dx") == 0) & (F.col("_dy") > 0))
    side = F.when(along_axis, -half).otherwise(half) if exchange else F.lit(half)
    shift = {
        "left_x": F.col("x") - side * F.sin("_h"), "left_y": F.col("y") + side * F.cos("_h"),
        "right_x": F.col("x") + side * F.sin("_h"), "right_y": F.col("y") - side * F.cos("_h"),
    }
    return way.withColumns(shift).drop("_dx", "_dy", "_h")


def boundary_changes(segments: DataFrame, keys=LINE) -> DataFrame:
    """Where the type of a boundary changes: ``offset, kind`` at the accumulated length of the pieces before (``pos, length, kind``)."""
    w = W.partitionBy(*keys).orderBy("pos")
    at = F.coalesce(F.sum("length").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    before = F.lag("kind").over(w)
    return segments.withColumns({"offset": at, "_b": before}).where(~F.col("kind").eqNullSafe(F.col("_b"))).select(*keys, "pos", "offset", "kind")


def mirrored(nodes: DataFrame, x_max: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Nodes of an image's map for the lower lanes (y turned over) and the upper ones (x turned about x_max)."""
    lower = nodes.withColumn("y", -F.col("y"))
    return lower, nodes.withColumn("x", F.lit(float(x_max)) - F.col("x"))


def link_lanes(ends: DataFrame, starts: DataFrame, most: float = 1.0) -> DataFrame:
    """Edges from a lane's last point to its successors' first, where those are nearer than ``most``.

    ``ends(map_id, node, x, y, successor)``, ``starts(map_id, lane, node, x, y)``.
    """
    a = ends.select("map_id", F.col("node").alias("src"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("successor").alias("lane"))
    b = starts.select("map_id", "lane", F.col("node").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    near = distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) < most
    return a.join(b, ["map_id", "lane"]).where(near).select("map_id", "src", "dst").distinct()


def wkt_points(wkt: Column) -> Column:
    """The points of a LINESTRING, or of a POLYGON's outer ring, as an array of structs."""
    inner = F.regexp_extract(wkt, r"\(+([^()]*)\)", 1)
    return F.transform(
        F.split(inner, r"\s*,\s*"),
        lambda p, i: F.struct(i.cast("int").alias("pos"), F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y")),
    )
