"""Queries of lane graphs, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import mapgraph as G
from ..operators import relations as R
from .views import POLY, TR, polylines, query, table, tracks

EDGES = f"{POLY}, ed AS (SELECT map_id, line_id, node AS src, lead(node) OVER (PARTITION BY line_id ORDER BY pos) AS dst, edge_type FROM poly QUALIFY dst IS NOT NULL)"


@query("graph_edges", f"WITH {EDGES} SELECT map_id, line_id, src, dst, edge_type FROM ed")
def graph_edges(spark, sf_dir):
    return G.line_edges(polylines(spark, sf_dir)).select("map_id", "line_id", "src", "dst", "edge_type")


@query("graph_bidirectional", f"WITH {EDGES} SELECT map_id, src, dst, edge_type FROM ed UNION ALL SELECT map_id, dst, src, edge_type FROM ed")
def graph_bidirectional(spark, sf_dir):
    return G.both_ways(G.line_edges(polylines(spark, sf_dir)).drop("line_id")).select("map_id", "src", "dst", "edge_type")


@query("graph_polygon_loop", f"WITH {POLY} SELECT map_id, node AS src, coalesce(lead(node) OVER w, first_value(node) OVER w) AS dst, edge_type FROM poly WINDOW w AS (PARTITION BY line_id ORDER BY pos)")
def graph_polygon_loop(spark, sf_dir):
    return G.line_edges(polylines(spark, sf_dir), closed=True).select("map_id", "src", "dst", "edge_type")


@query("graph_dedup_edges", f"WITH {EDGES} SELECT DISTINCT map_id, src % 7 AS src, dst % 7 AS dst, edge_type FROM ed")
def graph_dedup_edges(spark, sf_dir):
    e = G.line_edges(polylines(spark, sf_dir)).withColumns({"src": F.col("src") % 7, "dst": F.col("dst") % 7})
    return G.distinct_edges(e)


@query("graph_dedup_points", f"WITH {POLY} SELECT line_id, pos, round(x / 10) AS x FROM (SELECT *, row_number() OVER (PARTITION BY line_id, round(x / 10) ORDER BY pos) AS r FROM poly) WHERE r = 1")
def graph_dedup_points(spark, sf_dir):
    p = polylines(spark, sf_dir).withColumns({"x": F.round(F.col("x") / 10), "y": F.lit(0.0)})
    return G.first_occurrence(p).select("line_id", "pos", "x")


@query("polyline_every_nth", f"WITH {POLY} SELECT line_id, pos FROM poly WHERE (pos - 1) % 3 = 0")
def polyline_every_nth(spark, sf_dir):
    return G.every_nth(polylines(spark, sf_dir), 3).select("line_id", "pos")


@query("polyline_thin", f"""WITH RECURSIVE {POLY}, k AS (SELECT line_id, pos, x, y FROM poly WHERE pos = 1 UNION ALL
SELECT line_id, n.pos, n.x, n.y FROM (SELECT k.line_id, min(p.pos) AS pos FROM k JOIN poly p ON p.line_id = k.line_id AND p.pos > k.pos
 AND sqrt((p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y)) >= 15 GROUP BY k.line_id) JOIN poly n USING (line_id, pos)) SELECT line_id, pos FROM k""")  # fmt: skip
def polyline_thin(spark, sf_dir):
    return G.thin(polylines(spark, sf_dir), 15.0).select("line_id", "pos")


@query("delta_decode", f"WITH {POLY} SELECT line_id, pos, round(sum(x) OVER w * 0.01, 8) AS dx, round(sum(y) OVER w * 0.01, 8) AS dy FROM poly WINDOW w AS (PARTITION BY line_id ORDER BY pos)")
def delta_decode(spark, sf_dir):
    p = G.delta_decode(polylines(spark, sf_dir), columns=("x", "y"), names=("dx", "dy"))
    return p.select("line_id", "pos", F.round("dx", 8).alias("dx"), F.round("dy", 8).alias("dy"))


_ENDS = f"""{POLY}, en AS (SELECT line_id, pos, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM poly WINDOW w AS (PARTITION BY line_id ORDER BY pos))"""


def _ends(spark, sf_dir):
    w = W.partitionBy("line_id").orderBy("pos")
    p = polylines(spark, sf_dir).select("line_id", "pos", F.col("x").alias("x0"), F.col("y").alias("y0"))
    return p.withColumns({"x1": F.lead("x0").over(w), "y1": F.lead("y0").over(w)}).where("x1 IS NOT NULL")


@query("graph_interpolate", f"""WITH {_ENDS}, c AS (SELECT *, greatest(ceil(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / 10), 1)::INTEGER AS n FROM en WHERE x1 IS NOT NULL)
SELECT line_id, pos, piece::INTEGER AS piece, round(x0 + (x1 - x0) * (piece / n), 9) AS x, round(y0 + (y1 - y0) * (piece / n), 9) AS y FROM (SELECT *, unnest(range(1, n + 1)) AS piece FROM c)""")  # fmt: skip
def graph_interpolate(spark, sf_dir):
    return G.interpolate(_ends(spark, sf_dir), 10.0).select("line_id", "pos", "piece", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


def _sub_sql(condition: str) -> str:
    return f"""WITH {EDGES}, kn AS (SELECT map_id, node, row_number() OVER (PARTITION BY map_id ORDER BY node) - 1 AS i FROM poly WHERE {condition})
SELECT ed.map_id, a.i::INTEGER AS src, b.i::INTEGER AS dst, edge_type FROM ed JOIN kn a ON a.map_id = ed.map_id AND a.node = src JOIN kn b ON b.map_id = ed.map_id AND b.node = dst"""


@query("graph_radius", _sub_sql("sqrt((x - 25) * (x - 25) + (y - 30) * (y - 30)) <= 20"))
def graph_radius(spark, sf_dir):
    p = polylines(spark, sf_dir)
    return G.subgraph(p.select("map_id", "node", "x", "y"), G.line_edges(p), G.in_radius(F.col("x"), F.col("y"), F.lit(25.0), F.lit(30.0), 20.0))[1]


@query("graph_bbox", _sub_sql("x BETWEEN 10 AND 40 AND y BETWEEN 15 AND 45"))
def graph_bbox(spark, sf_dir):
    p = polylines(spark, sf_dir)
    return G.subgraph(p.select("map_id", "node", "x", "y"), G.line_edges(p), G.in_box(F.col("x"), F.col("y"), 25.0, 30.0, 15.0, 15.0))[1]


@query("graph_node_type", f"""WITH {EDGES}, e AS (SELECT map_id, src % 50 AS node, line_id, edge_type FROM ed UNION ALL SELECT map_id, dst % 50, line_id, edge_type FROM ed)
SELECT map_id, node, coalesce(arg_min(edge_type, line_id) FILTER (edge_type <> 1), 1)::INTEGER AS node_type FROM e GROUP BY ALL""")  # fmt: skip
def graph_node_type(spark, sf_dir):
    e = G.line_edges(polylines(spark, sf_dir)).withColumns({"src": F.col("src") % 50, "dst": F.col("dst") % 50})
    return G.node_types(e)


@query("graph_index", f"WITH {POLY} SELECT map_id, node, (row_number() OVER (PARTITION BY map_id ORDER BY node) - 1)::INTEGER AS node_idx FROM poly")
def graph_index(spark, sf_dir):
    return G.index_nodes(polylines(spark, sf_dir)).select("map_id", "node", "node_idx")


@query("graph_grid", """WITH m AS (SELECT * FROM (VALUES (0, 0.0), (1, 3.5), (2, 7.0), (3, 10.5)) v(line_id, y)), g AS (SELECT line_id, y, i FROM m, (SELECT unnest(range(0, 15)) AS i))
SELECT (line_id * 15 + i)::INTEGER AS src, (line_id * 15 + i + 1)::INTEGER AS dst, CASE WHEN line_id IN (0, 3) THEN 2 ELSE 7 END AS edge_type FROM g WHERE i < 14
UNION ALL SELECT (line_id * 15 + i + 1)::INTEGER, (line_id * 15 + i)::INTEGER, CASE WHEN line_id IN (0, 3) THEN 2 ELSE 7 END FROM g WHERE i < 14""")  # fmt: skip
def graph_grid(spark, sf_dir):
    return G.highway_grid(spark, [0, 3.5, 7, 10.5], 3.0, 116.0, 10.0, 10.0)[1].select("src", "dst", "edge_type")


@query("lane_borders", f"""WITH {POLY}, s AS (SELECT *, coalesce((lead(x) OVER w - lag(x) OVER w) / 2, lead(x) OVER w - x, x - lag(x) OVER w, 0) AS dx,
 coalesce((lead(y) OVER w - lag(y) OVER w) / 2, lead(y) OVER w - y, y - lag(y) OVER w, 0) AS dy FROM poly WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
th AS (SELECT *, CASE WHEN dy <> 0 THEN atan(-dx / dy) WHEN dx < 0 THEN pi() / 2 ELSE -pi() / 2 END AS th FROM s),
sw AS (SELECT *, CASE WHEN ((dx > 0 AND dy <> 0)::INTEGER + (sin(th) > 0)::INTEGER + (dx <> 0 OR dy <> 0)::INTEGER) % 2 = 0 THEN 1.9::DOUBLE ELSE -1.9::DOUBLE END AS side FROM th)
SELECT line_id, pos, round(x - side * cos(th), 5) AS left_x, round(y - side * sin(th), 5) AS left_y, round(x + side * cos(th), 5) AS right_x FROM sw""")  # fmt: skip
def lane_borders(spark, sf_dir):
    b = G.lane_borders(polylines(spark, sf_dir))
    return b.select("line_id", "pos", *(F.round(c, 5).alias(c) for c in ("left_x", "left_y", "right_x")))


@query("boundary_changes", """WITH p AS (SELECT l_orderkey AS line_id, l_returnflag AS kind, l_quantity AS length, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM lineitem)
SELECT line_id, pos::INTEGER AS pos, round(coalesce(sum(length) OVER (PARTITION BY line_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS offset_m, kind FROM p QUALIFY kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY line_id ORDER BY pos)""")  # fmt: skip
def boundary_changes(spark, sf_dir):
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)).cast("int")
    p = li.select(F.lit(0).alias("map_id"), F.col("l_orderkey").alias("line_id"), pos.alias("pos"), F.col("l_quantity").alias("length"), F.col("l_returnflag").alias("kind"))
    return G.boundary_changes(p).select("line_id", "pos", F.round("offset", 6).alias("offset_m"), "kind")


@query("link_lanes", f"""WITH {POLY}, a AS (SELECT map_id, line_id, arg_max(node, pos) AS n, arg_max(x, pos) AS x, arg_max(y, pos) AS y FROM poly GROUP BY ALL), b AS (SELECT map_id, line_id, arg_min(node, pos) AS n, arg_min(x, pos) AS x, arg_min(y, pos) AS y FROM poly GROUP BY ALL)
SELECT a.map_id, a.n AS src, b.n AS dst FROM a JOIN b ON a.map_id = b.map_id AND b.line_id = a.line_id + 1 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 12""")  # fmt: skip
def link_lanes(spark, sf_dir):
    p = polylines(spark, sf_dir)
    ends = p.groupBy("map_id", "line_id").agg(*(F.max_by(c, "pos").alias(c) for c in ("node", "x", "y"))).withColumn("successor", F.col("line_id") + 1)
    starts = p.groupBy("map_id", "line_id").agg(*(F.min_by(c, "pos").alias(c) for c in ("node", "x", "y"))).withColumnRenamed("line_id", "lane")
    return G.link_lanes(ends, starts, 12.0)


@query("wkt_lines", f"""WITH {POLY} SELECT line_id, pos - 1 AS pos, x, y FROM poly""")
def wkt_lines(spark, sf_dir):
    """Lines written as WKT and read again."""
    p = polylines(spark, sf_dir).groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    text = F.concat(F.lit("LINESTRING ("), F.array_join(F.transform("p", lambda q: F.concat_ws(" ", q["x"].cast("string"), q["y"].cast("string"))), ", "), F.lit(")"))
    return p.select("line_id", F.explode(G.wkt_points(text)).alias("q")).select("line_id", "q.pos", "q.x", "q.y")


@query("graph_translate", f"WITH {POLY}, m AS (SELECT map_id, quantile_disc(x, 0.5) AS mx, quantile_disc(y, 0.5) AS my FROM poly GROUP BY 1) SELECT line_id, pos, round(x - mx, 6) AS x, round(y - my, 6) AS y FROM poly JOIN m USING (map_id)")
def graph_translate(spark, sf_dir):
    p = polylines(spark, sf_dir)
    return R.translate_by_median(p).select("line_id", "pos", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("mean_at_median_frame", f"""WITH {TR}, m AS (SELECT rec_id, floor(median(frame))::INTEGER AS f FROM tr GROUP BY 1) SELECT rec_id, f, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM tr JOIN m USING (rec_id) WHERE frame = f GROUP BY ALL""")
def mean_at_median_frame(spark, sf_dir):
    return R.mean_at_median(tracks(spark, sf_dir)).select("rec_id", "f", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("utm_projection", "SELECT event_id, round(59.3 + value / 1000, 6) AS lat, round(17.9 + (event_id % 100) / 500.0::DOUBLE, 6) AS lon FROM events")
def utm_projection(spark, sf_dir):
    """Positions projected and mapped back by a Newton step's worth of inverse: the places that went in come out."""
    e = table(spark, sf_dir, "events").select("event_id", (F.lit(59.3) + F.col("value") / 1000).alias("lat"), (F.lit(17.9) + (F.col("event_id") % 100) / F.lit(500.0)).alias("lon"))
    east, north = geometry.utm(F.col("lat"), F.col("lon"))
    both = e.withColumns({"e": east, "n": north})
    lat, lon = geometry.utm_inverse(F.col("e"), F.col("n"), 33)
    lat2, lon2 = (F.when(F.col("lon") < 18, a).otherwise(b) for a, b in zip((lat, lon), geometry.utm_inverse(F.col("e"), F.col("n"), 34), strict=True))
    return both.select("event_id", F.round(lat2, 6).alias("lat"), F.round(lon2, 6).alias("lon"))


@query("csr_interval_join", """WITH f AS (SELECT o_orderkey AS frame_id, (o_orderkey * 3) % 40 AS a, (o_orderkey * 3) % 40 + o_orderkey % 5 AS b FROM orders), g AS (SELECT c_custkey AS agent_pos, c_nationkey FROM customer)
SELECT frame_id, agent_pos, c_nationkey FROM f JOIN g ON agent_pos >= a AND agent_pos < b""")  # fmt: skip
def csr_interval_join(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"), ((F.col("o_orderkey") * 3) % 40).alias("lo"))
    f = f.withColumn("hi", F.col("lo") + F.col("frame_id") % 5)
    g = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("agent_pos"), "c_nationkey")
    return R.interval_join(f, g, "lo", "hi", "agent_pos").select("frame_id", "agent_pos", "c_nationkey")


@query("token_join", """SELECT o_orderkey, n_name AS country, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def token_join(spark, sf_dir):
    chain = [("customer", "o_custkey", "c_custkey"), ("nation", "c_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey")]
    out = R.follow(table(spark, sf_dir, "orders"), [(table(spark, sf_dir, t), a, b) for t, a, b in chain])
    return out.select("o_orderkey", F.col("n_name").alias("country"), F.col("r_name").alias("region"))


@query("linked_list_order", f"WITH {TR} SELECT track_id, frame, frame - 1 AS ordinal FROM tr")
def linked_list_order(spark, sf_dir):
    """Rows with ``prev`` and ``next`` tokens in the order of their times; the links agree with it."""
    t = tracks(spark, sf_dir).withColumn("token", F.concat_ws("-", "track_id", "frame"))
    w = W.partitionBy("track_id").orderBy("frame")
    t = t.withColumn("next", F.lead("token").over(w))
    return R.list_order(t, "track_id", "frame", "token", "next").select("track_id", "frame", "ordinal")


@query("union_tracks", f"""WITH {TR}, v AS (SELECT * FROM tr WHERE track_id % 3 > 0), p AS (SELECT * FROM tr WHERE track_id % 3 = 0), ids AS (SELECT track_id, dense_rank() OVER (ORDER BY f, track_id) AS r FROM (SELECT track_id, min(frame) AS f FROM p GROUP BY 1))
SELECT track_id, frame, x FROM v UNION ALL SELECT (SELECT max(track_id) FROM v) + r, frame, x FROM p JOIN ids USING (track_id)""")  # fmt: skip
def union_tracks(spark, sf_dir):
    t = tracks(spark, sf_dir)
    out = R.union_with_offset(t.where("track_id % 3 > 0"), t.where("track_id % 3 = 0"))
    return out.select("track_id", "frame", "x")


@query("setdiff_tracks", f"WITH {TR} SELECT DISTINCT track_id FROM tr WHERE event_type = 'view' AND y < 3 EXCEPT SELECT track_id FROM tr WHERE event_type = 'error' AND y > 97")
def setdiff_tracks(spark, sf_dir):
    t = tracks(spark, sf_dir)
    bad = t.where("event_type = 'error' AND y > 97").select("track_id")
    return t.where("event_type = 'view' AND y < 3").select("track_id").distinct().join(bad, "track_id", "left_anti")


@query("split_list_union", f"WITH {TR} SELECT track_id FROM tr WHERE y < 2 UNION SELECT track_id FROM tr WHERE y > 97")
def split_list_union(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return t.where("y < 2").select("track_id").union(t.where("y > 97").select("track_id")).distinct()


@query("first_per_key", f"WITH {TR} SELECT track_id, arg_min(event_type, frame) AS agent_type, min(frame) AS initial_frame, max(frame) AS final_frame FROM tr GROUP BY 1")
def first_per_key(spark, sf_dir):
    from ..operators.filters import meta

    return meta(tracks(spark, sf_dir), "event_type").select("track_id", "agent_type", "initial_frame", "final_frame")


@query("time_to_frame", "SELECT event_id, (dense_rank() OVER (PARTITION BY user_id ORDER BY round(value, 1)) - 1)::INTEGER AS frame FROM events")
def time_to_frame(spark, sf_dir):
    return R.dense_frame(table(spark, sf_dir, "events"), "user_id", F.round("value", 1)).select("event_id", "frame")


@query("scene_split_join", f"""WITH {TR} SELECT CASE rec_id % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split, rec_id, count(*) AS n FROM tr WHERE rec_id % 7 <> 6 GROUP BY ALL""")
def scene_split_join(spark, sf_dir):
    """Every recording is in one list, but for those that no list names."""
    t = tracks(spark, sf_dir)
    every = sorted(r[0] for r in t.select("rec_id").distinct().collect())  # published lists name each recording
    named = [i for i in every if i % 7 != 6]
    lists = {"train": [i for i in named if i % 5 < 3], "val": [i for i in named if i % 5 == 3], "test": [i for i in named if i % 5 == 4]}
    return R.with_split_lists(t, "rec_id", lists).groupBy("split", "rec_id").agg(F.count("*").alias("n"))


@query("recording_lookup", f"""WITH {TR} SELECT track_id, max(n_name) AS place, count(*) AS n FROM tr JOIN nation ON n_nationkey = rec_id % 25 GROUP BY 1""")
def recording_lookup(spark, sf_dir):
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("_k"), F.col("n_name").alias("place"))
    t = tracks(spark, sf_dir).withColumn("_k", F.col("rec_id") % 25)
    return t.join(places, "_k").groupBy("track_id").agg(F.max("place").alias("place"), F.count("*").alias("n"))


@query("first_n_samples", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def first_n_samples(spark, sf_dir):
    return R.small_data(table(spark, sf_dir, "documents"), "doc_id").select("doc_id")


@query("batches", "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 16)::INTEGER AS batch FROM documents")
def batches(spark, sf_dir):
    return R.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 16).select("doc_id", "batch")
