"""Readers on small files of each format."""

import gzip
import json
import math
import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.functions.codes import EDGE_TYPES
from trailmark.operators import mapgraph as G
from trailmark.sources import binary, images, maps, rows, sinks
from trailmark.sources import trajectories as T


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_urban(spark, tmp_path):
    put(tmp_path / "00_tracks.csv", "recordingId,trackId,frame,xCenter,yCenter,heading,xVelocity,yVelocity,xAcceleration,yAcceleration\n0,3,0,1.5,2.5,270,1,2,3,4\n")
    put(tmp_path / "00_tracksMeta.csv", "trackId,class,initialFrame,finalFrame\n3,Car,0,9\n")
    put(tmp_path / "00_recordingMeta.csv", "xUtmOrigin,yUtmOrigin\n100.5,200.5\n")
    t, m, r = T.urban(spark, str(tmp_path))
    row = t.first()
    assert (row.rec_id, row.track_id, row.x, row.vx) == ("00", 3, 1.5, 1.0) and abs(row.psi + np.pi / 2) < 1e-9
    assert m.first().agent_type == "car" and r.first().yUtmOrigin == 200.5


def test_freeway_and_cases(spark, tmp_path):
    put(tmp_path / "f" / "trajectories-0750.csv", "Vehicle_ID,Frame_ID,Total_Frames,Local_X,Local_Y,v_Class,Lane_ID\n7,12,100,10,100,2,3\n7,13,100,10,200,2,3\n")
    row = T.freeway_feet(spark, str(tmp_path / "f")).where("frame = 13").first()
    assert (row.track_id, row.agent_type, row.lane_id, row.vx) == (7, "car", 3, 0.0) and abs(row.x - 30.48) < 1e-9 and abs(row.y + 3.048) < 1e-9
    lanes = "".join(f"{i},1,{10 * i},0,2,{i}\n" for i in (1, 2, 3))  # centres 10, 20 and 30 feet, of which the first two are fitted
    put(tmp_path / "g" / "trajectories-1.csv", f"vehicle_id,frame_id,local_x,local_y,v_class,lane_id\n{lanes}")
    # the model's bounds are -5, -15 and -25 feet, and y is counted from the least
    got = {r.track_id: round(r.y / 0.3048, 6) for r in T.freeway_feet(spark, str(tmp_path / "g")).collect()}
    assert got == {1: 15.0, 2: 5.0, 3: -5.0}
    put(tmp_path / "c" / "DR_USA_train.csv", "case_id,track_id,frame_id,timestamp_ms,agent_type,x,y,vx,vy\n1.0,2,3,300,pedestrian/bicycle,1,2,0,0\n")
    row = T.cases(spark, str(tmp_path / "c")).first()
    assert (row.rec_id, row.case_id, row.agent_type) == ("DR_USA", 1, "pedestrian")


def test_text_formats(spark, tmp_path):
    put(tmp_path / "a" / "r.txt", "5 1 3 10.0 20.0 0 1 1 1 0.5\n")
    row = T.whitespace_text(spark, str(tmp_path / "a")).first()
    assert (row.rec_id, row.frame, row.agent_type, row.x) == ("r", 5, "pedestrian", 10.0)
    put(tmp_path / "p" / "zara.txt", "780.0\t1.0\t8.4\t3.5\n790.0\t1.0\t9.5\t3.9\n")
    assert [(r.frame, r.x) for r in T.pedestrian_tsv(spark, str(tmp_path / "p")).orderBy("frame").collect()] == [(0, 8.4), (1, 9.5)]
    put(tmp_path / "s" / "1.csv", "TIMESTAMP,TRACK_ID,OBJECT_TYPE,X,Y,CITY_NAME\n0.2,a,AGENT,1,2,PIT\n0.1,a,AGENT,0,2,PIT\n0.2,b,OTHERS,1,1,PIT\n")
    rows = {(r.track_id, r.frame): r.agent_type for r in T.sequences(spark, str(tmp_path / "s")).collect()}
    assert rows == {("a", 0): "car", ("a", 1): "car", ("b", 1): "undefined"}


def test_token_tables(spark, tmp_path):
    tables = {
        "scene": [{"token": "s", "log_token": "l", "name": "scene-1", "first_sample_token": "a"}],
        "sample": [{"token": "b", "timestamp": 2, "prev": "a", "next": "", "scene_token": "s"}, {"token": "a", "timestamp": 1, "prev": "", "next": "b", "scene_token": "s"}],
        "sample_data": [{"token": "d", "sample_token": "a", "ego_pose_token": "e", "timestamp": 1}, {"token": "d2", "sample_token": "b", "ego_pose_token": "e", "timestamp": 2}],
        "ego_pose": [{"token": "e", "translation": [1.0, 2.0, 0.0]}],
        "sample_annotation": [{"token": "n", "sample_token": "b", "instance_token": "i", "attribute_tokens": ["t"], "translation": [5.0, 6.0, 0.0]}],
        "instance": [{"token": "i", "category_token": "c"}],
        "category": [{"token": "c", "name": "vehicle.bus.rigid"}],
        "attribute": [{"token": "t", "name": "vehicle.moving"}],
        "log": [{"token": "l", "location": "town"}],
    }
    for name, rows in tables.items():
        put(tmp_path / f"{name}.json", json.dumps(rows))
    rows = {(r.track_id, r.frame): (r.agent_type, r.full_status, r.x) for r in T.token_tables(spark, str(tmp_path)).collect()}
    assert rows == {("i", 1): ("bus", "vehicle.moving", 5.0), ("ego", 0): ("car", "unknown", 1.0), ("ego", 1): ("car", "unknown", 1.0)}


def test_sqlite(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "t.sqlite")
    for name in ("rdb1_1", "other"):
        db.execute(f"CREATE TABLE {name} (id, timestamp, object_id, utm_x, utm_y, utm_angle, velocity, acceleration, object_category, trailer_id)")
        db.executemany(f"INSERT INTO {name} VALUES (?,?,?,?,?,?,?,?,?,?)", [(1, 0.1, 4, 1.0, 2.0, 0, 3, 0, "Car", None), (2, 0.0, 4, 0.0, 2.0, 0, 3, 0, "Car", None)])
    db.execute("CREATE TABLE map1 (id, type, geometry, marking_type, area_type)")
    db.executemany("INSERT INTO map1 VALUES (?,?,?,?,?)", [(1, "l", "LINESTRING (0 0, 1.5 2)", "LONG_DASHED_LINE", None), (2, "a", "POLYGON ((0 0, 1 0, 0 0))", "CURB", "NEVER"), (3, "x", None, None, None)])
    db.commit()
    db.close()
    got = sorted((r.rec_id, r.frame, r.x, r.agent_type) for r in binary.drone_recordings(spark, str(tmp_path / "t.sqlite")).collect())
    assert got == [("rdb1_1", 0, 0.0, "car"), ("rdb1_1", 1, 1.0, "car")]
    points = sorted((r.pos, r.x, r.y, r.edge_type) for r in maps.wkt_sqlite(spark, str(tmp_path / "t.sqlite"), "map").collect())
    assert points == [(0, 0.0, 0.0, 7), (1, 1.5, 2.0, 7)]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 1) + struct.pack("<d", value)
    return varint(number << 3) + varint(value)


def test_scenarios(spark, tmp_path):
    state = field(2, 1.5) + field(3, 2.5) + field(11, 1)
    track = field(1, 300) + field(2, 1) + field(3, state) + field(3, field(11, 0))
    road = field(1, 9) + field(5, field(1, 1) + field(2, field(1, 3.0) + field(2, 4.0)))
    payload = field(5, b"abc") + field(2, track) + field(2, track) + field(6, 1) + field(4, 300) + field(8, road)
    (tmp_path / "x.tfrecord").write_bytes(2 * (struct.pack("<Q", len(payload)) + b"crc!" + payload + b"crc!"))
    tracks, points = binary.scenarios(spark, str(tmp_path / "x.tfrecord"))
    got = sorted((r.rec_id, r.frame, r.track_id, r.x, r.agent_type, r.of_interest) for r in tracks.collect())
    assert got == [("abc", 0, -1, 1.5, "car", True)] * 2 + [("abc", 0, 300, 1.5, "car", True)] * 2
    assert [(r.line_id, r.kind, r.x, r.y) for r in points.collect()] == [(9, "road_edge", 3.0, 4.0)] * 2
    with pytest.raises(ValueError, match="cut short"):
        list(binary.records(struct.pack("<Q", 99) + b"abcdef"))
    once = binary.scenarios(spark, str(tmp_path / "x.tfrecord"), store=str(tmp_path / "decoded"))
    assert [d.count() for d in once] == [4, 2]
    (tmp_path / "bad.tfrecord").write_bytes(struct.pack("<Q", 99) + b"crc!ab")
    with pytest.raises(Exception, match="cut short"):
        rows.records_of(spark, str(tmp_path / "bad.tfrecord")).collect()


def test_chunked_arrays(spark, tmp_path):
    kind = np.dtype([("frame_index_interval", "<i8", (2,)), ("host", "<U4")])
    rows = np.array([((0, 2), "a"), ((2, 3), "b"), ((3, 4), "c")], kind)
    meta = {"shape": [3], "chunks": [2], "dtype": [["frame_index_interval", "<i8", [2]], ["host", "<U4"]], "compressor": {"id": "gzip"}}
    put(tmp_path / "scenes" / ".zarray", json.dumps(meta))
    for i in range(2):
        (tmp_path / "scenes" / str(i)).write_bytes(gzip.compress(np.resize(rows[2 * i : 2 * i + 2], 2).tobytes()))
    got = binary.chunked_array(spark, str(tmp_path / "scenes"), {"frame_index_interval": "array<bigint>", "host": "string"}).orderBy("pos").collect()
    assert [(r.pos, list(r.frame_index_interval), r.host) for r in got] == [(0, [0, 2], "a"), (1, [2, 3], "b"), (2, [3, 4], "c")]


def test_indexed_scenes(spark):
    scenes = spark.createDataFrame([(0, [0, 2])], "pos long, frame_index_interval array<long>")
    frames = spark.createDataFrame([(0, [0, 1], [0.0, 0.0, 0.0]), (1, [1, 3], [1.0, 0.0, 0.0])], "pos long, agent_index_interval array<long>, ego_translation array<double>")
    p = [0.0] * 17
    agents = spark.createDataFrame([(i, i + 5, [float(i), 0.0], [0.0, 0.0], 0.0, p[:3] + [1.0] + p[4:]) for i in range(3)], "pos long, track_id long, centroid array<double>, velocity array<float>, yaw float, label_probabilities array<float>")
    got = sorted((r.frame, r.track_id, r.agent_type) for r in T.indexed_scenes(scenes, frames, agents).collect())
    assert got == [(0, -1, "car"), (0, 5, "car"), (1, -1, "car"), (1, 6, "car"), (1, 7, "car")]


def test_headers_of_each_file(spark, tmp_path):
    put(tmp_path / "00_tracks.csv", "trackId,frame,xCenter,yCenter,heading\n1,0,5,6,0\n")
    put(tmp_path / "sub dir" / "01_tracks.csv", "\ufeffframe,yCenter,xCenter,trackId,heading,more\n5,20,10,2,90,x\n")
    put(tmp_path / "02_tracks.csv", "trackId,frame,xCenter,yCenter,heading\n3,1,7,8,0\n")
    for i in range(3):
        put(tmp_path / f"0{i}_tracksMeta.csv", "trackId,class\n1,Car\n")
        put(tmp_path / f"0{i}_recordingMeta.csv", "xUtmOrigin\n1\n")
    t, m, r = T.urban(spark, str(tmp_path))
    assert sorted((x.rec_id, x.track_id, x.frame, x.x, x.y, x.vx) for x in t.collect()) == [("00", 1, 0, 5.0, 6.0, None), ("01", 2, 5, 10.0, 20.0, None), ("02", 3, 1, 7.0, 8.0, None)]
    assert m.count() == 3 and r.where("yUtmOrigin IS NULL").count() == 3


def test_intersection_and_single_files(spark, tmp_path):
    put(tmp_path / "Data" / "r1" / "x" / "Veh_smoothed_tracks.csv", "track_id,frame_id,timestamp_ms,agent_type,x,y,vx,vy,yaw_rad,heading_rad,length,width,ax,ay\n4,0,0,car,11,22,1,0,0,0,4,2,0.5,0\n")
    put(tmp_path / "Data" / "r1" / "x" / "Ped_smoothed_tracks.csv", "track_id,frame_id,timestamp_ms,agent_type,x,y,vx,vy\nP9,1,0,pedestrian,10,20,0,1\nP9,2,0,pedestrian,10,21,0,2\nP2,2,0,pedestrian,0,0,1,1\n")
    rows = {(r.track_id, r.frame): r for r in T.intersection(spark, str(tmp_path), x0=10.0, y0=20.0, polar=True).collect()}
    assert set(rows) == {(4, 0), (5, 1), (5, 2), (6, 2)} and {r.rec_id for r in rows.values()} == {"r1"}
    assert (rows[4, 0].x, rows[4, 0].ax, rows[5, 2].ay, rows[6, 2].ax) == (1.0, 0.5, 10.0, 0.0) and math.isclose(rows[5, 1].psi, math.pi / 2) and rows[5, 1].rho == 0.0
    put(tmp_path / "s" / "a.csv", "ID,VehicleCategory,tseconds,x,y,vx,vy,ax,ay\n7,Passenger Car,3.11,100,1,1,0,0,0\n9,Semi-trailer truck,3.31,104,-3,1,0,0,0\n9,Semi-trailer truck,3.41,104,9,1,0,0,0\n9,Tram,3.51,104,,1,0,0,0\n")
    got = sorted((r.track_id, r.frame, r.x, r.y, r.agent_type, r.lane_id) for r in T.single_csv(spark, str(tmp_path / "s"), {"a": "-3.75;0;3.75;7.5"}).where("y IS NOT NULL").collect())
    assert got == [(0, 0, 0.0, 4.75, "car", 2), (2, 2, 4.0, 0.75, "truck", 1), (2, 3, 4.0, 12.75, "truck", 4)]
    assert {r.agent_type for r in T.single_csv(spark, str(tmp_path / "s")).collect()} == {"car", "truck", "tram"}


def test_scenario_parquet_and_file_split(spark, tmp_path):
    kinds = ["vehicle", "motorcyclist", "cyclist", "unknown", "bus", "riderless_bicycle"]
    for name in ("s1", "s2"):
        t = spark.createDataFrame([(f"{name}-{k}", k, 1, 0, 1.0, 2.0, 0.0, 0.0, 0.1) for k in kinds], "track_id string, object_type string, object_category int, timestep int, position_x double, position_y double, velocity_x double, velocity_y double, heading double")
        t.coalesce(1).write.parquet(str(tmp_path / name))
    got = T.scenario_parquet(spark, str(tmp_path)).collect()
    assert {(r.object_type, r.agent_type) for r in got} == set(zip(kinds, ["car", "motorcycle", "bicycle", "undefined", "bus", "riderless_bicycle"], strict=True))
    assert got[0].category == 1 and got[0].psi == 0.1 and len({r.rec_id for r in got}) == 2
    from trailmark.operators.splits import file_split

    shares = spark.range(2000).select(file_split(F.concat(F.lit("file"), "id")).alias("s")).groupBy("s").count().collect()
    assert {r.s: r["count"] // 100 for r in shares} in ({"train": 16, "val": 3}, {"train": 15, "val": 4}, {"train": 16, "val": 4})


def test_row_generators(spark):
    rows.register(spark, "countdown", lambda n: ((i, "x" * i) for i in range(n, 0, -1)), "i int, s string")
    assert [tuple(r) for r in spark.sql("SELECT * FROM countdown(2)").collect()] == [(2, "xx"), (1, "x")]


def test_osm_relations_override(spark, tmp_path):
    nodes = "".join(f'<node id="{i}" lat="{50 + i * 1e-4}" lon="6.0"/>' for i in range(1, 4))
    ways = '<way id="10"><nd ref="1"/><nd ref="2"/><tag k="type" v="line_thin"/></way><way id="11"><nd ref="2"/><nd ref="3"/><tag k="type" v="road_border"/></way><way id="12"><nd ref="2"/><nd ref="1"/><tag k="type" v="curbstone"/></way>'
    rule = lambda i, kind, way: f'<relation id="{i}"><member type="way" ref="{way}" role="ref_line"/><tag k="type" v="{kind}"/></relation>'
    n, e = maps.osm(spark, put(tmp_path / "m.osm", f"<osm>{nodes}{ways}{rule(20, 'regulatory_element', 11)}{rule(21, 'stop_line', 11)}{rule(22, 'lanelet', 10)}</osm>"), zone=32)
    assert {(r.src, r.dst): r.edge_type for r in e.collect()} == {(1, 2): 3, (2, 1): 3, (2, 3): 13, (3, 2): 13}
    assert {r.node: r.node_type for r in n.collect()} == {1: 6, 2: 13, 3: 13}


def test_osm(spark, tmp_path):
    nodes = "".join(f'<node id="{i}" lat="{50 + i * 1e-4}" lon="6.0"/>' for i in range(1, 5))
    ways = '<way id="10"><nd ref="1"/><nd ref="2"/><tag k="type" v="line_thin"/><tag k="subtype" v="dashed"/></way><way id="11"><nd ref="3"/><nd ref="4"/><tag k="type" v="road_border"/></way>'
    rule = '<relation id="20"><member type="way" ref="11" role="ref_line"/><member type="way" ref="10" role="x"/><tag k="type" v="regulatory_element"/></relation>'
    n, e = maps.osm(spark, put(tmp_path / "m.osm", f"<osm>{nodes}{ways}{rule}</osm>"), 0.0, 5_500_000.0, 32)
    types = {(r.src, r.dst): r.edge_type for r in e.collect()}
    assert types == {(1, 2): 7, (2, 1): 7, (3, 4): EDGE_TYPES["REGULATORY"], (4, 3): EDGE_TYPES["REGULATORY"]}
    got = {r.node: (r.x, r.y, r.node_type) for r in n.collect()}
    assert abs(got[2][1] - got[1][1] - 11.12) < 0.05 and got[1][2] == 7 and got[4][2] == 4


def test_map_json_and_world_file(spark, tmp_path):
    line = [{"x": 0, "y": 0, "z": 0}, {"x": 1, "y": 0, "z": 0}]
    lane = {"id": 1, "left_lane_boundary": line, "right_lane_boundary": line, "left_lane_mark_type": "SOLID_WHITE", "right_lane_mark_type": "NONE", "successors": []}
    put(tmp_path / "m.json", json.dumps({"lane_segments": {"1": lane}, "pedestrian_crossings": {"2": {"id": 2, "edge1": line, "edge2": line}}, "drivable_areas": {}}))
    p = maps.lane_json(spark, str(tmp_path / "m.json"))
    assert {r.line_id: r.edge_type for r in p.collect()} == {"left-1": 6, "right-1": 5, "edge1-2": 10, "edge2-2": 10}
    nodes, edges = G.graph(p)
    assert nodes.count() == 2 and {r.edge_type for r in edges.collect()} == {5, 6, 10}
    area = {"id": 5, "area_boundary": line}
    put(tmp_path / "d" / "n.json", json.dumps({"lane_segments": {}, "pedestrian_crossings": {}, "drivable_areas": {"5": area}}))
    assert [(r.map_id, r.area_id, r.x) for r in maps.drivable_areas(spark, str(tmp_path / "d")).orderBy("pos").collect()] == [("n", 5, 0.0), ("n", 5, 1.0)]
    assert maps.world_file(spark, put(tmp_path / "a.pgw", "0.1\n0\n0\n-0.1\n500.5\n600.25\n\n")) == (500.5, 600.25)
    assert [d.count() for d in maps.empty(spark)] == [0, 0]


def test_layered_json(spark, tmp_path):
    seg = [{"node_token": "a", "segment_type": "DOUBLE_SOLID_WHITE"}, {"node_token": "b", "segment_type": "SINGLE_ZIGZAG_WHITE"}, {"node_token": "c", "segment_type": "NIL"}]
    data = {
        "node": [{"token": t, "x": float(i), "y": 0.0} for i, t in enumerate("abc")], "line": [{"token": "l", "node_tokens": ["a", "b"]}], "polygon": [{"token": "p", "exterior_node_tokens": ["a", "b", "c"]}],
        "lane_divider": [{"token": "d", "line_token": "l", "lane_divider_segments": seg}], "walkway": [{"token": "w", "polygon_token": "p"}], "road_divider": [{"token": "r", "line_token": "l"}, {"token": "bad", "line_token": "?"}],
        "traffic_light": [{"token": "t", "line_token": "l"}], "lane": [{"token": "n", "polygon_token": "p", "left_lane_divider_segments": seg[:2], "right_lane_divider_segments": []}],
        "stop_line": [{"token": f"s{i}", "polygon_token": "p", "stop_line_type": k, "traffic_light_tokens": t} for i, (k, t) in enumerate([("TRAFFIC_LIGHT", ["t"]), ("TURN_STOP", ["t"]), ("PEDESTRIAN_CROSSING", ["t"]), ("STOP_SIGN", [])])],
    }
    path = put(tmp_path / "n.json", json.dumps(data))
    got = {}
    for r in maps.layered_json(spark, path).collect():
        got.setdefault(r.line_id, []).append((r.pos, r.x, r.edge_type))
    got = {k: [x[1:] for x in sorted(v)] for k, v in got.items()}
    assert got == {
        "road_divider-r": [(0, 8), (1, 8)], "walkway-w": [(0, 3), (1, 3), (2, 3), (0, 3)], "traffic_light-t": [(0, 4), (1, 4)], "stop_line-s0": [(0, 13), (1, 13), (2, 13), (0, 13)],
        "lane_divider_segments-d": [(0, 14), (1, 4), (2, 5)], "left_lane_divider_segments-n": [(0, 14), (1, 4)],
    }
    lanes = maps.polygon_lanes_json(spark, path, ignore=("walkway", "stop_line", "road_divider", "traffic_light"))
    assert {(r.line_id, r.edge_type) for r in lanes.where("pos = 0").collect()} == {("lane-n", 6), ("left_lane_divider_segments-n", 14)}
    nodes, edges = G.graph(maps.layered_json(spark, path, ignore=("lane", "lane_divider")), True, 0.5)
    assert nodes.count() == 5 and edges.where("edge_type = 8").count() == 2
    with pytest.raises(ValueError, match="distance"):
        G.graph(lanes, interpolate=True)


def test_graph_defaults_and_empty_maps(spark):
    p = spark.createDataFrame([("m", "a", i, float(i), 2.0 * i, 6) for i in range(11)] + [("e", "b", 0, 5.0, 5.0, 1)], maps.POINTS)
    nodes, edges = G.graph(p)
    kept, lines = G.box_subgraph(nodes, edges)
    assert sorted(r.x for r in kept.where("map_id = 'm'").collect()) == [5.0] and lines.count() == 0
    kept, lines = G.box_subgraph(nodes, edges, (5.0, 10.0), 4.0, 8.0)
    assert sorted(r.x for r in kept.where("map_id = 'm'").collect()) == [3.0, 4.0, 5.0, 6.0, 7.0] and lines.count() == 4
    whole, _ = G.normalized(nodes, edges)
    assert {r.map_id for r in whole.collect()} == {"m"}
    with pytest.raises(ValueError, match="no nodes"):
        G.normalized(nodes.where("map_id = 'e'"), edges, return_if_empty=False)
    assert {r.edge_type for r in G.renamed_types(edges, {6: 7}).collect()} == {7}


def test_vector_graph(spark, tmp_path):
    def way(i, refs, tags):
        return f'<way lane_id="{i}">' + "".join(f'<nd ref="{r}"/>' for r in refs) + "".join(f'<tag k="{k}" v="{v}"/>' for k, v in tags) + "</way>"

    spots = {1: (0, 0), 2: (1, 10), 3: (2, 20), 4: (2.2, 20.1), 5: (3, 30)}
    nodes = "".join(f'<node id="{i}" x="{x}" y="{y}"/>' for i, (x, y) in spots.items())
    common = [("is_intersection", "False"), ("has_traffic_control", "False"), ("turn_direction", "NONE")]
    a = way(7, [1, 2, 2, 3], [*common, ("l_neighbor_id", "None"), ("r_neighbor_id", "9"), ("successor", "8")])
    b = way(8, [4, 5], [("is_intersection", "True"), ("has_traffic_control", "True"), ("turn_direction", "NONE"), ("l_neighbor_id", "None"), ("r_neighbor_id", "None"), ("predecessor", "7")])
    lanes = maps.vector_xml(spark, put(tmp_path / "v.xml", f"<ArgoverseVectorMap>{nodes}{a}{b}</ArgoverseVectorMap>"))
    n, e = maps.vector_graph(lanes)
    at = {r.node: (r.x, r.y) for r in n.collect()}
    found = {(at[r.src], at[r.dst]): r.edge_type for r in e.collect()}
    kinds = sorted(found.values())
    assert len(at) == 10 and kinds == [3, 3, 3, 4, 4, 5, 5, 5, 5, 5]  # curbs and virtual borders, a polygon with two regulatory ends, two links
    left = min(at.values(), key=lambda p: p[0])
    assert math.isclose(math.hypot(*left), 1.9) and left[0] < 0  # left of a lane that runs north is west


def test_semantic_map(spark, tmp_path):
    def zig(values):
        return b"".join(varint((v << 1) ^ (v >> 63)) for v in values)

    def boundary(dx, kinds, changes=()):
        out = field(1, zig(dx)) + field(2, zig([0] * len(dx))) + field(3, zig([0] * len(dx))) + field(4, b"".join(map(varint, kinds)))
        return out + (field(5, b"".join(map(varint, changes))) if changes else b"")

    def element(name, number, body):
        return field(2, field(1, field(1, name)) + field(2, field(number, body)))

    frame = field(1, varint(1 << 3 | 5) + struct.pack("<i", 0) + varint(2 << 3 | 5) + struct.pack("<i", 0))
    lane = field(2, frame) + field(3, boundary([0, 100, 100, 100], [3, 5], [150])) + field(4, boundary([0, -100], []))
    content = element(b"A", 3, lane) + element(b"B", 3, lane) + element(b"C", 3, lane) + element(b"S", 1, field(12, field(1, b"A"))) + element(b"J", 5, field(3, field(1, b"A")) + field(3, field(1, b"B")))
    (tmp_path / "map.pb").write_bytes(field(1, b"x") + content)
    rows = maps_of(binary.semantic_map(spark, str(tmp_path / "map.pb"), np.eye(4).tolist()))
    assert {k: [r[2] for r in v] for k, v in rows.items()} == {"A-left": [6, 6, 7, 5], "A-right": [5, 5], "B-left": [6, 6, 7, 5]}
    # at latitude and longitude 0 east is y and the earth's radius is x
    assert np.allclose([r[1] for r in rows["A-left"]], [0, 1, 2, 3]) and np.allclose([r[0] for r in rows["A-left"]], 6378137.0)


def maps_of(points):
    out = {}
    for r in points.orderBy("line_id", "pos").collect():
        out.setdefault(r.line_id, []).append((r.x, r.y, r.edge_type))
    return out


def test_scenario_lines(spark):
    rows = [("m", 1, "road_edge", 2, 0, 0.0, 0.0), ("m", 1, "road_edge", 2, 1, 1.0, 0.0), ("m", 2, "crosswalk", 0, 5, 0.0, 1.0), ("m", 2, "crosswalk", 0, 6, 1.0, 1.0), ("m", 2, "crosswalk", 0, 7, 1.0, 2.0), ("m", 3, "stop_sign", 0, 9, 7.0, 7.0), ("m", 4, "road_line", 8, 0, 0.0, 0.0), ("m", 4, "road_line", 8, 1, 0.0, 9.0)]
    lines = maps.scenario_lines(spark.createDataFrame(rows, "map_id string, line_id long, kind string, type int, pos int, x double, y double"))
    got = maps_of(lines)
    assert [r[:2] for r in got["2"]] == [(0.0, 1.0), (1.0, 1.0), (1.0, 2.0), (0.0, 1.0)] and got["1"][0][2] == 12 and got["4"][0][2] == 14
    nodes, edges = G.graph(lines)
    assert nodes.count() == 7 and edges.count() == 5 and nodes.where("x = 7").count() == 1


def png(pixels, kinds):
    rows = b"".join(bytes([k]) + filtered(pixels, y, k) for y, k in enumerate(kinds))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w = pixels.shape
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def filtered(pixels, y, kind):
    row = pixels[y].astype(int)
    up = pixels[y - 1].astype(int) if y else np.zeros_like(row)
    left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], up[:-1]])
    pick = []
    for a, b, c in zip(left, up, corner, strict=True):
        p = a + b - c
        pick.append(min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2])
    guess = [np.zeros_like(row), left, up, (left + up) // 2, np.array(pick)][kind]
    return ((row - guess) % 256).astype(np.uint8).tobytes()


def test_lane_masks(spark, tmp_path):
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 256, (10, 13)).astype(np.uint8)
    assert (images.png_pixels(png(noise, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0])) == noise).all()
    with pytest.raises(ValueError, match="PNG"):
        images.pixels_of(b"GIF89a")
    grey = np.zeros((9, 30), np.uint8)
    grey[3:6, 3:27] = 255
    (tmp_path / "a.png").write_bytes(png(grey, [4] * 9))
    (tmp_path / "b.pgm").write_bytes(b"P5\n30 9\n255\n" + grey.tobytes())
    border = images.border_mask(grey)
    assert border.sum() == 5 * 26 - 3 * 24
    (line,) = images.outlines(border)
    assert len(line) == border.sum() and set(map(tuple, line.astype(int))) == {(x, y) for y, x in np.argwhere(border)}
    nested = np.zeros((12, 12), np.uint8)
    nested[1:11, 1:11] = 1
    nested[3:9, 3:9] = 0
    nested[5:7, 5:7] = 1
    nested[0, 0] = 0
    assert len(images.outlines(nested > 0)) == 1  # a group within another's hole has no outline of its own
    p = images.lane_lines(spark, str(tmp_path), metres=1.0, least=3.0)
    rows = maps_of(p.where("map_id = 'a'"))
    assert len(rows) == 1 and all(r[2] == 7 for r in rows["0"]) and sorted(maps_of(p.where("map_id = 'b'"))["0"]) == sorted(rows["0"])
    both = images.image_maps(p, x_max=30.0)
    low, up = (sorted((r.x, r.y) for r in both[k][0].where("map_id = 'a'").collect()) for k in ("lower", "upper"))
    assert sorted((30.0 - x, -y) for x, y in low) == up and both["lower"][1].count() == both["upper"][1].count()


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([(0, i, 1, "train" if i else "val") for i in range(5)], "rec_id long, target_id long, start int, split string")
    sinks.write_samples(s, str(tmp_path / "out"))
    assert sinks.read_samples(spark, str(tmp_path / "out"), "train").count() == 4
    with pytest.raises(ValueError, match="no samples"):
        sinks.read_samples(spark, str(tmp_path / "out"), "test")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_samples(s, str(tmp_path / "out"))
    sinks.write_samples(s.unionByName(s.withColumn("start", F.lit(9))), str(tmp_path / "out"), resume=True)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    t = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "scene_name string, v int")
    sinks.stage_scenes(t, {"train": ["a", "a"], "val": ["b"]}, str(tmp_path / "staged"))
    assert spark.read.option("header", True).csv(str(tmp_path / "staged")).select(F.countDistinct("scene_name")).first()[0] == 2


def test_command_line(spark, tmp_path):
    from trailmark import cli

    args = cli.parser().parse_args(["etl", "-p", str(tmp_path / "in"), "--use-threads", "no", "-d", "--add-supp", "yes"])
    assert (args.config, args.use_threads, args.debug, args.add_supp) == ("rounD", False, True, True)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["etl", "--debug", "maybe"])
    head = "trackId,frame,xCenter,yCenter,heading,xVelocity,yVelocity,xAcceleration,yAcceleration\n"
    put(tmp_path / "in" / "00_tracks.csv", head + "".join(f"{i},{f},{i * 3 + f * 0.1},{i},0,1,0,0,0\n" for i in (1, 2) for f in range(1, 2400)))
    put(tmp_path / "in" / "00_tracksMeta.csv", "trackId,class,initialFrame,finalFrame\n1,Car,1,2399\n2,Van,1,2399\n")
    put(tmp_path / "in" / "00_recordingMeta.csv", "xUtmOrigin,yUtmOrigin\n0,0\n")
    got = cli.samples_of(spark, args)
    assert {r.split for r in got.select("split").distinct().collect()} == {"train", "val", "test"}
    row = got.where("split = 'val'").first()
    assert row.num_nodes == 2 and len(row.inp_rho[0]) == 75 and len(row.trg_x[0]) == 125 and all(row.sa_mask[0]) and all(row.ma_mask[1])
    truth = spark.createDataFrame([(0, 1, t, float(t), 0.0, True) for t in range(3)], "scenario_id long, agent_id long, t int, x double, y double, valid boolean")
    pred = truth.select("scenario_id", "agent_id", F.lit(0).alias("mode"), "t", "x", F.lit(1.0).alias("y"))
    for name, d in (("truth", truth), ("pred", pred), ("prob", pred.select("scenario_id", "agent_id", "mode", F.lit(1.0).alias("prob")).distinct())):
        d.write.parquet(str(tmp_path / "root" / name))
    values = {r.metric: r.value for r in cli.metrics_of(spark, cli.parser().parse_args(["score", "-r", str(tmp_path / "root"), "-sd"])).collect()}
    assert values["min_ade"] == 1.0 and values["miss_rate"] == 0.0 and values["collision_rate"] is None
