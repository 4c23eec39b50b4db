"""Steps whose cost must not grow faster than their tables: what they give, and how often they read and deal."""

import json
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trailmark import session as of_session
from trailmark.operators import filters as P
from trailmark.operators import mapgraph as G
from trailmark.operators import metrics as M
from trailmark.operators import neighbors as N
from trailmark.plans import formats
from trailmark.plans.views import prediction_tables
from trailmark.registry import QUERIES
from trailmark.sources import binary, maps
from trailmark.streaming import metrics as stream


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lane_maps_are_read_once(spark, tmp_path):
    lane = {"id": 1, "left_lane_boundary": [{"x": 0, "y": 0, "z": 0}], "right_lane_boundary": [{"x": 1, "y": 0, "z": 0}], "left_lane_mark_type": "NONE", "right_lane_mark_type": "SOLID_WHITE"}
    (tmp_path / "a.json").write_text(json.dumps({"lane_segments": {"1": lane}}))
    (tmp_path / "b.json").write_text(json.dumps({"pedestrian_crossings": {"2": {"id": 2, "edge1": [{"x": 0, "y": 5, "z": 0}], "edge2": None}}}))
    points = maps.lane_json(spark, str(tmp_path))
    assert sorted((r.map_id, r.line_id, r.pos, r.x, r.y) for r in points.collect()) == [("a", "left-1", 0, 0.0, 0.0), ("a", "right-1", 0, 1.0, 0.0), ("b", "edge1-2", 0, 0.0, 5.0)]
    assert plan(points).count("FileScan json") == 1


def test_edges_meet_in_tiles(spark):
    """Two lines share a stretch that crosses the border of a tile; their places need no join."""
    rows = [("m", "a", 0, 95.0, 0.0, 2), ("m", "a", 1, 105.0, 0.0, 2), ("m", "b", 0, 95.0, -0.0, 2), ("m", "b", 1, 110.0, 0.0, 2), ("m", "c", 0, -2.5, 0.0, 2), ("m", "c", 1, 202.5, 0.0, 2)]
    points = spark.createDataFrame(rows, "map_id string, line_id string, pos int, x double, y double, edge_type int")
    edges = G.placed_edges(points, True, 1.0, lambda c: F.round(c, 6))
    got = sorted((r.x0, r.x1) for r in edges.collect())
    want = {(95.0 + i, 96.0 + i) for i in range(15)} | {(-2.5 + i, -1.5 + i) for i in range(205)}
    assert got == sorted(want)
    assert "Join" not in plan(edges) and len(re.findall(r"Exchange hashpartitioning", plan(edges).split("Initial Plan")[-1])) == 2
    cut = lambda a, b, n: {(a + (b - a) * ((i - 1) / n), b if i == n else a + (b - a) * (i / n)) for i in range(1, n + 1)}
    assert G.graph(points, True, 1.0)[1].count() == len(cut(95.0, 105.0, 10) | cut(95.0, 110.0, 15) | cut(-2.5, 202.5, 205))


def test_pieces_of_files(spark, tmp_path):
    spark.range(100_000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert of_session.pieces(df, 1000) == 1 and of_session.pieces(spark.range(5).union(spark.createDataFrame([(1,)], "id long")), 1) <= 1
    assert "REPARTITION_BY_COL" in plan(of_session.spread(df, 1000, "id"))
    n = of_session.pieces(df, 0.01)
    assert n > 8 and of_session.spread(df, 0.01, "id").rdd.getNumPartitions() == n
    assert of_session.spread(df, 0.01, "id").agg(F.count("*")).collect()[0][0] == 100_000


def test_stream_keeps_nothing_on_the_driver(spark, tmp_path):
    """Two batches that share an agent: sums add up, the last step decides, and no table in memory is left behind."""
    rows = [[(1, 1, 0, 0, 1.0), (1, 1, 0, 5, 7.0), (1, 2, 0, 0, 2.0)], [(1, 1, 0, 3, 4.0), (2, 1, 1, 9, 3.0)]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, stream.STEPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "steps"))
    sums = str(tmp_path / "sums")
    stream.run_to_folder(stream.step_stream(spark, str(tmp_path / "steps"), 1), sums, str(tmp_path / "check"))
    assert len(list((tmp_path / "sums").glob("batch=*"))) == 2
    assert {tuple(r) for r in stream.errors_so_far(spark, sums).collect()} == {(1, 1, 0, 4.0, 7.0), (1, 2, 0, 2.0, 2.0), (2, 1, 1, 3.0, 3.0)}
    before = {t.name for t in spark.catalog.listTables()}
    out = QUERIES["stream_metrics"](spark, "/root/testdata/sf0.001")
    assert {t.name for t in spark.catalog.listTables()} == before and "FileScan parquet" in plan(out)


def test_knn_ranks_a_group_without_its_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(rng.integers(0, 6)), float(rng.integers(0, 6))) for g in range(3) for i in range(12)]
    points = spark.createDataFrame(rows, "scenario_id long, id long, x double, y double")
    for loops in (True, False):
        want = set()
        for g, i, x, y in rows:
            near = sorted((math.hypot(x - u, y - v), j) for h, j, u, v in rows if h == g and (loops or j != i))[:3]
            want |= {e for _, j in near for e in ((g, i, j), (g, j, i))}
        got = N.knn_graph(points, 3, loops=loops)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert "Join" not in plan(got) and "Window" not in plan(got)


def test_cells_hold_few_copies(spark):
    """Pairs at cell borders and at exactly the radius are found; a row is in one to four cells, not in nine."""
    rows = [(0, i, x, y) for i, (x, y) in enumerate([(3.9, 0.0), (4.1, 0.0), (4.0, 1.0), (-0.1, -0.1), (0.0, 0.9), (8.0, 8.0), (7.0, 8.0)])]
    a = spark.createDataFrame(rows, "scenario_id long, a long, ax double, ay double")
    b = spark.createDataFrame(rows, "scenario_id long, b long, bx double, by double")
    want = {(i, j) for _, i, x, y in rows for _, j, u, v in rows if math.hypot(x - u, y - v) <= 1}
    near = N.within(a, b, 1.0)
    assert sorted((r.a, r.b) for r in near.collect()) == sorted(want)
    assert "[-1,0,1]" not in plan(near).replace(" ", "")


def test_near_static_counts_no_steps(spark):
    rows = spark.createDataFrame([(1, [(0.2,), (-0.2,), None, (3.0,)])], "k long, steps array<struct<x:double>>")
    got = {n: P.near_static_steps(rows, lambda s: F.round(s["x"]), n).collect()[0].static for n in (2, 3)}
    assert got == {2: False, 3: True}
    assert "Exchange" not in plan(P.near_static_steps(rows))


def test_predictions_meet_truths_where_they_lie(spark):
    """Tables dealt by agent are not dealt again, and grouping gives what a join gives."""
    rng = np.random.default_rng(2)
    left = spark.createDataFrame([(int(a), int(b), float(i)) for i, (a, b) in enumerate(rng.integers(0, 4, (40, 2)))] + [(9, 9, -1.0)], "scenario_id long, agent_id long, x double")
    right = spark.createDataFrame([(int(a), int(b), float(i)) for i, (a, b) in enumerate(rng.integers(0, 4, (12, 2)))] + [(8, 8, -1.0)], "scenario_id long, agent_id long, u double")
    for outer in (False, True):
        got = M.meet(left, right, list(M.AGENT), outer=outer)
        want = left.join(right, list(M.AGENT), "left" if outer else "inner").select(got.columns)
        key = lambda r: tuple((v is None, v or 0) for v in r)
        assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    truth, pred, prob = prediction_tables(spark, "/root/testdata/sf0.001")  # windows of tracks, which lie by track
    scale = {"sx": F.lit(0.5), "sy": F.lit(0.8)}
    for metric in (M.nll(pred, truth, "normal", scale, prob), M.nll(pred, truth, "normal", scale, prob, masked=False), M.min_apde(pred, truth, "ML", prob)):
        assert not re.search(r"Exchange hashpartitioning\((?!user_id)", plan(metric)) and "Join" not in plan(metric)


def test_nearest_by_product_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 4)] if i % 17 else None, i % 2) for i in range(80)]
    e = spark.createDataFrame(rows, "id long, e array<float>, label int")
    got = N.nearest_by_product(e.where("id % 5 = 0").selectExpr("id AS a", "e AS ea", "label"), e.selectExpr("id AS b", "e AS eb", "label"), 3, "label")
    want = []
    for a, u, label in rows[::5]:
        product = lambda v: sum(p * q for p, q in zip(u, v)) if u and v else -math.inf  # noqa: B023, E731
        near = sorted((-product(v), b) for b, v, other in rows if b != a and other == label)[:3]
        want += [(a, b, i + 1) for i, (_, b) in enumerate(near)]
    assert sorted(map(tuple, got.select("a", "b", "nbr_rank").collect())) == sorted(want)


def test_files_of_formats_are_bounded(spark, tmp_path, monkeypatch):
    """No format is one file of the whole table, and a partitioned folder has one file for each value."""
    made = []
    monkeypatch.setattr(formats, "fresh", lambda s, name: made.append(str(tmp_path / name)) or made[-1])
    for name in ("msrc_layered_json", "src_token_tables", "src_scenario_parquet"):
        QUERIES[name](spark, "/root/testdata/sf0.01")
    files = lambda pattern: list(tmp_path.glob(pattern))
    assert len(files("layers/*.json")) == 150  # a map has 100 orders
    assert len(files("tokens/sample_annotation.json/*.json")) == 1  # a file has 100 recordings, and there are 15
    assert len(files("scenarios/rec_id=*/*.parquet")) == len(files("scenarios/rec_id=*")) == 15


def test_records_decode_what_is_asked_for():
    payload = formats._scenario(pd.DataFrame({"rec_id": [7, 7], "track_id": [1, 1], "frame": [1, 3], "x": [1.0, 2.0], "y": [0.5, 0.25], "code": [1, 1]}))[12:-4]
    name, tracks, points = binary.scenario_rows(payload)
    assert [r[1:5] for r in tracks] == [(1, -1, 1.0, 0.5), (3, -1, 2.0, 0.25)] and len(points) == 9
    assert binary.scenario_rows(payload, ("points",)) == (name, [], points) and binary.scenario_rows(payload, ("tracks",)) == (name, tracks, [])
