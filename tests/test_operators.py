"""Micro-cases with results worked out by hand or by numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.functions import codes, geometry
from trailmark.operators import kinematics as K
from trailmark.operators import lanes as L
from trailmark.operators import mapgraph as G
from trailmark.operators import metrics as M
from trailmark.operators import neighbors as N
from trailmark.operators import resample as R
from trailmark.operators import sampling as S
from trailmark.operators import splits
from trailmark.operators import transforms as X


def tracks(spark, rows):
    return spark.createDataFrame(rows, "rec_id long, track_id long, frame int, x double, y double")


def test_gradient_is_numpys_and_zero_for_one_row(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=20)
    t = tracks(spark, [(0, 1, i * 3, float(v), 0.0) for i, v in enumerate(x)] + [(0, 2, 5, 1.0, 1.0)])
    got = {(r.track_id, r.frame): r.vx for r in K.with_velocity(t, 0.1).collect()}
    assert np.allclose([got[1, i * 3] for i in range(20)], np.gradient(x, 0.1))
    assert got[2, 5] == 0.0


def test_unknown_classes(spark):
    one = spark.createDataFrame([("tram",), ("Car",), (None,)], "c string")
    assert [r[0] for r in one.select(codes.class_code(F.col("c"))).collect()] == [8, 0, 8]
    with pytest.raises(Exception, match="unknown agent class"):
        one.select(codes.class_code(F.col("c"), "error")).collect()


def test_split_blocks_follow_array_split(spark):
    for n in (10, 23, 57, 99):
        parts = np.array_split(np.arange(1, n + 1), 10)
        want = {int(f): b for b, part in enumerate(parts) for f in part}
        got = {r.id: r.b for r in spark.range(1, n + 1).withColumn("b", splits.block(F.col("id"), F.lit(n))).collect()}
        assert got == want


def test_prefix_stop_loses_later_starts(spark):
    frames = [1, 2, 3, 4, 5, 6, 20, 21, 22, 23, 24, 25]
    t = tracks(spark, [(0, 1, f, 0.0, 0.0) for f in frames])
    spec = S.Windows(1, 2, 1)
    assert sorted(r.start for r in S.starts(t, spec).collect()) == [1, 2, 3]
    assert sorted(r.start for r in S.starts(t, spec, prefix=False).collect()) == [1, 2, 3, 20, 21, 22]


def test_steps_of_tracks_with_gaps_and_repeats(spark):
    t = tracks(spark, [(0, 1, f, float(f), 0.0) for f in (0, 1, 2, 3)] + [(0, 2, f, 10.0 + f, 1.0) for f in (1, 3, 3)] + [(0, 3, 1, None, 2.0)])
    spec = S.Windows(2, 2, 1)
    rows = S.steps(S.agents(S.starts(t, S.Windows(2, 1, 1)).where("track_id = 1 AND start = 0"), t), t, spec).collect()
    got = {(r.track_id, r.t): (r.part, r.x, r.y) for r in rows}
    assert [got[2, i] for i in range(4)] == [("inp", None, None), ("inp", 11.0, 1.0), ("trg", None, None), ("trg", 13.0, 1.0)]
    assert got[3, 1] == ("inp", None, 2.0) and got[3, 0] == ("inp", None, None) and len(rows) == 12


def test_nearest_of_those_that_can_be_scored(spark):
    """The nearest agent stands still and takes no place among the k nearest."""
    t = tracks(spark, [(0, i, f, i + (0.0 if i == 2 else f * 0.1), 0.0) for i in (1, 2, 3, 4) for f in range(6)])
    spec = S.Windows(3, 3, 9)
    rows = S.with_masks(S.agent_steps(S.agents(S.starts(t, S.Windows(3, 2, 9)).where("track_id = 1"), t), t, spec), spec, least_future=3, k=2)
    got = {r.track_id: r for r in rows.collect()}
    assert [any(got[i].ma_mask) for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert all(got[1].sa_mask) and not any(got[3].sa_mask)
    sample = S.nested(rows, spec).first()
    assert (sample.num_nodes, sample.ids, sample.ta_index) == (4, [1, 2, 3, 4], 0) and sample.trg_x[2] == [3.0 + 0.1 * f for f in (3, 4, 5)]
    assert S.SAMPLING["waymo"].windows() == S.Windows(11, 80, 1) and S.SAMPLING["highD"].windows(keep=True).stride == 25
    nodes = spark.createDataFrame([(0, 0, 1.0, 2.0, 1)], "map_id long, node_idx int, x double, y double, node_type int")
    edges = spark.createDataFrame([(0, 0, 0, 6)], "map_id long, src int, dst int, edge_type int")
    both = S.with_map(S.nested(rows, spec).withColumn("map_id", F.explode(F.array(F.lit(0), F.lit(7)))), nodes, edges).orderBy("map_id").collect()
    assert [len(r.map_points) for r in both] == [1, 0] and both[0].map_edges[0].edge_type == 6


def test_last_lane_change_decides(spark):
    lanes = [1] * 6 + [2] * 3 + [1] * 3
    t = spark.createDataFrame([(0, 1, i, v, 1) for i, v in enumerate(lanes)], "rec_id long, track_id long, frame int, lane_id int, driving_direction int")
    got = [r.maneuver for r in L.maneuvers(t, 2).orderBy("frame").collect()]
    # the change at row 9 (to the right) covers rows 0..8 within five seconds, and is nearer than 3 s from row 4 on
    assert got == [6, 6, 6, 6, 5, 5, 5, 5, 4, 3, 3, 3]


def test_metrics_zero_and_order_of_modes(spark):
    truth = spark.createDataFrame([(0, a, t, float(t), float(a), t != 2) for a in range(2) for t in range(4)], "scenario_id long, agent_id long, t int, x double, y double, valid boolean")
    same = truth.select("scenario_id", "agent_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("mode"), "t", "x", "y")
    assert M.min_ade(same, truth).first()[0] == 0 and M.min_fde(same, truth).first()[0] == 0
    prob = same.select("scenario_id", "agent_id", "mode").distinct().withColumn("prob", F.when(F.col("mode") == 1, 0.75).otherwise(0.25))
    moved = same.withColumn("x", F.col("x") + F.col("mode") * 3.0)
    assert M.miss_rate(moved, truth, "ML", prob).first()[0] == 1.0
    assert M.miss_rate(moved, truth).first()[0] == 0.0
    assert math.isclose(M.exp_de(moved, truth, prob).first()[0], 2.25)
    assert math.isclose(M.min_brier(moved, truth, prob, "ML").first()[0], 0.75)
    with pytest.raises(ValueError, match="unknown criterion"):
        M.min_ade(moved, truth, "XX")
    with pytest.raises(ValueError, match="probabilities"):
        M.min_brier(moved, truth, None)
    with pytest.raises(ValueError, match="unknown distribution"):
        M.nll(moved, truth, "cauchy", {})
    empty = truth.withColumn("valid", F.lit(False))
    assert tuple(M.min_ade(moved, empty).first()) == (None, 0)


def test_collisions_are_summed_over_scenarios(spark):
    """Scenarios of one, two and five agents; two at one place do not collide; one agent has no valid step."""
    at = {0: [0.0], 1: [0.0, 0.5], 2: [0.0, 0.0, 0.9, 2.0, 50.0]}
    rows = [(s, a, t, x) for s, xs in at.items() for a, x in enumerate(xs) for t in range(3)]
    pred = spark.createDataFrame([(s, a, m, t, x + m * 7.0, 0.0) for s, a, t, x in rows for m in range(2)], "scenario_id long, agent_id long, mode int, t int, x double, y double")
    truth = spark.createDataFrame([(s, a, t, x, 0.0, not (s == 1 and a == 1)) for s, a, t, x in rows], "scenario_id long, agent_id long, t int, x double, y double, valid boolean")
    got = M.collision_rate(pred, truth).first()
    assert (got.n_hits, got.n_pairs) == (3 * (1 + 2), 3 * (0 + 1 + 10)) and math.isclose(got.collision_rate, 9 / 33)
    assert M.collision_rate(pred, truth, "ADE").first().n_hits == 9
    one = [d.where("scenario_id = 0") for d in (pred, truth)]
    assert tuple(M.collision_rate(*one).first()) == (None, 0, 0)
    far = pred.select("scenario_id", "agent_id").distinct().withColumn("mode", (F.col("agent_id") == 0).cast("int"))
    assert M.collision_rate(pred, truth, best=far).first().n_hits == 3


def test_apde_of_the_chosen_mode(spark):
    truth = spark.createDataFrame([(0, 0, t, float(t), 0.0, t != 1) for t in range(4)] + [(0, 1, t, 0.0, 0.0, False) for t in range(4)], "scenario_id long, agent_id long, t int, x double, y double, valid boolean")
    pred = spark.createDataFrame([(0, a, 0, t, t + 1.0, 1.0) for a in range(2) for t in range(4)], "scenario_id long, agent_id long, mode int, t int, x double, y double")
    # places 1, 3, 4 of valid steps 0, 2, 3 against truths 0, 2, 3; the agent without valid steps does not count
    want = (math.sqrt(2) + 1 + math.sqrt(2)) / 3
    got = M.min_apde(pred, truth).first()
    assert math.isclose(got.min_apde, want) and got.n_agents == 1


def test_two_wheelers_at_the_limit(spark):
    rows = [(0, i, f, v, 0.0, k) for i, v, k in ((1, 2.9, "x"), (2, 3.0, "x"), (3, 3.1, "x"), (4, 9.0, "car")) for f in range(2)]
    t = spark.createDataFrame(rows, "rec_id long, track_id long, frame int, vx double, vy double, agent_type string")
    got = {r.track_id: r.agent_type for r in K.two_wheeler_rule(t, joint="x").collect()}
    assert got == {1: "pedestrian", 2: "bicycle", 3: "bicycle", 4: "car"}


def test_lane_model_leaves_the_last_lane_out(spark):
    rows = [(0, 1, i, 0.0, 3.5 * lane + (40.0 if lane == 4 else 0.0), lane) for i, lane in enumerate([1, 2, 3, 4])]
    t = spark.createDataFrame(rows, "rec_id long, track_id long, frame int, x double, y double, lane_id int")
    assert np.allclose([r.y for r in L.lane_model(t).orderBy("bound").collect()], [1.75, 5.25, 8.75, 12.25])


def test_decimation_weights_keep_constants_and_last_sample():
    w = R.decimation_weights(40, 5)
    assert w.shape == (8, 40)
    assert np.allclose(w.sum(axis=1), 1, atol=0.02)
    slow = np.sin(np.arange(40) / 40)
    assert np.allclose(w @ slow, slow[4::5], atol=0.02)
    r = R.rational_weights(20, 2, 5)
    assert r.shape == (8, 20) and np.allclose(r[2:6].sum(axis=1), 1, atol=0.05)


def test_radius_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(-50, 50, (80, 2))
    a = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(p)], "scenario_id long, a long, ax double, ay double")
    b = a.withColumnsRenamed({"a": "b", "ax": "bx", "ay": "by"})
    got = {(r.a, r.b) for r in N.within(a, b, 13.0).collect()}
    d = np.hypot(*(p[:, None, :] - p[None, :, :]).transpose(2, 0, 1))
    assert got == {tuple(map(int, q)) for q in np.argwhere(d <= 13.0)}


def test_interpolation_ends_at_the_node(spark):
    e = spark.createDataFrame([(0.0, 0.0, 3.0, 4.0)], "x0 double, y0 double, x1 double, y1 double")
    got = [(r.x, r.y) for r in G.interpolate(e, 2.0).orderBy("piece").collect()]
    assert np.allclose(got, [(1, 4 / 3), (2, 8 / 3), (3, 4)])


def test_utm_of_a_known_place(spark):
    east, north = geometry.utm(F.lit(59.3293), F.lit(18.0686), F.lit(33))
    e, n = spark.range(1).select(east, north).first()
    assert abs(e - 674_550) < 200 and abs(n - 6_580_750) < 800


def test_ego_frame_faces_forward(spark):
    rows = [(0, 5, 0, 5, t, float(t), float(t), math.pi / 4) for t in range(4)]
    df = spark.createDataFrame(rows, "rec_id long, target_id long, start int, track_id long, t int, x double, y double, psi double")
    got = {r.t: (r.x, r.y, r.psi) for r in X.ego_frame(df, 2).collect()}
    assert np.allclose(got[3], (2 * math.sqrt(2), 0, 0), atol=1e-9)


def test_thinning_is_relative_to_the_last_kept_point(spark):
    p = spark.createDataFrame([(0, 0, i, x, 0.0) for i, x in enumerate([0.0, 0.6, 1.2, 1.8, 2.4])], "map_id long, line_id long, pos int, x double, y double")
    assert sorted(r.pos for r in G.thin(p, 1.0).collect()) == [0, 2, 4]


def test_plugins_and_configurations(tmp_path):
    from trailmark.functions.plugins import configuration, load

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.yml").write_text("fz: 25\n")
    try:
        assert configuration("a", str(tmp_path)) == {"fz": 25}
    except ModuleNotFoundError:
        pass
    with pytest.raises(FileNotFoundError):
        configuration("b", str(tmp_path))
    assert load("math", "sqrt")(4) == 2
