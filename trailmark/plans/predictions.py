"""Queries of prediction metrics, losses, neighbour graphs and motion models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import codes, geometry
from ..operators import metrics as M
from ..operators import neighbors as N
from ..operators import transforms as X
from .views import MV, PRED, TR, moving, prediction_tables, query, table, tracks


def _rounded(df, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_MODE = "SELECT scenario_id, agent_id, mode, round({err}, 6) AS err FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, agent_id ORDER BY {order}) AS r FROM {src}) WHERE r = 1"


def _mode(spark, sf_dir, criterion, err):
    truth, pred, prob = prediction_tables(spark, sf_dir)
    return M.best_mode(M.mode_errors(pred, truth), criterion, prob).select(*M.AGENT, "mode", F.round(err, 6).alias("err"))


@query("mode_fde", f"WITH {PRED} {_MODE.format(err='fde', order='fde, mode', src='me')}")
def mode_fde(spark, sf_dir):
    return _mode(spark, sf_dir, "FDE", "fde")


@query("mode_ade", f"WITH {PRED} {_MODE.format(err='ade', order='ade, mode', src='me')}")
def mode_ade(spark, sf_dir):
    return _mode(spark, sf_dir, "ADE", "ade")


@query("mode_ml", f"WITH {PRED} {_MODE.format(err='fde', order='prob DESC, mode', src='(SELECT * FROM me JOIN prob USING (scenario_id, agent_id, mode))')}")
def mode_ml(spark, sf_dir):
    return _mode(spark, sf_dir, "ML", "fde")


def _metric(name: str, sql: str, run, digits: int = 6):
    @query(name, f"WITH {PRED}{sql}")
    def f(spark, sf_dir):
        return _rounded(run(*prediction_tables(spark, sf_dir)), digits)

    f.__name__ = name
    return f


_ML = ", ml AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, agent_id ORDER BY prob DESC, mode) AS r FROM me JOIN prob USING (scenario_id, agent_id, mode)) WHERE r = 1)"
_CH = ", ch AS (SELECT pred.* FROM pred JOIN {b} b USING (scenario_id, agent_id, mode))"

_metric("met_minade", " SELECT round(avg(ade), 6) AS min_ade, count(*) AS n_agents FROM best", lambda t, p, q: M.min_ade(p, t))
_metric("met_minfde", f"{_ML} SELECT round(avg(fde), 6) AS min_fde, count(*) AS n_agents FROM ml", lambda t, p, q: M.min_fde(p, t, "ML", q))
_metric("met_missrate", f"{_ML} SELECT round(avg((fde > 2.0)::INTEGER), 6) AS miss_rate, count(*) AS n_agents FROM ml", lambda t, p, q: M.miss_rate(p, t, "ML", q))
_metric(
    "met_minapde",
    f"{_ML}{_CH.format(b='ml')}, w AS (SELECT c.scenario_id, c.agent_id, c.t, min(sqrt((c.x - v.x) * (c.x - v.x) + (c.y - v.y) * (c.y - v.y))) AS d FROM ch c "
    "JOIN truth u ON u.scenario_id = c.scenario_id AND u.agent_id = c.agent_id AND u.t = c.t AND u.valid JOIN truth v ON v.scenario_id = c.scenario_id AND v.agent_id = c.agent_id AND v.valid GROUP BY ALL) "
    "SELECT round(avg(a), 6) AS min_apde, count(*) AS n_agents FROM (SELECT avg(d) AS a FROM w GROUP BY scenario_id, agent_id)",
    lambda t, p, q: M.min_apde(p, t, "ML", q),
)
_metric(
    "met_collision",
    ", em AS (SELECT p.*, q.valid, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS d FROM pred p JOIN truth q USING (scenario_id, agent_id, t)), "
    "ms AS (SELECT scenario_id, agent_id, mode, coalesce(arg_max(d, t) FILTER (valid), arg_max(d, t)) AS e FROM em GROUP BY ALL), "
    "bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, agent_id ORDER BY e, mode) AS r FROM ms) WHERE r = 1), "
    "ch AS (SELECT pred.* FROM pred JOIN bs USING (scenario_id, agent_id, mode)), h AS (SELECT count(*) AS h FROM ch a JOIN ch b ON a.scenario_id = b.scenario_id AND a.t = b.t AND a.agent_id < b.agent_id "
    "WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 1 AND (a.x <> b.x OR a.y <> b.y)), "
    "s AS (SELECT sum(k * n * (n - 1) // 2)::BIGINT AS c FROM (SELECT count(DISTINCT agent_id) AS n, count(DISTINCT t) AS k FROM ch GROUP BY scenario_id)) "
    "SELECT round(h / c, 9) AS collision_rate, h AS n_hits, c AS n_pairs FROM h, s",
    lambda t, p, q: M.collision_rate(p, t),
    9,
)
_metric("met_brier", " SELECT round(avg((1 - prob) * fde), 6) AS min_brier, count(*) AS n_agents FROM best JOIN prob USING (scenario_id, agent_id, mode)", lambda t, p, q: M.min_brier(p, t, q))
_metric("met_brier_logits", " SELECT round(avg((1 - 1 / (1 + exp(-prob))) * fde), 6) AS min_brier, count(*) AS n_agents FROM best JOIN prob USING (scenario_id, agent_id, mode)", lambda t, p, q: M.min_brier(p, t, q, logits=True))
_metric(
    "met_precomputed_mode", ", bm AS (SELECT scenario_id, agent_id, (agent_id % 6)::INTEGER AS mode FROM truth GROUP BY ALL) SELECT round(avg(fde), 6) AS min_fde, count(*) AS n_agents FROM me JOIN bm USING (scenario_id, agent_id, mode)",
    lambda t, p, q: M.min_fde(p, t, best=t.select(*M.AGENT, (F.col("agent_id") % 6).cast("int").alias("mode")).distinct()),
)
_metric("met_expde", ", e AS (SELECT scenario_id, agent_id, sum(fde * prob) AS v FROM me JOIN prob USING (scenario_id, agent_id, mode) GROUP BY ALL) SELECT round(avg(v), 6) AS exp_de, count(*) AS n_agents FROM e", lambda t, p, q: M.exp_de(p, t, q))
_metric("met_expde_uniform", ", e AS (SELECT scenario_id, agent_id, avg(ade) AS v FROM me GROUP BY ALL) SELECT round(avg(v), 6) AS exp_de, count(*) AS n_agents FROM e", lambda t, p, q: M.exp_de(p, t, None, "ADE"))
_metric(
    "met_expde_logits",
    ", e AS (SELECT scenario_id, agent_id, sum(fde * exp(prob)) / sum(exp(prob)) AS v FROM me JOIN prob USING (scenario_id, agent_id, mode) GROUP BY ALL) SELECT round(avg(v), 6) AS exp_de, count(*) AS n_agents FROM e",
    lambda t, p, q: M.exp_de(p, t, q, "FDE", logits=True),
)

_L2PI = repr(math.log(2 * math.pi))
_DENSITY = {
    "normal": (f"-(dx * dx / 0.25 + dy * dy / 0.64) / 2 - ln(0.5) - ln(0.8) - {_L2PI}", {"sx": 0.5, "sy": 0.8}),
    "laplace": ("-abs(dx) / 0.5 - abs(dy) / 0.8 - ln(1.0) - ln(1.6)", {"sx": 0.5, "sy": 0.8}),
    "mvn": (f"-(0.7 * dx * dx - 0.4 * dx * dy + 0.5 * dy * dy) / 0.31 / 2 - ln(0.31) / 2 - {_L2PI}", {"s11": 0.5, "s12": 0.2, "s22": 0.7}),
}
for _family, (_sql, _scale) in _DENSITY.items():
    _metric(
        f"met_nll_{_family}",
        f", l AS (SELECT scenario_id, agent_id, t, {_sql.replace('dx', '(tx - x)').replace('dy', '(ty - y)')} + ln(prob) AS l FROM err JOIN prob USING (scenario_id, agent_id, mode)), "
        "s AS (SELECT scenario_id, agent_id, t, max(l) + ln(sum(exp(l - m))) AS v FROM (SELECT *, max(l) OVER (PARTITION BY scenario_id, agent_id, t) AS m FROM l) GROUP BY ALL) "
        "SELECT round(avg(a), 6) AS nll, count(*) AS n_agents FROM (SELECT -avg(v) AS a FROM s GROUP BY scenario_id, agent_id)",
        lambda t, p, q, family=_family, scale=_scale: M.nll(p, t, family, {k: F.lit(v) for k, v in scale.items()}, q),
    )

_metric(
    "loss_gmm_unmasked",
    ", ue AS (SELECT p.*, q.x AS tx, q.y AS ty, q.valid FROM pred p JOIN truth q USING (scenario_id, agent_id, t)), "
    f"l AS (SELECT scenario_id, agent_id, t, valid, {_DENSITY['mvn'][0].replace('dx', '(tx - x)').replace('dy', '(ty - y)')} + ln(prob) AS l FROM ue JOIN prob USING (scenario_id, agent_id, mode)), "
    "s AS (SELECT scenario_id, agent_id, t, bool_or(valid) AS ok, max(l) + ln(sum(exp(l - m))) AS v FROM (SELECT *, max(l) OVER (PARTITION BY scenario_id, agent_id, t) AS m FROM l) GROUP BY ALL) "
    "SELECT round(avg(a), 6) AS nll, count(*) AS n_agents FROM (SELECT -sum(v) / count_if(ok) AS a FROM s GROUP BY scenario_id, agent_id HAVING count_if(ok) > 0)",
    lambda t, p, q: M.nll(p, t, "mvn", {k: F.lit(v) for k, v in _DENSITY["mvn"][1].items()}, q, masked=False),
)

_EWTA = ", z AS (SELECT scenario_id, agent_id, mode, sum({e}) AS e FROM err GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY scenario_id, agent_id ORDER BY e, mode) AS r FROM z) SELECT round(avg(v), 6) AS ewta, count(*) AS n_agents FROM (SELECT avg(e) AS v FROM k WHERE r <= 3 GROUP BY scenario_id, agent_id)"
_HUBER = "CASE WHEN abs({u}) <= 0.5 THEN ({u}) * ({u}) / 2 ELSE 0.5 * (abs({u}) - 0.25) END"
_metric("loss_ewta", _EWTA.format(e="d"), lambda t, p, q: M.ewta(p, t, 3))
_metric("loss_ewta_mse", _EWTA.format(e="d * d"), lambda t, p, q: M.ewta(p, t, 3, "mse"))
_metric("loss_ewta_huber", _EWTA.format(e=_HUBER.format(u="x - tx") + " + " + _HUBER.format(u="y - ty")), lambda t, p, q: M.ewta(p, t, 3, "huber", 0.5))
_metric("loss_masked_ade", " SELECT round(avg(d), 6) AS loss, count(*) AS n_steps FROM err", lambda t, p, q: M.masked_ade(p, t))


def _scene(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return t.select((F.col("rec_id") * 1000 + F.col("frame")).alias("scenario_id"), F.col("track_id").alias("id"), (F.col("x") / 5).alias("x"), "y")


_PAIR = f"""{TR}, pt AS (SELECT rec_id * 1000 + frame AS scenario_id, track_id AS id, x / 5 AS x, y FROM tr),
pr AS (SELECT a.scenario_id, a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM pt a JOIN pt b USING (scenario_id))"""


@query("knn_agents", f"""WITH {_PAIR}, k AS (SELECT *, row_number() OVER (PARTITION BY scenario_id, a ORDER BY d, b) AS r FROM pr)
SELECT scenario_id, a, b FROM k WHERE r <= 3 UNION SELECT scenario_id, b, a FROM k WHERE r <= 3""")  # fmt: skip
def knn_agents(spark, sf_dir):
    return N.knn_graph(_scene(spark, sf_dir), 3)


@query("radius_pairs", f"""WITH {_PAIR}, k AS (SELECT *, row_number() OVER (PARTITION BY scenario_id, a ORDER BY d, b) AS r FROM pr WHERE d <= 20)
SELECT scenario_id, a, b, round(d, 6) AS d FROM (SELECT scenario_id, a, b, d FROM k WHERE r <= 4 UNION SELECT scenario_id, b, a, d FROM k WHERE r <= 4)""")  # fmt: skip
def radius_pairs(spark, sf_dir):
    return _rounded(N.radius_graph(_scene(spark, sf_dir), 20.0, 4))


@query("map_agent_radius", f"""WITH {_PAIR}, nd AS (SELECT scenario_id, n, n * 25.0::DOUBLE AS x, n * 25.0::DOUBLE AS y FROM (SELECT DISTINCT scenario_id FROM pt), (SELECT unnest(range(0, 5))::INTEGER AS n))
SELECT scenario_id, a, b, round(d, 6) AS d, nbr_rank::INTEGER AS nbr_rank FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, a ORDER BY d, b) AS nbr_rank FROM
 (SELECT nd.scenario_id, n AS a, id AS b, sqrt((nd.x - pt.x) * (nd.x - pt.x) + (nd.y - pt.y) * (nd.y - pt.y)) AS d FROM nd JOIN pt USING (scenario_id)) WHERE d <= 20) WHERE nbr_rank <= 2""")  # fmt: skip
def map_agent_radius(spark, sf_dir):
    points = _scene(spark, sf_dir)
    nodes = points.select("scenario_id").distinct().withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(4))))
    nodes = nodes.withColumns({"x": F.col("node") * F.lit(25.0), "y": F.col("node") * F.lit(25.0)})
    return _rounded(N.map_to_agents(nodes, points, 20.0, 2).select("scenario_id", "a", "b", "d", "nbr_rank"))


@query("topk_neighbors", f"WITH {_PAIR} SELECT scenario_id, a, b, r::INTEGER AS nbr_rank FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, a ORDER BY d, b) AS r FROM pr WHERE a <> b) WHERE r <= 2")
def topk_neighbors(spark, sf_dir):
    p = _scene(spark, sf_dir)
    a = p.select("scenario_id", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = p.select("scenario_id", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    pairs = a.join(b, "scenario_id").where("a <> b").withColumn("d", geometry.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    return N.nearest(pairs, 2, ("scenario_id", "a")).select("scenario_id", "a", "b", "nbr_rank")


@query("argmax_vector", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS k FROM embeddings")
def argmax_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", codes.argmax(F.col("embedding")).alias("k"))


@query("softmax_probabilities", f"WITH {PRED} SELECT scenario_id, agent_id, mode, round(exp(prob) / sum(exp(prob)) OVER (PARTITION BY scenario_id, agent_id), 6) AS prob FROM prob")
def softmax_probabilities(spark, sf_dir):
    return _rounded(M.softmax(prediction_tables(spark, sf_dir)[2]).select("scenario_id", "agent_id", "mode", "prob"))


@query("edge_weight", f"WITH {_PAIR} SELECT scenario_id, a, b, round(exp(-(d / 30.0) * (d / 30.0)), 6) AS w FROM pr WHERE a < b")
def edge_weight(spark, sf_dir):
    p = _scene(spark, sf_dir)
    a = p.select("scenario_id", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = p.select("scenario_id", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d = geometry.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return a.join(b, "scenario_id").where("a < b").select("scenario_id", "a", "b", F.round(N.edge_weight(d, 30.0), 6).alias("w"))


@query("rollout_double_integrator", f"""WITH {MV} SELECT track_id, t::INTEGER AS t, round(x + vx * t * 0.2 + greatest(least(ax, 8), -8) * (t * 0.2) * (t * 0.2) / 2, 4) AS x,
  round(y + vy * t * 0.2 + greatest(least(ay, 8), -8) * (t * 0.2) * (t * 0.2) / 2, 4) AS y FROM mv, (SELECT unnest(range(1, 6)) AS t) WHERE frame = 10""")  # fmt: skip
def rollout_double_integrator(spark, sf_dir):
    m = moving(spark, sf_dir).where("frame = 10")
    out = X.rollout(m.select("track_id", "x", "y", "vx", "vy", "ax", "ay"), 5, 0.2, F.col("ax"), F.col("ay"))
    return _rounded(out.select("track_id", "t", "x", "y"), 4)


@query("ode_steppers", f"WITH {TR} SELECT track_id, frame, round(x * 0.9, 9) AS ef, round(x * 0.905, 9) AS heun, round(x * (1 - 0.1 + 0.005 - 0.001 / 6), 9) AS rk3, round(x * (1 - 0.1 + 0.005 - 0.001 / 6 + 0.0001 / 24), 9) AS rk4 FROM tr")
def ode_steppers(spark, sf_dir):
    decay = lambda s: {"x": -s["x"]}
    each = {m: F.round(X.step({"x": F.col("x")}, decay, 0.1, m)["x"], 9).alias(m) for m in ("ef", "heun", "rk3", "rk4")}
    return tracks(spark, sf_dir).select("track_id", "frame", *each.values())


@query("covariance_step", f"WITH {TR} SELECT track_id, frame, round((y + 1) + 0.4 * 0.5 + 0.04 * (x + 2) + 0.01, 6) AS p11, round(0.5 + 0.2 * (x + 2) + 0.3 * 0.1 * 0.2, 6) AS p12, round(x + 2 + 0.04, 6) AS p22 FROM tr")
def covariance_step(spark, sf_dir):
    q = X.process_noise(F.lit(0.1), F.lit(0.2), F.lit(0.3))
    p11, p12, p22 = X.propagate((F.col("y") + 1, F.lit(0.5), F.col("x") + 2), (1, 0.2, 0, 1), q)
    return _rounded(tracks(spark, sf_dir).select("track_id", "frame", p11.alias("p11"), p12.alias("p12"), p22.alias("p22")))


@query("input_clamp", f"WITH {MV} SELECT track_id, frame, round(greatest(least(ax, 50), -50), 4) AS ux FROM mv")
def input_clamp(spark, sf_dir):
    return moving(spark, sf_dir).select("track_id", "frame", F.round(X.clamp(F.col("ax"), 50), 4).alias("ux"))


@query("nearest_vectors", """WITH q AS (SELECT vec_id AS a, embedding AS ea, label FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT a, vec_id AS b, list_inner_product(ea::DOUBLE[], embedding::DOUBLE[]) AS s FROM q JOIN embeddings e ON e.label = q.label AND e.vec_id <> a)
SELECT a, b, nbr_rank::INTEGER AS nbr_rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS nbr_rank FROM p) WHERE nbr_rank <= 3""")  # fmt: skip
def nearest_vectors(spark, sf_dir):
    """A search: the vectors whose id is divisible by 20 are the queries, against all vectors of their label."""
    e = table(spark, sf_dir, "embeddings")
    a = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea"), "label")
    b = e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb"), "label")
    return N.nearest_by_product(a, b, 3, "label").select("a", "b", "nbr_rank")
