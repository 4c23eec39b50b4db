"""Queries of splits, windows, masks, filters and resampling."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import filters as P
from ..operators import lanes as L
from ..operators import resample as R
from ..operators import sampling as S
from ..operators import splits
from ..operators import transforms as X
from .views import LANES, MV, TR, moving, on_lanes, query, tracks

SMALL, LONG = S.Windows(2, 3, 2), S.Windows(6, 10, 4)

_BLOCK = """CASE WHEN frame <= (n % 10) * (floor(n / 10) + 1) THEN floor((frame - 1) / (floor(n / 10) + 1))
  ELSE n % 10 + floor((frame - (n % 10) * (floor(n / 10) + 1) - 1) / floor(n / 10)) END"""
SPLIT = f"""{TR}, fin AS (SELECT rec_id, track_id, max(frame) AS final FROM tr GROUP BY ALL), nn AS (SELECT rec_id, arg_max(final, track_id) AS n FROM fin GROUP BY 1),
sp AS (SELECT *, CASE WHEN b = 8 THEN 'val' WHEN b = 1 THEN 'test' WHEN b IS NOT NULL THEN 'train' END AS split
  FROM (SELECT tr.*, n, (CASE WHEN frame BETWEEN 1 AND n THEN {_BLOCK} END)::INTEGER AS b FROM tr JOIN nn USING (rec_id)))"""


@query("split_blocks", f"WITH {SPLIT} SELECT track_id, frame, b AS block, split FROM sp")
def split_blocks(spark, sf_dir):
    t = tracks(spark, sf_dir)
    final = t.withColumn("_f", F.max("frame").over(W.partitionBy("track_id"))).withColumn("n", F.max_by("_f", "track_id").over(W.partitionBy("rec_id")))
    out = final.withColumn("block", splits.block(F.col("frame"), F.col("n")))
    return out.select("track_id", "frame", "block", splits.split_of(F.col("block")).alias("split"))


@query("split_membership", f"WITH {SPLIT} SELECT rec_id, split, count(*) AS n, count(DISTINCT frame) AS frames FROM sp GROUP BY ALL")
def split_membership(spark, sf_dir):
    return splits.with_split(tracks(spark, sf_dir)).groupBy("rec_id", "split").agg(F.count("*").alias("n"), F.countDistinct("frame").alias("frames"))


@query("split_purge", f"WITH {SPLIT} SELECT s.name AS split, track_id, count(*) AS n FROM sp, (VALUES ('train'), ('val'), ('test')) s(name) WHERE split IS NULL OR split = s.name GROUP BY ALL")
def split_purge(spark, sf_dir):
    t = splits.with_split(tracks(spark, sf_dir))
    whole = t.withColumn("split", F.explode(F.when(F.col("split").isNull(), F.array(*map(F.lit, ("train", "val", "test")))).otherwise(F.array("split"))))
    return whole.groupBy("split", "track_id").agg(F.count("*").alias("n"))


def _purged(spark, sf_dir):
    """Each split's frames as tracks of their own: a row of no split is in all three."""
    t = splits.with_split(tracks(spark, sf_dir))
    return t.withColumn("split", F.explode(F.when(F.col("split").isNull(), F.array(*map(F.lit, ("train", "val", "test")))).otherwise(F.array("split"))))


SPLIT_KEYS = ("split", "rec_id", "track_id")
PURGED = f"{SPLIT}, pu AS (SELECT s.name AS split, rec_id, track_id, frame FROM sp, (VALUES ('train'), ('val'), ('test')) s(name) WHERE split IS NULL OR split = s.name)"


def _starts_sql(keys: str, source: str, last: int, stride: int, prefix: bool) -> str:
    ok = f"min(has) OVER (PARTITION BY {keys} ORDER BY frame)" if prefix else "has"
    return f"""st AS (SELECT {keys}, frame AS start FROM (SELECT *, {ok} AS good FROM (SELECT a.*, (b.frame IS NOT NULL)::INTEGER AS has FROM
  (SELECT {keys}, frame, row_number() OVER (PARTITION BY {keys} ORDER BY frame) - 1 AS p FROM {source}) a
  LEFT JOIN {source} b ON {" AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))} AND b.frame = a.frame + {last} WHERE p % {stride} = 0)) WHERE good = 1)"""


@query("win_starts_stride", f"WITH {PURGED}, {_starts_sql('split, rec_id, track_id', 'pu', 5, 2, False)} SELECT split, track_id, start FROM st")
def win_starts_stride(spark, sf_dir):
    return S.starts(_purged(spark, sf_dir), SMALL, SPLIT_KEYS, prefix=False).select("split", "track_id", "start")


PREFIX = f"{PURGED}, {_starts_sql('split, rec_id, track_id', 'pu', 5, 2, True)}"


@query("win_starts_prefix", f"WITH {PREFIX} SELECT split, track_id, start FROM st")
def win_starts_prefix(spark, sf_dir):
    return S.starts(_purged(spark, sf_dir), SMALL, SPLIT_KEYS).select("split", "track_id", "start")


@query("win_starts_strict", f"""WITH {PURGED}, {_starts_sql('split, rec_id, track_id', 'pu', 5, 2, False)}
SELECT st.split, st.track_id, start FROM st JOIN pu ON pu.split = st.split AND pu.track_id = st.track_id AND pu.frame BETWEEN start AND start + 5 GROUP BY ALL HAVING count(*) = 6""")  # fmt: skip
def win_starts_strict(spark, sf_dir):
    return S.starts(_purged(spark, sf_dir), SMALL, SPLIT_KEYS, prefix=False, strict=True).select("split", "track_id", "start")


WIN = f"{TR}, {_starts_sql('rec_id, track_id', 'tr', 16, 4, True)}"
AG = f"""{WIN}, ag AS (SELECT *, row_number() OVER (PARTITION BY rec_id, target_id, start ORDER BY track_id <> target_id, track_id) - 1 AS agent_idx FROM
 (SELECT st.rec_id, st.track_id AS target_id, start, tr.track_id FROM st JOIN tr ON tr.rec_id = st.rec_id AND tr.frame = start + 5))"""


def _members(spark, sf_dir):
    t = tracks(spark, sf_dir)
    return t, S.agents(S.starts(t, LONG), t)


@query("sample_agents", f"WITH {AG} SELECT target_id, start, track_id, agent_idx::INTEGER AS agent_idx FROM ag")
def sample_agents(spark, sf_dir):
    return _members(spark, sf_dir)[1].select("target_id", "start", "track_id", "agent_idx")


STEPS = f"""{AG}, ss AS (SELECT ag.*, t, CASE WHEN t < 6 THEN 'inp' ELSE 'trg' END AS part, x, y FROM (SELECT *, unnest(range(0, 16))::INTEGER AS t FROM ag) ag
  LEFT JOIN tr ON tr.rec_id = ag.rec_id AND tr.track_id = ag.track_id AND tr.frame = ag.start + ag.t)"""


@query("sample_steps", f"WITH {STEPS} SELECT target_id, start, track_id, agent_idx::INTEGER AS agent_idx, t, part, x, y FROM ss")
def sample_steps(spark, sf_dir):
    t, members = _members(spark, sf_dir)
    return S.steps(members, t, LONG).select("target_id", "start", "track_id", "agent_idx", "t", "part", "x", "y")


MASKS = f"""{STEPS}, a0 AS (SELECT rec_id, target_id, start, track_id,
  count(DISTINCT x) FILTER (part = 'inp') + count(*) FILTER (part = 'inp' AND x IS NULL) + count(DISTINCT x) FILTER (part = 'trg') + count(*) FILTER (part = 'trg' AND x IS NULL) AS spread,
  count(*) FILTER (part = 'trg' AND x IS NOT NULL AND y IS NOT NULL) AS future, max(x) FILTER (t = 5) AS lx, max(y) FILTER (t = 5) AS ly FROM ss GROUP BY ALL),
a1 AS (SELECT a0.*, sqrt((a0.lx - z.lx) * (a0.lx - z.lx) + (a0.ly - z.ly) * (a0.ly - z.ly)) AS away FROM a0 JOIN a0 z
  ON z.rec_id = a0.rec_id AND z.target_id = a0.target_id AND z.start = a0.start AND z.track_id = a0.target_id),
a2 AS (SELECT *, row_number() OVER (PARTITION BY rec_id, target_id, start, future >= 6 AND spread > 3 ORDER BY away NULLS LAST, track_id) AS r FROM a1),
mk AS (SELECT ss.*, x IS NOT NULL AND y IS NOT NULL AS mask, ss.track_id = ss.target_id AND x IS NOT NULL AND y IS NOT NULL AS sa_mask,
  future >= 6 AND spread > 3 AND r <= 4 AND x IS NOT NULL AND y IS NOT NULL AS ma_mask FROM ss JOIN a2 USING (rec_id, target_id, start, track_id))"""


def _masked(spark, sf_dir, **more):
    t, members = _members(spark, sf_dir)
    return S.with_masks(S.agent_steps(members, t, LONG), LONG, least_future=6, k=4, **more)


@query("sample_masks", f"WITH {MASKS} SELECT target_id, start, track_id, t, part, x, y, mask, sa_mask, ma_mask FROM mk")
def sample_masks(spark, sf_dir):
    """The flagship: tracks to windows to agents to steps to masks."""
    return S.long(_masked(spark, sf_dir), LONG).select("target_id", "start", "track_id", "t", "part", "x", "y", "mask", "sa_mask", "ma_mask")


@query("sample_moving_targets", f"""WITH {MASKS.replace("future >= 6 AND spread > 3", "future >= 6 AND spread > 16")}, sk AS (SELECT rec_id, target_id, start FROM a0 WHERE track_id = target_id AND spread > 16)
SELECT target_id, start, track_id, t, ma_mask FROM mk JOIN sk USING (rec_id, target_id, start)""")  # fmt: skip
def sample_moving_targets(spark, sf_dir):
    """Samples whose target has more than 16 distinct places; the others are skipped."""
    return S.long(_masked(spark, sf_dir, threshold=16, skip_static=True), LONG).select("target_id", "start", "track_id", "t", "ma_mask")


@query("sample_ma_topk", f"WITH {MASKS} SELECT DISTINCT target_id, start, track_id FROM mk WHERE ma_mask")
def sample_ma_topk(spark, sf_dir):
    return _masked(spark, sf_dir).where(F.array_contains("ma_mask", True)).select("target_id", "start", "track_id")


@query("sample_category_masks", f"WITH {STEPS} SELECT target_id, start, track_id, t, track_id % 4 > 1 AND x IS NOT NULL AND y IS NOT NULL AS ma_mask FROM ss")
def sample_category_masks(spark, sf_dir):
    """Agents are scored by their category."""
    t, members = _members(spark, sf_dir)
    rows = S.agent_steps(members.withColumn("category", F.col("track_id") % 4), t, LONG)
    return S.long(S.with_masks(rows, LONG, 6, category="category"), LONG).select("target_id", "start", "track_id", "t", "ma_mask")


@query("sample_nested", f"""WITH {MASKS}, al AS (SELECT rec_id, target_id, start, agent_idx, track_id, part, list(coalesce(x, 0) ORDER BY t) AS x, list(mask ORDER BY t) AS m, list(ma_mask ORDER BY t) AS ma FROM mk GROUP BY ALL)
SELECT target_id, start, count(*)::INTEGER AS num_nodes, to_json(list(track_id ORDER BY agent_idx)) AS ids, to_json(list(track_id % 3 ORDER BY agent_idx)) AS intention, round(sum(list_sum(i.x)), 4) AS inp, round(sum(list_sum(o.x)), 4) AS trg,
  to_json(list(i.m ORDER BY agent_idx)) AS input_mask, to_json(list(o.m ORDER BY agent_idx)) AS valid_mask, to_json(list(o.ma ORDER BY agent_idx)) AS ma_mask
FROM al i JOIN (SELECT rec_id, target_id, start, track_id, x, m, ma FROM al WHERE part = 'trg') o USING (rec_id, target_id, start, track_id) WHERE i.part = 'inp' GROUP BY target_id, start""")  # fmt: skip
def sample_nested(spark, sf_dir):
    whole = S.nested(_masked(spark, sf_dir).withColumn("intention", F.col("track_id") % 3), LONG, extra=("intention",))
    total = lambda c: F.round(F.aggregate(F.flatten(c), F.lit(0.0), lambda acc, v: acc + v), 4)
    return whole.select("target_id", "start", "num_nodes", F.to_json("ids").alias("ids"), F.to_json("intention").alias("intention"), total("inp_x").alias("inp"), total("trg_x").alias("trg"), *(F.to_json(c).alias(c) for c in ("input_mask", "valid_mask", "ma_mask")))


_FIXED = f"""{TR}, tg AS (SELECT rec_id, min(track_id) AS target_id FROM tr GROUP BY 1), fa AS (SELECT rec_id, track_id, min(frame) AS f FROM tr WHERE y > 30 GROUP BY ALL)"""


@query("sample_fixed", f"""WITH {_FIXED}, ag AS (SELECT rec_id, target_id, track_id, row_number() OVER (PARTITION BY rec_id ORDER BY track_id <> target_id, track_id) - 1 AS i FROM tg JOIN (SELECT rec_id, track_id, min(f) AS f FROM fa GROUP BY ALL) USING (rec_id) WHERE f < 20 OR track_id = target_id)
SELECT target_id, ag.track_id, i::INTEGER AS agent_idx, t, part, x FROM (SELECT *, unnest(range(0, 50))::INTEGER AS t, CASE WHEN t < 20 THEN 'inp' ELSE 'trg' END AS part FROM ag) ag LEFT JOIN tr ON tr.track_id = ag.track_id AND tr.frame = t AND tr.y > 30""")  # fmt: skip
def sample_fixed(spark, sf_dir):
    """One window per recording at a fixed place, with every agent that appears in its history."""
    spec = S.SAMPLING["argoverse"].windows()
    t = tracks(spark, sf_dir)
    shown = t.where("y > 30")
    targets = t.groupBy("rec_id").agg(F.min("track_id").alias("track_id"))
    members = S.present_agents(S.fixed_windows(targets, spec), shown)
    return S.steps(members, shown, spec).select("target_id", "track_id", "agent_idx", "t", "part", "x")


@query("sample_ego_only", f"WITH {TR} SELECT rec_id, track_id FROM tr WHERE track_id % 10 = 0 GROUP BY ALL")
def sample_ego_only(spark, sf_dir):
    """The first track of a recording is its ego vehicle, and the only target."""
    t = tracks(spark, sf_dir).withColumn("track_id", F.col("track_id") - F.col("rec_id") * 10)
    targets = t.select("rec_id", "track_id").distinct()
    own = S.only_ego(targets, S.SAMPLING["lyft"].ego_only)
    return own.select("rec_id", (F.col("track_id") + F.col("rec_id") * 10).alias("track_id"))


_EGO = f"""{MV}, {_starts_sql('rec_id, track_id', 'tr', 16, 4, True)}, p AS (SELECT st.rec_id, st.track_id, start, x AS x0, y AS y0, psi AS h FROM st JOIN mv ON mv.track_id = st.track_id AND mv.frame = start + 5)"""


def _own_steps(spark, sf_dir):
    m = moving(spark, sf_dir)
    own = S.starts(m, LONG).select("rec_id", F.col("track_id").alias("target_id"), "start", "pred_frame", "track_id", F.lit(0).alias("agent_idx"))
    return S.steps(own, m, LONG, ("x", "y", "vx", "vy", "ax", "ay", "psi"))


@query("ego_transform", f"""WITH {_EGO} SELECT p.track_id AS target_id, start, frame - start AS t, round((x - x0) * cos(h) + (y - y0) * sin(h), 4) AS x, round((y - y0) * cos(h) - (x - x0) * sin(h), 4) AS y,
  round(vx * cos(h) + vy * sin(h), 5) AS vx, round(cos(psi - h), 4) AS c FROM p JOIN mv ON mv.track_id = p.track_id AND frame BETWEEN start AND start + 15""")  # fmt: skip
def ego_transform(spark, sf_dir):
    out = X.ego_frame(_own_steps(spark, sf_dir), LONG.history)
    return out.select("target_id", "start", "t", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("vx", 5).alias("vx"), F.round(F.cos("psi"), 4).alias("c"))


@query("ego_shift", f"WITH {_EGO} SELECT p.track_id AS target_id, start, frame - start AS t, round(x - x0, 4) AS x, round(y - y0, 4) AS y FROM p JOIN mv ON mv.track_id = p.track_id AND frame BETWEEN start AND start + 15")
def ego_shift(spark, sf_dir):
    out = X.ego_frame(_own_steps(spark, sf_dir), LONG.history, turn=False)
    return out.select("target_id", "start", "t", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("parked_filter", f"WITH {TR}, m AS (SELECT rec_id, track_id, min(frame) AS a, max(frame) AS b FROM tr GROUP BY ALL) SELECT track_id FROM (SELECT *, max(b) OVER (PARTITION BY rec_id) AS z FROM m) WHERE NOT (a = 1 AND b = z)")
def parked_filter(spark, sf_dir):
    return P.without_parked(P.meta(tracks(spark, sf_dir)), first=1).select("track_id")


@query("track_any_bad", f"WITH {TR} SELECT track_id, count(*) AS n FROM tr GROUP BY rec_id, track_id HAVING NOT bool_or(event_type = 'error' AND y >= 95)")
def track_any_bad(spark, sf_dir):
    return P.without_any(tracks(spark, sf_dir), (F.col("event_type") == "error") & (F.col("y") >= 95)).groupBy("track_id").agg(F.count("*").alias("n"))


@query("track_present_by", f"WITH {TR} SELECT track_id, min(frame) AS first FROM tr WHERE y > 80 GROUP BY rec_id, track_id HAVING min(frame) <= 5")
def track_present_by(spark, sf_dir):
    return P.present_by(tracks(spark, sf_dir).where("y > 80"), 5).groupBy("track_id").agg(F.min("frame").alias("first"))


@query("short_tracks", f"WITH {TR} SELECT track_id, count(*) AS n FROM tr GROUP BY rec_id, track_id HAVING count(*) >= 70")
def short_tracks(spark, sf_dir):
    return P.at_least(tracks(spark, sf_dir), 70).groupBy("track_id").agg(F.count("*").alias("n"))


@query("class_filter", f"WITH {TR} SELECT track_id, frame FROM tr WHERE event_type NOT IN ('error', 'signup')")
def class_filter(spark, sf_dir):
    return P.without_classes(tracks(spark, sf_dir), ("error", "signup"), "event_type").select("track_id", "frame")


@query("nearstatic_agents", f"""WITH {STEPS} SELECT target_id, start, track_id, count(DISTINCT round(x)) + count(*) FILTER (x IS NULL) <= 12 AS static FROM ss GROUP BY ALL""")
def nearstatic_agents(spark, sf_dir):
    t, members = _members(spark, sf_dir)
    return P.near_static_steps(S.agent_steps(members, t, LONG), lambda s: F.round(s["x"]), 12).select("target_id", "start", "track_id", "static")


@query("lk_lc_balance", f"""WITH {LANES}, {_starts_sql('rec_id, track_id', 'tr', 16, 4, True)}, w AS (SELECT st.*, floor(y / 60) = 0 AS lk FROM st JOIN tr ON tr.track_id = st.track_id AND tr.frame = start + 5),
c AS (SELECT *, count_if(lk) OVER (PARTITION BY track_id) AS nlk, count_if(NOT lk) OVER (PARTITION BY track_id) AS nlc, row_number() OVER (PARTITION BY track_id, lk ORDER BY start) - 1 AS pos FROM w)
SELECT track_id, start, lk FROM c WHERE NOT lk OR pos % greatest(ceil(nlk / (CASE WHEN nlc > 0 THEN least(nlc, nlk) ELSE least(nlk, 5) END + 1)), 1) = 0""")  # fmt: skip
def lk_lc_balance(spark, sf_dir):
    t = tracks(spark, sf_dir)
    at = t.select("rec_id", "track_id", (F.col("frame") + 1).alias("pred_frame"), F.when(F.floor(F.col("y") / 60) == 0, 3).otherwise(0).alias("m"))
    w = S.starts(t, LONG).join(at, ["rec_id", "track_id", "pred_frame"])
    return S.balanced_starts(w, F.col("m")).select("track_id", "start", (F.col("m") == 3).alias("lk"))


@query("lane_keep_targets", f"WITH {LANES}, c AS (SELECT rec_id, track_id, CASE WHEN driving_direction = 2 THEN 0 ELSE 1 END AS nlc FROM dir) SELECT rec_id, (count_if(nlc > 0) + least(count_if(nlc = 0), greatest(count_if(nlc > 0) // 10, 5)))::BIGINT AS n FROM c GROUP BY 1")
def lane_keep_targets(spark, sf_dir):
    m = L.driving_direction(tracks(spark, sf_dir)).withColumn("num_lane_changes", F.when(F.col("driving_direction") == 2, 0).otherwise(1))
    return S.lane_keep_targets(m).groupBy("rec_id").agg(F.count("*").alias("n"))


@query("case_target", f"""WITH {TR}, z AS (SELECT rec_id, track_id, max(frame) - min(frame) AS d, min(frame) AS f FROM tr WHERE y > 5 GROUP BY ALL)
SELECT rec_id, track_id AS target_id FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY d DESC, f, track_id) AS r FROM z WHERE d > 0) WHERE r = 1""")  # fmt: skip
def case_target(spark, sf_dir):
    return S.longest_target(tracks(spark, sf_dir).where("y > 5"), "rec_id")


_PED = f"""{TR}, pe AS (SELECT rec_id, track_id, frame - 1 AS frame FROM tr WHERE y > 15), n AS (SELECT rec_id, max(frame) AS m FROM pe GROUP BY 1),
w AS (SELECT rec_id, unnest(range(0, m - 6 + 1, 2)) AS start FROM n), c AS (SELECT w.rec_id, start, track_id, count(*) AS k, bool_or(frame = start + 2) AS now
  FROM w JOIN pe ON pe.rec_id = w.rec_id AND pe.frame BETWEEN start AND start + 6 GROUP BY ALL)"""


@query("ped_windows", f"""WITH {_PED}, s AS (SELECT *, count_if(now) OVER (PARTITION BY rec_id, start) AS n_agents FROM c)
SELECT rec_id, start::INTEGER AS start, track_id AS target_id, n_agents::INTEGER AS n_agents FROM s WHERE n_agents >= 2 AND k = 7""")  # fmt: skip
def ped_windows(spark, sf_dir):
    t = tracks(spark, sf_dir).where("y > 15").withColumn("frame", F.col("frame") - 1)
    return S.pedestrian_windows(t, 3, 4, skip=2, least=2)


@query("resample_linear", f"""WITH {TR}, z AS (SELECT *, lead(frame) OVER w AS f1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM tr WHERE y > 20 WINDOW w AS (PARTITION BY rec_id, track_id ORDER BY frame)),
g AS (SELECT *, unnest(range(ceil(frame / 0.4)::BIGINT, CASE WHEN f1 IS NULL THEN floor(frame / 0.4) ELSE ceil(f1 / 0.4) - 1 END::BIGINT + 1)) AS grid FROM z)
SELECT track_id, grid::INTEGER AS grid, round(CASE WHEN f1 IS NULL THEN x ELSE x + (x1 - x) * ((grid * 0.4 - frame) / (f1 - frame)) END, 4) AS x,
  round(CASE WHEN f1 IS NULL THEN y ELSE y + (y1 - y) * ((grid * 0.4 - frame) / (f1 - frame)) END, 4) AS y FROM g""")  # fmt: skip
def resample_linear(spark, sf_dir):
    out = R.linear_grid(tracks(spark, sf_dir).where("y > 20"), "frame", 0.4)
    return out.select("track_id", "grid", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_RUNS = f"{TR}, ru AS (SELECT *, (frame - row_number() OVER (PARTITION BY rec_id, track_id ORDER BY frame))::INTEGER AS run FROM tr WHERE y > 20)"


@query("island_runs", f"WITH {_RUNS} SELECT track_id, run, min(frame) AS a, max(frame) AS b, count(*) AS n FROM ru GROUP BY ALL")
def island_runs(spark, sf_dir):
    runs = R.islands(tracks(spark, sf_dir), ("rec_id", "track_id"), valid=F.col("y") > 20)
    return runs.groupBy("track_id", "run").agg(F.min("frame").alias("a"), F.max("frame").alias("b"), F.count("*").alias("n"))


@query("upsample_factor", f"""WITH {_RUNS}, z AS (SELECT *, coalesce(x - lag(x) OVER w, lead(x) OVER w - x, 0) AS sx, coalesce(y - lag(y) OVER w, lead(y) OVER w - y, 0) AS sy FROM ru WINDOW w AS (PARTITION BY track_id, run ORDER BY frame))
SELECT track_id, (frame * 3 + j)::INTEGER AS frame, round(x - sx * (1 - (j + 1) / 3.0::DOUBLE), 4) AS x, round(y - sy * (1 - (j + 1) / 3.0::DOUBLE), 4) AS y FROM z, (SELECT unnest(range(0, 3)) AS j)""")  # fmt: skip
def upsample_factor(spark, sf_dir):
    out = R.upsample(tracks(spark, sf_dir).where("y > 20"), 3)
    return out.select("track_id", "frame", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("decimate_lazy", f"""WITH {TR}, b AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame DESC) - 1 AS b FROM tr WHERE y > 20)
SELECT track_id, frame, (row_number() OVER (PARTITION BY track_id ORDER BY frame) - 1)::INTEGER AS pick FROM b WHERE b % 5 = 0""")  # fmt: skip
def decimate_lazy(spark, sf_dir):
    return R.decimate_lazy(tracks(spark, sf_dir), 5, ("rec_id", "track_id"), "frame", F.col("y") > 20).select("track_id", "frame", "pick")


def _weights_sql(matrix, digits: int) -> str:
    """A SQL of the same weighted sums, with the weight table as literals: tracks cut into windows of its length."""
    n = matrix.shape[1]
    rows = ", ".join(f"({i}, {j}, {matrix[i, j]!r}::DOUBLE)".replace("np.float64(", "").replace(")::", "::") for i in range(matrix.shape[0]) for j in range(n))
    return f"""WITH {TR}, wt(out_t, in_t, w) AS (VALUES {rows}), s AS (SELECT track_id, (frame - 1) // {n} AS part, (frame - 1) % {n} AS in_t, x, y FROM tr),
k AS (SELECT track_id, part FROM s GROUP BY ALL HAVING count(*) = {n})
SELECT track_id, part::INTEGER AS part, out_t::INTEGER AS out_t, round(sum(w * x), {digits}) AS x, round(sum(w * y), {digits}) AS y FROM s JOIN k USING (track_id, part) JOIN wt USING (in_t) GROUP BY ALL"""


def _weighted(spark, sf_dir, matrix, digits: int):
    n = matrix.shape[1]
    t = tracks(spark, sf_dir).withColumns({"part": F.floor((F.col("frame") - 1) / n).cast("int"), "in_t": F.pmod(F.col("frame") - 1, F.lit(n))})
    table = R.weight_table(spark, {n: matrix})
    return R.apply_weights(t, table, ("track_id", "part")).select("track_id", "part", "out_t", F.round("x", digits).alias("x"), F.round("y", digits).alias("y"))


@query("decimate_weights", _weights_sql(R.decimation_weights(40, 5), 4))
def decimate_weights(spark, sf_dir):
    return _weighted(spark, sf_dir, R.decimation_weights(40, 5), 4)


@query("resample_rational", _weights_sql(R.rational_weights(20, 2, 5), 4))
def resample_rational(spark, sf_dir):
    return _weighted(spark, sf_dir, R.rational_weights(20, 2, 5), 4)


@query("sample_targets_zeroed", f"WITH {STEPS} SELECT target_id, part, round(sum(CASE WHEN part = 'trg' THEN 0.0 ELSE x END), 2) AS sx, count(*) AS n FROM ss GROUP BY ALL")
def sample_targets_zeroed(spark, sf_dir):
    t, members = _members(spark, sf_dir)
    rows = P.unlabelled_targets(S.steps(members, t, LONG), ("x", "y"))
    return rows.groupBy("target_id", "part").agg(F.round(F.sum("x"), 2).alias("sx"), F.count("*").alias("n"))


@query("sample_directional", f"""WITH {LANES}, {_starts_sql('rec_id, track_id', 'tr', 16, 4, True)}
SELECT st.track_id AS target_id, start, count(*) AS n FROM st JOIN ln a ON a.track_id = st.track_id AND a.frame = start + 5 JOIN ln b ON b.rec_id = a.rec_id AND b.frame = a.frame AND b.driving_direction = a.driving_direction GROUP BY ALL""")  # fmt: skip
def sample_directional(spark, sf_dir):
    t = on_lanes(spark, sf_dir)
    return S.agents(S.starts(t, LONG), t, same_direction=True).groupBy("target_id", "start").agg(F.count("*").alias("n"))
