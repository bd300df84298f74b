"""Queries: windows, chunks, smoothing, filters, scans and recursions."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sensorframe.functions import vec as V
from sensorframe.operators import chunks as C
from sensorframe.operators import scan as N
from sensorframe.operators import sequence as X
from sensorframe.operators import windows as W
from sensorframe.operators.blocks import prefix_sums
from sensorframe.operators.packed import pack_windows
from sensorframe.operators.sampling import hash_uniform
from sensorframe.operators.turns import heading_turn, turn_channels
from sensorframe.session import cut_lineage
from sensorframe.sources.views import event_view, sensor_view
from workload import inputs as I
from workload import sql as Q
from workload.registry import query

_WIN = "CAST(floor(frame / 50) AS INTEGER)"
_ORDER = "(PARTITION BY rec ORDER BY frame)"


def _window_avg(f, cols):
    return W.window_means(f, {c: c for c in cols}, I.RIG)


def _avg_sql(cols, source):
    return (f"SELECT rec, {_WIN} AS win_idx, " + ", ".join(f"avg({c}) AS {c}" for c in cols)
            + f" FROM {source} GROUP BY 1, 2 HAVING count(*) = 50")


KEYS = "rec:bigint win_idx:int"


# ---------------------------------------------------------------- local operators
@query("moving_average_same", "rec:bigint frame:int", "even odd", f"""{Q.BASE}
SELECT rec, frame, sum(ax) OVER (PARTITION BY rec ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)
       / 10 AS even, sum(az) OVER (PARTITION BY rec ORDER BY frame ROWS BETWEEN 12 PRECEDING
       AND 12 FOLLOWING) / 25 AS odd FROM sv""")
def moving_average_same(spark, d):
    f = sensor_view(spark, d).select("rec", "frame", "ax", "az")
    a = X.moving_average_same(f, ["ax"], 10, "_e", block=256)
    return X.moving_average_same(a, ["az"], 25, "_o", block=256).select(
        "rec", "frame", F.col("ax_e").alias("even"), F.col("az_o").alias("odd"))


@query("central_gradient", "rec:bigint frame:int", "ax_d wz_d", f"""{Q.BASE}
SELECT rec, frame, coalesce((lead(ax) OVER w - lag(ax) OVER w) / 2, lead(ax) OVER w - ax,
       ax - lag(ax) OVER w) AS ax_d,
       coalesce((lead(wz) OVER w - lag(wz) OVER w) / 2, lead(wz) OVER w - wz, wz - lag(wz) OVER w) AS wz_d
FROM sv WINDOW w AS {_ORDER}""")
def central_gradient(spark, d):
    return X.central_gradient(sensor_view(spark, d).select("rec", "frame", "ax", "wz"),
                              ["ax", "wz"])


@query("roughness", "rec:bigint", "ax_rough wz_rough", f"""{Q.BASE},
s AS (SELECT rec, abs(ax - lag(ax) OVER w) AS a, abs(wz - lag(wz) OVER w) AS b FROM sv WINDOW w AS {_ORDER})
SELECT rec, avg(a) AS ax_rough, avg(b) AS wz_rough FROM s GROUP BY rec""")
def roughness(spark, d):
    return X.roughness(sensor_view(spark, d).select("rec", "frame", "ax", "wz"), ["ax", "wz"])


_TAPS = X.fir_taps(31, 0.1)


def _fir_sql(c):
    terms = [f"{h!r} * coalesce({'lead' if j > 15 else 'lag'}({c}, {abs(j - 15)}) OVER w, 0)"
             if j != 15 else f"{h!r} * {c}" for j, h in enumerate(_TAPS)]
    return " + ".join(terms)


@query("fir_decimate", "rec:bigint frame:int", "ax_lp wz_lp", f"""{Q.BASE},
f AS (SELECT rec, frame, {_fir_sql('ax')} AS ax_lp, {_fir_sql('wz')} AS wz_lp FROM sv WINDOW w AS {_ORDER})
SELECT * FROM f WHERE frame % 4 = 0""")
def fir_decimate(spark, d):
    return X.fir_decimate(sensor_view(spark, d), ["ax", "wz"], _TAPS, 4)


_TAP_ROWS = ", ".join(f"({i - 15}, CAST({h!r} AS DOUBLE))" for i, h in enumerate(_TAPS))


@query("neighbourhood", "rec:bigint win_idx:int q:int", "ax_lp", f"""{Q.WINDOWS},
tp AS (SELECT * FROM (VALUES {_TAP_ROWS}) AS t(o, h)),
ou AS (SELECT rec, win_idx, unnest(range(63)) AS q FROM wm),
fr AS (SELECT sv.rec, frame, sv.ax FROM sv JOIN wm ON sv.rec = wm.rec AND {_WIN.replace('frame', 'sv.frame')} = wm.win_idx)
SELECT ou.rec, ou.win_idx, q, coalesce(sum(h * fr.ax), 0) AS ax_lp FROM ou CROSS JOIN tp
LEFT JOIN fr ON fr.rec = ou.rec AND fr.frame = (ou.win_idx - 2) * 50 + q * 4 + tp.o
     AND q * 4 + tp.o BETWEEN 0 AND 249
GROUP BY 1, 2, 3""")
def neighbourhood(spark, d):
    n = X.neighbourhood(sensor_view(spark, d), ["ax"], _TAPS, 4, 2, I.RIG)
    return n.select("rec", "win_idx", F.posexplode("ax_wide").alias("q", "ax_lp"))


@query("lerp_resample", "rec:bigint out_frame:int", "ax vx", f"""{Q.BASE},
nn AS (SELECT rec, count(*) AS n FROM sv GROUP BY rec),
pt AS (SELECT rec, n, unnest(range(CAST(floor((n - 1) / 1.7) AS INTEGER) + 1)) AS k FROM nn),
sp AS (SELECT rec, k, k * CAST(1.7 AS DOUBLE) AS spot, least(CAST(floor(k * CAST(1.7 AS DOUBLE)) AS INTEGER), n - 2) AS i FROM pt)
SELECT sp.rec, k AS out_frame, a.ax * (1 - (spot - i)) + b.ax * (spot - i) AS ax,
       a.vx * (1 - (spot - i)) + b.vx * (spot - i) AS vx
FROM sp JOIN sv a ON a.rec = sp.rec AND a.frame = i JOIN sv b ON b.rec = sp.rec AND b.frame = i + 1""")
def lerp_resample(spark, d):
    return X.resample(sensor_view(spark, d), ["ax", "vx"], 1.7, I.RIG)


@query("packed_windows", "rec:bigint win_idx:int n:int", "own beyond", f"""{Q.BASE},
ww AS (SELECT rec, CAST(floor(frame / 50) AS INTEGER) AS win_idx, count(*) AS n, sum(ax * (frame % 50 + 1)) AS own FROM sv GROUP BY 1, 2),
hh AS (SELECT rec, CAST(floor(frame / 50) AS INTEGER) - 1 AS win_idx, sum(ax * (frame % 50 + 1)) AS beyond FROM sv WHERE frame % 50 < 2 AND frame >= 50 GROUP BY 1, 2)
SELECT ww.rec, ww.win_idx, n, own, coalesce(beyond, 0) AS beyond FROM ww LEFT JOIN hh ON hh.rec = ww.rec AND hh.win_idx = ww.win_idx""")
def packed_windows(spark, d):
    """Windows as arrays: weighted sums of the own frames and of the halo from the next window."""
    p = pack_windows(sensor_view(spark, d), ["ax"], I.RIG)
    weighed = lambda x: F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    n = F.col("n")
    return p.select("rec", "win_idx", "n", weighed(F.slice("ax", 1, n)).alias("own"),
                    weighed(F.slice("ax", n + 1, F.lit(2))).alias("beyond"))


# ------------------------------------------------------------------ window tables
@query("sub_window_means", "rec:bigint win_idx:int part:int", "vx vy", f"""{Q.WINDOWS}
SELECT sv.rec, wm.win_idx, CAST(floor((frame % 50) / 10) AS INTEGER) AS part, avg(sv.vx) AS vx, avg(sv.vy) AS vy
FROM sv JOIN wm ON sv.rec = wm.rec AND {_WIN} = wm.win_idx GROUP BY 1, 2, 3""")
def sub_window_means(spark, d):
    return W.sub_window_means(sensor_view(spark, d), ("vx", "vy"), 5, I.RIG)


@query("sub_window_samples", "rec:bigint win_idx:int part:int frame:int", "ax", f"""{Q.BASE},
nn AS (SELECT rec, CAST(count(*) AS INTEGER) AS n FROM sv GROUP BY rec),
sp AS (SELECT rec, win_idx, part, least(win_idx * 50 + CAST(floor((part + 0.5) * 50 / 4) AS INTEGER), n - 1) AS frame
FROM (SELECT rec, n, unnest(range(CAST(ceil(n / 50) AS INTEGER))) AS win_idx FROM nn),
     (SELECT unnest(range(4)) AS part))
SELECT sp.*, sv.ax FROM sp JOIN sv ON sv.rec = sp.rec AND sv.frame = sp.frame""")
def sub_window_samples(spark, d):
    f = sensor_view(spark, d)
    wins = W.with_window(f, I.RIG).select("rec", "win_idx").distinct()
    return W.sub_window_samples(wins, f, ("ax",), 4, I.RIG)


@query("neighbour_windows", "rec:bigint win_idx:int has_m2:boolean has_p1:boolean", "vx_m2 vx_m1 vx_p0 vx_p1 vx_p2",
       f"""{Q.WINDOWS} SELECT rec, win_idx, lag(vx, 2) OVER w IS NOT NULL AS has_m2,
       lead(vx) OVER w IS NOT NULL AS has_p1, coalesce(lag(vx, 2) OVER w, 0) AS vx_m2,
       coalesce(lag(vx) OVER w, 0) AS vx_m1, vx AS vx_p0, coalesce(lead(vx) OVER w, 0) AS vx_p1,
       coalesce(lead(vx, 2) OVER w, 0) AS vx_p2 FROM wm WINDOW w AS (PARTITION BY rec ORDER BY win_idx)""")
def neighbour_windows(spark, d):
    return W.neighbour_windows(I.truth(spark, d), ("vx",))


@query("rest_flag", KEYS, "flag", f"""{Q.REST}
SELECT sc.rec, win_idx, CASE WHEN win_idx = anchor_win THEN 1.0 ELSE 0.0 END AS flag
FROM sc JOIN an ON sc.rec = an.rec""")
def rest_flag(spark, d):
    f = sensor_view(spark, d)
    return W.window_means(W.rest_flag(f, W.rest_anchor(f, I.RIG), I.RIG), {"flag": "rest_flag"},
                          I.RIG)


@query("segments", "rec:bigint run_start:int step:int win_idx:int", "", f"""{Q.WINDOWS},
nn AS (SELECT rec, count(*) AS n FROM wm GROUP BY rec)
SELECT wm.rec, win_idx AS run_start, k AS step, win_idx + k AS win_idx
FROM wm JOIN nn ON wm.rec = nn.rec, (SELECT unnest(range(4)) AS k) WHERE win_idx + 4 <= n""")
def segments(spark, d):
    return W.window_runs(I.truth(spark, d), 4)


@query("window_gaps", KEYS, "", f"""{Q.WINDOWS},
k AS (SELECT rec, win_idx FROM wm WHERE (rec + win_idx) % 4 <> 0)
SELECT rec, win_idx FROM (SELECT *, win_idx - lag(win_idx) OVER (PARTITION BY rec ORDER BY win_idx) AS s FROM k)
WHERE s > 1""")
def window_gaps(spark, d):
    holes = I.truth(spark, d).where((F.col("rec") + F.col("win_idx")) % 4 != 0)
    return W.window_gaps(holes)


_K = 5
_CHUNKS = f"""nw AS (SELECT rec, CAST(count(*) AS INTEGER) AS n FROM wm GROUP BY rec),
ck AS MATERIALIZED (SELECT DISTINCT rec, least({_K}, n) AS len, least(s, greatest(n - {_K}, 0)) AS start FROM
(SELECT rec, n, unnest(range(0, greatest(n - {_K}, 0) + 2, 2)) AS s FROM nw)),
cw AS MATERIALIZED (SELECT rec, start, len, off, start + off AS win_idx FROM
(SELECT *, unnest(range(len)) AS off FROM ck))"""


@query("chunks", "rec:bigint start:int len:int", "", f"{Q.WINDOWS}, {_CHUNKS} SELECT rec, start, len FROM ck")
def chunks(spark, d):
    return C.chunks(I.truth(spark, d), _K)


def _scored(spark, d):
    t = I.means(spark, d)
    return C.chunk_windows(C.chunks(t, _K)).join(t, ["rec", "win_idx"]).withColumns(
        {c: F.col(c) + F.sin(F.col("start") + i) for i, c in enumerate(V.VEL)})


_SCORED = f"""{Q.WINDOWS}, {_CHUNKS}, cs AS MATERIALIZED (SELECT cw.*, abs(off - (len - 1) / 2.0) AS dist,
vx + sin(start) AS vx, vy + sin(start + 1) AS vy, vz + sin(start + 2) AS vz
FROM cw JOIN wm ON cw.rec = wm.rec AND cw.win_idx = wm.win_idx)"""


@query("stitch_center", KEYS, "vx vy vz", f"""{_SCORED}
SELECT rec, win_idx, vx, vy, vz FROM (SELECT *, row_number() OVER (PARTITION BY rec, win_idx
ORDER BY dist, start) AS k FROM cs) WHERE k = 1""")
def stitch_center(spark, d):
    return C.stitch_center(_scored(spark, d))


@query("stitch_mean", KEYS, "vx vy vz", f"""{_SCORED}
SELECT rec, win_idx, sum(w*vx)/sum(w) AS vx, sum(w*vy)/sum(w) AS vy, sum(w*vz)/sum(w) AS vz
FROM (SELECT *, 1 - dist / (len / 2.0 + 1) AS w FROM cs) GROUP BY 1, 2""")
def stitch_mean(spark, d):
    return C.stitch_mean(_scored(spark, d))


@query("score_chunks", KEYS, "vx vy vz", f"""{Q.WINDOWS}, {_CHUNKS},
cm AS (SELECT cw.rec, start, avg(ax) AS m FROM cw JOIN wm USING (rec, win_idx) GROUP BY 1, 2),
cs AS (SELECT cw.*, abs(off - (len - 1) / 2.0) AS dist, ax - m AS vx, ay + m AS vy, az * off AS vz
FROM cw JOIN wm USING (rec, win_idx) JOIN cm USING (rec, start))
SELECT rec, win_idx, vx, vy, vz FROM (SELECT *, row_number() OVER (PARTITION BY rec, win_idx
ORDER BY dist, start) AS k FROM cs) WHERE k = 1""")
def score_chunks(spark, d):
    """A stand-in model: the chunk mean of valid windows and the place in the chunk."""
    def model(x, lengths):
        k = np.arange(x.shape[1])
        valid = (k[None, :] < lengths[:, None]).astype(float)
        m = (x[:, :, 0] * valid).sum(1) / lengths
        return np.stack([x[:, :, 0] - m[:, None], x[:, :, 1] + m[:, None], x[:, :, 2] * k], axis=2)
    return C.score_chunks(I.means(spark, d), ["ax", "ay", "az"], model, _K)


def _chunked(spark, d):
    t = I.means(spark, d)
    return C.chunk_windows(C.chunks(t, _K)).join(t, ["rec", "win_idx"])


_DIFF = {n: i for n, i in (("e_x", 0), ("e_y", 1), ("e_z", 2))}
_STABLE = C.block_corrections(3)
_S_ROWS = ", ".join(f"({n}, {i}, {j}, CAST({s!r} AS DOUBLE))" for n, i, j, s in _STABLE)


@query("block_difference", "rec:bigint start:int win_idx:int", "vx vy", f"""{Q.WINDOWS}, {_CHUNKS},
tb AS (SELECT * FROM (VALUES {_S_ROWS}) AS t(n, i, j, s)),
cc AS (SELECT cw.*, off // 3 AS b, off % 3 AS p, least(3, len - (off // 3) * 3) AS n, ax, ay, vx, vy
FROM cw JOIN wm USING (rec, win_idx)),
fx AS (SELECT cc.rec, cc.start, b, i AS p, sum(s * ax) AS fx, sum(s * ay) AS fy
FROM cc JOIN tb ON cc.n = tb.n AND cc.p = tb.j GROUP BY 1, 2, 3, 4)
SELECT rec, start, win_idx, vx + fx AS vx, vy + fy AS vy FROM cc JOIN fx USING (rec, start, b, p)""")
def block_difference(spark, d):
    c = _chunked(spark, d).withColumns({n: F.col(a) for n, a in zip(_DIFF, V.ACC)})
    return C.block_difference(c, size=3, keys=("rec", "start"))


_STEP = "(p.v{a} + c.a{a} / 10)"


@query("gated_recursion", "rec:bigint start:int win_idx:int", "vx vy vz", Q.recursive(f"""{Q.WINDOWS}, {_CHUNKS},
cc AS MATERIALIZED (SELECT cw.*, wm.ax, wm.ay, wm.az, wm.vx, wm.vy, wm.vz, 1 / (1 + exp(-wm.wz * 10)) AS g
FROM cw JOIN wm USING (rec, win_idx)),
p AS (SELECT rec, start, off, win_idx, vx, vy, vz FROM cc WHERE off = 0 UNION ALL
SELECT c.rec, c.start, c.off, c.win_idx,
       (-p.vy + c.ax / 10) + g * (c.vx - (-p.vy + c.ax / 10)), (p.vx + c.ay / 10) + g * (c.vy - (p.vx + c.ay / 10)),
       (p.vz + c.az / 10) + g * (c.vz - (p.vz + c.az / 10))
FROM p JOIN cc c ON c.rec = p.rec AND c.start = p.start AND c.off = p.off + 1)
SELECT rec, start, win_idx, vx, vy, vz FROM p"""))
def gated_recursion(spark, d):
    """Turn of a quarter about z per window, force / 10 as the change."""
    c = _chunked(spark, d).withColumn("gain", V.logistic(F.col("wz") * 10)).withColumns({
        f"c_{a}": F.col(f"a{a}") / 10 for a in "xyz"})
    quarter = V.mat(((0, -1, 0), (1, 0, 0), (0, 0, 1)))
    c = c.withColumns(V.as_columns(quarter, C.INCREMENT))
    return C.gated_recursion(c, keys=("rec", "start"))


_IW = ((0.5, -0.8, 0.3), (-0.2, 0.6, 0.1), (0.4, 1.1, -0.7))
_IB = (0.1, -0.3, 0.2)
_PROP = ("(-p.vy + c.ax / 10)", "(p.vx + c.ay / 10)", "(p.vz + c.az / 10)")
_MISS = [f"(c.v{a} - {p})" for a, p in zip("xyz", _PROP)]
_BOTH = " + ".join(f"{m} * {m}" for m in _MISS)
_FOLD = ", ".join(f"{p} + {m} / (1 + exp(-(c.l{a} + CAST({w[1]} AS DOUBLE) * ln(1 + sqrt({_BOTH})))))"
                  for a, p, m, w in zip("xyz", _PROP, _MISS, _IW))
_LOGITS = ", ".join(f"w{a} * 10 + m * CAST({w[0]} AS DOUBLE) + f * CAST({w[2]} AS DOUBLE) + CAST({b} AS DOUBLE) + 6 * (1 - m) AS l{a}"
                    for a, w, b in zip("xyz", _IW, _IB))


@query("gated_recursion_innovation", "rec:bigint start:int win_idx:int", "vx vy vz", Q.recursive(f"""{Q.WINDOWS}, {_CHUNKS},
cb AS (SELECT cw.*, wm.ax, wm.ay, wm.az, wm.vx, wm.vy, wm.vz, wm.wx, wm.wy, wm.wz, CAST(win_idx % 3 <> 0 AS DOUBLE) AS m, (win_idx % 5) / 10.0 AS f
FROM cw JOIN wm USING (rec, win_idx)), cc AS MATERIALIZED (SELECT *, {_LOGITS} FROM cb),
p AS (SELECT rec, start, off, win_idx, vx, vy, vz FROM cc WHERE off = 0 UNION ALL
SELECT c.rec, c.start, c.off, c.win_idx, {_FOLD} FROM p JOIN cc c ON c.rec = p.rec AND c.start = p.start AND c.off = p.off + 1)
SELECT rec, start, win_idx, vx, vy, vz FROM p"""))
def gated_recursion_innovation(spark, d):
    """The gain follows the innovation, the mask and the confidence of each window."""
    c = _chunked(spark, d).withColumns({f"c_{a}": F.col(f"a{a}") / 10 for a in "xyz"})
    c = c.withColumns(V.as_columns(V.mat(((0, -1, 0), (1, 0, 0), (0, 0, 1))), C.INCREMENT))
    made = C.gain_logits([F.col(f"w{a}") * 10 for a in "xyz"], (F.col("win_idx") % 3 != 0).cast("double"),
                         (F.col("win_idx") % 5) / 10.0, _IW, _IB, trust_direct=True)
    c = c.withColumns(dict(zip(("lx", "ly", "lz"), made)))
    return C.gated_recursion(c, keys=("rec", "start"), logits=("lx", "ly", "lz"), innovation=[w[1] for w in _IW])


@query("anchored_smoothing", "rec:bigint start:int win_idx:int", "residual", f"""{Q.WINDOWS}, {_CHUNKS}
SELECT rec, start, win_idx, 0.0 AS residual FROM cw""", digits=5)
def anchored_smoothing(spark, d):
    """The solution must make the normal equations vanish, whatever the data."""
    mu = 5.0
    c = _chunked(spark, d).withColumns({f"e_{a}": F.col(f"a{a}") / 10 for a in "xyz"})
    q = C.anchored_smoothing(c, mu=mu, keys=("rec", "chunk_id")).withColumnsRenamed(
        {f"v{a}": f"q{a}" for a in "xyz"})
    both = c.join(q, ["rec", "chunk_id", "win_idx"])
    from pyspark.sql import Window
    w = Window.partitionBy("rec", "chunk_id").orderBy("off")
    weight = 1 / (1 + V.norm(V.vec(*V.VEL)))
    parts = []
    for a in "xyz":
        q0, back, ahead = F.col(f"q{a}"), F.lag(f"q{a}").over(w), F.lead(f"q{a}").over(w)
        left = F.coalesce(q0 - back - F.col(f"e_{a}"), F.lit(0.0))
        right = F.coalesce(ahead - q0 - F.lead(f"e_{a}").over(w), F.lit(0.0))
        parts.append(F.abs(weight * (q0 - F.col(f"v{a}")) + mu * (left - right)))
    return both.withColumn("residual", F.greatest(*parts)).select("rec", "start", "win_idx",
                                                                  "residual")


@query("context_split", "rec:bigint start:int win_idx:int piece:int off:int len:int", "", f"""{Q.WINDOWS},
{_CHUNKS.replace(str(_K), '12')},
sg AS (SELECT *, {Q.uniform('7', 'rec', 'start')} AS u FROM cw),
ct AS (SELECT *, CASE WHEN len >= 10 AND start % 3 <> 1 THEN CAST(least(5 + floor(u * (len - 9)), len - 5) AS INTEGER) END AS cut FROM sg)
SELECT rec, start, win_idx, (cut IS NOT NULL AND off >= cut)::INT AS piece,
       CASE WHEN off >= cut THEN off - cut ELSE off END AS off,
       CASE WHEN cut IS NULL THEN len WHEN off >= cut THEN len - cut ELSE cut END AS len FROM ct""".replace(
           "range(0, greatest(n - 12, 0) + 2, 2)", "range(0, greatest(n - 12, 0) + 6, 6)"))
def context_split(spark, d):
    from sensorframe.operators.sampling import hash_uniform
    seg = C.chunk_windows(C.chunks(I.truth(spark, d), 12))
    return C.context_split(seg, F.col("start") % 3 != 1, hash_uniform(7, "rec", "start"),
                           keys=("rec", "start"))


@query("linear_readout", KEYS, "vx vy vz", f"""{Q.WINDOWS} SELECT rec, win_idx,
vx + (1 / (1 + exp(-wz))) * (0.5 + 0.1*ax + 0.2*ay + 0.3*az) AS vx,
vy + (1 / (1 + exp(-wz))) * (-0.5 + 0.2*ax - 0.1*ay + 0.05*az) AS vy,
vz + (1 / (1 + exp(-wz))) * (0.1 + 0.0*ax + 0.3*ay - 0.2*az) AS vz FROM wm""")
def linear_readout(spark, d):
    return C.linear_readout(I.means(spark, d), V.ACC, (
        (0.1, 0.2, 0.3), (0.2, -0.1, 0.05), (0.0, 0.3, -0.2)), (0.5, -0.5, 0.1), F.col("wz"))


# ------------------------------------------------------------------------- scans
@query("reanchored_cumsum", "rec:bigint frame:int", "c_ax c_wz", f"""{Q.REST},
c AS (SELECT sv.rec, frame, coalesce(sum(ax) OVER w, 0) AS a, coalesce(sum(wz) OVER w, 0) AS b,
coalesce(sum(ax) FILTER (frame < anchor_at) OVER r, 0) AS za, coalesce(sum(wz) FILTER (frame < anchor_at) OVER r, 0) AS zb
FROM sv JOIN an ON an.rec = sv.rec WINDOW w AS (PARTITION BY sv.rec ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
r AS (PARTITION BY sv.rec))
SELECT rec, frame, (a - za) * 0.02 AS c_ax, (b - zb) * 0.02 AS c_wz FROM c""")
def reanchored_cumsum(spark, d):
    f = sensor_view(spark, d).select("rec", "frame", *V.ACC, *V.GYR)
    return N.integrate_from_anchor(f, {"c_ax": F.col("ax"), "c_wz": F.col("wz")},
                                   W.rest_anchor(f, I.RIG), I.RIG, block=128)


@query("event_running_sum", "rec:bigint frame:int", "running", f"""WITH {Q.EVENTS}
SELECT rec, frame, sum(value) OVER (PARTITION BY rec ORDER BY frame) AS running FROM ev""")
def event_running_sum(spark, d):
    return prefix_sums(event_view(spark, d), {"running": F.col("value")}, block=32, fan_out=4)


_REL = Q.quat_mul(("-z.x", "-z.y", "-z.z", "z.w"), ("q.x", "q.y", "q.z", "q.w"))
_ATT = f"""{Q.rotation_prefix('sv')},
rl AS MATERIALIZED (SELECT q.rec, q.frame, {_REL[0]} AS x, {_REL[1]} AS y, {_REL[2]} AS z, {_REL[3]} AS w
FROM rq q JOIN an ON an.rec = q.rec JOIN rq z ON z.rec = an.rec AND z.frame = an.anchor_at)"""
_R = Q.quat_matrix("x", "y", "z", "w")
_ROT = ", ".join(f"avg({e}) AS {n}" for e, n in zip(_R, N.ROTATION))


@query("attitude_scan", KEYS, " ".join(N.ROTATION), Q.recursive(f"""{Q.REST}, {_ATT}
SELECT rl.rec, {_WIN} AS win_idx, {_ROT} FROM rl JOIN sv USING (rec, frame) GROUP BY 1, 2 HAVING count(*) = 50"""), digits=5)
def attitude_scan(spark, d):
    """Attitude from a three-level product; a short block makes every level work."""
    f = I.stored_frames(spark, d)
    return _window_avg(N.attitude(f, W.rest_anchor(f, I.RIG), I.RIG, block=64, fan_out=3), N.ROTATION)


_CELLS = f"""cl AS MATERIALIZED (SELECT rec, frame, CAST(floor(frame / 5) AS INTEGER) AS cell, wx * 0.02 AS tx, wy * 0.02 AS ty, wz * 0.02 AS tz FROM sv),
ins AS MATERIALIZED (SELECT rec, frame, cell, coalesce(sum(tx) OVER w, 0) AS tx, coalesce(sum(ty) OVER w, 0) AS ty, coalesce(sum(tz) OVER w, 0) AS tz
FROM cl WINDOW w AS (PARTITION BY rec, cell ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
inq AS MATERIALIZED (SELECT rec, frame, cell, {', '.join(f'{e} AS {n}' for e, n in zip(Q.rotvec_quat(('tx', 'ty', 'tz')), 'xyzw'))} FROM ins),
tot AS MATERIALIZED (SELECT rec, cell AS frame, sum(tx) * 50 AS wx, sum(ty) * 50 AS wy, sum(tz) * 50 AS wz FROM cl GROUP BY 1, 2),
{Q.rotation_prefix('tot')}"""
_CELLQ = Q.quat_mul(("p.x", "p.y", "p.z", "p.w"), ("i.x", "i.y", "i.z", "i.w"))


@query("attitude_small_angle", KEYS, " ".join(N.ROTATION), Q.recursive(f"""{Q.REST}, {_CELLS},
pt AS MATERIALIZED (SELECT i.rec, i.frame, {', '.join(f'{e} AS {n}' for e, n in zip(_CELLQ, 'xyzw'))}
FROM inq i JOIN rq p ON p.rec = i.rec AND p.frame = i.cell),
rl AS (SELECT q.rec, q.frame, {', '.join(f'{e} AS {n}' for e, n in zip(_REL, 'xyzw'))}
FROM pt q JOIN an ON an.rec = q.rec JOIN pt z ON z.rec = an.rec AND z.frame = an.anchor_at)
SELECT rec, {_WIN} AS win_idx, {_ROT} FROM rl GROUP BY 1, 2 HAVING count(*) = 50"""), digits=5)
def attitude_small_angle(spark, d):
    """Turns are summed inside five frames and only the sums are composed."""
    f = I.stored_frames(spark, d)
    return _window_avg(N.attitude_small_angle(f, W.rest_anchor(f, I.RIG), I.RIG), N.ROTATION)


_UP = Q.matvec(Q.transpose(_R), ("u0", "u1", "u2"))
_UP0 = """up AS (SELECT rec, fx / n AS u0, fy / n AS u1, fz / n AS u2, anchor_at
FROM (SELECT *, sqrt(fx*fx + fy*fy + fz*fz) AS n FROM an))"""


@query("carried_up", KEYS, "ux uy uz", Q.recursive(f"""{Q.REST}, {_ATT}, {_UP0}
SELECT rl.rec, CAST(floor(rl.frame / 50) AS INTEGER) AS win_idx, avg({_UP[0]}) AS ux, avg({_UP[1]}) AS uy, avg({_UP[2]}) AS uz
FROM rl JOIN up ON up.rec = rl.rec JOIN sv ON sv.rec = rl.rec AND sv.frame = rl.frame
GROUP BY 1, 2 HAVING count(*) = 50"""), digits=5)
def carried_up(spark, d):
    f = I.stored_frames(spark, d)
    a = cut_lineage(W.rest_anchor(f, I.RIG))
    return _window_avg(N.carried_up(N.attitude(f, a, I.RIG), a), ("ux", "uy", "uz"))


_FORCE = Q.matvec(_R, ("sv.ax", "sv.ay", "sv.az"))
_BACK = Q.matvec(Q.transpose(_R), ("ix", "iy", "iz"))
_DR = f"""{_ATT}, {_UP0},
fa AS MATERIALIZED (SELECT rl.rec, rl.frame, x, y, z, w, {_FORCE[0]} - 9.81 * u0 AS gx, {_FORCE[1]} - 9.81 * u1 AS gy,
       {_FORCE[2]} - 9.81 * u2 AS gz, anchor_at
FROM rl JOIN sv ON sv.rec = rl.rec AND sv.frame = rl.frame JOIN up ON up.rec = rl.rec),
cu AS MATERIALIZED (SELECT *, coalesce(sum(gx) OVER w0, 0) AS cx, coalesce(sum(gy) OVER w0, 0) AS cy,
       coalesce(sum(gz) OVER w0, 0) AS cz FROM fa
       WINDOW w0 AS (PARTITION BY rec ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
iv AS MATERIALIZED (SELECT c.rec, c.frame, c.x, c.y, c.z, c.w, (c.cx - a.cx) * 0.02 AS ix, (c.cy - a.cy) * 0.02 AS iy,
       (c.cz - a.cz) * 0.02 AS iz, (c.frame - c.anchor_at) / 50 / 10 AS since
FROM cu c JOIN cu a ON a.rec = c.rec AND a.frame = c.anchor_at),
rk AS MATERIALIZED (SELECT rec, frame, x, y, z, w, ix, iy, iz, since, 8 * tanh({_BACK[0]} / 8) AS dx,
       8 * tanh({_BACK[1]} / 8) AS dy, 8 * tanh({_BACK[2]} / 8) AS dz FROM iv)"""


@query("dead_reckon", KEYS, "d_x d_y d_z i_x since", Q.recursive(f"""{Q.REST}, {_DR}
SELECT rec, {_WIN} AS win_idx, avg(dx) AS d_x, avg(dy) AS d_y, avg(dz) AS d_z, avg(ix) AS i_x, avg(since) AS since
FROM rk GROUP BY 1, 2 HAVING count(*) = 50"""), digits=4)
def dead_reckon(spark, d):
    f = I.stored_frames(spark, d)
    return _window_avg(N.dead_reckon(f, W.rest_anchor(f, I.RIG), I.RIG),
                       ("d_x", "d_y", "d_z", "i_x", "since"))


def _given_sql(force, more=""):
    """Dead reckoning on the attitude th about the third axis, with the calibrated force given as SQL."""
    ax, ay, az = force
    sums = ", ".join(f"coalesce(sum(p{c}) OVER w, 0) AS c{c}" for c in "xyz")
    return f"""un AS (SELECT rec, anchor_at, fx / n AS u0, fy / n AS u1, fz / n AS u2 FROM (SELECT *, sqrt(fx*fx + fy*fy + fz*fz) AS n FROM an)),
ga AS (SELECT sv.rec, frame, cos(0.3 * wz + 0.01 * frame) AS co, sin(0.3 * wz + 0.01 * frame) AS si, {ax} AS ax, {ay} AS ay, {az} AS az{more} FROM sv),
gl AS (SELECT ga.*, anchor_at, u0, u1, u2, co * ax - si * ay - 9.81 * u0 AS px, si * ax + co * ay - 9.81 * u1 AS py, az - 9.81 * u2 AS pz FROM ga JOIN un ON un.rec = ga.rec),
gc AS MATERIALIZED (SELECT *, {sums} FROM gl WINDOW w AS (PARTITION BY rec ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
gi AS (SELECT gc.*, (gc.cx - z.cx) / 50 AS ix, (gc.cy - z.cy) / 50 AS iy, (gc.cz - z.cz) / 50 AS iz FROM gc JOIN gc z ON z.rec = gc.rec AND z.frame = gc.anchor_at),
gd AS (SELECT *, 8 * tanh((co * ix + si * iy) / 8) AS dx, 8 * tanh((co * iy - si * ix) / 8) AS dy, 8 * tanh(iz / 8) AS dz,
       co * u0 + si * u1 AS ux, co * u1 - si * u0 AS uy, u2 AS uz, (frame - anchor_at) / 500 AS since FROM gi)"""


def _with_attitude(f):
    th = 0.3 * F.col("wz") + 0.01 * F.col("frame")
    co, si, zero = F.cos(th), F.sin(th), F.lit(0.0)
    return f.withColumns(dict(zip(N.ROTATION, (co, -si, zero, si, co, zero, zero, zero, F.lit(1.0)))))


@query("dead_reckon_given_attitude", KEYS, "d_x d_y d_z i_x i_z ux uy since", f"""{Q.REST}, {_given_sql(("ax", "ay", "az"))}
SELECT rec, {_WIN} AS win_idx, avg(dx) AS d_x, avg(dy) AS d_y, avg(dz) AS d_z, avg(ix) AS i_x, avg(iz) AS i_z, avg(ux) AS ux, avg(uy) AS uy,
avg(since) AS since FROM gd GROUP BY 1, 2 HAVING count(*) = 50""", digits=4)
def dead_reckon_given_attitude(spark, d):
    """Velocity integrated on an attitude from outside: here a turn about the third axis."""
    f = I.stored_frames(spark, d)
    return _window_avg(N.dead_reckon_given(_with_attitude(f), W.rest_anchor(f, I.RIG), I.RIG),
                       ("d_x", "d_y", "d_z", "i_x", "i_z", "ux", "uy", "since"))


_GAIN = {c: f"(1 + 0.01 * (rec % {n}))" for c, n in zip("xyz", (5, 3, 7))}
_BIAS = {c: f"(0.02 * (rec % {n}))" for c, n in zip("xyz", (3, 5, 2))}


@query("derived_channels", KEYS, "d_x d_z i_y ux r11 deviation since", f"""{Q.REST}, {_given_sql(
    [f"CASE WHEN rec % 4 = 0 THEN a{c} ELSE (a{c} - {_BIAS[c]}) / {_GAIN[c]} END" for c in "xyz"],
    f", CASE WHEN rec % 4 = 0 THEN 0 ELSE greatest({', '.join(f'abs({g} - 1)' for g in _GAIN.values())}) / 0.05 + sqrt("
    + " + ".join(f"{b} * {b}" for b in _BIAS.values()) + ") / 0.5 + 1 - abs(tanh((rec % 9 - 4) / 2.0)) END AS dev")}
SELECT rec, {_WIN} AS win_idx, avg(CASE WHEN abs(frame - anchor_at) <= 200 THEN dx ELSE 0 END) AS d_x,
avg(CASE WHEN abs(frame - anchor_at) <= 200 THEN dz ELSE 0 END) AS d_z, avg(iy) AS i_y, avg(ux) AS ux, avg(co) AS r11, avg(dev) AS deviation,
avg(since) AS since FROM gd GROUP BY 1, 2 HAVING count(*) = 50""", digits=4)
def derived_channels(spark, d):
    """Calibrated axes on a given attitude, with a horizon; every fourth recording has no calibration."""
    f = I.stored_frames(spark, d)
    calibration = f.select("rec").distinct().where("rec % 4 <> 0").select(
        "rec", *[F.expr(g).cast("double").alias(f"gain_{c}") for c, g in _GAIN.items()],
        *[F.expr(b).cast("double").alias(f"bias_{c}") for c, b in _BIAS.items()],
        (F.col("rec") % 9 - 4).cast("double").alias("logit"), (F.col("rec") % 2 == 0).alias("flip"))
    made = N.derived_channels(_with_attitude(f), I.RIG, calibration, W.rest_anchor(f, I.RIG), horizon=4.0)
    return _window_avg(made, ("d_x", "d_z", "i_y", "ux", "r11", "deviation", "since"))


_TURNQ = Q.quat_mul(("-e.x", "-e.y", "-e.z", "e.w"), ("p.x", "p.y", "p.z", "p.w"))
_T = Q.quat_matrix("tx", "ty", "tz", "tw")
_TV = Q.matvec(_T, ("pdx", "pdy", "pdz"))


@query("window_increments", KEYS, "c_x c_y c_z t00 t01 t12 mask", Q.recursive(f"""{Q.REST}, {_DR},
en AS MATERIALIZED (SELECT *, {_WIN} AS win_idx FROM rk WHERE (frame + 1) % 50 = 0),
tr AS MATERIALIZED (SELECT e.rec, e.win_idx, e.dx, e.dy, e.dz, e.since, p.dx AS pdx, p.dy AS pdy, p.dz AS pdz,
       {_TURNQ[0]} AS tx, {_TURNQ[1]} AS ty, {_TURNQ[2]} AS tz, {_TURNQ[3]} AS tw
FROM en e LEFT JOIN en p ON p.rec = e.rec AND p.win_idx = e.win_idx - 1)
SELECT rec, win_idx, CASE WHEN pdx IS NULL OR NOT abs(since)*10 < 8 THEN 0 ELSE dx - {_TV[0]} END AS c_x,
       CASE WHEN pdx IS NULL OR NOT abs(since)*10 < 8 THEN 0 ELSE dy - {_TV[1]} END AS c_y,
       CASE WHEN pdx IS NULL OR NOT abs(since)*10 < 8 THEN 0 ELSE dz - {_TV[2]} END AS c_z,
       CASE WHEN pdx IS NULL OR NOT abs(since)*10 < 8 THEN 1 ELSE {_T[0]} END AS t00,
       CASE WHEN pdx IS NULL OR NOT abs(since)*10 < 8 THEN 0 ELSE {_T[1]} END AS t01,
       CASE WHEN pdx IS NULL OR NOT abs(since)*10 < 8 THEN 0 ELSE {_T[5]} END AS t12,
       CASE WHEN abs(since)*10 < 8 THEN 1 ELSE 0 END AS mask FROM tr"""), digits=4)
def window_increments(spark, d):
    f = I.stored_frames(spark, d)
    dr = N.dead_reckon(f, W.rest_anchor(f, I.RIG), I.RIG).withColumn("deviation", F.lit(0.0))
    ends = C.window_ends(dr, I.RIG.window, [c for c in dr.columns if c not in ("rec", "frame")])
    return C.window_increments(ends, "end", horizon=8.0)


_INCR = Q.recursive(f"""{Q.REST}, {_DR},
en AS MATERIALIZED (SELECT *, {_WIN} AS win_idx, (rec % 5) * 0.25 AS deviation FROM rk WHERE (frame + 1) % 50 = 0),
tr AS MATERIALIZED (SELECT e.rec, e.win_idx, e.x, e.y, e.z, e.w, e.dx, e.dy, e.dz, e.ix - p.ix AS jx, e.iy - p.iy AS jy, e.iz - p.iz AS jz,
       e.since, e.deviation, p.dx AS pdx, p.dy AS pdy, p.dz AS pdz,
       {_TURNQ[0]} AS tx, {_TURNQ[1]} AS ty, {_TURNQ[2]} AS tz, {_TURNQ[3]} AS tw
FROM en e LEFT JOIN en p ON p.rec = e.rec AND p.win_idx = e.win_idx - 1)""")
_JUMP = [f"15 * tanh({c} / 15)" for c in Q.matvec(Q.quat_matrix("-x", "-y", "-z", "w"), ("jx", "jy", "jz"))]


def _ends(spark, d):
    f = I.stored_frames(spark, d)
    dr = N.dead_reckon(f, W.rest_anchor(f, I.RIG), I.RIG).withColumn("deviation", (F.col("rec") % 5) * 0.25)
    return C.window_ends(dr, I.RIG.window, [c for c in dr.columns if c not in ("rec", "frame")])


def _increment_sql(mode, change, turn, usable):
    live = f"pdx IS NOT NULL AND {usable}"
    return (f"SELECT '{mode}' AS mode, rec, win_idx, " + ", ".join(f"CASE WHEN {live} THEN {c} ELSE 0 END AS c_{a}" for a, c in zip("xyz", change))
            + ", " + ", ".join(f"CASE WHEN {live} AND {turn} THEN {_T[i]} ELSE {e} END AS {n}" for n, i, e in (("t00", 0, 1), ("t01", 1, 0), ("t12", 5, 0)))
            + f", CASE WHEN {usable} THEN 1 ELSE 0 END AS mask, deviation / 10 AS confidence FROM tr")


@query("increment_modes", "mode:string " + KEYS, "c_x c_y c_z t00 t01 t12 mask confidence", " UNION ALL ".join([
    _INCR + " " + _increment_sql("int", _JUMP, "TRUE", "deviation < 0.6"),
    _increment_sql("zero", ("0", "0", "0"), "TRUE", "deviation < 0.9 AND abs(since)*10 < 6"),
    _increment_sql("end without turn", [f"{v} - {m}" for v, m in zip(("dx", "dy", "dz"), _TV)], "FALSE", "TRUE")]), digits=4)
def increment_modes(spark, d):
    """Integrated and absent velocity changes, no turn, and both limits."""
    ends = cut_lineage(_ends(spark, d))
    made = {"int": C.window_increments(ends, "int", deviation_limit=0.6),
            "zero": C.window_increments(ends, "zero", deviation_limit=0.9, horizon=6.0),
            "end without turn": C.window_increments(ends, "end", "none")}
    return reduce(DataFrame.unionByName, [df.withColumn("mode", F.lit(m)) for m, df in made.items()])


# turned frames: the attitude is q conj(h), vectors in sensor axes are turned by h
_HEAD = f"2 * pi() * {Q.uniform('11:turn', 'rec')}"
_TURNED = Q.quat_mul(("x", "y", "z", "w"), ("0", "0", "-sn", "cs"))
_MOUNT = ((1.0, 0.0, 0.0), (0.0, 0.8, -0.6), (0.0, 0.6, 0.8))


def _about_z(v):
    return (f"(co * {v[0]} - si * {v[1]})", f"(si * {v[0]} + co * {v[1]})", f"({v[2]})")


_ENDV = _about_z(("dx", "dy", "dz"))
_LABEL = [f"avg({c})" for c in Q.matvec([str(x) for r in _MOUNT for x in r], _about_z(
    Q.matvec([str(_MOUNT[j][i]) for i in range(3) for j in range(3)], ("vx", "vy", "vz"))))]


@query("turned_increments", KEYS, "c_x c_y c_z t00 t01 t12 l_x l_y l_z mask", Q.recursive(f"""{Q.REST}, {_DR},
hd AS MATERIALIZED (SELECT rec, cos(a) AS co, sin(a) AS si, cos(a / 2) AS cs, sin(a / 2) AS sn FROM (SELECT rec, {_HEAD} AS a FROM (SELECT DISTINCT rec FROM sv))),
lw AS MATERIALIZED (SELECT sv.rec, {_WIN} AS win_idx, {', '.join(f'{e} AS l_{a}' for e, a in zip(_LABEL, 'xyz'))} FROM sv JOIN hd USING (rec) GROUP BY 1, 2),
en AS MATERIALIZED (SELECT rk.rec, {_WIN} AS win_idx, since, {', '.join(f'{e} AS {n}' for e, n in zip(_TURNED, 'xyzw'))},
       {', '.join(f'{e} AS d{n}' for e, n in zip(_ENDV, 'xyz'))} FROM rk JOIN hd USING (rec) WHERE (frame + 1) % 50 = 0),
tr AS MATERIALIZED (SELECT e.rec, e.win_idx, e.dx, e.dy, e.dz, e.since, p.dx AS pdx, p.dy AS pdy, p.dz AS pdz,
       {_TURNQ[0]} AS tx, {_TURNQ[1]} AS ty, {_TURNQ[2]} AS tz, {_TURNQ[3]} AS tw
FROM en e LEFT JOIN en p ON p.rec = e.rec AND p.win_idx = e.win_idx - 1),
ti AS ({_increment_sql("end", [f"{v} - {m}" for v, m in zip(("dx", "dy", "dz"), _TV)], "TRUE", "abs(since)*10 < 8").replace("deviation / 10", "0")})
SELECT ti.*, l_x, l_y, l_z FROM ti JOIN lw USING (rec, win_idx)"""), digits=4)
def turned_increments(spark, d):
    """Increments and labels turned as typed groups; the SQL turns the frames and then takes the increments."""
    f = I.stored_frames(spark, d)
    labels = W.window_means(f, {f"l_{a}": f"v{a}" for a in "xyz"}, I.RIG)
    made = C.window_increments(_ends(spark, d), "end", horizon=8.0).join(labels, ["rec", "win_idx"])
    angle = 2 * np.pi * hash_uniform("11:turn", "rec")
    mount = tuple(F.lit(x) for row in _MOUNT for x in row)
    return turn_channels(made, heading_turn(angle), [
        ("polar", ("c_x", "c_y", "c_z")), ("increment", C.INCREMENT), ("label", ("l_x", "l_y", "l_z")),
        ("fixed", ("mask", "confidence"))], mount)


@query("gate_scalars", KEYS, "since rest_score log_speed", Q.recursive(f"""{Q.REST}, {_DR}
SELECT rk.rec, {_WIN} AS win_idx, avg(since) AS since, avg(score) AS rest_score,
       ln(1 + sqrt(avg(dx)*avg(dx) + avg(dy)*avg(dy) + avg(dz)*avg(dz))) AS log_speed
FROM rk JOIN an ON an.rec = rk.rec GROUP BY 1, 2 HAVING count(*) = 50"""), digits=4)
def gate_scalars(spark, d):
    f = I.stored_frames(spark, d)
    a = cut_lineage(W.rest_anchor(f, I.RIG))
    dr = N.dead_reckon(f, a, I.RIG).join(a.select("rec", "score"), "rec")
    return C.gate_scalars(dr, I.RIG.window)


_CAND = f"""cf AS MATERIALIZED (SELECT rec, frame, cand, CASE cand WHEN 'same' THEN wx WHEN 'negated' THEN -wx ELSE -wy END AS wx,
       CASE cand WHEN 'same' THEN wy WHEN 'negated' THEN -wy ELSE -wx END AS wy,
       CASE cand WHEN 'same' THEN wz ELSE -wz END AS wz
FROM sv CROSS JOIN (VALUES ('same'), ('negated'), ('exchanged')) AS k(cand)),
{Q.rotation_prefix('cf', keys='rec, cand')},
rl AS MATERIALIZED (SELECT q.rec, q.cand, q.frame, {_REL[0]} AS x, {_REL[1]} AS y, {_REL[2]} AS z, {_REL[3]} AS w
FROM rq q JOIN an ON an.rec = q.rec JOIN rq z ON z.rec = an.rec AND z.cand = q.cand AND z.frame = an.anchor_at)"""


@query("candidate_maps", "rec:bigint candidate:string n:bigint", "err", Q.recursive(f"""{Q.REST}, {_CAND}, {_UP0},
sm AS (SELECT rec, frame, {", ".join(f"sum({c}) OVER (PARTITION BY rec ORDER BY frame ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) / 25 AS {c}" for c in ("ax", "ay", "az", "wx", "wy", "wz"))} FROM sv),
cm AS (SELECT sm.*, sqrt(ax*ax + ay*ay + az*az) AS n FROM sm JOIN an ON sm.rec = an.rec
WHERE abs(sqrt(ax*ax + ay*ay + az*az) - 9.81) < 0.5 AND sqrt(wx*wx + wy*wy + wz*wz) < 0.5
AND abs(sm.frame - anchor_at) / 50 > 1.0 AND abs(sm.frame - anchor_at) / 50 < 20.0)
SELECT rl.rec, rl.cand AS candidate, count(*) AS n, avg(degrees(acos(least(1, greatest(-1,
       (cm.ax * {_UP[0]} + cm.ay * {_UP[1]} + cm.az * {_UP[2]}) / n))))) AS err
FROM rl JOIN up ON up.rec = rl.rec JOIN cm ON cm.rec = rl.rec AND cm.frame = rl.frame GROUP BY 1, 2"""), digits=4)
def candidate_maps(spark, d):
    from sensorframe.operators.summary import calm_after_anchor
    f = I.stored_frames(spark, d)
    a = cut_lineage(W.rest_anchor(f, I.RIG))
    up = N.carried_up_by_map(f, a, I.RIG, at=calm_after_anchor(f, a, I.RIG))
    err = V.angle_deg(V.vec("ux", "uy", "uz"), V.vec("s_x", "s_y", "s_z"))
    return up.groupBy("rec", "candidate").agg(F.count(F.lit(1)).alias("n"), F.avg(err).alias("err"))


_PM = Q.quat_matrix("qx", "qy", "qz", "qw")
_PQ = """pq AS MATERIALIZED (SELECT sv.rec, frame, ax, ay, az, vx, vy, vz, wx / n AS qx, wy / n AS qy, wz / n AS qz, 1 / n AS qw
FROM (SELECT *, sqrt(wx*wx + wy*wy + wz*wz + 1) AS n FROM sv) sv)"""
_PF = Q.matvec(_PM, ("ax", "ay", "az"))
_PB = Q.matvec(Q.transpose(_PM), ("ix", "iy", "iz"))


@query("truth_velocity", "rec:bigint win_idx:int away:int", "b_x b_y b_z err", f"""{Q.REST}, {_PQ},
fa AS (SELECT *, {_PF[0]} AS gx, {_PF[1]} AS gy, {_PF[2]} - 9.81 AS gz FROM pq),
cu AS MATERIALIZED (SELECT *, coalesce(sum(gx) OVER w, 0) AS cx, coalesce(sum(gy) OVER w, 0) AS cy, coalesce(sum(gz) OVER w, 0) AS cz
FROM fa WINDOW w AS (PARTITION BY rec ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
iv AS (SELECT c.*, (c.cx - a.cx) * 0.02 AS ix, (c.cy - a.cy) * 0.02 AS iy, (c.cz - a.cz) * 0.02 AS iz, anchor_win
FROM cu c JOIN an ON an.rec = c.rec JOIN cu a ON a.rec = an.rec AND a.frame = anchor_at),
wv AS (SELECT rec, {_WIN} AS win_idx, any_value(anchor_win) AS k0, avg({_PB[0]}) AS b_x, avg({_PB[1]}) AS b_y, avg({_PB[2]}) AS b_z,
       avg(vx) AS vx, avg(vy) AS vy, avg(vz) AS vz FROM iv GROUP BY 1, 2 HAVING count(*) = 50)
SELECT rec, win_idx, abs(win_idx - k0) AS away, b_x, b_y, b_z,
       sqrt((b_x-vx)*(b_x-vx) + (b_y-vy)*(b_y-vy) + (b_z-vz)*(b_z-vz)) AS err FROM wv""")
def truth_velocity(spark, d):
    f = cut_lineage(I.posed(spark, d))
    return N.truth_attitude_velocity(f, W.rest_anchor(f, I.RIG), I.RIG)


def _filter_sql(gain):
    """CTEs for the up recursion with a gain expression over the next frame's force."""
    th = [f"(f.w{a} * 0.02)" for a in "xyz"]
    n = Q.norm(*th)
    ax = [f"(CASE WHEN {n} > 1e-9 THEN {t} / {n} ELSE 0 END)" for t in th]
    u = ("f.ux", "f.uy", "f.uz")
    cr, dt = Q.cross(ax, u), Q.dot(ax, u)
    turned = [f"({u[i]} * cos({n}) - (-1) * {cr[i]} * (-sin({n})) + {ax[i]} * {dt} * (1 - cos({n})))"
              for i in range(3)]
    return f"""nx AS MATERIALIZED (SELECT rec, frame, ax, ay, az, sqrt(ax*ax + ay*ay + az*az) AS n, {gain} AS g,
       lag(wx) OVER w AS wx, lag(wy) OVER w AS wy, lag(wz) OVER w AS wz FROM sv
       WINDOW w AS (PARTITION BY rec ORDER BY frame)),
uf AS (SELECT rec, frame, ax / n AS ux, ay / n AS uy, az / n AS uz FROM nx WHERE frame = 0
UNION ALL SELECT rec, frame, mx / m, my / m, mz / m FROM (
  SELECT *, sqrt(mx*mx + my*my + mz*mz) AS m FROM (
    SELECT rec, frame, (1 - g) * tx + g * ax / n AS mx, (1 - g) * ty + g * ay / n AS my, (1 - g) * tz + g * az / n AS mz FROM (
      SELECT f.*, {turned[0]} AS tx, {turned[1]} AS ty, {turned[2]} AS tz FROM (
        SELECT nx.*, uf.ux, uf.uy, uf.uz FROM uf JOIN nx ON nx.rec = uf.rec AND nx.frame = uf.frame + 1) f))))"""


@query("up_filter", KEYS, "ux uy uz", Q.recursive(f"{Q.BASE}, {_filter_sql('CAST(0.05 AS DOUBLE)')} " + _avg_sql(("ux", "uy", "uz"), "uf")), digits=5)
def up_filter(spark, d):
    f = sensor_view(spark, d)
    return _window_avg(N.up_filter(f, 0.05, I.RIG), ("ux", "uy", "uz"))


@query("up_filter_blocked", KEYS, "ux uy uz", Q.recursive(f"{Q.BASE}, {_filter_sql('CAST(0.05 AS DOUBLE)')} " + _avg_sql(("ux", "uy", "uz"), "uf")), digits=5)
def up_filter_blocked(spark, d):
    """Short blocks, so that most starts have to be solved."""
    f = sensor_view(spark, d)
    return _window_avg(N.up_filter(f, 0.05, I.RIG, block=60), ("ux", "uy", "uz"))


@query("adaptive_up", KEYS, "ux uy uz", Q.recursive(
    f"{Q.BASE}, {_filter_sql('0.005 * exp(-((sqrt(ax*ax + ay*ay + az*az) - 9.81) * (sqrt(ax*ax + ay*ay + az*az) - 9.81)))')} "
    + _avg_sql(("ux", "uy", "uz"), "uf")), digits=5)
def adaptive_up(spark, d):
    f = sensor_view(spark, d)
    return _window_avg(N.up_filter(f, N.adaptive_gain(), I.RIG), ("ux", "uy", "uz"))


@query("adaptive_up_blocked", KEYS, "ux uy uz", Q.recursive(
    f"{Q.BASE}, {_filter_sql('0.005 * exp(-((sqrt(ax*ax + ay*ay + az*az) - 9.81) * (sqrt(ax*ax + ay*ay + az*az) - 9.81)))')} "
    + _avg_sql(("ux", "uy", "uz"), "uf")), digits=5)
def adaptive_up_blocked(spark, d):
    """A filter that forgets slowly, in short blocks."""
    f = sensor_view(spark, d)
    return _window_avg(N.up_filter(f, N.adaptive_gain(), I.RIG, block=60), ("ux", "uy", "uz"))


_PREINT_Q = Q.quat_mul(("r.x", "r.y", "r.z", "r.w"), ("d.x", "d.y", "d.z", "d.w"))


@query("preintegrate", KEYS, "s_x s_y s_z g_x g_y g_z", Q.recursive(f"""{Q.WINDOWS},
dq AS MATERIALIZED (SELECT sv.rec, {_WIN} AS win_idx, frame % 50 AS t, ax, ay, az, {', '.join(f'{e} AS {n}' for e, n in zip(Q.rotvec_quat(('(wx*0.02)', '(wy*0.02)', '(wz*0.02)')), 'xyzw'))} FROM sv),
dw AS MATERIALIZED (SELECT dq.* FROM dq JOIN (SELECT rec, win_idx FROM wm) USING (rec, win_idx)),
rq AS (SELECT rec, win_idx, 0 AS t, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z, 1.0::DOUBLE AS w FROM wm
UNION ALL SELECT r.rec, r.win_idx, r.t + 1, {_PREINT_Q[0]}, {_PREINT_Q[1]}, {_PREINT_Q[2]}, {_PREINT_Q[3]}
FROM rq r JOIN dw d ON d.rec = r.rec AND d.win_idx = r.win_idx AND d.t = r.t WHERE r.t < 49),
fr AS (SELECT q.rec, q.win_idx, q.t, q.x, q.y, q.z, q.w, ax, ay, az FROM rq q JOIN (SELECT rec, win_idx, t, ax, ay, az FROM dw) USING (rec, win_idx, t))
SELECT rec, win_idx, {', '.join(f'sum({e}) * 0.02 AS s_{n}' for e, n in zip(Q.matvec(_R, ('ax', 'ay', 'az')), 'xyz'))},
{', '.join(f'max(2 * atan2(sqrt(x*x + y*y + z*z), w) * {n} / sqrt(x*x + y*y + z*z)) FILTER (t = 49) AS g_{n}' for n in 'xyz')}
FROM fr GROUP BY 1, 2"""), digits=5)
def preintegrate(spark, d):
    p = N.preintegrate(sensor_view(spark, d), I.RIG)
    return p.where(F.col("frame") % I.RIG.window == I.RIG.window - 1)
