"""Queries: recording summaries, spectra, correlations and fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sensorframe.functions import vec as V
from sensorframe.operators import summary as S
from sensorframe.operators import windows as W
from sensorframe.sources.views import sensor_view
from workload import inputs as I
from workload import sql as Q
from workload.registry import query

_A, _W = "sqrt(ax*ax + ay*ay + az*az)", "sqrt(wx*wx + wy*wy + wz*wz)"
_ORDER = "(PARTITION BY rec ORDER BY frame)"


def _spectrum_sql(bands, size=200, fs=50.0):
    """CTE bp: mean band power of |a| per recording and band (a plain Fourier sum)."""
    freqs = np.fft.rfftfreq(size, 1 / fs)
    rows = ", ".join(f"({i}, {k})" for i, (lo, hi) in enumerate(bands)
                     for k in range(len(freqs)) if lo <= freqs[k] < hi)
    return f"""bk AS MATERIALIZED (SELECT rec, CAST(floor(frame / {size}) AS INTEGER) AS blk, frame % {size} AS t, {_A} AS s FROM sv),
bf AS MATERIALIZED (SELECT rec, blk, t, s - avg(s) OVER (PARTITION BY rec, blk) AS s, count(*) OVER (PARTITION BY rec, blk) AS n FROM bk),
fq AS (SELECT * FROM (VALUES {rows}) AS f(band, k)),
pw AS MATERIALIZED (SELECT rec, blk, k, sum(s * cos(2 * pi() * k * t / {size})) AS re, sum(s * sin(2 * pi() * k * t / {size})) AS im
FROM bf CROSS JOIN (SELECT DISTINCT k FROM fq) WHERE n = {size} GROUP BY 1, 2, 3),
bb AS (SELECT rec, blk, band, avg(re*re + im*im) AS p FROM pw JOIN fq USING (k) GROUP BY 1, 2, 3),
bp AS MATERIALIZED (SELECT rec, band, ln(1 + avg(p)) AS v FROM bb GROUP BY 1, 2)"""


def _band_columns(n, prefix):
    return ", ".join(f"coalesce(max(v) FILTER (band = {i}), 0) AS {prefix}_{i}" for i in range(n))


_BANDS = S.even_bands(2.5, 10)
_LOG_BANDS = S.log_bands(50.0)


@query("block_spectrum", "rec:bigint", " ".join(f"spectrum_{i}" for i in range(10)),
       f"{Q.BASE}, {_spectrum_sql(_BANDS)} SELECT rec, {_band_columns(10, 'spectrum')} FROM bp GROUP BY rec", digits=5)
def block_spectrum(spark, d):
    return S.block_spectrum(sensor_view(spark, d), V.norm(V.vec(*V.ACC)), _BANDS, I.RIG,
                            prefix="spectrum")


@query("window_spectrum", "rec:bigint win_idx:int k:int", "ax", f"""{Q.WINDOWS},
s AS (SELECT sv.rec, wm.win_idx, frame % 50 AS t, sv.ax FROM sv JOIN wm ON sv.rec = wm.rec AND CAST(floor(frame / 50) AS INTEGER) = wm.win_idx),
p AS (SELECT rec, win_idx, k, sum(ax * cos(2 * pi() * k * t / 50)) AS re, sum(ax * sin(2 * pi() * k * t / 50)) AS im
FROM s CROSS JOIN range(26) AS r(k) GROUP BY 1, 2, 3)
SELECT rec, win_idx, k, ln(1 + sqrt(re*re + im*im)) AS ax FROM p""")
def window_spectrum(spark, d):
    s = S.window_spectrum(sensor_view(spark, d), ["ax"], I.RIG)
    return s.select("rec", "win_idx", F.posexplode("ax").alias("k", "ax"))


_GRAD = {c: f"coalesce((lead({c}) OVER w - lag({c}) OVER w) / 2, lead({c}) OVER w - {c}, {c} - lag({c}) OVER w)"
         for c in ("ax", "ay", "az")}
_LAGS = f"""gr AS MATERIALIZED (SELECT rec, frame, {_W} AS x, {', '.join(f'{e} AS d{c}' for c, e in _GRAD.items())} FROM sv WINDOW w AS {_ORDER}),
sg AS MATERIALIZED (SELECT rec, frame, x, sqrt(dax*dax + day*day + daz*daz) AS y FROM gr),
zs AS MATERIALIZED (SELECT rec, frame, (x - avg(x) OVER p) / (stddev_pop(x) OVER p + 1e-9) AS x, (y - avg(y) OVER p) / (stddev_pop(y) OVER p + 1e-9) AS y
FROM sg WINDOW p AS (PARTITION BY rec)),
lg AS (SELECT a.rec, lag, avg(a.x * b.y) AS c FROM range(-20, 21, 2) AS l(lag) JOIN zs a ON true JOIN zs b ON b.rec = a.rec AND b.frame = a.frame - lag GROUP BY 1, 2),
bl AS MATERIALIZED (SELECT rec, lag, c AS correlation FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY c DESC, lag) AS k FROM lg) WHERE k = 1)"""


@query("lag_correlation", "rec:bigint lag:int", "correlation", f"{Q.BASE}, {_LAGS} SELECT * FROM bl")
def lag_correlation(spark, d):
    return S.lag_correlation(sensor_view(spark, d))


def _slope_sql(smooth):
    """CTE ds: smoothed direction u, its rate d, smoothed gyro s and force size."""
    b, a = smooth // 2, (smooth - 1) // 2
    sm = ", ".join(f"sum({c}) OVER (PARTITION BY rec ORDER BY frame ROWS BETWEEN {b} PRECEDING AND {a} FOLLOWING) / {smooth} AS {c}"
                   for c in ("ax", "ay", "az", "wx", "wy", "wz"))
    gr = ", ".join(f"50 * coalesce((lead({c}) OVER w - lag({c}) OVER w) / 2, lead({c}) OVER w - {c}, {c} - lag({c}) OVER w) AS d{c[1]}"
                   for c in ("ux", "uy", "uz"))
    return f"""s1 AS MATERIALIZED (SELECT rec, frame, {sm} FROM sv),
s2 AS MATERIALIZED (SELECT rec, frame, n, ax / greatest(n, 1e-6) AS ux, ay / greatest(n, 1e-6) AS uy, az / greatest(n, 1e-6) AS uz, wx, wy, wz
FROM (SELECT *, {_A} AS n FROM s1)),
ds AS MATERIALIZED (SELECT rec, frame, n, ux, uy, uz, wx, wy, wz, {gr} FROM s2 WINDOW w AS {_ORDER})"""


def _miss(w):
    c = Q.cross(w, ("ux", "uy", "uz"))
    return Q.norm(*[f"d{a} + {e}" for a, e in zip("xyz", c)])


_SIZE = Q.norm("dx", "dy", "dz")
_CONSIST = f"""SELECT rec, avg({_miss(('wx', 'wy', 'wz'))}) / (avg({_SIZE}) + 1e-6) AS residual_same,
avg({_miss(('-wy', '-wx', '-wz'))}) / (avg({_SIZE}) + 1e-6) AS residual_exchanged FROM ds GROUP BY rec"""


@query("frame_consistency", "rec:bigint", "residual_same residual_exchanged",
       f"{Q.BASE}, {_slope_sql(12)} {_CONSIST}", digits=5)
def frame_consistency(spark, d):
    return S.frame_consistency(sensor_view(spark, d), I.RIG, block=256)


@query("segment_stats", "rec:bigint segment:int", "ax_mean ax_std ax_rough wz_mean wz_std wz_rough", f"""{Q.BASE},
s AS (SELECT *, CAST(floor(frame / 120) AS INTEGER) AS segment FROM sv),
t AS (SELECT *, abs(ax - lag(ax) OVER w) AS da, abs(wz - lag(wz) OVER w) AS dw FROM s WINDOW w AS (PARTITION BY rec, segment ORDER BY frame))
SELECT rec, segment, avg(ax) AS ax_mean, stddev_samp(ax) AS ax_std, avg(da) AS ax_rough, avg(wz) AS wz_mean,
       stddev_samp(wz) AS wz_std, avg(dw) AS wz_rough FROM t GROUP BY 1, 2""")
def segment_stats(spark, d):
    return W.segment_stats(sensor_view(spark, d), ("ax", "wz"), F.floor(F.col("frame") / 120))


@query("aggressiveness", "rec:bigint", "aggressiveness", f"""{Q.BASE} SELECT rec,
quantile_cont(abs({_A} - 9.81), 0.9) AS aggressiveness FROM sv GROUP BY rec""")
def aggressiveness(spark, d):
    return S.aggressiveness(I.stored_frames(spark, d), I.RIG)


@query("histogram_percentiles", "rec:bigint", "a_p10 a_p50 a_p99 vx_p25 wz_p75", f"""{Q.BASE} SELECT rec, quantile_cont({_A}, 0.1) AS a_p10,
quantile_cont({_A}, 0.5) AS a_p50, quantile_cont({_A}, 0.99) AS a_p99, quantile_cont(vx, 0.25) AS vx_p25, quantile_cont(wz, 0.75) AS wz_p75
FROM sv GROUP BY rec""")
def histogram_percentiles(spark, d):
    """The route for groups too large for one task, taken whatever the size."""
    from sensorframe.operators.blocks import percentiles
    return percentiles(sensor_view(spark, d), ["rec"], {
        "a": (V.norm(V.vec(*V.ACC)), [0.1, 0.5, 0.99]), "vx": (F.col("vx"), [0.25]),
        "wz": (F.col("wz"), [0.75])})


@query("drag_slope", "rec:bigint n_moving:bigint", "slope", f"""{Q.REST}, {Q.MEANS},
up AS (SELECT rec, fx, fy, fz, fx/n AS u0, fy/n AS u1, fz/n AS u2 FROM (SELECT *, sqrt(fx*fx + fy*fy + fz*fz) AS n FROM an)),
h AS (SELECT wm.rec, ax - (ax*u0 + ay*u1 + az*u2)*u0 - (fx - (fx*u0 + fy*u1 + fz*u2)*u0) AS hx,
      ay - (ax*u0 + ay*u1 + az*u2)*u1 - (fy - (fx*u0 + fy*u1 + fz*u2)*u1) AS hy,
      az - (ax*u0 + ay*u1 + az*u2)*u2 - (fz - (fx*u0 + fy*u1 + fz*u2)*u2) AS hz,
      vx - (vx*u0 + vy*u1 + vz*u2)*u0 AS gx, vy - (vx*u0 + vy*u1 + vz*u2)*u1 AS gy, vz - (vx*u0 + vy*u1 + vz*u2)*u2 AS gz
FROM wm JOIN up ON up.rec = wm.rec),
p AS (SELECT rec, sqrt(hx*hx + hy*hy + hz*hz) AS tilt, sqrt(gx*gx + gy*gy + gz*gz) AS speed FROM h)
SELECT rec, sum((speed > 2.0)::INT) AS n_moving, regr_slope(speed, tilt) FILTER (speed > 2.0) AS slope FROM p
GROUP BY rec HAVING count(*) >= 5 AND sum((speed > 2.0)::INT) >= 5 AND regr_slope(speed, tilt) FILTER (speed > 2.0) > -10
AND regr_slope(speed, tilt) FILTER (speed > 2.0) < 10""")
def drag_slope(spark, d):
    return S.drag_slope(sensor_view(spark, d), I.RIG, moving=2.0, minimum=5, low=-10.0)


@query("channel_scales", "channel:string", "mean std", f"""{Q.WINDOWS},
u AS (SELECT sv.* FROM sv JOIN wm ON sv.rec = wm.rec AND CAST(floor(frame / 50) AS INTEGER) = wm.win_idx)
SELECT 'ax' AS channel, avg(ax) AS mean, greatest(stddev_samp(ax), 1e-6) AS std FROM u
UNION ALL SELECT 'wz', avg(wz), greatest(stddev_samp(wz), 1e-6) FROM u UNION ALL SELECT 'vx', 0.0, 5.0""")
def channel_scales(spark, d):
    return S.channel_scales(sensor_view(spark, d), ["ax", "wz", "vx"], fixed={"vx": (0, 5)},
                            rig=I.RIG)


_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
_UU = {(0, 0): "(uy*uy + uz*uz)", (1, 1): "(ux*ux + uz*uz)", (2, 2): "(ux*ux + uy*uy)",
       (0, 1): "(-ux*uy)", (0, 2): "(-ux*uz)", (1, 2): "(-uy*uz)"}
_WW = ("wx", "wy", "wz")
_BACK = [f"(-{c})" for c in Q.cross(("ux", "uy", "uz"), ("dx", "dy", "dz"))]
_NORMAL = {f"a{p[0]}{p[1]}_{q[0]}{q[1]}": f"sum(wt * {_UU[p]} * {_WW[q[0]]} * {_WW[q[1]]})"
           for p in _PAIRS for q in _PAIRS}
_NORMAL.update({f"b{j}{k}": f"sum(wt * {_BACK[j]} * {_WW[k]})" for j in range(3) for k in range(3)})
_SHOWN = ["a00_00", "a01_02", "a12_22", "a22_11", "b00", "b12", "b21"]


@query("frame_normal_equations", "rec:bigint n_used:bigint", " ".join(_SHOWN), f"""{Q.BASE}, {_slope_sql(50)},
wq AS (SELECT *, exp(-((n - 9.81) / 3.0) * ((n - 9.81) / 3.0)) AS wt FROM ds)
SELECT rec, count(*) AS n_used, {', '.join(f'{_NORMAL[n]} AS {n}' for n in _SHOWN)} FROM wq GROUP BY rec""", digits=4)
def frame_normal_equations(spark, d):
    base = S._direction_slope(sensor_view(spark, d), 50, I.RIG, 8192)
    far = (F.col("_size") - I.RIG.g) / 3.0
    return S.frame_normal_equations(base, F.exp(-(far * far)))


@query("frame_fit", "rec:bigint", "r00 r11 r22 residual_before residual_after")
def frame_fit(spark, d):
    """Rates are scaled up so that enough frames carry information."""
    f = I.stored_frames(spark, d).withColumns({c: F.col(c) * 20 for c in V.GYR})
    return S.gyro_frame_fit(f, I.RIG, smooth=50, minimum=100)


@query("frame_fit_checks", "rec:bigint fitted:boolean", "residual_before off_identity determinant", f"""{Q.BASE}, {_slope_sql(50)},
fw AS (SELECT *, 20 * wx AS sx, 20 * wy AS sy, 20 * wz AS sz, exp(-((n - 9.81) / 3.0) * ((n - 9.81) / 3.0)) AS wt,
       sqrt(wx*wx + wy*wy + wz*wz) * 20 AS turn FROM ds),
fu AS (SELECT * FROM fw WHERE turn > 0.3 AND turn < 6.0 AND wt > 0.05),
fr AS (SELECT rec, sum(wt * sqrt((dx + sy * uz - sz * uy) ** 2 + (dy + sz * ux - sx * uz) ** 2 + (dz + sx * uy - sy * ux) ** 2))
       / (sum(wt * sqrt(dx*dx + dy*dy + dz*dz)) + 1e-9) AS residual_before FROM fu GROUP BY rec HAVING count(*) >= 100)
SELECT rec, residual_before IS NOT NULL AS fitted, residual_before, 0.0::DOUBLE AS off_identity, 1.0::DOUBLE AS determinant
FROM (SELECT DISTINCT rec FROM sv) LEFT JOIN fr USING (rec)""", digits=5)
def frame_fit_checks(spark, d):
    """What every fit must satisfy: the residual it starts from, and an orthogonal map without reflection."""
    m = V.mat(V.mat_cols("r"))
    rows = [V.vec(*[f"r{i}{j}" for j in range(3)]) for i in range(3)]
    off = F.greatest(*[F.abs(V.dot(rows[i], rows[j]) - (1.0 if i == j else 0.0)) for i in range(3) for j in range(i, 3)])
    f = I.stored_frames(spark, d).withColumns({c: F.col(c) * 20 for c in V.GYR})
    return S.gyro_frame_fit(f, I.RIG, smooth=50, minimum=100).select(
        "rec", F.col("residual_before").isNotNull().alias("fitted"), "residual_before", off.alias("off_identity"),
        V.det(m).alias("determinant"))


_REST1 = Q.REST.replace("stddev_pop", "stddev_samp")
_EXTRAS = f"""sh AS (SELECT rec, sqrt(avg(v)) AS vibration_rms FROM (SELECT rec, var_pop({_A}) AS v FROM sv
GROUP BY rec, CAST(floor(frame / 50) AS INTEGER) HAVING count(*) = 50) GROUP BY rec),
sp AS (SELECT rec, {_band_columns(10, 'spectrum')} FROM bp GROUP BY rec),
rt AS (SELECT rec, quantile_cont({_W}, 0.5) AS rate_p50, quantile_cont({_W}, 0.9) AS rate_p90,
       quantile_cont({_W}, 0.99) AS rate_p99, ln(count(*) / 50) AS log_seconds FROM sv GROUP BY rec),
rx AS (SELECT rec, sqrt(fx*fx + fy*fy + fz*fz) AS rest_force, score AS rest_score FROM an)"""
_SIX = ("ax", "ay", "az", "wx", "wy", "wz")
_EXTRA_NAMES = ["rest_force", "rest_score", "vibration_rms", *[f"spectrum_{i}" for i in range(10)],
                "rate_p50", "rate_p90", "rate_p99", "log_seconds"]


def _base_sql(source, chans):
    steps = ", ".join(f"abs({c} - lag({c}) OVER w) AS s_{c}" for c in chans)
    aggs = ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, avg(s_{c}) AS {c}_rough" for c in chans)
    return f"""bs AS (SELECT rec, {aggs} FROM (SELECT rec, {', '.join(chans)}, {steps} FROM {source} WINDOW w AS {_ORDER}) GROUP BY rec)"""


_V1 = [f"{c}_{k}" for k in ("mean", "std", "rough") for c in _SIX] + _EXTRA_NAMES


@query("descriptors", "rec:bigint", " ".join(_V1), f"""{_REST1}, {_spectrum_sql(_BANDS)}, {_EXTRAS}, {_base_sql('sv', _SIX)}
SELECT * FROM bs JOIN rx USING (rec) JOIN sh USING (rec) JOIN sp USING (rec) JOIN rt USING (rec)""", digits=5)
def descriptors(spark, d):
    return S.recording_descriptors(I.stored_frames(spark, d), I.RIG)


_CALM = f"""cm AS MATERIALIZED (SELECT *, CASE WHEN slow >= 200 THEN r < 0.5 ELSE rk <= greatest(200, floor(n / 20)) END AS calm FROM (
SELECT *, {_W} AS r, row_number() OVER (PARTITION BY rec ORDER BY {_W}, frame) AS rk,
       sum(({_W} < 0.5)::INT) OVER (PARTITION BY rec) AS slow, count(*) OVER (PARTITION BY rec) AS n FROM sv))"""
_FREE = ("a_v", "a_h", "w_v", "w_h")
_V2 = ([f"{c}_{k}" for k in ("mean", "std", "rough") for c in _FREE]
       + ["a_h_p50", "a_h_p90", "a_h_p99", "a_dev_p50", "a_dev_p90", "a_dev_p99"] + _EXTRA_NAMES)


@query("descriptors_v2", "rec:bigint", " ".join(_V2), f"""{_REST1}, {_spectrum_sql(_BANDS)}, {_EXTRAS}, {_CALM},
up AS (SELECT rec, x/n AS u0, y/n AS u1, z/n AS u2 FROM (SELECT *, sqrt(x*x + y*y + z*z) AS n FROM
       (SELECT rec, avg(ax) AS x, avg(ay) AS y, avg(az) AS z FROM cm WHERE calm GROUP BY rec))),
yf AS MATERIALIZED (SELECT sv.rec, frame, ax*u0 + ay*u1 + az*u2 AS a_v,
       sqrt(pow(ax - (ax*u0 + ay*u1 + az*u2)*u0, 2) + pow(ay - (ax*u0 + ay*u1 + az*u2)*u1, 2) + pow(az - (ax*u0 + ay*u1 + az*u2)*u2, 2)) AS a_h,
       wx*u0 + wy*u1 + wz*u2 AS w_v,
       sqrt(pow(wx - (wx*u0 + wy*u1 + wz*u2)*u0, 2) + pow(wy - (wx*u0 + wy*u1 + wz*u2)*u1, 2) + pow(wz - (wx*u0 + wy*u1 + wz*u2)*u2, 2)) AS w_h
FROM sv JOIN up ON up.rec = sv.rec), {_base_sql('yf', _FREE)},
pq AS (SELECT rec, quantile_cont(a_h, 0.5) AS a_h_p50, quantile_cont(a_h, 0.9) AS a_h_p90, quantile_cont(a_h, 0.99) AS a_h_p99,
       quantile_cont(abs(a_v - 9.81), 0.5) AS a_dev_p50, quantile_cont(abs(a_v - 9.81), 0.9) AS a_dev_p90,
       quantile_cont(abs(a_v - 9.81), 0.99) AS a_dev_p99 FROM yf GROUP BY rec)
SELECT * FROM bs JOIN pq USING (rec) JOIN rx USING (rec) JOIN sh USING (rec) JOIN sp USING (rec) JOIN rt USING (rec)""", digits=5)
def descriptors_v2(spark, d):
    return S.recording_descriptors(I.stored_frames(spark, d), I.RIG, version=2)


_SUMMARY = ([f"calm_force_p{p}" for p in (5, 25, 50, 75, 95)] + [f"calm_{c}_{k}" for k in ("mean", "std") for c in ("ax", "ay", "az")]
            + ["wx_mean", "wy_mean", "wz_mean", "rate_mean", "rate_std", "force_std"] + [f"band_{i}" for i in range(16)]
            + ["residual_same", "residual_exchanged", "lag", "correlation", "log_seconds", "force_dev_p90", "rate_p50", "rate_p90", "rate_p99"])


@query("recording_summary", "rec:bigint", " ".join(_SUMMARY), f"""{Q.BASE}, {_CALM}, {_spectrum_sql(_LOG_BANDS)}, {_slope_sql(12)}, {_LAGS},
cs AS (SELECT rec, {', '.join(f'quantile_cont({_A}, {p / 100}) FILTER (calm) AS calm_force_p{p}' for p in (5, 25, 50, 75, 95))},
       {', '.join(f'avg({c}) FILTER (calm) AS calm_{c}_mean, stddev_pop({c}) FILTER (calm) AS calm_{c}_std' for c in ('ax', 'ay', 'az'))},
       avg(wx) AS wx_mean, avg(wy) AS wy_mean, avg(wz) AS wz_mean, avg(r) AS rate_mean, stddev_pop(r) AS rate_std, stddev_pop({_A}) AS force_std,
       ln(count(*) / 50) AS log_seconds, quantile_cont(abs({_A} - 9.81), 0.9) AS force_dev_p90, quantile_cont(r, 0.5) AS rate_p50,
       quantile_cont(r, 0.9) AS rate_p90, quantile_cont(r, 0.99) AS rate_p99 FROM cm GROUP BY rec),
bd AS (SELECT rec, {_band_columns(16, 'band')} FROM bp GROUP BY rec), fc AS ({_CONSIST})
SELECT cs.*, bd.* EXCLUDE (rec), fc.* EXCLUDE (rec), lag * 1000 / 50 / 100.0 AS lag, correlation
FROM cs JOIN bd ON bd.rec = cs.rec JOIN fc ON fc.rec = cs.rec JOIN bl ON bl.rec = cs.rec""", digits=5)
def recording_summary(spark, d):
    return S.recording_summary(I.stored_frames(spark, d), I.RIG)


_PAIR = Q.quat_mul(("-p.x", "-p.y", "-p.z", "p.w"), ("o.x", "o.y", "o.z", "o.w"))
_PM = Q.transpose(Q.quat_matrix("qx", "qy", "qz", "qw"))
_PUP = Q.matvec(_PM, ("dx", "dy", "dz"))


@query("consistency_anchor", "rec:bigint anchor_win:int", "disagreement", Q.recursive(f"""{Q.BASE}, {Q.SCORES},
cd AS MATERIALIZED (SELECT rec, win_idx, score, rk, fx/n AS dx, fy/n AS dy, fz/n AS dz FROM (SELECT *, sqrt(fx*fx + fy*fy + fz*fz) AS n,
row_number() OVER (PARTITION BY rec ORDER BY score, win_idx) AS rk FROM sc) WHERE rk <= 6),
{Q.rotation_prefix('sv')},
hd AS MATERIALIZED (SELECT cd.*, x, y, z, w FROM cd JOIN rq ON rq.rec = cd.rec AND rq.frame = win_idx * 50 + 25),
pr AS (SELECT p.rec, p.win_idx, p.rk, p.dx, p.dy, p.dz, o.dx AS ox, o.dy AS oy, o.dz AS oz, 1 / (1e-3 + o.score) AS wt,
{', '.join(f'{e} AS q{n}' for e, n in zip(_PAIR, 'xyzw'))} FROM hd p JOIN hd o ON o.rec = p.rec AND o.win_idx <> p.win_idx),
eg AS (SELECT rec, win_idx, rk, wt, degrees(acos(least(1, greatest(-1, {_PUP[0]} * ox + {_PUP[1]} * oy + {_PUP[2]} * oz)))) AS e FROM pr),
ag AS (SELECT rec, win_idx, rk, sum(e * wt) / sum(wt) AS disagreement FROM eg GROUP BY 1, 2, 3)
SELECT rec, win_idx AS anchor_win, disagreement FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY disagreement, rk) AS k FROM ag) WHERE k = 1"""), digits=4)
def consistency_anchor(spark, d):
    f = I.stored_frames(spark, d)
    return S.consistency_anchor(f, W.rest_scores(f, I.RIG), I.RIG)
