"""Queries: weighted draws, placement, dilation and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe.operators.blocks import number_rows
from sensorframe.functions import vec as V
from sensorframe.operators import sampling as M
from sensorframe.operators import windows as W
from sensorframe.operators.sequence import fir_taps
from sensorframe.session import cut_lineage
from sensorframe.sources.views import sensor_view
from workload import inputs as I
from workload import sql as Q
from workload.registry import query

SEED = 11
_DRAW = Q.uniform(str(SEED), "draw_id")
_WEIGHTED = f"""{Q.RECS},
wt AS (SELECT *, CASE WHEN n_windows >= 11 THEN 1.0 / greatest(1, sum((n_windows >= 11)::INT) OVER (PARTITION BY platform))
       ELSE 0 END AS weight FROM rc)"""


def _draws_sql(weights="wt", n="(SELECT count(*) FROM wm)"):
    return f"""iv AS MATERIALIZED (SELECT rec, (s - weight) / t AS lo, s / t AS hi FROM (SELECT rec, weight, sum(weight) OVER () AS t,
       sum(weight) OVER (ORDER BY substr(md5(CAST(rec AS VARCHAR)), 1, 3), rec) AS s FROM {weights} WHERE weight > 0)),
dr AS MATERIALIZED (SELECT draw_id, u, iv.rec FROM (SELECT draw_id, {_DRAW} AS u FROM (SELECT unnest(range({n})) AS draw_id)) d
JOIN iv ON u >= lo AND u < hi)"""


_DRAWN = f"{_WEIGHTED}, {Q.MEANS}, {_draws_sql()}"


def _weights(spark, d, f=None):
    return M.recording_weights(I.recordings(spark, d, f), min_windows=11)


def _draws(spark, d, recs):
    """As many draws as the tables have windows."""
    n = recs.agg(F.sum("n_windows")).first()[0]
    return M.weighted_draw(M.recording_weights(recs, min_windows=11), n, SEED)


def _stored(spark, d):
    """Frames and recordings, written once for all the steps of a job."""
    f = I.stored_frames(spark, d)
    return f, cut_lineage(I.recordings(spark, d, f))


@query("recording_weights", "rec:bigint platform:string", "weight", f"{_WEIGHTED} SELECT rec, platform, weight FROM wt")
def recording_weights(spark, d):
    return _weights(spark, d)


@query("length_weights", "rec:bigint", "weight", f"{Q.RECS} SELECT rec, CASE WHEN platform <> 'ASIA' THEN n_frames ELSE 0 END AS weight FROM rc")
def length_weights(spark, d):
    return M.recording_weights(I.recordings(spark, d), balanced=False, platforms=[
        "AFRICA", "AMERICA", "EUROPE", "MIDDLE EAST"])


_INSIDE = "platform = 'ASIA'"


@query("scaled_weights", "rec:bigint", "weight", f"""{_WEIGHTED},
nw AS (SELECT *, CASE WHEN {_INSIDE} AND n_frames > 600 THEN weight * 3 ELSE weight END AS w2 FROM wt)
SELECT rec, CASE WHEN {_INSIDE} THEN w2 * (SELECT sum(weight) FROM nw WHERE {_INSIDE}) / (SELECT sum(w2) FROM nw WHERE {_INSIDE})
       ELSE w2 END AS weight FROM nw""")
def scaled_weights(spark, d):
    return M.scale_weights(_weights(spark, d), F.col("n_frames") > 600, 3.0,
                           F.col("platform") == "ASIA")


@query("dropped_share", "rec:bigint", "weight", f"""{_WEIGHTED},
nw AS (SELECT *, CASE WHEN rec % 3 = 0 THEN 0 ELSE weight END AS w2 FROM wt)
SELECT rec, CASE WHEN {_INSIDE} AND (SELECT sum(w2) FROM nw WHERE {_INSIDE}) > 0 THEN w2 * (SELECT sum(weight) FROM nw WHERE {_INSIDE})
       / (SELECT sum(w2) FROM nw WHERE {_INSIDE}) ELSE w2 END AS weight FROM nw""")
def dropped_share(spark, d):
    return M.drop_share(_weights(spark, d), F.col("rec") % 3 == 0, F.col("platform") == "ASIA")


@query("weighted_draw", "draw_id:bigint rec:bigint", "u", f"{_DRAWN} SELECT * FROM dr")
def weighted_draw(spark, d):
    return _draws(spark, d, cut_lineage(I.recordings(spark, d)))


_PLACED = f"""{_DRAWN}, pn AS (SELECT draw_id, dr.rec, n_frames, CAST(least(floor(n_frames / 50), 3) AS INTEGER) AS len,
       {Q.uniform(f'{SEED}:start', 'draw_id')} AS v FROM dr JOIN rc ON rc.rec = dr.rec),
pl AS MATERIALIZED (SELECT draw_id, rec, len, CAST(least(floor(v * (n_frames - 50 - (len - 1) * 50 + 1)), n_frames - 50 - (len - 1) * 50) AS INTEGER) AS base FROM pn)"""


def _placed(spark, d, recs):
    return M.place_segments(_draws(spark, d, recs), recs, 3, SEED, I.RIG)


@query("segment_targets", "draw_id:bigint rec:bigint step:int valid:boolean", "vx vy vz", f"""{_PLACED}
SELECT draw_id, pl.rec, step, step < len AS valid, avg(vx) AS vx, avg(vy) AS vy, avg(vz) AS vz
FROM pl CROSS JOIN range(3) AS s(step) JOIN sv ON sv.rec = pl.rec AND frame >= base + least(step, len - 1) * 50
     AND frame < base + least(step, len - 1) * 50 + 50 GROUP BY 1, 2, 3, 4""")
def segment_targets(spark, d):
    f, recs = _stored(spark, d)
    seg = M.segment_frames(_placed(spark, d, recs), f, V.VEL, 3, I.RIG, pad=True)
    return M.segment_targets(seg)


_CELLS = """sr AS (SELECT rec, CAST(floor(frame / 50) AS INTEGER) AS win_idx, avg(sqrt(vx*vx + vy*vy + vz*vz)) AS speed,
       avg(sqrt(wx*wx + wy*wy + wz*wz)) AS rate FROM sv GROUP BY 1, 2 HAVING count(*) = 50),
qe AS (SELECT quantile_cont(speed, [0.2, 0.4, 0.6, 0.8]) AS s, quantile_cont(rate, [1.0/3, 2.0/3]) AS g FROM sr),
ce AS MATERIALIZED (SELECT rec, win_idx, ((speed >= s[1])::INT + (speed >= s[2])::INT + (speed >= s[3])::INT + (speed >= s[4])::INT) * 3
       + (rate >= g[1])::INT + (rate >= g[2])::INT AS cell FROM sr, qe),
cn AS MATERIALIZED (SELECT cell, count(*) AS cell_count FROM ce GROUP BY 1),
sa AS MATERIALIZED (SELECT ce.*, cell_count, cell_count < (SELECT quantile_cont(cell_count, 0.5) FROM cn) AS rare FROM ce JOIN cn USING (cell))"""
_STRATA = f"{Q.WINDOWS}, {_CELLS}"


def _strata(spark, d):
    w = cut_lineage(W.window_means(sensor_view(spark, d), {
        "speed": V.norm(V.vec(*V.VEL)), "rate": V.norm(V.vec(*V.GYR))}, I.RIG))
    return M.motion_strata(w)


@query("motion_strata", "rec:bigint win_idx:int cell:int cell_count:bigint rare:boolean", "", f"{_STRATA} SELECT * FROM sa")
def motion_strata(spark, d):
    return _strata(spark, d)


_KEY = """'{"cell":' || cell || ',"rec":' || rec || ',"win_idx":' || win_idx || '}'"""


@query("stratified_draw", "draw_id:bigint cell:int rec:bigint win_idx:int", "", f"""{_STRATA},
rw AS (SELECT {_KEY} AS rec, 1.0 / (count(*) OVER (PARTITION BY cell, rec) *
       (SELECT count(DISTINCT b.rec) FROM sa b WHERE b.rare AND b.cell = sa.cell) * (SELECT count(DISTINCT cell) FROM sa WHERE rare)) AS weight FROM sa WHERE rare),
{_draws_sql('rw')}
SELECT draw_id, sa.cell, sa.rec, sa.win_idx FROM dr JOIN sa ON dr.rec = {_KEY.replace('cell', 'sa.cell', 2).replace('"sa.cell"', '"cell"').replace('|| rec ||', '|| sa.rec ||').replace('|| win_idx ||', '|| sa.win_idx ||')}""")
def stratified_draw(spark, d):
    strata = cut_lineage(_strata(spark, d))
    return M.stratified_draw(strata, strata.count(), SEED)


_PICKS = f"""ri AS MATERIALIZED (SELECT cell, rec, count(*) AS w, row_number() OVER (PARTITION BY cell ORDER BY rec) - 1 AS rec_no FROM sa WHERE rare GROUP BY cell, rec),
ci AS MATERIALIZED (SELECT cell, count(*) AS r, row_number() OVER (ORDER BY cell) - 1 AS cell_no FROM ri GROUP BY cell),
wi AS MATERIALIZED (SELECT cell, rec, win_idx, row_number() OVER (PARTITION BY cell, rec ORDER BY win_idx) - 1 AS win_no FROM sa WHERE rare),
un AS (SELECT draw_id, {Q.uniform(f'{SEED}:cell', 'draw_id')} AS a, {Q.uniform(f'{SEED}:recording', 'draw_id')} AS b, {Q.uniform(f'{SEED}:window', 'draw_id')} AS c
FROM (SELECT unnest(range((SELECT count(*) FROM sa))) AS draw_id)),
pi AS MATERIALIZED (SELECT draw_id, ri.cell, ri.rec, wi.win_idx FROM un JOIN ci ON ci.cell_no = floor(a * (SELECT count(*) FROM ci))
JOIN ri ON ri.cell = ci.cell AND ri.rec_no = floor(b * ci.r) JOIN wi ON wi.cell = ri.cell AND wi.rec = ri.rec AND wi.win_no = floor(c * ri.w))"""


@query("stratified_picks", "draw_id:bigint cell:int rec:bigint win_idx:int", "", f"{_STRATA}, {_PICKS} SELECT * FROM pi")
def stratified_picks(spark, d):
    """Even picks on three levels, by counted places."""
    strata = cut_lineage(_strata(spark, d))
    return M.stratified_picks(strata, strata.count(), SEED)


# -------------------------------------------------------------------- dilation
def _u(name):
    return Q.uniform(f"{SEED}:{name}", "draw_id")


_RATED = f"""{_DRAWN}, ra AS (SELECT draw_id, rec, CASE WHEN hit AND NOT pick_s THEN 0.7 + 0.9 * ur ELSE 1.0 END AS k,
       CASE WHEN hit AND pick_s THEN 1.0 + 0.8 * us ELSE 1.0 END AS s FROM (SELECT draw_id, rec, {_u('hit')} < 0.8 AS hit,
       {_u('pick')} < 0.5 AS pick_s, {_u('rate')} AS ur, {_u('scale')} AS us FROM dr)),
dp AS (SELECT *, greatest(1, least(floor(usable / (k * 50)), 3)) AS len FROM (SELECT draw_id, ra.rec, k, s, floor(n_frames / 50) * 50 AS usable FROM ra JOIN rc ON rc.rec = ra.rec)),
dl AS MATERIALIZED (SELECT draw_id, rec, k, s, CAST(len AS INTEGER) AS len, usable, CAST(least(floor({_u('start')} * (sp + 1)), sp) AS INTEGER) AS base
FROM (SELECT *, greatest(usable - ceil(len * k * 50) - 1, 0) AS sp FROM dp))"""


def _dilated(spark, d, recs, seg_len=3, short="keep"):
    rated = M.dilation_rates(_draws(spark, d, recs), SEED, (0.7, 1.6), 0.8, scales=(1.0, 1.8),
                             exclusive=True)
    return M.place_dilated(rated, recs, seg_len, SEED, short, I.RIG)


@query("dilation_rates", "draw_id:bigint rec:bigint len:int base:int", "k s", f"{_RATED} SELECT * FROM dl")
def dilation_rates(spark, d):
    return _dilated(spark, d, cut_lineage(I.recordings(spark, d)))


@query("cancelled_dilation", "draw_id:bigint len:int", "k", f"""{_RATED},
c1 AS (SELECT draw_id, usable, CASE WHEN least(floor(usable / (k * 50)), 9) < 9 THEN 1.0 ELSE k END AS k FROM dl)
SELECT draw_id, k, CAST(greatest(1, least(floor(usable / (k * 50)), 9)) AS INTEGER) AS len FROM c1""")
def cancelled_dilation(spark, d):
    return _dilated(spark, d, cut_lineage(I.recordings(spark, d)), 9, "cancel")


_MOVED = f"""mv AS (SELECT dl.*, prec, pwin, rec % 2 = 0 AND {_u('strat')} < 0.6 AND prec IS NOT NULL AS moved FROM dl LEFT JOIN pk USING (draw_id)),
nu AS (SELECT mv.*, floor(rc.n_frames / 50) * 50 AS us2 FROM mv LEFT JOIN rc ON rc.rec = mv.prec),
nl AS (SELECT *, greatest(least(floor(us2 / (k * 50)), 3), 1) AS len2 FROM nu),
ns AS (SELECT *, greatest(us2 - ceil(len2 * k * 50) - 1, 0) AS sp2, floor({_u('inside')} * (len2 - 1) * k * 50) AS off FROM nl)
SELECT draw_id, CASE WHEN moved THEN prec ELSE rec END AS rec, CASE WHEN moved THEN len2 ELSE len END AS len,
       CASE WHEN moved THEN least(greatest(pwin * 50 - off, 0), sp2) ELSE base END AS base, k FROM ns"""


@query("stratified_segments", "draw_id:bigint rec:bigint len:int base:bigint", "k", f"""{_RATED},
pk AS (SELECT row_number() OVER (ORDER BY rec, win_idx) - 1 AS draw_id, rec AS prec, win_idx AS pwin FROM wm WHERE (rec * 7 + win_idx) % 4 = 0),
{_MOVED}""")
def stratified_segments(spark, d):
    """A share of the draws of even recordings moved onto picked windows."""
    recs = cut_lineage(I.recordings(spark, d))
    rare = I.truth(spark, d).where((F.col("rec") * 7 + F.col("win_idx")) % 4 == 0).select("rec", "win_idx")
    picks = number_rows(rare.withColumn("_one", F.lit(1)), "_one", ["rec", "win_idx"], F.floor(F.col("rec") / 1000), "draw_id")
    return M.place_stratified(_dilated(spark, d, recs), picks.select("draw_id", "rec", "win_idx"), recs, 0.6, 3, SEED,
                              F.col("rec") % 2 == 0, I.RIG)


@query("rare_window_segments", "draw_id:bigint rec:bigint len:int base:bigint", "k",
       f"{_RATED}, {_CELLS}, {_PICKS}, pk AS (SELECT draw_id, rec AS prec, win_idx AS pwin FROM pi), {_MOVED}")
def rare_window_segments(spark, d):
    """A share of the draws of even recordings moved onto picked windows of the rare strata."""
    recs, strata = cut_lineage(I.recordings(spark, d)), cut_lineage(_strata(spark, d))
    placed = _dilated(spark, d, recs)
    picks = M.stratified_picks(strata, strata.count(), SEED)
    return M.place_stratified(placed, picks, recs, 0.6, 3, SEED, F.col("rec") % 2 == 0, I.RIG)


_SPOTS = """sp AS (SELECT dl.*, t, base + k * t AS spot FROM dl, unnest(range(len * 50)) AS r(t)),
ix AS (SELECT sp.*, least(CAST(floor(spot) AS INTEGER), n_frames - 2) AS i FROM sp JOIN rc ON rc.rec = sp.rec)"""
_LERP = {c: f"a.{c} * (1 - (spot - i)) + b.{c} * (spot - i)" for c in ("ax", "ay", "az", "wx", "wy", "wz", "vx", "vy", "vz")}
_LERPED = f"""{_SPOTS}, lp AS MATERIALIZED (SELECT draw_id, ix.rec, t, k, s, {', '.join(f'{e} AS {c}' for c, e in _LERP.items())}
FROM ix JOIN sv a ON a.rec = ix.rec AND a.frame = i JOIN sv b ON b.rec = ix.rec AND b.frame = i + 1)"""
# up direction of the drawn frames: the unit force through a quarter turn about x
_UPX = ("ax / fn", "(0.5 * az) / fn", "az / fn")
_DIL = """up AS (SELECT *, sqrt(ax*ax + 0.25*az*az + az*az) AS fn FROM lp),
di AS MATERIALIZED (SELECT draw_id, rec, t, k, s, ax / fn AS ux, (0.5 * az) / fn AS uy, az / fn AS uz,
       k*k*s * (ax - 9.81 * ax / fn) + 9.81 * ax / fn AS ax, k*k*s * (ay - 9.81 * (0.5 * az) / fn) + 9.81 * (0.5 * az) / fn AS ay,
       k*k*s * (az - 9.81 * az / fn) + 9.81 * az / fn AS az, k*wx AS wx, k*wy AS wy, k*wz AS wz, k*s*vx AS vx, k*s*vy AS vy, k*s*vz AS vz FROM up)"""
_AXES = ("ax", "ay", "az", "wx", "wy", "wz", "vx", "vy", "vz")


def _with_up(df):
    return df.withColumns({"ux": F.col("ax"), "uy": 0.5 * F.col("az"), "uz": F.col("az")})


def _per_draw(df, cols=_AXES):
    return df.groupBy("draw_id", "rec").agg(F.count(F.lit(1)).alias("n"), *[
        F.avg(c).alias(c) for c in cols])


def _per_draw_sql(source, cols=_AXES):
    return f"SELECT draw_id, rec, count(*) AS n, {', '.join(f'avg({c}) AS {c}' for c in cols)} FROM {source} GROUP BY 1, 2"


@query("time_dilation", "draw_id:bigint rec:bigint n:bigint", " ".join(_AXES), f"{_RATED}, {_LERPED}, {_DIL} {_per_draw_sql('di')}")
def time_dilation(spark, d):
    """Draws replayed at their rate and scale with consistent physics."""
    f, recs = _stored(spark, d)
    f = M.dilated_frames(_dilated(spark, d, recs), f, _AXES, I.RIG)
    return _per_draw(M.apply_dilation(_with_up(f), rig=I.RIG))


@query("dilated_derived", "draw_id:bigint rec:bigint n:bigint", "d_x i_z since", f"""{_RATED}, {_LERPED}
SELECT draw_id, rec, count(*) AS n, avg(k * s * 2 * vx) AS d_x, avg(k * s * (vz - vy)) AS i_z, avg((wz + 5) / k) AS since FROM lp GROUP BY 1, 2""")
def dilated_derived(spark, d):
    """Derived velocities grow with rate and scale, the time since the anchor shrinks with the rate."""
    f, recs = _stored(spark, d)
    more = {"d_x": F.col("vx") * 2, "d_y": F.col("vy"), "d_z": F.col("vz"), "i_x": F.col("vx"), "i_y": F.col("vy"),
            "i_z": F.col("vz") - F.col("vy"), "since": F.col("wz") + 5}
    drawn = M.dilated_frames(_dilated(spark, d, recs), f.withColumns(more), (*_AXES, *more), I.RIG)
    return M.apply_dilation(_with_up(drawn), rig=I.RIG).groupBy("draw_id", "rec").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("d_x", "i_z", "since")])


_KERNEL = ", ".join(f"({i}, CAST({h!r} AS DOUBLE))" for i, h in enumerate(fir_taps(63, 0.125)))


@query("antialias_dilation", "draw_id:bigint rec:bigint n:bigint", "ax vx ax_late vx_late", f"""{_RATED}, {_SPOTS},
tp AS (SELECT * FROM (VALUES {_KERNEL}) AS t(m, h)),
gr AS (SELECT draw_id, dl.rec, k, t, h, least(greatest(base + k * (4*t + m - 31) / 4.0, 0), usable - 1) AS p, usable FROM dl, unnest(range(len * 50)) AS r(t), tp WHERE k > 1.02),
gi AS (SELECT *, least(CAST(floor(p) AS INTEGER), CAST(usable AS INTEGER) - 2) AS i FROM gr),
fi AS (SELECT draw_id, gi.rec, t, sum(h * (a.ax * (1 - (p - i)) + b.ax * (p - i))) AS ax
FROM gi JOIN sv a ON a.rec = gi.rec AND a.frame = i JOIN sv b ON b.rec = gi.rec AND b.frame = i + 1 GROUP BY 1, 2, 3),
lp AS (SELECT draw_id, ix.rec, t, k, {_LERP['ax']} AS ax, {_LERP['vx']} AS vx
FROM ix JOIN sv a ON a.rec = ix.rec AND a.frame = i JOIN sv b ON b.rec = ix.rec AND b.frame = i + 1),
al AS (SELECT lp.draw_id, lp.rec, lp.t, CASE WHEN k <= 1.02 THEN lp.ax ELSE fi.ax END AS ax, vx
FROM lp LEFT JOIN fi ON fi.draw_id = lp.draw_id AND fi.rec = lp.rec AND fi.t = lp.t)
SELECT draw_id, rec, count(*) AS n, avg(ax) AS ax, avg(vx) AS vx, avg(ax * (t % 11)) AS ax_late, avg(vx * (t % 11)) AS vx_late FROM al GROUP BY 1, 2""", digits=5)
def antialias_dilation(spark, d):
    f, recs = _stored(spark, d)
    placed = cut_lineage(_dilated(spark, d, recs))
    f = M.smooth_dilated_frames(placed, f, ("ax", "vx"), rig=I.RIG)
    return f.groupBy("draw_id", "rec").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ax").alias("ax"), F.avg("vx").alias("vx"),
        F.avg(F.col("ax") * (F.col("t") % 11)).alias("ax_late"), F.avg(F.col("vx") * (F.col("t") % 11)).alias("vx_late"))


_K3 = ("kx", "ky", "kz")


def _turn(v):
    c, dt = Q.cross(_K3, v), Q.dot(_K3, v)
    return [f"({v[i]} * cos(th) - {c[i]} * sin(th) + {_K3[i]} * {dt} * (1 - cos(th)))" for i in range(3)]


_TA, _TW, _TV = _turn(("ax", "ay", "az")), _turn(("wx", "wy", "wz")), _turn(("vx", "vy", "vz"))


@query("pitch_for_drag", "draw_id:bigint rec:bigint n:bigint", "ax ay az wx wy wz vx vy vz", f"""{_RATED}, {_LERPED}, {_DIL},
h0 AS (SELECT *, vx/s AS px, vy/s AS py, vz/s AS pz, (vx*ux + vy*uy + vz*uz)/s AS pu, CASE WHEN rec % 4 <> 0 THEN 0.8 + (rec % 5) * 0.1 END AS slope FROM di),
h1 AS (SELECT *, px - pu*ux AS hx, py - pu*uy AS hy, pz - pu*uz AS hz FROM h0),
h2 AS (SELECT *, sqrt(hx*hx + hy*hy + hz*hz) AS sp FROM h1),
h3 AS (SELECT *, CASE WHEN s > 1.0 AND slope IS NOT NULL THEN atan(sp * s / (greatest(slope, 0.5) * 9.81)) - atan(sp / (greatest(slope, 0.5) * 9.81)) ELSE 0 END AS th,
       (uy*hz - uz*hy) / greatest(sp, 1e-3) AS cx, (uz*hx - ux*hz) / greatest(sp, 1e-3) AS cy, (ux*hy - uy*hx) / greatest(sp, 1e-3) AS cz FROM h2),
h4 AS (SELECT *, cx / greatest(sqrt(cx*cx + cy*cy + cz*cz), 1e-6) AS kx, cy / greatest(sqrt(cx*cx + cy*cy + cz*cz), 1e-6) AS ky, cz / greatest(sqrt(cx*cx + cy*cy + cz*cz), 1e-6) AS kz FROM h3),
h5 AS (SELECT *, 50 * coalesce((lead(th) OVER w - lag(th) OVER w) / 2, lead(th) OVER w - th, th - lag(th) OVER w) AS spin FROM h4
       WINDOW w AS (PARTITION BY draw_id, CAST(floor(t / 50) AS INTEGER) ORDER BY t)),
h6 AS (SELECT draw_id, rec, {_TA[0]} AS ax, {_TA[1]} AS ay, {_TA[2]} AS az, {_TW[0]} + kx*spin AS wx, {_TW[1]} + ky*spin AS wy, {_TW[2]} + kz*spin AS wz,
       {_TV[0]} AS vx, {_TV[1]} AS vy, {_TV[2]} AS vz FROM h5)
{_per_draw_sql('h6')}""", digits=5)
def pitch_for_drag(spark, d):
    f, recs = _stored(spark, d)
    f = M.dilated_frames(_dilated(spark, d, recs), f, _AXES, I.RIG)
    f = M.apply_dilation(_with_up(f), rig=I.RIG).withColumn("slope", F.when(
        F.col("rec") % 4 != 0, 0.8 + (F.col("rec") % 5) * 0.1))
    return _per_draw(M.pitch_for_drag(f, rig=I.RIG))


# ---------------------------------------------------------------- augmentation
def _segments(spark, d, cols=_AXES, made=lambda draws: draws):
    """Frames of placed draws (with what ``made`` adds to them) with ``pos`` inside the window."""
    f, recs = _stored(spark, d)
    seg = M.segment_frames(made(_placed(spark, d, recs)), f, cols, 3, I.RIG)
    return seg.withColumn("pos", (F.col("frame") - F.col("base") - F.col("step") * I.RIG.window)
                          .cast("int"))


_SEG = f"""{_PLACED}, sg AS MATERIALIZED (SELECT draw_id, sv.rec, step, frame - base - step * 50 AS pos, ax, ay, az, wx, wy, wz, vx, vy, vz
FROM pl, unnest(range(len)) AS s(step) JOIN sv ON sv.rec = pl.rec AND frame >= base + step * 50 AND frame < base + step * 50 + 50)"""


@query("channel_dropout", "draw_id:bigint rec:bigint n:bigint", "wx wy wz", f"""{_SEG},
dp AS (SELECT draw_id, rec, keep * wx AS wx, keep * wy AS wy, keep * wz AS wz FROM (SELECT *, ({_u('drop')} >= 0.3)::INT AS keep FROM sg))
{_per_draw_sql('dp', ('wx', 'wy', 'wz'))}""")
def channel_dropout(spark, d):
    s = M.drop_channels(_segments(spark, d), V.GYR, 0.3, SEED)
    return _per_draw(s, V.GYR)


@query("yaw_turn", "draw_id:bigint rec:bigint n:bigint", " ".join(_AXES), f"""{_SEG},
y AS (SELECT *, CASE WHEN rec % 2 = 0 THEN {_u('yaw')} * 2 * pi() ELSE 0 END AS th FROM sg),
z AS (SELECT draw_id, rec, {', '.join(f'cos(th)*{p}x - sin(th)*{p}y AS {p}x, sin(th)*{p}x + cos(th)*{p}y AS {p}y, {p}z' for p in 'awv')} FROM y)
{_per_draw_sql('z')}""")
def yaw_turn(spark, d):
    s = M.yaw_turn(_segments(spark, d), SEED, [V.ACC], [V.GYR], chosen=F.col("rec") % 2 == 0)
    return _per_draw(s)


@query("mirror_views", "draw_id:bigint rec:bigint n:bigint", " ".join(_AXES), f"""{_SEG},
y AS (SELECT *, floor({_u('yaw')} * 3) AS c FROM sg),
m AS (SELECT *, CASE WHEN c IN (0, 1) THEN -1 ELSE 1 END AS dx, CASE WHEN c IN (0, 2) THEN -1 ELSE 1 END AS dy FROM y),
z AS (SELECT draw_id, rec, dx*ax AS ax, dy*ay AS ay, az, dx*dy*dx*wx AS wx, dx*dy*dy*wy AS wy, dx*dy*wz AS wz, dx*vx AS vx, dy*vy AS vy, vz FROM m)
{_per_draw_sql('z')}""")
def mirror_views(spark, d):
    return _per_draw(M.yaw_turn(_segments(spark, d), SEED, [V.ACC], [V.GYR], views="pi_mirror"))


@query("sensor_noise", "draw_id:bigint rec:bigint n:bigint", "ax ay az wx wy wz", f"""{_SEG},
z AS (SELECT draw_id, rec, {', '.join(f"{c} * (1 + 0.1 * (2 * {_u('gain')} - 1)) + (2 * {_u('bias:' + c)} - 1) * 0.3 AS {c}" for c in ('ax', 'ay', 'az'))},
{', '.join(f"{c} + (2 * {_u('bias:' + c)} - 1) * 0.02 AS {c}" for c in ('wx', 'wy', 'wz'))} FROM sg)
{_per_draw_sql('z', ('ax', 'ay', 'az', 'wx', 'wy', 'wz'))}""")
def sensor_noise(spark, d):
    sizes = (SEED, 0.1, 0.3, 0.02)
    s = M.sensor_noise(_segments(spark, d, made=lambda draws: M.noise_factors(draws, *sizes)), *sizes)
    return _per_draw(s, (*V.ACC, *V.GYR))


def _noise(c, *keys):
    one, two = (Q.uniform(str(SEED + M.hash_code(c) + more), *keys) for more in (0, 7919))
    return f"sqrt(-2 * ln(1 - {one})) * cos(2 * pi() * {two})"


@query("frame_noise", "rec:bigint n:bigint", "mean std late", f"""{_SEG},
no AS (SELECT rec, pos, 0.5 * {_noise('ax', 'draw_id', 'step', 'pos')} AS gap FROM sg)
SELECT rec, count(*) AS n, avg(gap) AS mean, stddev_samp(gap) AS std, avg(gap * (pos % 7)) AS late FROM no GROUP BY rec""")
def frame_noise(spark, d):
    """Gaussian noise per frame of every drawn segment."""
    s = _segments(spark, d).withColumn("clean", F.col("ax"))
    s = M.sensor_noise(s, SEED, noise={"ax": 0.5}, frame_key=("draw_id", "step", "pos"),
                       uniform=M.hash_uniform)
    gap = F.col("ax") - F.col("clean")
    return s.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mean"),
                                F.stddev_samp(gap).alias("std"), F.avg(gap * (F.col("pos") % 7)).alias("late"))


def _gauss(i):
    return (f"sqrt(-2 * ln(1 - {Q.uniform(str(SEED + 17 * i), 'draw_id')})) * "
            f"cos(2 * pi() * {Q.uniform(str(SEED + 17 * i + 7919), 'draw_id')})")


_TK = _turn(("ax", "ay", "az"))


@query("tilt_up", "draw_id:bigint rec:bigint n:bigint", "ax ay az", f"""{_SEG},
g AS (SELECT *, {_gauss(1)} AS g1, {_gauss(2)} AS g2, {_gauss(3)} AS g3, -radians({_u('tilt')} * 8) AS th FROM sg),
k AS (SELECT *, g1 / gn AS kx, g2 / gn AS ky, g3 / gn AS kz FROM (SELECT *, sqrt(g1*g1 + g2*g2 + g3*g3) AS gn FROM g)),
z AS (SELECT draw_id, rec, {_TK[0]} AS ax, {_TK[1]} AS ay, {_TK[2]} AS az FROM k)
{_per_draw_sql('z', ('ax', 'ay', 'az'))}""")
def tilt_up(spark, d):
    return _per_draw(M.tilt_up(_segments(spark, d), SEED, 8.0, up=V.ACC), V.ACC)


def _us(name):
    return Q.uniform(f"{SEED}:{name}", "draw_id", "step")


@query("time_mask", "draw_id:bigint rec:bigint n:bigint", "ax wz", f"""{_SEG},
m AS (SELECT *, 5 + floor({_us('span')} * 16) AS span, {_us('start')} AS us, {_us('hit')} < 0.5 AS hit FROM sg),
q AS (SELECT *, floor(us * (50 - span)) AS st FROM m),
z AS (SELECT draw_id, rec, CASE WHEN hit AND pos >= st AND pos < st + span THEN 0 ELSE ax END AS ax,
      CASE WHEN hit AND pos >= st AND pos < st + span THEN 0 ELSE wz END AS wz FROM q)
{_per_draw_sql('z', ('ax', 'wz'))}""")
def time_mask(spark, d):
    s = M.time_mask(_segments(spark, d), SEED, ("ax", "wz"), 0.5, (5, 20), window=I.RIG.window)
    return _per_draw(s, ("ax", "wz"))


@query("span_mask", "draw_id:bigint rec:bigint n:bigint n_masked:bigint", "", f"""{_SEG},
m AS (SELECT *, {', '.join(f"floor({_u(f'span{i}')} * (50 - 6)) AS b{i}" for i in range(3))} FROM sg)
SELECT draw_id, rec, count(*) AS n, sum(({' OR '.join(f'(pos >= b{i} AND pos < b{i} + 6)' for i in range(3))})::INT) AS n_masked FROM m GROUP BY 1, 2""")
def span_mask(spark, d):
    s = M.span_mask(_segments(spark, d), SEED, 0.4, 3, window=I.RIG.window)
    return s.groupBy("draw_id", "rec").agg(F.count(F.lit(1)).alias("n"),
                                           F.count_if("masked").alias("n_masked"))


def _line(c, hz):
    """Strength of one frequency line of a 50-frame window."""
    return f"sqrt(pow(sum({c} * cos(2 * pi() * {hz} * pos / 50)), 2) + pow(sum({c} * sin(2 * pi() * {hz} * pos / 50)), 2))"


def _knot(c, hz):
    """Gain at a line: the eight hashed knots lie evenly over the 26 lines."""
    at = hz * 7 / 25
    i = int(at)
    one, two = (f"(1 + 0.5 * (2 * any_value({Q.uniform(f'{SEED}:{c}:{k}', 'draw_id')}) - 1))" for k in (i, i + 1))
    return f"({1 - (at - i)!r} * {one} + {at - i!r} * {two})"


@query("band_gain", "draw_id:bigint step:int n:bigint", "ax_mean wz_mean ax_low ax_high wz_high", f"""{_SEG}
SELECT draw_id, step, count(*) AS n, avg(ax) AS ax_mean, avg(wz) AS wz_mean,
       sqrt(pow(sum(ax * cos(2 * pi() * 4 * pos / 50)), 2) + pow(sum(ax * sin(2 * pi() * 4 * pos / 50)), 2)) AS ax_low,
       {_line('ax', 15)} * {_knot('ax', 15)} AS ax_high, {_line('wz', 22)} * {_knot('wz', 22)} AS wz_high
FROM sg GROUP BY 1, 2""", digits=5)
def band_gain(spark, d):
    """Content above the limit changes by the hashed gain; the mean and the 4 Hz line stay."""
    s = M.band_gain(_segments(spark, d), SEED, ("ax", "wz"), 0.5, rig=I.RIG)
    def line(c, hz):
        at = 2 * 3.141592653589793 * hz * F.col("pos") / 50
        re, im = F.sum(F.col(c) * F.cos(at)), F.sum(F.col(c) * F.sin(at))
        return F.sqrt(re * re + im * im)
    return s.groupBy("draw_id", "step").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ax").alias("ax_mean"), F.avg("wz").alias("wz_mean"),
        line("ax", 4).alias("ax_low"), line("ax", 15).alias("ax_high"), line("wz", 22).alias("wz_high"))


@query("anchored_crop", "rec:bigint crop_start:int crop_len:int", "", f"""{Q.RECS}, {Q.SCORES}, {Q.ANCHOR},
c AS (SELECT rc.rec, n_frames, anchor_win * 50 + 25 AS c, {Q.uniform(f'{SEED}:crop', 'rc.rec')} AS u FROM rc JOIN an ON an.rec = rc.rec),
p AS (SELECT *, greatest(0, c - 300 + 100) AS lo, c - 50 + 1 AS hi FROM c)
SELECT rec, CASE WHEN n_frames > 300 THEN CAST(floor(greatest(0, least(lo + floor(u * (hi - lo)), n_frames - 300)) / 50) * 50 AS INTEGER) ELSE 0 END AS crop_start,
       CAST(least(n_frames, 300) AS INTEGER) AS crop_len FROM p""")
def anchored_crop(spark, d):
    recs = I.recordings(spark, d).join(W.rest_anchor(sensor_view(spark, d), I.RIG).select(
        "rec", "anchor_win"), "rec")
    return M.anchored_crop(recs, SEED, 300, I.RIG.window)
