"""Queries: vector, rotation and calibration algebra on frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe.functions import vec as V
from sensorframe.operators import summary as S
from sensorframe.operators import windows as W
from sensorframe.sources.views import sensor_view
from workload import inputs as I
from workload import sql as Q
from workload.registry import query

_WIN = "CAST(floor(frame / 50) AS INTEGER) AS win_idx"
_UNITQ = """pq AS (SELECT rec, frame, ax, ay, az, vx, vy, vz, wx / n AS x, wy / n AS y, wz / n AS z,
1 / n AS w FROM (SELECT *, sqrt(wx*wx + wy*wy + wz*wz + 1) AS n FROM sv))"""


def _avg(names, exprs):
    return ", ".join(f"avg({e}) AS {n}" for n, e in zip(names, exprs))


def _by_window(exprs, names, source="sv", ctes=""):
    return f"""{Q.BASE}{ctes} SELECT rec, {_WIN}, {_avg(names, exprs)} FROM {source}
GROUP BY 1, 2 HAVING count(*) = 50"""


_M = Q.quat_matrix("x", "y", "z", "w")
KEYS = "rec:bigint win_idx:int"


@query("gravity_body", KEYS, "gx gy gz", _by_window(
    [f"-{_M[6]}", f"-{_M[7]}", f"-{_M[8]}"], ("gx", "gy", "gz"), "pq", f", {_UNITQ}"))
def gravity_body(spark, d):
    g = V.gravity_in_body(V.vec4(V.QUAT))
    return W.window_means(I.posed(spark, d), V.as_columns(g, ("gx", "gy", "gz")), I.RIG)


@query("quat_rotate", KEYS, "b0 b1 b2", _by_window(
    Q.matvec(_M, ("vx", "vy", "vz")), ("b0", "b1", "b2"), "pq", f", {_UNITQ}"))
def quat_rotate(spark, d):
    v = V.matvec(V.quat_matrix(V.vec4(V.QUAT)), V.vec(*V.VEL))
    return W.window_means(I.posed(spark, d), V.as_columns(v, ("b0", "b1", "b2")), I.RIG)


_AGREE = f"""(ax * {_M[6]} + ay * {_M[7]} + az * {_M[8]}) / sqrt(ax*ax + ay*ay + az*az)"""


@query("truth_up", "rec:bigint choice:int", "agreement ux uy uz", f"""{Q.BASE}, {_UNITQ},
ex AS (SELECT rec, avg({_AGREE}) FILTER (abs(sqrt(ax*ax + ay*ay + az*az) - 9.81) < 0.5) AS ab,
avg((ax * {_M[7]} - ay * {_M[6]} + az * {_M[8]}) / sqrt(ax*ax + ay*ay + az*az))
FILTER (abs(sqrt(ax*ax + ay*ay + az*az) - 9.81) < 0.5) AS am,
count(*) FILTER (abs(sqrt(ax*ax + ay*ay + az*az) - 9.81) < 0.5) AS n FROM pq GROUP BY rec),
ch AS (SELECT rec, CASE WHEN n <= 50 THEN 0 WHEN am >= -am AND am >= ab AND am >= -ab THEN 0
       WHEN -am >= ab AND -am >= -ab THEN 1 WHEN ab >= -ab THEN 2 ELSE 3 END AS choice,
       CASE WHEN n <= 50 THEN 0 ELSE greatest(am, -am, ab, -ab) END AS agreement FROM ex)
SELECT pq.rec, choice, agreement,
       avg(CASE choice WHEN 0 THEN {_M[7]} WHEN 1 THEN -{_M[7]} WHEN 2 THEN {_M[6]} ELSE -{_M[6]} END) AS ux,
       avg(CASE choice WHEN 0 THEN -{_M[6]} WHEN 1 THEN {_M[6]} WHEN 2 THEN {_M[7]} ELSE -{_M[7]} END) AS uy,
       avg(CASE WHEN choice % 2 = 0 THEN {_M[8]} ELSE -{_M[8]} END) AS uz
FROM pq JOIN ch ON pq.rec = ch.rec GROUP BY 1, 2, 3""")
def truth_up(spark, d):
    """Mounting rotation: a quarter turn about z, the same for every recording."""
    f = I.posed(spark, d)
    quarter = V.mat(((0, -1, 0), (1, 0, 0), (0, 0, 1)))
    ext = f.select("rec").distinct().select("rec", *V.named(quarter, V.mat_cols("e")))
    up = S.truth_up(f, ext, I.RIG)
    return up.groupBy("rec", "choice", "agreement").agg(
        *[F.avg(c).alias(c) for c in ("ux", "uy", "uz")])


@query("rotvec_round_trip", KEYS, "lx ly lz gap", _by_window(
    ("wx", "wy", "wz", "0.0"), ("lx", "ly", "lz", "gap")))
def rotvec_round_trip(spark, d):
    """Exponential then logarithm gives the rotation vector back."""
    f = sensor_view(spark, d)
    m = V.rotvec_matrix(V.vec(*V.GYR))
    f = f.withColumns(V.as_columns(m, V.mat_cols("r")))
    back = V.matrix_rotvec(V.mat(V.mat_cols("r")))
    f = f.withColumns(V.as_columns(back, ("lx", "ly", "lz")))
    gap = V.norm(V.sub(V.vec("lx", "ly", "lz"), V.vec(*V.GYR)))
    return W.window_means(f, {"lx": "lx", "ly": "ly", "lz": "lz", "gap": gap}, I.RIG)


@query("gram_schmidt", KEYS, "m00 m10 m20 m01 m11 m21 m02 m12 m22", f"""{Q.BASE},
a AS (SELECT rec, frame, (wx + 1) / n AS p, wy / n AS q, wz / n AS r, ax / 10 AS u, ay / 10 + 1 AS v,
      az / 10 AS t FROM (SELECT *, sqrt((wx+1)*(wx+1) + wy*wy + wz*wz) AS n FROM sv)),
b AS (SELECT *, u - dt*p AS u2, v - dt*q AS v2, t - dt*r AS t2 FROM (SELECT *, p*u + q*v + r*t AS dt FROM a)),
c AS (SELECT *, u2/n AS i, v2/n AS j, t2/n AS k FROM (SELECT *, sqrt(u2*u2 + v2*v2 + t2*t2) AS n FROM b))
SELECT rec, {_WIN}, avg(p) AS m00, avg(q) AS m10, avg(r) AS m20, avg(i) AS m01, avg(j) AS m11,
       avg(k) AS m21, avg(q*k - r*j) AS m02, avg(r*i - p*k) AS m12, avg(p*j - q*i) AS m22
FROM c GROUP BY 1, 2 HAVING count(*) = 50""")
def gram_schmidt(spark, d):
    m = V.six_to_matrix(V.vec(*V.GYR), V.divide(V.vec(*V.ACC), 10))
    return W.window_means(sensor_view(spark, d), V.as_columns(m, V.mat_cols("m")), I.RIG)


_UPV = ("vx / vn", "vy / vn", "vz / vn")
_WITHV = ", uv AS (SELECT *, sqrt(vx*vx + vy*vy + vz*vz) AS vn FROM sv)"


@query("decompose_up", KEYS, "a_up a_hx a_hy a_hz w_up w_hx w_hy w_hz", _by_window(
    [Q.dot(("ax", "ay", "az"), _UPV)]
    + [f"{c} - {Q.dot(('ax', 'ay', 'az'), _UPV)} * {u}" for c, u in zip(("ax", "ay", "az"), _UPV)]
    + [Q.dot(("wx", "wy", "wz"), _UPV)]
    + [f"{c} - {Q.dot(('wx', 'wy', 'wz'), _UPV)} * {u}" for c, u in zip(("wx", "wy", "wz"), _UPV)],
    ("a_up", "a_hx", "a_hy", "a_hz", "w_up", "w_hx", "w_hy", "w_hz"), "uv", _WITHV))
def decompose_up(spark, d):
    parts = V.decompose_about_up(V.vec(*V.ACC), V.vec(*V.GYR), V.unit(V.vec(*V.VEL)))
    return W.window_means(sensor_view(spark, d), parts, I.RIG)


@query("canonical_up", KEYS, "ux uy uz ax", f"""{Q.WINDOWS},
u AS (SELECT rec, win_idx, ax AS fax, ay AS fay, az AS faz, n, vx / n AS x, vy / n AS y, vz / n AS z
      FROM (SELECT *, sqrt(vx*vx + vy*vy + vz*vz) AS n FROM wm)),
k AS (SELECT *, sqrt(y*y + x*x) AS s FROM u)
SELECT rec, win_idx, 0.0 AS ux, 0.0 AS uy, n AS uz,
       fax * (z + (y/s)*(y/s)*(1-z)) + fay * ((y/s)*(-x/s)*(1-z)) + faz * ((-x/s)*s) AS ax FROM k""")
def canonical_up(spark, d):
    """Every window is turned so that its mean direction lands on +z."""
    from sensorframe.plans.features import canonical_frames
    turned = canonical_frames(sensor_view(spark, d), V.VEL, I.RIG)
    return W.window_means(turned, {"ux": "vx", "uy": "vy", "uz": "vz", "ax": "ax"}, I.RIG)


@query("upright_basis", KEYS, "x0 x1 x2 y0 y1 y2", f"""{Q.BASE},
z AS (SELECT rec, frame, ax/fn AS a, ay/fn AS b, az/fn AS c FROM
      (SELECT *, sqrt(ax*ax + ay*ay + az*az) AS fn FROM sv)),
x AS (SELECT *, CASE WHEN abs(a) < 0.9 THEN 0 ELSE c END AS p, CASE WHEN abs(a) < 0.9 THEN -c ELSE 0 END AS q,
      CASE WHEN abs(a) < 0.9 THEN b ELSE -a END AS r FROM z),
n AS (SELECT rec, frame, a, b, c, p/l AS p, q/l AS q, r/l AS r FROM (SELECT *, sqrt(p*p + q*q + r*r) AS l FROM x))
SELECT rec, {_WIN}, avg(p) AS x0, avg(q) AS x1, avg(r) AS x2, avg(b*r - c*q) AS y0, avg(c*p - a*r) AS y1,
       avg(a*q - b*p) AS y2 FROM n GROUP BY 1, 2 HAVING count(*) = 50""")
def upright_basis(spark, d):
    b = V.upright_basis(V.vec(*V.ACC))
    names = ("x0", "x1", "x2", "y0", "y1", "y2", "z0", "z1", "z2")
    return W.window_means(sensor_view(spark, d), V.as_columns(b, names), I.RIG)


_FORCED = ("(ay*wz - az*wy)", "(az*wx - ax*wz)", "(ax*wy - ay*wx)")
_ROOT = "sqrt(greatest(sqrt(wx*wx + wy*wy + wz*wz), 1e-8))"


def _unit_case(i):
    """Component i of the first vector: across z, else across the force, else across x."""
    out = "0"
    for v in (("0", "wz", "(-wy)"), _FORCED, ("(-wy)", "wx", "0")):
        size = f"sqrt({' + '.join(f'{c}*{c}' for c in v)})"
        out = f"CASE WHEN {size} > 1e-8 THEN {v[i]} / {size} ELSE {out} END"
    return out


_FIRST = [_unit_case(i) for i in range(3)]
_ACROSS = [f"(w{p}*({_FIRST[b]}) - w{q}*({_FIRST[a]}))" for p, q, a, b in (("y", "z", 1, 2), ("z", "x", 2, 0), ("x", "y", 0, 1))]
_SIZE = f"greatest(sqrt({' + '.join(f'{c}*{c}' for c in _ACROSS)}), 1e-8)"


@query("split_rate", KEYS, "a0 a1 a2 b0 b1 b2 px py pz", _by_window(
    (*[f"({c}) * {_ROOT}" for c in _FIRST], *[f"{c} / {_SIZE} * {_ROOT}" for c in _ACROSS], "wx", "wy", "wz"),
    ("a0", "a1", "a2", "b0", "b1", "b2", "px", "py", "pz")))
def split_rate(spark, d):
    """Both vectors, and that their cross product is the rate again."""
    a, b = V.split_rate(V.vec(*V.GYR), V.vec(*V.ACC))
    f = sensor_view(spark, d).withColumns({
        **V.as_columns(a, ("a0", "a1", "a2")), **V.as_columns(b, ("b0", "b1", "b2"))})
    back = V.cross(V.vec("a0", "a1", "a2"), V.vec("b0", "b1", "b2"))
    # a still frame has no rate to split; both sides give (almost) nothing there
    return W.window_means(f, {**{c: F.col(c) for c in ("a0", "a1", "a2", "b0", "b1", "b2")},
                              **V.as_columns(back, ("px", "py", "pz"))}, I.RIG)


@query("mirror_axes", KEYS, "ax ay az wx wy wz lx ly lz", _by_window(
    ("-ax", "ay", "az", "wx", "-wy", "-wz", "vx", "-vy", "vz"),
    ("ax", "ay", "az", "wx", "wy", "wz", "lx", "ly", "lz")))
def mirror_axes(spark, d):
    """Mirror of x: forces flip x, rates flip y and z; the label is seen through a quarter turn."""
    mirror = V.mat(((-1, 0, 0), (0, 1, 0), (0, 0, 1)))
    quarter = V.mat(((0, -1, 0), (1, 0, 0), (0, 0, 1)))
    acc = V.transform_axes(V.vec(*V.ACC), mirror)
    gyr = V.transform_axes(V.vec(*V.GYR), mirror, "axial")
    lab = V.matvec(V.matmul(V.matmul(quarter, mirror), V.transpose(quarter)), V.vec(*V.VEL))
    return W.window_means(sensor_view(spark, d), {
        **V.as_columns(acc, V.ACC), **V.as_columns(gyr, V.GYR),
        **V.as_columns(lab, ("lx", "ly", "lz"))}, I.RIG)


@query("vector_angles", KEYS, "angle cosine", _by_window(
    (f"degrees(acos(least(1, greatest(-1, {Q.dot(('ax', 'ay', 'az'), ('vx', 'vy', 'vz'))} / ({Q.norm('ax', 'ay', 'az')} * {Q.norm('vx', 'vy', 'vz')})))))",
     f"1 - {Q.dot(('ax', 'ay', 'az'), ('vx', 'vy', 'vz'))} / ({Q.norm('ax', 'ay', 'az')} * {Q.norm('vx', 'vy', 'vz')})"),
    ("angle", "cosine")))
def vector_angles(spark, d):
    a, v = V.vec(*V.ACC), V.vec(*V.VEL)
    return W.window_means(sensor_view(spark, d), {
        "angle": V.angle_deg(a, v), "cosine": V.cosine_distance(a, v)}, I.RIG)


@query("squash_clip", KEYS, "squashed logged clipped", _by_window(
    ("8 * tanh(vx * 10 / 8)", "ln(1 + vx)", "least(greatest(ax, -1.5), 1.5)"),
    ("squashed", "logged", "clipped")))
def squash_clip(spark, d):
    return W.window_means(sensor_view(spark, d), {
        "squashed": V.squash(F.col("vx") * 10, 8.0), "logged": F.log1p("vx"),
        "clipped": V.clip(F.col("ax"), -1.5, 1.5)}, I.RIG)


@query("gated_blend", KEYS, "b0 b1 b2", _by_window(
    [f"{p} + (1 / (1 + exp(-wz * 4))) * ({q} - {p})" for p, q in
     (("vx", "ax"), ("vy", "ay"), ("vz", "az"))], ("b0", "b1", "b2")))
def gated_blend(spark, d):
    b = V.gated_blend(V.vec(*V.VEL), V.vec(*V.ACC), F.col("wz") * 4)
    return W.window_means(sensor_view(spark, d), V.as_columns(b, ("b0", "b1", "b2")), I.RIG)


@query("flip_rule", "rec:bigint flip:boolean", "", f"""{Q.WINDOWS}
SELECT rec, avg(ax) * 20 > 2.0 AND avg(wy) < avg(wx) AS flip FROM wm GROUP BY rec""")
def flip_rule(spark, d):
    m = I.means(spark, d).groupBy("rec").agg(*[F.avg(c).alias(c) for c in ("ax", "wx", "wy")])
    return m.select("rec", V.flip_rule(F.col("ax") * 20, F.col("wx"), F.col("wy")).alias("flip"))
