"""SQL text fragments shared by the reference queries."""

from __future__ import annotations

SENSOR = """sv AS MATERIALIZED (
SELECT l_suppkey AS rec,
       CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey,
            l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax,
            l_returnflag, l_linestatus) - 1 AS INTEGER) AS frame,
       (l_quantity - 25.5) / 10 AS ax, ((l_discount + 0.0) - 0.05) * 20 AS ay,
       9.81 + ((l_tax + 0.0) - 0.04) * 20 AS az, ((l_discount + 0.0) - 0.05) * 4 AS wx,
       ((l_tax + 0.0) - 0.04) * 4 AS wy, (l_quantity - 25.5) / 50 AS wz,
       l_extendedprice / 20000 AS vx, l_quantity / 25 AS vy, (l_tax + 0.0) * 5 AS vz
FROM lineitem)"""

PLATFORM = """pf AS (
SELECT s_suppkey AS rec, r_name AS platform FROM supplier
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

VECTOR = """vv AS MATERIALIZED (
SELECT label AS rec, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER)
       AS frame,
       list_sum([CAST(embedding[i] AS DOUBLE) FOR i IN range(1, 65, 9)]) AS ax, list_sum([CAST(embedding[i] AS DOUBLE) FOR i IN range(2, 65, 9)]) AS ay,
       list_sum([CAST(embedding[i] AS DOUBLE) FOR i IN range(3, 65, 9)]) AS az, list_sum([CAST(embedding[i] AS DOUBLE) FOR i IN range(4, 65, 9)]) AS wx,
       list_sum([CAST(embedding[i] AS DOUBLE) FOR i IN range(5, 65, 9)]) AS wy, list_sum([CAST(embedding[i] AS DOUBLE) FOR i IN range(6, 65, 9)]) AS wz,
       list_sum([CAST(embedding[i] AS DOUBLE) FOR i IN range(7, 65, 9)]) AS vx, list_sum([CAST(embedding[i] AS DOUBLE) FOR i IN range(8, 65, 9)]) AS vy,
       list_sum([CAST(embedding[i] AS DOUBLE) FOR i IN range(9, 65, 9)]) AS vz
FROM embeddings)"""

EVENTS = """ev AS MATERIALIZED (
SELECT user_id AS rec, ts, event_id, event_type, value + 0.0 AS value,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame
FROM events)"""

MEANS = """wm AS MATERIALIZED (
SELECT rec, CAST(floor(frame / 50) AS INTEGER) AS win_idx, avg(ax) AS ax, avg(ay) AS ay,
       avg(az) AS az, avg(wx) AS wx, avg(wy) AS wy, avg(wz) AS wz, avg(vx) AS vx, avg(vy) AS vy,
       avg(vz) AS vz
FROM sv GROUP BY 1, 2 HAVING count(*) = 50)"""

SCORES = """sc AS MATERIALIZED (
SELECT rec, CAST(floor(frame / 50) AS INTEGER) AS win_idx,
       abs(avg(sqrt(ax*ax + ay*ay + az*az)) - 9.81) + avg(sqrt(wx*wx + wy*wy + wz*wz))
       + 0.5 * stddev_pop(sqrt(ax*ax + ay*ay + az*az)) AS score,
       avg(ax) AS fx, avg(ay) AS fy, avg(az) AS fz
FROM sv GROUP BY 1, 2 HAVING count(*) = 50)"""

ANCHOR = """an AS MATERIALIZED (
SELECT rec, win_idx AS anchor_win, score, fx, fy, fz, win_idx * 50 + 25 AS anchor_at
FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY score, win_idx) AS rk FROM sc)
WHERE rk = 1)"""

RUNS = [("alpha_s1", 0.1, 0.0), ("alpha_s2", 0.12, 1.0), ("beta_s1", 0.25, 0.0),
        ("beta_s2", 0.2, 1.0)]
_RUN_ROWS = ", ".join(f"('{t}', CAST({a} AS DOUBLE), CAST({p} AS DOUBLE))" for t, a, p in RUNS)

MATCHED = f"""mt AS MATERIALIZED (
SELECT r.tag, wm.rec, wm.win_idx, pf.platform, wm.vx AS vx_gt, wm.vy AS vy_gt, wm.vz AS vz_gt,
       wm.vx + r.amp * sin(wm.win_idx + r.phase) AS vx_pred,
       wm.vy + r.amp * sin(wm.win_idx + r.phase + 1) AS vy_pred,
       wm.vz + r.amp * sin(wm.win_idx + r.phase + 2) AS vz_pred
FROM wm JOIN pf ON wm.rec = pf.rec CROSS JOIN (VALUES {_RUN_ROWS}) AS r(tag, amp, phase)),
er AS MATERIALIZED (
SELECT *, sqrt((vx_pred-vx_gt)*(vx_pred-vx_gt) + (vy_pred-vy_gt)*(vy_pred-vy_gt)
               + (vz_pred-vz_gt)*(vz_pred-vz_gt)) AS err,
       sqrt(vx_gt*vx_gt + vy_gt*vy_gt + vz_gt*vz_gt) AS true_speed,
       sqrt(vx_pred*vx_pred + vy_pred*vy_pred + vz_pred*vz_pred) AS pred_speed
FROM mt)"""

PATHS = """st AS (
SELECT tag, platform, rec, win_idx,
       sum(vx_pred) OVER w AS cx, sum(vy_pred) OVER w AS cy, sum(vz_pred) OVER w AS cz,
       sum(vx_gt) OVER w AS gx, sum(vy_gt) OVER w AS gy, sum(vz_gt) OVER w AS gz
FROM mt WINDOW w AS (PARTITION BY tag, rec ORDER BY win_idx
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pe AS MATERIALIZED (
SELECT tag, platform, rec, count(*) AS n_steps,
       sqrt(var_pop(cx - gx) + var_pop(cy - gy) + var_pop(cz - gz) + 1e-8) AS ate
FROM st GROUP BY tag, platform, rec)"""

BASE = f"WITH {SENSOR}"
WINDOWS = f"{BASE}, {MEANS}"
REST = f"{BASE}, {SCORES}, {ANCHOR}"
EVAL = f"{WINDOWS}, {PLATFORM}, {MATCHED}"

RECS = f"""{BASE}, {PLATFORM},
rc AS MATERIALIZED (SELECT sv.rec, any_value(platform) AS platform, count(*) AS n_frames,
       CAST(floor(count(*) / 50) AS INTEGER) AS n_windows
FROM sv JOIN pf ON sv.rec = pf.rec GROUP BY sv.rec)"""


def norm(*c: str) -> str:
    return "sqrt(" + " + ".join(f"({x})*({x})" for x in c) + ")"


def dot(a, b) -> str:
    return "(" + " + ".join(f"({x})*({y})" for x, y in zip(a, b)) + ")"


def cross(a, b) -> tuple[str, str, str]:
    f = "(({0})*({1}) - ({2})*({3}))"
    return (f.format(a[1], b[2], a[2], b[1]), f.format(a[2], b[0], a[0], b[2]),
            f.format(a[0], b[1], a[1], b[0]))


def quat_mul(p, q) -> tuple[str, str, str, str]:
    px, py, pz, pw = p
    qx, qy, qz, qw = q
    return (f"({pw}*{qx} + {px}*{qw} + {py}*{qz} - {pz}*{qy})",
            f"({pw}*{qy} - {px}*{qz} + {py}*{qw} + {pz}*{qx})",
            f"({pw}*{qz} + {px}*{qy} - {py}*{qx} + {pz}*{qw})",
            f"({pw}*{qw} - {px}*{qx} - {py}*{qy} - {pz}*{qz})")


def quat_matrix(x, y, z, w) -> list[str]:
    """Entries of the matrix of a unit quaternion, row by row."""
    return [f"(1 - 2*({y}*{y} + {z}*{z}))", f"(2*({x}*{y} - {z}*{w}))", f"(2*({x}*{z} + {y}*{w}))",
            f"(2*({x}*{y} + {z}*{w}))", f"(1 - 2*({x}*{x} + {z}*{z}))", f"(2*({y}*{z} - {x}*{w}))",
            f"(2*({x}*{z} - {y}*{w}))", f"(2*({y}*{z} + {x}*{w}))", f"(1 - 2*({x}*{x} + {y}*{y}))"]


def rotvec_quat(v: tuple[str, str, str]) -> list[str]:
    n = norm(*v)
    k = f"(CASE WHEN {n} / 2 > 1e-12 THEN sin({n} / 2) / {n} ELSE 0.5 END)"
    return [f"(({c}) * {k})" for c in v] + [f"cos({n} / 2)"]


def matvec(m, v) -> tuple[str, str, str]:
    return tuple(f"({m[3*i]}*{v[0]} + {m[3*i+1]}*{v[1]} + {m[3*i+2]}*{v[2]})" for i in range(3))


def transpose(m):
    return [m[0], m[3], m[6], m[1], m[4], m[7], m[2], m[5], m[8]]


def uniform(seed: str, *keys: str) -> str:
    text = f"concat_ws('|', '{seed}', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")"
    return f"(CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def rotation_prefix(source: str, rate=("wx", "wy", "wz"), dt: str = "0.02",
                    keys: str = "rec") -> str:
    """CTEs dq and rq: running rotation from frame 0 as a recursive query."""
    turn = rotvec_quat(tuple(f"({c}*{dt})" for c in rate))
    ks = [k.strip() for k in keys.split(",")]
    head = ", ".join(ks)
    step = quat_mul(("r.x", "r.y", "r.z", "r.w"), ("d.x", "d.y", "d.z", "d.w"))
    on = " AND ".join(f"d.{k} = r.{k}" for k in ks)
    return f"""dq AS MATERIALIZED (SELECT {head}, frame, {turn[0]} AS x, {turn[1]} AS y,
       {turn[2]} AS z, {turn[3]} AS w FROM {source}),
rq AS (SELECT {head}, 0 AS frame, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y,
       CAST(0 AS DOUBLE) AS z, CAST(1 AS DOUBLE) AS w FROM {source} WHERE frame = 0
UNION ALL
SELECT {", ".join("r." + k for k in ks)}, r.frame + 1, {step[0]}, {step[1]}, {step[2]}, {step[3]}
FROM rq r JOIN dq d ON {on} AND d.frame = r.frame)"""


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)
