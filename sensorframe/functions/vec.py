"""Vector, rotation and quaternion algebra as Spark Column expressions.

A vector is a tuple of three Columns, a matrix a tuple of nine (row-major).
Everything stays inside whole-stage codegen: no UDF, no arrays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from sensorframe.params import GYRO_AXIS_MAP

Vec = tuple
Mat = tuple

ACC = ("ax", "ay", "az")
GYR = ("wx", "wy", "wz")
VEL = ("vx", "vy", "vz")
QUAT = ("qx", "qy", "qz", "qw")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def vec(*items) -> Vec:
    """Three column names, Columns or numbers as a vector."""
    return tuple(_col(x) for x in items)


def vec4(names):
    """Four columns as a quaternion (x, y, z, w)."""
    return tuple(_col(n) for n in names)


def mat(rows) -> Mat:
    """Nine entries (flat or three rows) as a matrix."""
    flat = [x for r in rows for x in (r if isinstance(r, (tuple, list)) else (r,))]
    return tuple(_col(x) for x in flat)


def mat_cols(prefix: str) -> tuple[str, ...]:
    return tuple(f"{prefix}{i}{j}" for i in range(3) for j in range(3))


def named(v, names) -> list[Column]:
    return [c.alias(n) for c, n in zip(v, names)]


def as_columns(v, names) -> dict[str, Column]:
    return dict(zip(names, v))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def scale(a: Vec, s) -> Vec:
    s = _col(s)
    return tuple(x * s for x in a)


def divide(a: Vec, s) -> Vec:
    s = _col(s)
    return tuple(x / s for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return reduce(lambda p, q: p + q, [x * y for x, y in zip(a, b)])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def at_least(c: Column, floor: float) -> Column:
    return F.greatest(c, F.lit(floor))


def unit(a: Vec, eps: float = 1e-6) -> Vec:
    n = at_least(norm(a), eps)
    return tuple(x / n for x in a)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def choose(cond: Column, a: Vec, b: Vec) -> Vec:
    return tuple(F.when(cond, x).otherwise(y) for x, y in zip(a, b))


# ---------------------------------------------------------------- matrices
def identity() -> Mat:
    return mat((1, 0, 0, 0, 1, 0, 0, 0, 1))


def transpose(m: Mat) -> Mat:
    return (m[0], m[3], m[6], m[1], m[4], m[7], m[2], m[5], m[8])


def matvec(m: Mat, v: Vec) -> Vec:
    return tuple(m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3))


def mat_t_vec(m: Mat, v: Vec) -> Vec:
    """Transpose times vector: carries a vector back through a rotation."""
    return matvec(transpose(m), v)


def matmul(a: Mat, b: Mat) -> Mat:
    return tuple(
        a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j]
        for i in range(3) for j in range(3))


def det(m: Mat) -> Column:
    return (m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6])
            + m[2] * (m[3] * m[7] - m[4] * m[6]))


# -------------------------------------------------------------- quaternions
def quat_matrix(q) -> Mat:
    """Quaternion (x, y, z, w) -> body-to-world matrix, normalised first."""
    n = F.sqrt(dot(q, q))
    return unit_quat_matrix(tuple(c / n for c in q))


def unit_quat_matrix(q) -> Mat:
    """The same for a quaternion that already has length one."""
    x, y, z, w = q
    return (1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
            2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
            2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y))


def quat_multiply(p, q):
    """Hamilton product of two (x, y, z, w) quaternions."""
    px, py, pz, pw = p
    qx, qy, qz, qw = q
    return (pw * qx + px * qw + py * qz - pz * qy,
            pw * qy - px * qz + py * qw + pz * qx,
            pw * qz + px * qy - py * qx + pz * qw,
            pw * qw - px * qx - py * qy - pz * qz)


def quat_conjugate(q):
    return (-q[0], -q[1], -q[2], q[3])


def quat_from_rotvec(v: Vec):
    """Rotation vector -> unit quaternion."""
    half = norm(v) / 2
    k = F.when(half > 1e-12, F.sin(half) / (half * 2)).otherwise(F.lit(0.5))
    return (v[0] * k, v[1] * k, v[2] * k, F.cos(half))


def gravity_in_body(q, down: tuple[float, float, float] = (0.0, 0.0, -1.0)) -> Vec:
    """Unit direction gravity pulls, seen from the body."""
    return unit(mat_t_vec(quat_matrix(q), vec(*down)), 1e-12)


# --------------------------------------------------------------- exponentials
def rotvec_matrix(v: Vec) -> Mat:
    """Rotation vector -> matrix (Rodrigues)."""
    th = at_least(norm(v), 1e-9)
    return axis_angle_matrix(divide(v, th), F.sin(th), F.cos(th))


def axis_angle_matrix(k: Vec, s: Column, c: Column) -> Mat:
    x, y, z = k
    d = 1 - c
    return (c + x * x * d, x * y * d - z * s, x * z * d + y * s,
            x * y * d + z * s, c + y * y * d, y * z * d - x * s,
            x * z * d - y * s, y * z * d + x * s, c + z * z * d)


def let(values, *steps):
    """Put the given Columns through ``steps`` (tuple to tuple); each value is computed once per row."""
    state = F.array(F.struct(*[c.alias(f"v{i}") for i, c in enumerate(values)]))
    width = len(values)
    for step in steps:
        sizes = []

        def inner(row, step=step, n=width, sizes=sizes):
            out = step(tuple(row[f"v{i}"] for i in range(n)))
            sizes.append(len(out))
            return F.struct(*[c.alias(f"v{i}") for i, c in enumerate(out)])
        state = _map(state, inner)
        width = sizes[0]
    return tuple(state[0][f"v{i}"] for i in range(width))


def _map(state: Column, inner) -> Column:
    return F.transform(state, lambda row: inner(row))


def _quat_steps():
    """Steps from a rotation matrix to its unit quaternion (x, y, z, w) with w >= 0.

    The squares of all four components follow from the diagonal; the largest one
    is safe to divide by, and the others come from sums and differences across it.
    """
    def rows(m):
        d, total = (m[0], m[4], m[8]), m[0] + m[4] + m[8]
        return (*[1 + 2 * c - total for c in d], 1 + total, m[1] + m[3], m[2] + m[6], m[5] + m[7],
                m[7] - m[5], m[2] - m[6], m[3] - m[1])

    def largest(v):
        xx, yy, zz, ww, xy, xz, yz, xw, yw, zw = v
        products = ((xx, xy, xz, xw), (xy, yy, yz, yw), (xz, yz, zz, zw), (xw, yw, zw, ww))
        most = F.greatest(xx, yy, zz, ww)
        return tuple(F.coalesce(*[F.when(v[i] == most, products[i][j]) for i in range(4)]) for j in range(4))

    def signed(q):
        size = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
        return tuple(c / F.when(q[3] < 0, -size).otherwise(size) for c in q)
    return rows, largest, signed


def matrix_rotvec(m: Mat) -> Vec:
    """Matrix -> rotation vector, through the quaternion: angle 2 * atan2(|v|, w) along v."""
    def turned(q):
        n = norm(q[:3])
        return scale(q[:3], F.when(n > 1e-12, 2 * F.atan2(n, q[3]) / n).otherwise(2.0))
    return let(m, *_quat_steps(), turned)


def six_to_matrix(a: Vec, b: Vec, offset: bool = True) -> Mat:
    """Two 3-vectors -> rotation by Gram-Schmidt; zeros give the identity."""
    a1 = add(a, vec(1, 0, 0)) if offset else a
    a2 = add(b, vec(0, 1, 0)) if offset else b
    b1 = unit(a1, 1e-6)
    b2 = unit(sub(a2, scale(b1, dot(b1, a2))), 1e-6)
    b3 = cross(b1, b2)
    return (b1[0], b2[0], b3[0], b1[1], b2[1], b3[1], b1[2], b2[2], b3[2])


# ----------------------------------------------------------------- directions
def angle_deg(a: Vec, b: Vec) -> Column:
    """Angle between two vectors in degrees, clamped against rounding."""
    n = at_least(norm(a) * norm(b), 1e-9)
    return F.degrees(F.acos(clip(dot(a, b) / n, -1.0, 1.0)))


def split_about(v: Vec, up: Vec) -> tuple[Column, Vec]:
    """Part of ``v`` along ``up`` (scalar) and the remaining perpendicular vector."""
    along = dot(v, up)
    return along, sub(v, scale(up, along))


def decompose_about_up(acc: Vec, gyr: Vec, up: Vec) -> dict[str, Column]:
    """Eight channels: vertical and horizontal force, yaw and tilt rate."""
    a_up, a_h = split_about(acc, up)
    w_up, w_h = split_about(gyr, up)
    return {"a_up": a_up, **as_columns(a_h, ("a_hx", "a_hy", "a_hz")),
            "w_up": w_up, **as_columns(w_h, ("w_hx", "w_hy", "w_hz"))}


def scale_horizontal(v: Vec, up: Vec, s) -> Vec:
    """Scale only the part of ``v`` perpendicular to ``up``."""
    along, rest = split_about(v, up)
    return add(scale(up, along), scale(rest, s))


def canonical_up_matrix(up: Vec) -> Mat:
    """Smallest rotation R that takes ``up`` to +z: R = I + [v]x + [v]x^2 / (1 + c), v = up x z, c = up . z.

    With v = (y, -x, 0) the matrix is written out. Within 1e-3 (fixed value) of
    the axis it is the identity, or half a turn about x when upside down.
    """
    def closed(v):
        x, y, c = v
        near = F.sqrt(x * x + y * y) < 1e-3
        k = 1 / at_least(1 + c, 1e-12)
        free = (1 - k * x * x, -k * x * y, -x, -k * x * y, 1 - k * y * y, -y, x, y, c)
        flip = F.when(c < 0, -1.0).otherwise(1.0)
        zero = F.lit(0.0)
        return tuple(F.when(near, n).otherwise(f) for n, f in zip((F.lit(1.0), zero, zero, zero, flip, zero, zero, zero, flip), free))
    return let(unit(up, 1e-9), closed)


def upright_basis(up: Vec) -> Mat:
    """Rows are an orthonormal basis whose third axis is ``up``; heading is free."""
    z = unit(up, 1e-8)
    ref = choose(F.abs(z[0]) < 0.9, vec(1, 0, 0), vec(0, 1, 0))
    x = unit(cross(ref, z), 1e-8)
    return (*x, *cross(z, x), *z)


def split_rate(w: Vec, a: Vec, eps: float = 1e-8) -> tuple[Vec, Vec]:
    """Write an angular rate as a pair of true vectors whose cross product it is.

    Any two perpendicular vectors of length sqrt(|w|) across w will do. The first
    is the horizontal one, z x w; for a vertical rate it is across the force, and
    for one along the force across x. The second completes the pair.
    """
    def across(v):
        w, a = v[:3], v[3:]
        crossed = [cross(axis, w) for axis in (vec(0, 0, 1), a, vec(-1, 0, 0))]
        usable = [F.when(norm(c) > eps, F.struct(*[x.alias(n) for x, n in zip(c, "xyz")])) for c in crossed]
        return (*w, F.coalesce(*usable, F.struct(*[F.lit(0.0).alias(n) for n in "xyz"])))

    def one(v):
        return (*v[:3], *unit(tuple(v[3][n] for n in "xyz"), eps))

    def both(v):
        root = F.sqrt(at_least(norm(v[:3]), eps))
        return (*scale(v[3:], root), *scale(unit(cross(v[:3], v[3:]), eps), root))
    out = let((*w, *a), across, one, both)
    return out[:3], out[3:]


def transform_axes(v: Vec, m: Mat, kind: str = "polar") -> Vec:
    """Change axes; an angular rate (``axial``) also picks up det(m)."""
    if kind not in ("polar", "axial"):
        raise ValueError(f"kind must be polar or axial, not {kind!r}")
    out = matvec(m, v)
    return scale(out, det(m)) if kind == "axial" else out


# ---------------------------------------------------------------- calibration
def calibrate_force(acc: Vec, gain: Vec, bias: Vec) -> Vec:
    """Remove the bias, then divide by the per-axis gain."""
    return tuple((a - b) / s for a, b, s in zip(acc, bias, gain))


def flip_gyro(gyr: Vec, flip: Column) -> Vec:
    """Fixed axis change for recordings whose gyro sits in the other frame."""
    return choose(flip, matvec(mat(GYRO_AXIS_MAP), gyr), gyr)


def flip_rule(logit: Column, kept_residual: Column, mapped_residual: Column) -> Column:
    """Flip only when the classifier is sure and the consistency residual agrees."""
    return (logit > 2.0) & (mapped_residual < kept_residual)


def calibration_deviation(gain: Vec, bias: Vec, logit: Column) -> Column:
    """How far a recording's calibration is from clean, in tolerances."""
    worst = F.greatest(*[F.abs(s - 1) for s in gain])
    return worst / 0.05 + norm(bias) / 0.5 + (1 - F.abs(F.tanh(logit / 2)))


# ---------------------------------------------------------------------- losses
def squash(c: Column, q: float) -> Column:
    """Soft bound: q * tanh(c / q)."""
    return q * F.tanh(c / q)


def vector_huber(a: Vec, b: Vec, beta: float = 0.25) -> Column:
    e = norm(sub(a, b))
    return F.when(e < beta, 0.5 * e * e / beta).otherwise(e - 0.5 * beta)


def cosine_distance(a: Vec, b: Vec, eps: float = 1e-8) -> Column:
    return 1 - dot(a, b) / (at_least(norm(a), eps) * at_least(norm(b), eps))


def logistic(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def gated_blend(direct: Vec, other: Vec, logit) -> Vec:
    """Move from ``direct`` toward ``other`` by the logistic of ``logit``."""
    gate = logistic(_col(logit))
    return tuple(d + gate * (o - d) for d, o in zip(direct, other))
