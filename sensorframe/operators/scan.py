"""Running products and recursions along a recording.

Rotations and rotated force sums form one associative state: every block is
reduced to one row, the block rows are combined in levels, and each block is
replayed from its start state, so a recording of any length is spread over
tasks. The up-direction filters are true recursions; their blocks run from
guessed starts with the derivative of the end by the start, and the true starts
are solved over all blocks at once until they stand still.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorframe.functions import vec as V
from sensorframe.operators.blocks import BLOCK, block_of, prefix_sums
from sensorframe.operators.grouped import give_back, map_groups, positions, running_sum, spread
from sensorframe.operators.windows import rest_reference, with_window
from sensorframe.params import (ADAPTIVE_GAIN, ADAPTIVE_SIGMA, DEFAULT_RIG, GYRO_AXIS_MAP,
                                SLOW_GAIN, VELOCITY_SQUASH, Rig)
from sensorframe.session import cut_lineage, write_bucketed

ROTATION = V.mat_cols("r")
SCAN_BLOCK = 4096
SCAN_FAN_OUT = 4096
Q = ("_qx", "_qy", "_qz", "_qw")


def _crossed(a, b):
    """Cross product of two triples of arrays."""
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _quat_mul(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    *pv, pw = p.T
    *qv, qw = q.T
    out = np.empty((len(p), 4))
    for i, turned in enumerate(_crossed(pv, qv)):
        out[:, i] = pw * qv[i] + qw * pv[i] + turned
    out[:, 3] = pw * qw - (pv[0] * qv[0] + pv[1] * qv[1] + pv[2] * qv[2])
    return out


def _doubled(q: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Inclusive running product inside each group: some log2(longest) products for every row."""
    out, step, longest = q.copy(), 1, int(place.max()) + 1 if len(q) else 0
    while step < longest:
        rows = np.flatnonzero(place >= step)
        out[rows] = _quat_mul(out[rows - step], out[rows])
        step *= 2
    return out


def running_product(q: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Inclusive running product of unit quaternions inside each group.

    ``place`` counts rows inside their group, so a row only takes in rows of its
    own group. Groups are cut into short runs that are multiplied side by side;
    the runs' products are combined by doubling, so a row costs about two products.
    """
    groups = np.count_nonzero(place == 0)
    run = int(np.sqrt(len(q) / groups)) if groups else 0
    if run < 4:
        out = _doubled(q, place)
    else:
        out, starts = q.copy(), np.flatnonzero(place % run == 0)
        sizes = np.diff(np.append(starts, len(q)))
        for i in range(1, run):
            rows = starts[sizes > i] + i
            out[rows] = _quat_mul(out[rows - 1], out[rows])
        whole = _doubled(out[starts + sizes - 1], place[starts] // run)
        rows = np.flatnonzero(place >= run)
        out[rows] = _quat_mul(whole[np.repeat(np.arange(len(starts)), sizes)[rows] - 1], out[rows])
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _rec_type(df: DataFrame) -> str:
    return df.schema["rec"].dataType.simpleString()


def _rotate(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Turn vectors by unit quaternions, row by row."""
    *u, s = q.T
    c = _crossed(u, v.T)
    out = np.empty((len(v), 3))
    for i, turned in enumerate(_crossed(u, c)):
        out[:, i] = v[:, i] + 2 * (s * c[i] + turned)
    return out


NO_TURN = np.array([0.0, 0.0, 0.0, 1.0])


def _turns(w: np.ndarray, dt: float) -> np.ndarray:
    """Quaternion of every frame's turn from its angular rate."""
    v = w * dt
    half = np.linalg.norm(v, axis=-1, keepdims=True) / 2
    k = np.where(half > 1e-12, np.sin(half) / np.maximum(2 * half, 1e-300), 0.5)
    return np.concatenate([v * k, np.cos(half)], axis=-1)


def _table(left: pd.DataFrame, names, values: np.ndarray) -> pd.DataFrame:
    cols = {c: left[c].to_numpy() for c in left.columns}
    cols.update({n: values[:, i] for i, n in enumerate(names)})
    return pd.DataFrame(cols)


def _before(q: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The running product before each row."""
    out = np.tile(NO_TURN, (len(q), 1))
    rows = np.flatnonzero(place > 0)
    out[rows] = q[rows - 1]
    return out


def _states(q_step: np.ndarray, f: np.ndarray, bounds: np.ndarray):
    """State (rotation, rotated sum) before each row, and after each row's step."""
    place = positions(bounds)
    after = running_product(q_step, place)
    before = _before(after, place)
    lifted = _rotate(before, f)
    sums = running_sum(lifted, bounds)
    return before, sums, after, sums + lifted


S = ("_sx", "_sy", "_sz")
A = ("_aqx", "_aqy", "_aqz", "_aqw", "_asx", "_asy", "_asz")
_STATE = ", ".join(f"{c} double" for c in (*Q, *S))


def _block_totals(frames: DataFrame, keys: list[str], dt: float) -> DataFrame:
    """One row per block: its whole turn and force sum, and both at the anchor frame."""
    types = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in (*keys, BLOCK)] + [_STATE] + [
        f"{c} double" for c in A])

    def run(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        q, s, q1, s1 = _states(_turns(pdf[list(V.GYR)].to_numpy(float), dt),
                               pdf[list(V.ACC)].to_numpy(float), bounds)
        last = bounds[1:] - 1
        here = np.full((len(last), 7), np.nan)
        at = np.flatnonzero(pdf["frame"].to_numpy() == pdf["anchor_at"].to_numpy())
        here[np.searchsorted(bounds, at, side="right") - 1] = np.concatenate(
            [q[at], s[at]], axis=1)
        return _table(pdf[[*keys, BLOCK]].iloc[last], (*Q, *S, *A), np.concatenate(
            [q1[last], s1[last], here], axis=1))
    return map_groups(frames, [*keys, BLOCK], ["frame"], run, schema)


def _prefix_states(totals: DataFrame, group: list[str], order: str) -> DataFrame:
    """State before each row of a bounded group (b_*), and the group's total."""
    types = {f.name: f.dataType.simpleString() for f in totals.schema.fields}
    before = [f"_b{c}" for c in (*Q, *S)]

    def run(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        q, s, q1, s1 = _states(pdf[list(Q)].to_numpy(float), pdf[list(S)].to_numpy(float), bounds)
        last = bounds[1:] - 1
        total = spread(np.concatenate([q1[last], s1[last]], axis=1), bounds)
        out = _table(pdf[[*group, order]], (*before, *Q, *S),
                     np.concatenate([q, s, total], axis=1))
        out["_closes"] = False
        out.loc[last, "_closes"] = True
        return out
    schema = ", ".join([f"{g} {types[g]}" for g in (*group, order)]
                       + [f"{c} double" for c in before] + [_STATE, "_closes boolean"])
    return map_groups(totals.select(*group, order, *Q, *S), group, [order], run, schema)


def _after(q0, s0, q1, s1):
    """State after running (q1, s1) from state (q0, s0)."""
    return (*V.quat_multiply(q0, q1), *V.add(s0, V.matvec(V.unit_quat_matrix(q0), s1)))


def _block_starts(totals: DataFrame, keys: list[str], fan_out: int) -> DataFrame:
    """State at the start of every block; needs no more than fan_out rows per group."""
    names = [f"_b{c}" for c in (*Q, *S)]
    longest = totals.agg(F.max(BLOCK)).first()[0] or 0
    if longest < fan_out:
        return _prefix_states(totals, keys, BLOCK).select(*keys, BLOCK, *names)
    tagged = totals.withColumn("_super", F.floor(F.col(BLOCK) / fan_out))
    middle = cut_lineage(_prefix_states(tagged, [*keys, "_super"], BLOCK))
    top = _prefix_states(middle.where("_closes"), keys, "_super").select(
        *keys, "_super", *[F.col(n).alias(f"_t{n}") for n in names])
    state = _after(V.vec4([f"_t_b{c}" for c in Q]), V.vec(*[f"_t_b{c}" for c in S]),
                   V.vec4([f"_b{c}" for c in Q]), V.vec(*[f"_b{c}" for c in S]))
    return middle.join(top, [*keys, "_super"]).select(*keys, BLOCK, *V.named(state, names))


_STARTS = [f"_b{c}" for c in (*Q, *S)]


def _start() -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    return V.vec4(_STARTS[:4]), V.vec(*_STARTS[4:])


def _at_anchor(totals: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """State (``_z*``) at the anchor frame."""
    return totals.where(F.col(A[0]).isNotNull() & ~F.isnan(A[0])).join(starts, [*keys, BLOCK]).select(*keys, *V.named(
        _after(*_start(), V.vec4(A[:4]), V.vec(*A[4:])), [f"_z{c}" for c in (*Q, *S)]))


def _moved_starts() -> list[Column]:
    """Start states as seen from the state at the anchor."""
    (bq, bs), zq, zs = _start(), V.vec4([f"_z{c}" for c in Q]), V.vec(*[f"_z{c}" for c in S])
    return V.named((*V.quat_multiply(V.quat_conjugate(zq), bq),
                    *V.mat_t_vec(V.unit_quat_matrix(zq), V.sub(bs, zs))), _STARTS)


def anchored_states(frames: DataFrame, anchors: DataFrame, rig: Rig = DEFAULT_RIG,
                    group: tuple[str, ...] = (), keep: tuple[str, ...] = (),
                    block: int = SCAN_BLOCK, fan_out: int = SCAN_FAN_OUT) -> DataFrame:
    """Rotation to the anchor frame and force summed from the anchor, for every frame.

    Both are one associative running state. Pass 1 reduces every block to one
    row; the few block rows are combined in at most two levels and moved to the
    anchor; pass 2 replays each block from its start state. Frames are read
    twice and a task never holds more than one block. Returns the quaternion
    _qx.._qw, the force sum _sx.._sz (anchor frame) and ``anchor_at``.
    """
    keys = ["rec", *group]
    spot = anchors.select("rec", "anchor_at")
    base = frames.select(*keys, "frame", *V.ACC, *V.GYR, *keep).withColumn(
        BLOCK, block_of("frame", block)).join(spot, "rec")
    totals = cut_lineage(_block_totals(base, keys, rig.dt))
    starts = _block_starts(totals, keys, fan_out)
    starts = starts.join(_at_anchor(totals, starts, keys), keys).select(*keys, BLOCK, *_moved_starts())
    types = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    held = [*keys, "frame", "anchor_at", *keep]
    schema = ", ".join([f"{c} {types[c]}" for c in held] + [_STATE])
    dt = rig.dt

    def replay(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        # the first row of a group is its start state, the frames follow
        head = pdf[[f"_b{c}" for c in (*Q, *S)]].to_numpy(float)[bounds[:-1]]
        rows = np.ones(len(pdf), bool)
        rows[bounds[:-1]] = False
        inner = bounds - np.arange(len(bounds))
        pdf = pdf[rows].reset_index(drop=True)
        q, s, _, _ = _states(_turns(pdf[list(V.GYR)].to_numpy(float), dt),
                             pdf[list(V.ACC)].to_numpy(float), inner)
        head = spread(head, inner)
        q0, s0 = head[:, :4], head[:, 4:]
        left = pdf[held].astype({"frame": "int64", "anchor_at": "int64"})
        return _table(left, (*Q, *S), np.concatenate(
            [_quat_mul(q0, q), s0 + _rotate(q0, s)], axis=1))
    # start states travel as one header row per block, so frames are shuffled once
    headers = starts.withColumn("frame", F.lit(-1))
    return map_groups(base.unionByName(headers, allowMissingColumns=True), [*keys, BLOCK],
                      ["frame"], replay, schema)


def attitude(frames: DataFrame, anchors: DataFrame, rig: Rig = DEFAULT_RIG,
             group: tuple[str, ...] = (), block: int = SCAN_BLOCK,
             fan_out: int = SCAN_FAN_OUT) -> DataFrame:
    """Rotation r00..r22 from every frame to the rest anchor's frame.

    Frames after the anchor use the product of the turns in between, frames
    before it the inverse. ``group`` adds keys (for example a candidate axis
    map) that each get their own product.
    """
    states = anchored_states(frames, anchors, rig, group, (), block, fan_out)
    return states.select("rec", *group, "frame",
                         *V.named(V.unit_quat_matrix(V.vec4(Q)), ROTATION))


def attitude_small_angle(frames: DataFrame, anchors: DataFrame, rig: Rig = DEFAULT_RIG,
                         bias: tuple[Column, ...] | None = None,
                         correction: tuple[Column, ...] | None = None,
                         step: int = 5, block: int = SCAN_BLOCK) -> DataFrame:
    """Attitude with turns summed (not composed) inside short steps.

    Cheaper variant: rotation vectors are added inside ``step`` frames and only
    the step totals are composed. A gyro bias and a correction rate may be given.
    """
    w = V.vec(*V.GYR)
    if bias is not None:
        w = V.sub(w, bias)
    if correction is not None:
        w = V.add(w, correction)
    names = ("_tx", "_ty", "_tz")
    cells = frames.select("rec", "frame", *V.named(V.scale(w, rig.dt), names)).withColumn(
        "_cell", F.floor(F.col("frame") / step).cast("bigint"))
    spec = (Window.partitionBy("rec", "_cell").orderBy("frame")
            .rowsBetween(Window.unboundedPreceding, -1))
    inside = cells.select("rec", "frame", "_cell", *[
        F.coalesce(F.sum(n).over(spec), F.lit(0.0)).alias(n) for n in names])
    totals = cells.groupBy("rec", F.col("_cell").alias("frame")).agg(
        *[(F.sum(n) * rig.fs).alias(g) for n, g in zip(names, V.GYR)],
        *[F.lit(0.0).alias(a) for a in V.ACC])
    anchors = cut_lineage(anchors.select("rec", "anchor_at"))
    # states are anchored at the cell that holds the anchor, then at the frame itself
    cell_anchor = anchors.select("rec", F.floor(F.col("anchor_at") / step).cast("bigint")
                                 .alias("anchor_at"))
    coarse = anchored_states(totals, cell_anchor, rig, block=block).select(
        "rec", F.col("frame").alias("_cell"), *Q)
    run = inside.join(coarse, ["rec", "_cell"]).select("rec", "frame", *V.named(
        V.quat_multiply(V.vec4(Q), V.quat_from_rotvec(V.vec(*names))), Q))
    offset = inside.join(anchors, "rec").where(F.col("frame") == F.col("anchor_at")).select(
        "rec", *V.named(V.quat_from_rotvec(V.vec(*names)), [f"_o{c}" for c in Q]))
    rel = V.quat_multiply(V.quat_conjugate(V.vec4([f"_o{c}" for c in Q])), V.vec4(Q))
    return run.join(offset, "rec").select("rec", "frame", *V.named(rel, Q)).select(
        "rec", "frame", *V.named(V.unit_quat_matrix(V.vec4(Q)), ROTATION))


def _rest_direction() -> list[Column]:
    return V.named(V.unit(V.vec("fx", "fy", "fz")), ("_u0", "_u1", "_u2"))


def _rest_up(anchors: DataFrame) -> DataFrame:
    return anchors.select("rec", *_rest_direction())


def carried_up(rotations: DataFrame, anchors: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """The rest anchor's up direction carried to every frame by the attitude."""
    return rotations.join(_rest_up(anchors), "rec").select("rec", *group, "frame", *_turned_up())


def _turned_up() -> list[Column]:
    """The anchor's up direction in the frame's own axes."""
    return V.named(V.mat_t_vec(V.mat(ROTATION), V.vec("_u0", "_u1", "_u2")), ("ux", "uy", "uz"))


def integrate_from_anchor(frames: DataFrame, accel: dict[str, Column], anchors: DataFrame,
                          rig: Rig = DEFAULT_RIG, block: int = 8192) -> DataFrame:
    """Sum an acceleration forward and backward from the anchor (zero there).

    One running sum serves both directions: v(t) = (C(t) - C(anchor)) * dt with
    C the sum of all earlier frames. C(anchor) is a plain grouped sum of the
    frames before the anchor, so no second running sum is needed.
    """
    lifted = frames.withColumns({f"_c_{n}": c for n, c in accel.items()})
    early = F.col("frame") < F.col("anchor_at")
    at = lifted.join(anchors.select("rec", "anchor_at"), "rec").groupBy("rec").agg(*[
        F.coalesce(F.sum(F.when(early, F.col(f"_c_{n}"))), F.lit(0.0)).alias(f"_z_{n}")
        for n in accel])
    run = prefix_sums(lifted, {f"_c_{n}": F.col(f"_c_{n}") for n in accel}, inclusive=False,
                      block=block)
    return run.join(at, "rec").withColumns({
        n: (F.col(f"_c_{n}") - F.col(f"_z_{n}")) * rig.dt for n in accel}).drop(
        *[f"_c_{n}" for n in accel], *[f"_z_{n}" for n in accel])


def dead_reckon(frames: DataFrame | PackedFrames, anchors: DataFrame, rig: Rig = DEFAULT_RIG,
                bound: float = VELOCITY_SQUASH, horizon: float = 0.0,
                keep: tuple[str, ...] = (), block: int = SCAN_BLOCK,
                fan_out: int = SCAN_FAN_OUT) -> DataFrame:
    """Attitude and velocity integrated from the rest anchor.

    Returns per frame the bounded body velocity d_x..d_z, the unbounded
    anchor-frame velocity i_x..i_z, the time since the anchor (seconds / 10),
    the carried up direction u* and the rotation. Beyond ``horizon`` seconds the
    bounded velocity is zero. Of packed frames, ``keep`` may also name their
    directions and columns of ``anchors``; no frame is moved.
    """
    if isinstance(frames, PackedFrames):
        held = [c for c in keep if c in anchors.columns]
        spot = cut_lineage(anchors.select("rec", "anchor_at", *held, *_rest_direction()))
        both = frames.rows([n for n in frames.starts if f"{n}x" in keep], frames.anchored(spot, fan_out=fan_out))
    else:
        anchors = cut_lineage(anchors.select("rec", "anchor_at", "fx", "fy", "fz"))
        both = anchored_states(frames, anchors, rig, (), keep, block, fan_out).join(_rest_up(anchors), "rec")
    away = F.col("frame") - F.col("anchor_at")
    up0 = V.vec("_u0", "_u1", "_u2")
    drift = V.scale(V.sub(V.vec(*S), V.scale(up0, away * rig.g)), rig.dt)
    both = both.withColumns({
        **V.as_columns(V.unit_quat_matrix(V.vec4(Q)), ROTATION),
        **V.as_columns(drift, ("i_x", "i_y", "i_z"))})
    body = V.mat_t_vec(V.mat(ROTATION), V.vec("i_x", "i_y", "i_z"))
    up = V.mat_t_vec(V.mat(ROTATION), up0)
    near = F.abs(away) <= horizon * rig.fs if horizon > 0 else F.lit(True)
    return both.select(
        "rec", "frame", *keep,
        *[F.when(near, V.squash(c, bound)).otherwise(0.0).alias(n)
          for c, n in zip(body, ("d_x", "d_y", "d_z"))],
        (away / rig.fs / 10.0).alias("since"), "i_x", "i_y", "i_z",
        *V.named(up, ("ux", "uy", "uz")), *ROTATION)


def truth_attitude_velocity(frames: DataFrame, anchors: DataFrame,
                            rig: Rig = DEFAULT_RIG) -> DataFrame:
    """Window-mean velocity from true attitude and integrated force.

    World acceleration R f - g e_z is summed both ways from the rest anchor,
    rotated back to the body, and compared with the truth velocity per window.
    """
    m = V.quat_matrix(V.vec4(V.QUAT))
    lifted = frames.withColumns(V.as_columns(m, ROTATION))
    pull = V.sub(V.matvec(V.mat(ROTATION), V.vec(*V.ACC)), V.vec(0, 0, rig.g))
    run = integrate_from_anchor(lifted, V.as_columns(pull, ("i_x", "i_y", "i_z")), anchors, rig)
    body = V.mat_t_vec(V.mat(ROTATION), V.vec("i_x", "i_y", "i_z"))
    means = (with_window(run.withColumns(V.as_columns(body, ("b_x", "b_y", "b_z"))), rig)
             .groupBy("rec", "win_idx").agg(
                 F.count(F.lit(1)).alias("_n"),
                 *[F.avg(c).alias(c) for c in ("b_x", "b_y", "b_z", *V.VEL)])
             .where(F.col("_n") == rig.window))
    return (means.join(anchors.select("rec", "anchor_win"), "rec")
            .withColumn("err", V.norm(V.sub(V.vec("b_x", "b_y", "b_z"), V.vec(*V.VEL))))
            .withColumn("away", F.abs(F.col("win_idx") - F.col("anchor_win")))
            .select("rec", "win_idx", "away", "b_x", "b_y", "b_z", "err"))


def candidate_maps(spark) -> DataFrame:
    """Three fixed gyro axis maps to compare: as is, negated, exchanged."""
    eye = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
    flip = tuple(tuple(-x for x in r) for r in eye)
    rows = [(n, *[x for r in m for x in r])
            for n, m in (("same", eye), ("negated", flip), ("exchanged", GYRO_AXIS_MAP))]
    return spark.createDataFrame(rows, "candidate string, " + ", ".join(
        f"c{i}{j} double" for i in range(3) for j in range(3)))


def carried_up_by_map(frames: DataFrame, anchors: DataFrame, rig: Rig = DEFAULT_RIG, at: DataFrame | None = None) -> DataFrame:
    """Carried up direction under each candidate gyro axis map (three per frame).

    With ``at`` (rec, frame and more columns) only its rows are returned, with
    their columns; they are packed with the frames, so nothing is joined to these.
    """
    maps = candidate_maps(frames.sparkSession)
    spot = cut_lineage(anchors.select("rec", "anchor_at", *_rest_direction()))
    packed = pack_frames(frames.select("rec", "frame", *V.ACC, *V.GYR), {}, rig, at=at)
    rot = packed.rows((), packed.anchored(spot, maps)).withColumns(V.as_columns(V.unit_quat_matrix(V.vec4(Q)), ROTATION))
    return rot.select("rec", "candidate", "frame", *packed.at, *_turned_up())


# ------------------------------------------------------------------ pre-integration
def preintegrate(frames: DataFrame, rig: Rig = DEFAULT_RIG) -> DataFrame:
    """Turn and force integrals inside each window, from its first frame.

    Nine values per frame: rotation vector back to the window's first frame and
    the summed force in that frame under the gyro's own axes and under the
    exchanged axes. Windows are independent; those of a batch step together.
    """
    t = rig.window
    names = ["g_x", "g_y", "g_z", "s_x", "s_y", "s_z", "e_x", "e_y", "e_z"]
    exchange = np.asarray(GYRO_AXIS_MAP)

    def products(w: np.ndarray) -> np.ndarray:
        q = _turns(w, rig.dt)
        out = np.empty_like(q)
        cur = np.tile(NO_TURN, (len(q), 1))
        for i in range(q.shape[1]):  # all windows of the batch step together
            out[:, i] = cur
            cur = _quat_mul(cur, q[:, i])
        return out.reshape(-1, 4)

    def rotvec(q: np.ndarray) -> np.ndarray:
        q = np.where(q[:, 3:] < 0, -q, q)
        n = np.linalg.norm(q[:, :3], axis=1, keepdims=True)
        ang = 2 * np.arctan2(n, q[:, 3:])
        return q[:, :3] * np.where(n > 1e-12, ang / np.maximum(n, 1e-300), 2.0)

    def run(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        full = spread(np.diff(bounds) == t, bounds)
        pdf = pdf[full].reset_index(drop=True)
        a = pdf[list(V.ACC)].to_numpy(float)
        w = pdf[list(V.GYR)].to_numpy(float).reshape(-1, t, 3)
        own, other = products(w), products(w @ exchange.T)
        total = lambda q: np.cumsum(_rotate(q, a).reshape(-1, t, 3), axis=1).reshape(-1, 3) * rig.dt
        return _table(pdf[["rec", "frame", "win_idx"]], names, np.concatenate(
            [rotvec(own), total(own), total(other)], axis=1))
    wins = with_window(frames.select("rec", "frame", *V.ACC, *V.GYR), rig)
    schema = f"rec {_rec_type(frames)}, frame bigint, win_idx bigint, " + ", ".join(
        f"{n} double" for n in names)
    return map_groups(wins, ["rec", "win_idx"], ["frame"], run, schema)


# ---------------------------------------------------------------------- up filters
# One step of the filter is u' = unit((1 - g) R u + g f), with R the turn of the
# frame before, f the force direction and g the gain: a map of u that depends on
# the frame alone. A block of frames is thus a map from its start state to its
# end. Blocks are run from guessed starts, together with the derivative of the
# end by the start; the true starts then solve a linear chain of blocks, which is
# composed like any running state. That is Newton's method on the starts: the
# number of rounds depends on how far the guesses are off, not on how many blocks
# there are.
UP_BLOCK, UP_CHAIN = 1024, 1024


def _step_maps(values: np.ndarray, lead: np.ndarray, dt: float):
    """M, c and a flag per frame: a step is u' = M u + c, made unit where the flag is set.

    ``values``: force, rate, gain (blocks x frames x 7), NaN beyond a block's end;
    ``lead``: the rate of the frame before the block, NaN for a recording's first.
    """
    f, w, g = values[..., :3], values[..., 3:6], values[..., 6]
    size = np.linalg.norm(f, axis=-1)
    forced = size > 1e-6
    gain = np.where(forced, g, 0.0)
    c = gain[..., None] * f / np.where(forced, size, 1.0)[..., None]
    rate = np.concatenate([lead[:, None], w[:, :-1]], axis=1) * dt
    angle = np.linalg.norm(rate, axis=-1)
    turned = angle > 1e-9
    k = rate / np.where(turned, angle, 1.0)[..., None]
    cross = np.zeros((*angle.shape, 3, 3))
    for i, j, part, sign in ((0, 1, 2, -1), (0, 2, 1, 1), (1, 2, 0, -1)):
        cross[..., i, j], cross[..., j, i] = sign * k[..., part], -sign * k[..., part]
    # the body turned by the rate, so the direction turns back
    turn = np.eye(3) - np.sin(angle)[..., None, None] * cross + (1 - np.cos(angle))[..., None, None] * (cross @ cross)
    turn = np.where((turned & ~np.isnan(angle))[..., None, None], turn, np.eye(3))
    m = (1 - gain)[..., None, None] * turn
    gone = np.isnan(g)  # padding: the state stays
    m[gone], c[gone] = np.eye(3), 0.0
    return m, c, forced & ~gone


def _run_blocks(m: np.ndarray, c: np.ndarray, forced: np.ndarray, start: np.ndarray, states: bool):
    """All blocks step by step, side by side: every state, or the end and its derivative by the start."""
    u, slope = start.copy(), np.broadcast_to(np.eye(3), (len(start), 3, 3)).copy()
    out = np.empty((*c.shape[:2], 3)) if states else None
    for t in range(c.shape[1]):
        y = (m[:, t] @ u[..., None])[..., 0] + c[:, t]
        size = np.where(forced[:, t], np.linalg.norm(y, axis=1), 1.0)[:, None]
        u = y / size
        if states:
            out[:, t] = u
        else:
            slope = (m[:, t] @ slope) / size[..., None]
            along = (u[:, None] @ slope)[:, 0]
            slope -= np.where(forced[:, t], 1.0, 0.0)[:, None, None] * u[..., None] * along[:, None]
    return out if states else (u, slope)


def run_one(m: np.ndarray, c: np.ndarray, forced: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Every state of a single block, in plain numbers: arrays of one row cost more than the sums in them."""
    x, y, z = start.tolist()
    out = np.empty((len(c), 3))
    for at in range(0, len(c), 4096):
        part, states = slice(at, at + 4096), []
        for (a0, a1, a2, b0, b1, b2, d0, d1, d2), (p, q, r), on in zip(
                m[part].reshape(-1, 9).tolist(), c[part].tolist(), forced[part].tolist()):
            x, y, z = a0 * x + a1 * y + a2 * z + p, b0 * x + b1 * y + b2 * z + q, d0 * x + d1 * y + d2 * z + r
            if on:
                size = math.sqrt(x * x + y * y + z * z) or math.nan
                x, y, z = x / size, y / size, z / size
            states.append((x, y, z))
        out[part] = states
    return out


#: Frames (with padding) whose step maps are held at once, some 500 bytes each.
UP_CELLS = 1 << 17


def _packed_blocks(frames: DataFrame, gain: Column | dict[str, Column], block: int, keep: tuple[str, ...] = (),
                   at: DataFrame | None = None) -> DataFrame:
    """One row per recording and block: its frames in order, and the rate of the frame before.

    Rows of ``at`` (rec, frame and more) come to the blocks of their frames, as ``at``.
    The rows are written in buckets, so the rounds meet them where they lie.
    """
    gains = gain if isinstance(gain, dict) else {"g": gain}
    spot = F.col("frame")
    row = frames.where("rec IS NOT NULL").select(
        "rec", "frame", *V.ACC, *V.GYR, *keep, *[g.cast("double").alias(n) for n, g in gains.items()],
        F.explode(F.sequence(F.floor(spot / block), F.floor((spot + 1) / block))).alias(BLOCK))
    more, true_frame = [], F.lit(True)
    if at is not None:
        each = at.select("rec", F.floor(spot / block).alias(BLOCK), F.struct("frame", *[c for c in at.columns if c not in ("rec", "frame")]).alias("_at"))
        row = row.unionByName(each, allowMissingColumns=True)
        more, true_frame = [F.collect_list("_at").alias("at")], F.col("_at").isNull()
    own = true_frame & (F.floor(spot / block) == F.col(BLOCK))
    one = F.struct("frame", *[F.col(c).cast("double").alias(c) for c in (*V.ACC, *V.GYR)], *gains, *keep)
    lead = F.max(F.when(true_frame & ~own, F.array(*[F.col(c).cast("double") for c in V.GYR])))
    packs = row.repartition(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rec", BLOCK).groupBy("rec", BLOCK).agg(
        F.array_sort(F.collect_list(F.when(own, one))).alias("rows"), lead.alias("lead"), *more)
    return write_bucketed(packs.where(F.size("rows") > 0), ["rec", BLOCK], "blocks")


def _meet(packs: DataFrame, starts: DataFrame) -> DataFrame:
    """Packed blocks with their start states; only the states move."""
    return packs.join(starts.hint("shuffle_hash"), ["rec", BLOCK])


def _pieces(batches):
    """Arrow batches cut so that the padded blocks of each stay below ``UP_CELLS`` frames."""
    for b in batches:
        if b.num_rows:
            n = max(1, UP_CELLS // int(b.column("rows").value_lengths().to_numpy().max()))
            for i in range(0, b.num_rows, n):
                yield b.slice(i, n)
    give_back()


def _opened_blocks(b: pa.RecordBatch, dt: float, gains: tuple[str, ...] = ("g",)):
    """Step maps of a batch of blocks for each gain, where their frames lie, and the frames."""
    rows = b.column("rows")
    n = rows.value_lengths().to_numpy()
    flat = rows.flatten()
    block = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
    lead = np.array([[np.nan] * 3 if x is None else x for x in b.column("lead").to_pylist()], float)

    def maps(gain: str):
        values = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in (*V.ACC, *V.GYR, gain)], axis=1)
        wide = np.full((len(n), int(n.max()), 7), np.nan)
        wide[block, place] = values
        return _step_maps(wide, lead, dt)
    return (maps(g) for g in gains), block, place, flat


def _guesses(rows: Column) -> Column:
    """A block's guessed start: the force direction of its first frame."""
    f = V.vec(*[rows[0][c] for c in V.ACC])
    n = V.norm(f)
    return F.when(n > 1e-6, F.array(*[x / n for x in f])).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))


def _chain(ends: DataFrame, rec_type: str, chain: int) -> DataFrame:
    """Starts that fit the linearised blocks: ``rec``, block, ``start``, and how far each moved (``gap``).

    ``ends``: start, end and slope of every block. Runs of ``chain`` blocks shrink
    to one affine map each, the maps are walked per recording, and every run is
    walked again from its true start.
    """
    def affine(pdf):
        s, e = (np.stack(pdf[c].to_numpy()) for c in ("start", "end"))
        j = np.stack(pdf["slope"].to_numpy()).reshape(-1, 3, 3)
        return s, j, e - (j @ s[..., None])[..., 0]

    def shrink(pdf, bounds):
        _, j, c = affine(pdf)
        out = []
        for p, q in zip(bounds[:-1], bounds[1:]):
            m, v = np.eye(3), np.zeros(3)
            for i in range(p, q):
                m, v = j[i] @ m, j[i] @ v + c[i]
            out.append((pdf["rec"].iat[p], pdf["run"].iat[p], m.ravel(), v, pdf["start"].iat[p]))
        return pd.DataFrame(out, columns=["rec", "run", "m", "v", "start"])

    def walk(pdf, bounds):
        out = []
        for p, q in zip(bounds[:-1], bounds[1:]):
            x = np.array(pdf["start"].iat[p])  # the first block of a recording starts as it must
            for i in range(p, q):
                out.append((pdf["rec"].iat[i], pdf["run"].iat[i], x))
                x = pdf["m"].iat[i].reshape(3, 3) @ x + pdf["v"].iat[i]
        return pd.DataFrame(out, columns=["rec", "run", "begin"])

    def replay(pdf, bounds):
        s, j, c = affine(pdf)
        new = np.empty_like(s)
        for p, q in zip(bounds[:-1], bounds[1:]):
            x = np.array(pdf["begin"].iat[p])
            for i in range(p, q):
                new[i] = x
                x = j[i] @ x + c[i]
        size = np.linalg.norm(new, axis=1, keepdims=True)
        new = new / np.where(size > 1e-12, size, 1.0)
        return pd.DataFrame({"rec": pdf["rec"], BLOCK: pdf[BLOCK], "start": list(new), "gap": np.abs(new - s).max(axis=1)})

    runs = ends.withColumn("run", F.floor(F.col(BLOCK) / chain))
    maps = map_groups(runs, ["rec", "run"], [BLOCK], shrink,
                      f"rec {rec_type}, run bigint, m array<double>, v array<double>, start array<double>")
    begins = map_groups(maps, ["rec"], ["run"], walk, f"rec {rec_type}, run bigint, begin array<double>")
    return map_groups(runs.join(begins, ["rec", "run"]), ["rec", "run"], [BLOCK], replay,
                      f"rec {rec_type}, {BLOCK} bigint, start array<double>, gap double")


def up_starts(packs: DataFrame, rig: Rig, tolerance: float,
              chain: int = UP_CHAIN, gain: str = "g") -> tuple[DataFrame, int]:
    """The true start state of every block, and how many rounds it took.

    A few rounds usually do. As each round hands one more exact start along the
    chain, there can never be more of them than blocks.
    """
    rec_type = packs.schema["rec"].dataType.simpleString()
    dt = rig.dt

    def run(batches):
        for b in _pieces(batches):
            ((m, c, forced),), *_ = _opened_blocks(b, dt, (gain,))
            start = np.array(b.column("start").to_pylist(), float)
            end, slope = _run_blocks(m, c, forced, start, False)
            yield pa.RecordBatch.from_arrays([b.column("rec"), b.column(BLOCK), b.column("start"), *[
                pa.array(list(x.reshape(len(x), -1)), pa.list_(pa.float64())) for x in (end, slope)]],
                ["rec", BLOCK, "start", "end", "slope"])

    met = packs.withColumn("start", _guesses(F.col("rows")))
    for n in count(1):
        ends = met.mapInArrow(
            run, f"rec {rec_type}, {BLOCK} bigint, start array<double>, end array<double>, slope array<double>")
        starts = cut_lineage(_chain(cut_lineage(ends), rec_type, chain))
        if (starts.agg(F.max("gap")).first()[0] or 0.0) <= tolerance:
            return starts, n
        met = _meet(packs, starts.select("rec", BLOCK, "start"))


def up_filter(frames: DataFrame, gain: Column | float = SLOW_GAIN, rig: Rig = DEFAULT_RIG,
              block: int = UP_BLOCK, tolerance: float = 1e-9, name: str = "u") -> DataFrame:
    """Filtered up direction <name>x, <name>y, <name>z for every frame.

    Each step turns the direction by the gyro reading before, moves it toward the
    measured force by ``gain`` and makes it unit. Frames are packed into blocks
    once; the blocks' start states are solved (``up_starts``) to ``tolerance``, and
    a last pass writes all states. Every recording takes the same way.
    """
    return up_filters(frames, {name: gain}, rig, block, tolerance).select("rec", "frame", *[f"{name}{c}" for c in "xyz"])


def up_filters(frames: DataFrame, gains: dict[str, Column | float], rig: Rig = DEFAULT_RIG, block: int = UP_BLOCK,
               tolerance: float = 1e-9, keep: tuple[str, ...] = ()) -> DataFrame:
    """Frames (rec, frame, the six axes and ``keep``) with the direction of ``up_filter`` for each gain, by its name.

    All filters share the packed blocks; the frames pass through the last pass, so
    nothing is joined to them.
    """
    return pack_frames(frames, gains, rig, block, tolerance, keep).rows(list(gains))


@dataclass(frozen=True)
class PackedFrames:
    """Frames packed in blocks and written in buckets, with solved starts: a pass over them moves no frame.

    ``starts`` has the gain column and the blocks' start states of each direction;
    ``types`` those of the frames' columns, ``at`` the columns of the rows that came
    with the frames.
    """

    packs: DataFrame
    rig: Rig
    block: int
    types: dict[str, str]
    keep: tuple[str, ...]
    starts: dict[str, tuple[str, DataFrame]]
    at: tuple[str, ...] = ()

    def per_block(self, table: DataFrame) -> DataFrame:
        """A table with one row per recording, for every block of its frames."""
        return cut_lineage(self.packs.select("rec", BLOCK).join(table, "rec"))

    def anchored(self, spot: DataFrame, maps: DataFrame | None = None, fan_out: int = SCAN_FAN_OUT) -> DataFrame:
        """The blocks' start states (``_b*``) of ``anchored_states``, with the columns of ``spot``; one without a state at the anchor is ``_lost``.

        ``spot``: rec, anchor_at and more, one row per recording; ``maps``: axis maps
        (candidate, c00..c22) that turn the rates and get states of their own.
        """
        keys, dt = ["rec", *(["candidate"] if maps is not None else [])], self.rig.dt
        here = spot.select("rec", "anchor_at", F.floor(F.col("anchor_at") / self.block).alias(BLOCK))
        met = self.packs.join(here.hint("shuffle_hash"), ["rec", BLOCK], "left")
        met = met if maps is None else met.join(F.broadcast(maps))
        names = [*keys, BLOCK, *Q, *S, *A]

        def totals(batches):
            for b in _pieces(batches):
                bounds, w, f, flat = _block_axes(b)
                q, s, q1, s1 = _states(_turns(w, dt), f, bounds)
                last = bounds[1:] - 1
                anchor = np.full((len(last), 7), np.nan)
                wanted = spread(b.column("anchor_at").to_numpy(zero_copy_only=False), bounds)
                at = np.flatnonzero(flat.field("frame").to_numpy() == wanted)
                anchor[np.searchsorted(bounds, at, side="right") - 1] = np.concatenate([q[at], s[at]], axis=1)
                values = np.concatenate([q1[last], s1[last], anchor], axis=1)
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in (*keys, BLOCK)], *[pa.array(x) for x in values.T]], names)

        kinds = {"rec": self.types["rec"], "candidate": "string", BLOCK: "bigint"}
        whole = cut_lineage(met.mapInArrow(totals, ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names)))
        starts = _block_starts(whole, keys, fan_out)
        starts = starts.join(spot, "rec").join(_at_anchor(whole, starts, keys), keys, "left")
        if maps is not None:
            starts = starts.join(F.broadcast(maps), "candidate")
        more = [c for c in (*spot.columns, *(maps.columns if maps is not None else ())) if c not in keys]
        return cut_lineage(starts.select(*keys, BLOCK, *more, *_moved_starts(), F.col(f"_z{Q[0]}").isNull().alias("_lost")))

    def rows(self, names: list[str] | tuple[str, ...] = (), heads: DataFrame | None = None) -> DataFrame:
        """Frames with the directions ``names`` and the columns of their block's row in ``heads``.

        Heads of ``anchored`` give the running state (``_q*``, ``_s*``) as well. Rows that came
        with the frames (``at``) take their place.
        """
        met, dt, state = self.packs, self.rig.dt, heads is not None and _STARTS[0] in heads.columns
        for n in names:
            met = _meet(met, self.starts[n][1].select("rec", BLOCK, F.col("start").alias(f"start{self.starts[n][0]}")))
        met = met if heads is None else _meet(met, heads)
        head = {} if heads is None else {f.name: f.dataType.simpleString() for f in heads.schema.fields if f.name not in ("rec", BLOCK, "_lost", *_STARTS, *V.mat_cols("c"))}
        wanted, size = tuple(self.starts[n][0] for n in names), self.block
        inside = ["frame", *([] if self.at else [*V.ACC, *V.GYR, *self.keep])]
        made = [f"{n}{c}" for n in names for c in "xyz"] + [*Q, *S] * state
        columns = ["rec", *head, *inside, *self.at, *made]
        if not wanted and not state and not self.at:
            out = met.select("rec", *head, F.inline("rows")).select(*columns)
            return out.withColumns(self._as_given())

        def write(batches):
            for b in _pieces(batches):
                opened, block, place, flat = _opened_blocks(b, dt, wanted)
                ups = [_run_blocks(*maps, np.array(b.column(f"start{g}").to_pylist(), float), True)[block, place]
                       for g, maps in zip(wanted, opened)]
                row, held, states = np.arange(len(block)), [], []
                if state:
                    bounds, w, f, _ = _block_axes(b)
                    start = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in _STARTS], axis=1)
                    q, s, _, _ = _states(_turns(w, dt), f, bounds)
                    start = spread(start, bounds)
                    states = [_quat_mul(start[:, :4], q), start[:, 4:] + _rotate(start[:, :4], s)]
                    # as anchored_states does where the state at the anchor is unknown
                    lost = b.column("_lost").to_numpy(zero_copy_only=False) & (b.column(BLOCK).to_numpy() * size % SCAN_BLOCK == 0)
                    row = row[~(spread(lost, bounds) & (place == 0))]
                if "at" in b.schema.names:
                    row, other, asked = _rows_asked(b.column("at"), block, flat.field("frame").to_numpy(), row)
                    held = [asked.field(c).take(pa.array(other)) for c in columns[len(head) + 2:len(columns) - len(made)]]
                yield pa.RecordBatch.from_arrays([
                    *[b.column(c).take(pa.array(block[row])) for c in ("rec", *head)], *[flat.field(c).take(pa.array(row)) for c in inside], *held,
                    *[pa.array(x) for v in ups for x in v[row].T],
                    *[pa.array(x, from_pandas=True) for v in states for x in v[row].T]], columns)  # an unknown state is null
        kinds = {**{c: "double" for c in (*V.ACC, *V.GYR, *made)}, **{c: self.types[c] for c in ("rec", "frame", *self.keep, *self.at)}, **head}
        return met.mapInArrow(write, ", ".join(f"`{c}` {kinds[c]}" for c in columns)).withColumns({} if self.at else self._as_given())

    def _as_given(self) -> dict[str, Column]:
        return {c: F.col(c).cast(self.types[c]) for c in (*V.ACC, *V.GYR) if self.types[c] != "double"}


def pack_frames(frames: DataFrame, gains: dict[str, Column | float], rig: Rig = DEFAULT_RIG, block: int = UP_BLOCK,
                tolerance: float = 1e-9, keep: tuple[str, ...] = (), at: DataFrame | None = None) -> PackedFrames:
    """Pack frames once and solve the starts of the directions in ``gains`` (see ``up_filters``).

    With ``at`` (rec, frame and more columns) its rows are packed with their frames.
    """
    columns = {f"_g{i}": g if isinstance(g, Column) else F.lit(float(g)) for i, g in enumerate(gains.values())}
    packs = _packed_blocks(frames, columns, block, keep, at)
    types = {f.name: f.dataType.simpleString() for t in (at, frames) if t is not None for f in t.schema.fields}
    more = () if at is None else tuple(c for c in at.columns if c not in ("rec", "frame"))
    return PackedFrames(packs, rig, block, types, keep, {
        n: (g, up_starts(packs, rig, tolerance, gain=g)[0]) for n, g in zip(gains, columns)}, more)


def _block_axes(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Where the blocks of a batch begin and end, rates (turned by a block's axis map) and forces, and the frames."""
    rows = b.column("rows")
    n = rows.value_lengths().to_numpy()
    flat = rows.flatten()
    w, f = (np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in axes], axis=1) for axes in (V.GYR, V.ACC))
    if "c00" in b.schema.names:
        turn = np.stack([b.column(c).to_numpy() for c in V.mat_cols("c")], axis=1).reshape(-1, 3, 3)
        w = (np.repeat(turn, n, axis=0) @ w[..., None])[..., 0]
    return np.append(0, np.cumsum(n)), w, f, flat


def _rows_asked(at: pa.Array, block: np.ndarray, frame: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each asked row, the place of its frame (one of ``row``) and its own place among those asked, which come last."""
    asked = at.flatten()
    theirs = np.repeat(np.arange(len(at)), at.value_lengths().fill_null(0).to_numpy())
    met = pd.DataFrame({"block": block[row], "frame": frame[row], "row": row}).merge(
        pd.DataFrame({"block": theirs, "frame": asked.field("frame").to_numpy(), "other": np.arange(len(theirs))}), on=["block", "frame"])
    return met["row"].to_numpy(), met["other"].to_numpy(), asked


def adaptive_gain(alpha: float = ADAPTIVE_GAIN, sigma: float = ADAPTIVE_SIGMA,
                  g: float = DEFAULT_RIG.g) -> Column:
    """Gain that fades when the force is far from gravity."""
    d = (V.norm(V.vec(*V.ACC)) - g) / sigma
    return alpha * F.exp(-(d * d))


def dead_reckon_given(frames: DataFrame, anchors: DataFrame, rig: Rig = DEFAULT_RIG,
                      bound: float = VELOCITY_SQUASH, horizon: float = 0.0, keep: tuple[str, ...] = (),
                      block: int = 8192) -> DataFrame:
    """Velocity from the rest anchor on an attitude that is given: frames hold r00..r22, the rotation to the anchor frame.

    ``anchors``: rec, anchor_at and the anchor's up direction (fx, fy, fz, of any
    length). The columns are those of ``dead_reckon``. The force turned by the
    given attitude, less gravity, is one running sum, so nothing is replayed.
    """
    up0 = V.vec("_u0", "_u1", "_u2")
    spot = cut_lineage(anchors.select("rec", "anchor_at", "fx", "fy", "fz"))
    lifted = V.sub(V.matvec(V.mat(ROTATION), V.vec(*V.ACC)), V.scale(up0, F.lit(rig.g)))
    based = frames.select("rec", "frame", *V.ACC, *ROTATION, *keep).join(_rest_up(spot), "rec")
    summed = integrate_from_anchor(based, dict(zip(("i_x", "i_y", "i_z"), lifted)), spot, rig, block)
    away = F.col("frame") - F.col("anchor_at")
    body = V.mat_t_vec(V.mat(ROTATION), V.vec("i_x", "i_y", "i_z"))
    up = V.mat_t_vec(V.mat(ROTATION), up0)
    near = F.abs(away) <= horizon * rig.fs if horizon > 0 else F.lit(True)
    return summed.join(spot.select("rec", "anchor_at"), "rec").select(
        "rec", "frame", *keep,
        *[F.when(near, V.squash(c, bound)).otherwise(0.0).alias(n) for c, n in zip(body, ("d_x", "d_y", "d_z"))],
        (away / rig.fs / 10.0).alias("since"), "i_x", "i_y", "i_z", *V.named(up, ("ux", "uy", "uz")), *ROTATION)


def calibrate_frames(frames: DataFrame, calibration: DataFrame) -> DataFrame:
    """Calibrated axes and ``deviation`` per frame; recordings without a row stay as they are, with deviation 0.

    ``calibration``: rec, gain_x..z, bias_x..z, logit (of the exchanged gyro axes), flip.
    """
    gain, bias = V.vec("gain_x", "gain_y", "gain_z"), V.vec("bias_x", "bias_y", "bias_z")
    both = frames.join(calibration.withColumn("_known", F.lit(True)), "rec", "left")
    known = F.col("_known").isNotNull()
    force = V.choose(known, V.calibrate_force(V.vec(*V.ACC), gain, bias), V.vec(*V.ACC))
    rate = V.flip_gyro(V.vec(*V.GYR), known & F.col("flip"))
    worth = F.when(known, V.calibration_deviation(gain, bias, F.col("logit"))).otherwise(0.0)
    return both.withColumns({**V.as_columns(force, V.ACC), **V.as_columns(rate, V.GYR), "deviation": worth}).select(
        *frames.columns, "deviation")


def derived_channels(frames: DataFrame, rig: Rig = DEFAULT_RIG, calibration: DataFrame | None = None,
                     anchors: DataFrame | None = None, horizon: float = 0.0) -> DataFrame:
    """All anchor-based channels of a frame in one table.

    Carried up, bounded velocity, time since anchor, first two rotation columns,
    unbounded anchor-frame velocity and the recording's calibration deviation.
    Frames that hold an attitude (r00..r22) are integrated on it, others on their
    own rates. A ``calibration`` (see ``calibrate_frames``) is applied first;
    ``anchors`` default to the calmest window of the calibrated frames.
    """
    made = calibrate_frames(frames, calibration) if calibration is not None else frames.withColumn("deviation", F.lit(0.0))
    anchors = rest_reference(made, rig) if anchors is None else anchors
    run = dead_reckon_given if set(ROTATION) <= set(frames.columns) else dead_reckon
    dr = run(made, anchors, rig, horizon=horizon, keep=("deviation",))
    return dr.select("rec", "frame", "ux", "uy", "uz", "d_x", "d_y", "d_z", "since",
                     "r00", "r10", "r20", "r01", "r11", "r21", "i_x", "i_y", "i_z", "deviation")
