"""Operators against plain NumPy on small synthetic recordings."""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorframe import Rig
from sensorframe.functions import vec as V
from sensorframe.operators import blocks as B
from sensorframe.operators import chunks as C
from sensorframe.operators import sampling as M
from sensorframe.operators import scan as N
from sensorframe.operators import sequence as X
from sensorframe.operators import summary as S
from sensorframe.operators import windows as W
from sensorframe.operators.grouped import positions

RIG = Rig(window=20, fs=20.0)
AXES = ["ax", "ay", "az", "wx", "wy", "wz", "vx", "vy", "vz"]


def recording(name: str, n: int, seed: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 9)) * [0.5, 0.5, 0.5, 0.4, 0.4, 0.4, 1, 1, 1]
    x[:, 2] += 9.81
    out = pd.DataFrame(x, columns=AXES)
    out.insert(0, "frame", np.arange(n, dtype=np.int32))
    out.insert(0, "rec", name)
    return out


@pytest.fixture(scope="module")
def table():
    # one recording holds most of the rows; others are short or exactly one window
    return pd.concat([recording("long", 700, 1), recording("mid", 95, 2), recording("one", 20, 3),
                      recording("tiny", 7, 4)], ignore_index=True)


@pytest.fixture(scope="module")
def frames(spark, table):
    return spark.createDataFrame(table, "rec string, frame int, " + ", ".join(
        f"{c} double" for c in AXES)).repartition(5).cache()


def per_rec(df, cols):
    out = df.toPandas().sort_values(["rec", "frame"])
    return {r: g[cols].to_numpy() for r, g in out.groupby("rec")}


def anchors_of(table):
    out = {}
    for r, g in table.groupby("rec"):
        a, w = g[AXES[:3]].to_numpy(), g[AXES[3:6]].to_numpy()
        n = len(g) // 20
        if n == 0:
            out[r] = (0, 9.0, a.mean(0), min(10, len(g) - 1))
            continue
        an = np.linalg.norm(a[:n * 20], axis=1).reshape(n, 20)
        wn = np.linalg.norm(w[:n * 20], axis=1).reshape(n, 20)
        s = np.abs(an.mean(1) - 9.81) + wn.mean(1) + 0.5 * an.std(1)
        k = int(np.argmin(s))
        out[r] = (k, s[k], a[k * 20:(k + 1) * 20].mean(0), k * 20 + 10)
    return out


def test_rest_reference_with_short_recording(frames, table):
    got = {r["rec"]: r for r in W.rest_reference(frames, RIG).collect()}
    for r, (k, score, f, at) in anchors_of(table).items():
        assert got[r]["anchor_win"] == k and got[r]["anchor_at"] == at
        assert got[r]["score"] == pytest.approx(score)
        assert [got[r][c] for c in ("fx", "fy", "fz")] == pytest.approx(list(f))


def test_tied_rest_scores_take_the_first_window(spark):
    g = recording("a", 20, 5)
    twice = pd.concat([g, g.assign(frame=g.frame + 20)])
    got = W.rest_anchor(spark.createDataFrame(twice), RIG).first()
    assert got["anchor_win"] == 0


@pytest.mark.parametrize("n", [25, 50])
def test_smoothing_and_gradient(frames, table, n):
    got = per_rec(X.moving_average_same(frames, ["ax"], n, block=64), ["ax_sm"])
    grad = per_rec(X.central_gradient(frames, ["ax"], block=64), ["ax_d"])
    for r, g in table.groupby("rec"):
        if len(g) >= n:
            want = np.convolve(g["ax"], np.ones(n) / n, mode="same")
            assert np.allclose(got[r][:, 0], want)
        assert np.allclose(grad[r][:, 0], np.gradient(g["ax"].to_numpy()))


def test_prefix_sums_use_every_level(frames, table):
    got = B.prefix_sums(frames, {"c": F.col("ax")}, block=8, fan_out=4)
    for r, v in per_rec(got, ["c"]).items():
        assert np.allclose(v[:, 0], np.cumsum(table[table.rec == r]["ax"]))


def test_percentiles(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=3000), np.full(1000, 0.5), [0.0, -0.0], -np.exp(
        rng.normal(size=50) * 5)])
    data = pd.DataFrame({"k": ["hot"] * len(v) + ["few"] * 3, "v": [*v, 1.0, 2.0, 4.0]})
    qs = [0.0, 0.05, 0.37, 0.5, 0.9, 1.0]
    got = B.percentiles(spark.createDataFrame(data), ["k"], {"v": (F.col("v"), qs)}).collect()
    for row in got:
        want = np.percentile(data[data.k == row["k"]]["v"], np.array(qs) * 100)
        assert [row[B.percentile_name("v", q)] for q in qs] == pytest.approx(list(want))


@pytest.mark.parametrize("gathered", [5, 60, 1_000_000])
def test_percentiles_narrow_their_brackets(spark, monkeypatch, gathered):
    monkeypatch.setattr(B, "GATHERED", gathered)
    g = np.random.default_rng(3)
    data = pd.DataFrame({"k": np.repeat([0, 1, 2, 3], [3000, 7, 900, 1]), "v": g.lognormal(0, 3, 3908), "w": g.integers(0, 4, 3908) * 1.0})
    data.loc[data.k == 2, "v"] = 5.5  # ties alone cannot be narrowed and need not be
    data.loc[:400, "v"] = 1e-3
    qs = [0.0, 0.01, 0.5, 0.9, 1.0]
    rows = B.percentiles(spark.createDataFrame(data).repartition(5), ["k"], {"v": (F.col("v"), qs), "w": (F.col("w"), [0.5])}).collect()
    assert len(rows) == 4
    for row in rows:
        mine = data[data.k == row["k"]]
        assert [row[B.percentile_name("v", q)] for q in qs] == pytest.approx(list(np.percentile(mine["v"], np.array(qs) * 100)))
        assert row["w_p50"] == np.percentile(mine["w"], 50)
    whole = B.percentiles(spark.createDataFrame(data), [], {"v": (F.col("v"), [0.3])}).collect()
    assert whole[0]["v_p30"] == pytest.approx(np.percentile(data["v"], 30))


def test_percentiles_keep_every_group(spark):
    """All-NaN groups, null keys, infinite values and values crowded in a narrow range."""
    rng = np.random.default_rng(1)
    crowd = np.concatenate([9.81 + rng.uniform(-0.002, 0.002, 4950), rng.normal(size=50)])
    rows = [("crowd", float(x)) for x in crowd] + [("nan", float("nan")), ("nan", None), (None, 3.0), (None, 5.0)]
    rows += [("inf", float("inf")), ("inf", float("-inf")), ("inf", 1.0), ("one", float("inf"))]
    qs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {r["k"]: [r[B.percentile_name("v", q)] for q in qs] for r in B.percentiles(
        spark.createDataFrame(rows, "k string, v double"), ["k"], {"v": (F.col("v"), qs)}).collect()}
    assert got.keys() == {"crowd", "nan", None, "inf", "one"}
    assert got["crowd"] == pytest.approx(list(np.quantile(crowd, qs)), abs=1e-12)
    assert got["nan"] == [None] * 5 and got[None] == [3.0, 3.5, 4.0, pytest.approx(4.98), 5.0]
    assert got["inf"][0] == float("-inf") and got["inf"][2] == 1.0 and got["inf"][4] == float("inf")
    assert got["one"] == [float("inf")] * 5


@pytest.mark.parametrize("rows_per_slice", [1, 40, 10 ** 7])
def test_numbering_is_the_same_for_any_slices(spark, rows_per_slice):
    from sensorframe.sources.views import day_slices
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"k": "a", "t": pd.to_datetime(rng.integers(0, 3, 300) * 86400, unit="s"), "o": rng.permutation(300)})
    table = spark.createDataFrame(data)
    got = B.number_rows(table, "k", ["t", "o"], day_slices(table, "t", "o", rows_per_slice), "i").toPandas().sort_values("i")
    want = data.sort_values(["t", "o"])
    assert list(got.o) == list(want.o) and list(got.i) == list(range(300))


def test_number_rows_and_top_k(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"k": ["a"] * 300 + ["b"] * 5, "t": rng.permutation(305)})
    got = B.number_rows(spark.createDataFrame(data), "k", ["t"], F.floor(F.col("t") / 17), "i")
    want = data.sort_values("t").assign(i=data.sort_values("t").groupby("k").cumcount())
    assert set(map(tuple, got.select("k", "t", "i").collect())) == set(
        want[["k", "t", "i"]].itertuples(index=False, name=None))
    top = B.top_k(spark.createDataFrame(data), ["k"], [F.col("t")], 4).collect()
    assert len(top) == 8
    assert sorted(r["t"] for r in top if r["k"] == "a") == sorted(data[data.k == "a"]["t"])[:4]


def rot(v):
    th = np.linalg.norm(v)
    if th < 1e-12:
        return np.eye(3)
    k = v / th
    m = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + math.sin(th) * m + (1 - math.cos(th)) * m @ m


@pytest.mark.parametrize("block,fan_out", [(4096, 4096), (16, 4)])
def test_attitude_and_dead_reckoning(spark, frames, table, block, fan_out):
    # small Arrow batches cut groups at batch edges
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    ref = W.rest_reference(frames, RIG)
    got = per_rec(N.dead_reckon(frames, ref, RIG, block=block, fan_out=fan_out),
                  [*N.ROTATION, "d_x", "d_y", "d_z", "i_x", "since"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for r, g in table.groupby("rec"):
        _, _, f, s0 = anchors_of(table)[r]
        a, w = g[AXES[:3]].to_numpy(), g[AXES[3:6]].to_numpy()
        up = f / np.linalg.norm(f)
        n = len(g)
        m = [None] * n
        m[s0] = np.eye(3)
        for i in range(s0 + 1, n):
            m[i] = m[i - 1] @ rot(w[i - 1] / 20)
        for i in range(s0 - 1, -1, -1):
            m[i] = m[i + 1] @ rot(w[i] / 20).T
        m = np.array(m)
        pull = np.einsum("nij,nj->ni", m, a) - 9.81 * up
        v = np.zeros((n, 3))
        for i in range(s0 + 1, n):
            v[i] = v[i - 1] + pull[i - 1] / 20
        for i in range(s0 - 1, -1, -1):
            v[i] = v[i + 1] - pull[i] / 20
        assert np.allclose(got[r][:, :9], m.reshape(n, 9), atol=1e-9)
        assert np.allclose(got[r][:, 9:12], 8 * np.tanh(np.einsum("nji,nj->ni", m, v) / 8), atol=1e-8)
        assert np.allclose(got[r][:, 12], v[:, 0], atol=1e-8)
        assert np.allclose(got[r][:, 13], (np.arange(n) - s0) / 20 / 10)


def up_loop(a, w, gain, dt):
    u, out = a[0] / np.linalg.norm(a[0]), []
    for k in range(len(a)):
        if k:
            u = rot(-w[k - 1] * dt) @ u
        u = (1 - gain) * u + gain * a[k] / np.linalg.norm(a[k])
        u = u / np.linalg.norm(u)
        out.append(u)
    return np.array(out)


@pytest.mark.parametrize("n_blocks", [4, 16, 64])
def test_up_filter_rounds_do_not_grow_with_blocks(spark, n_blocks):
    """A gain that fades under a sustained force of twice gravity: nothing is forgotten."""
    rng = np.random.default_rng(n_blocks)
    n = n_blocks * 50
    pdf = pd.DataFrame({"rec": "a", "frame": np.arange(n), **{c: rng.normal(0, 0.5, n) for c in AXES[:6]}})
    pdf["az"] += np.where(np.arange(n) < 40, 9.81, 2 * 9.81)
    packs = N._packed_blocks(spark.createDataFrame(pdf), N.adaptive_gain(), 50)
    _, rounds = N.up_starts(packs, RIG, 1e-9)
    assert rounds <= 6


@pytest.mark.parametrize("block", [1024, 64])
def test_up_filter(frames, table, block):
    got = per_rec(N.up_filter(frames, 0.05, RIG, block), ["ux", "uy", "uz"])
    for r, g in table.groupby("rec"):
        want = up_loop(g[AXES[:3]].to_numpy(), g[AXES[3:6]].to_numpy(), 0.05, 1 / 20)
        assert np.allclose(got[r], want, atol=1e-7)


def test_lookups_clamp_to_the_last_row(spark):
    n = 50 * 2 + 10
    f = spark.createDataFrame(pd.DataFrame({"rec": "a", "frame": range(n), "ts": np.arange(n) / 50.0, "qx": np.arange(n) * 1.0,
                                            "px": np.arange(n) * 2.0}))
    rig = Rig(window=50, fs=50.0)
    wins = spark.createDataFrame([("a", 0), ("a", 2), ("a", 9), ("b", 0)], "rec string, win_idx bigint")
    got = {r.win_idx: (r.qx, r.gx, r.dt) for r in W.pose_lookup(wins, f, rig, middle=("qx",), last=("px",)).collect()}
    assert got == {0: (25.0, 98.0, pytest.approx(1.0)), 2: (109.0, 218.0, pytest.approx(0.2)), 9: (109.0, 218.0, None)}
    parts = {(r.win_idx, r.part): r.frame for r in W.sub_window_samples(wins, f, ("qx",), 2, rig).collect()}
    assert parts == {(0, 0): 12, (0, 1): 37, (2, 0): 109, (2, 1): 109, (9, 0): 109, (9, 1): 109}


@pytest.mark.parametrize("n,k", [(3, 8), (8, 8), (9, 8), (21, 8), (50, 7)])
def test_chunks(spark, n, k):
    wins = spark.range(n).select(F.lit("a").alias("rec"), F.col("id").cast("int").alias("win_idx"))
    got = sorted((r["start"], r["len"]) for r in C.chunks(wins, k).collect())
    starts = list(range(0, max(1, n - k + 1), max(1, k // 2)))
    if starts[-1] != max(0, n - k):
        starts.append(max(0, n - k))
    assert got == [(s, min(k, n)) for s in starts]


def test_calm_frames_fallback(spark):
    g = recording("fast", 400, 9)
    g[["wx", "wy", "wz"]] *= 20
    g.loc[:30, ["wx", "wy", "wz"]] = 3.0  # ties at one value
    got = per_rec(S.calm_frames(spark.createDataFrame(g), 0.5, 50), ["frame", "calm"])["fast"]
    rate = np.linalg.norm(g[["wx", "wy", "wz"]].to_numpy(), axis=1)
    want = set(np.lexsort((g["frame"], rate))[:50])
    assert {f for f, c in got if c} == want


def test_gyro_frame_fit_recovers_a_mounting(spark):
    rng = np.random.default_rng(2)
    n, fs = 4000, 100.0
    t = np.arange(n) / fs
    w = np.stack([np.sin(0.7 * t), np.cos(0.9 * t), 0.8 * np.sin(1.3 * t)], 1)
    u = np.empty((n, 3))
    u[0] = [0, 0, 1]
    for i in range(1, n):
        u[i] = rot(w[i - 1] / fs).T @ u[i - 1]
    mount = rot(np.array([0.3, -0.5, 0.8]))
    gyr = w @ mount  # force axes = mount @ gyro axes
    acc = 9.81 * u + rng.normal(size=(n, 3)) * 0.01
    df = pd.DataFrame(np.hstack([acc, gyr]), columns=AXES[:6])
    df.insert(0, "frame", np.arange(n, dtype=np.int32))
    df.insert(0, "rec", "m")
    got = S.gyro_frame_fit(spark.createDataFrame(df), Rig(window=100, fs=fs), smooth=10).first()
    m = np.array([got[c] for c in N.ROTATION]).reshape(3, 3)
    assert np.allclose(m, mount, atol=0.02)
    assert got["residual_after"] < 0.1 * got["residual_before"]


def test_weighted_draw_follows_weights(spark):
    w = spark.createDataFrame([("hot", 90.0), ("a", 6.0), ("b", 4.0), ("none", 0.0)],
                              "rec string, weight double")
    got = dict(M.weighted_draw(w, 20_000, 1, slots=64).groupBy("rec").count().collect())
    assert sum(got.values()) == 20_000 and "none" not in got
    assert got["hot"] / 20_000 == pytest.approx(0.9, abs=0.01)
    assert got["b"] / 20_000 == pytest.approx(0.04, abs=0.006)


def test_dilation_at_rate_one_changes_nothing(spark, frames):
    rows = frames.where("rec = 'long'").withColumns({
        "draw_id": F.lit(1), "k": F.lit(1.0), "s": F.lit(1.0), "ux": F.lit(0.0),
        "uy": F.lit(0.6), "uz": F.lit(0.8)})
    out = M.apply_dilation(rows, rig=RIG)
    gap = out.join(frames.select("rec", "frame", F.col("ax").alias("o")), ["rec", "frame"])
    assert gap.agg(F.max(F.abs(F.col("ax") - F.col("o")))).first()[0] < 1e-12
    # a still sensor stays still at any rate
    still = rows.withColumns({"ax": F.lit(0.0), "ay": F.lit(9.81 * 0.6), "az": F.lit(9.81 * 0.8),
                              "k": F.lit(1.7), "s": F.lit(1.3)})
    assert M.apply_dilation(still, rig=RIG).agg(F.max(F.abs(
        F.col("ay") - 9.81 * 0.6))).first()[0] < 1e-9


def test_frame_noise_has_the_right_spread(spark):
    df = spark.range(50_000).select(F.col("id").alias("draw_id"), F.lit(0).alias("t"), *[
        F.lit(0.0).alias(c) for c in AXES[:6]])
    got = M.sensor_noise(df, 5, noise={"ax": 2.0}).agg(F.avg("ax"), F.stddev("ax")).first()
    assert abs(got[0]) < 0.05 and got[1] == pytest.approx(2.0, rel=0.02)


def test_rotation_log_near_half_a_turn(spark):
    vs = [(0.0, 0.0, 0.0), (1e-6, 0.0, 0.0), (3.1415, 0.0, 0.0), (0.0, -3.14159, 0.0),
          (1.0, 2.0, -0.5)]
    df = spark.createDataFrame(vs, "x double, y double, z double")
    df = df.withColumns(V.as_columns(V.rotvec_matrix(V.vec("x", "y", "z")), V.mat_cols("m")))
    back = df.select("x", "y", "z", *V.named(V.matrix_rotvec(V.mat(V.mat_cols("m"))), "abc"))
    for r in back.collect():
        assert np.allclose(rot(np.array(r[:3])), rot(np.array(r[3:])), atol=2e-3)
    with pytest.raises(ValueError):
        V.transform_axes(V.vec(0, 0, 1), V.identity(), "other")


def test_running_products_of_groups_of_any_length():
    g = np.random.default_rng(2)
    for sizes in ([1, 1, 1], [300], [1, 700, 2, 64, 65, 3], [40] * 30, [5000, 1]):
        bounds = np.append(0, np.cumsum(sizes))
        q = N._turns(g.normal(size=(bounds[-1], 3)), 0.02)
        want = q.copy()
        for a, b in zip(bounds[:-1], bounds[1:]):
            for i in range(a + 1, b):
                want[i] = N._quat_mul(want[i - 1:i], q[i:i + 1])[0]
        assert np.allclose(N.running_product(q, positions(bounds)), want, atol=1e-11)


def test_running_products_take_about_two_products_a_row(monkeypatch):
    rows, real = [], N._quat_mul
    monkeypatch.setattr(N, "_quat_mul", lambda p, q: rows.append(len(p)) or real(p, q))
    N.running_product(N._turns(np.ones((4096, 3)), 0.02), np.arange(4096))
    assert sum(rows) < 2.5 * 4096


def test_one_block_in_plain_numbers_is_the_same():
    g = np.random.default_rng(3)
    values = g.normal(size=(1, 5000, 7))
    values[0, :, 6] = 0.05
    values[0, 7, :3] = 0.0
    m, c, forced = N._step_maps(values, np.full((1, 3), np.nan), 0.02)
    start = np.array([0.6, 0.0, 0.8])
    assert np.allclose(N.run_one(m[0], c[0], forced[0], start), N._run_blocks(m, c, forced, start[None], True)[0], atol=1e-12)
    assert np.isnan(N.run_one(np.zeros((1, 3, 3)), np.zeros((1, 3)), np.array([True]), start)).all()


def test_noise_of_draws_is_hashed_before_their_frames_are_read(spark):
    draws = spark.createDataFrame([(i,) for i in range(4)], "draw_id bigint")
    frames = lambda d: d.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumns(
        {c: F.col("t") + i + 0.5 for i, c in enumerate(("ax", "ay", "az", "wx", "wy", "wz"))})
    late = M.sensor_noise(frames(draws), 5, 0.1, 0.3, 0.02)
    early = M.sensor_noise(frames(M.noise_factors(draws, 5, 0.1, 0.3, 0.02)), 5, 0.1, 0.3, 0.02)
    assert late.columns == early.columns and sorted(late.collect()) == sorted(early.collect())
    assert len({r.ax for r in early.where("t = 0").collect()}) == 4
