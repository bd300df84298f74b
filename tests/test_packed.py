from __future__ import annotations

import numpy as np
import pytest

from sensorframe.operators import packed as P
from sensorframe.operators import sampling as M
from sensorframe.operators import sequence as X
from sensorframe.params import Rig

RIG = Rig(window=5, fs=100.0)
LENGTHS = (1, 2, 4, 5, 6, 7, 10, 11, 12, 23)


@pytest.fixture(scope="module")
def signal(spark):
    g = np.random.default_rng(0)
    values = {r: g.normal(size=(n, 2)) for r, n in enumerate(LENGTHS)}
    rows = [(r, i, float(a), float(b), f"{r}-{i}") for r, v in values.items() for i, (a, b) in enumerate(v)]
    return values, spark.createDataFrame(rows, "rec bigint, frame bigint, a double, b double, tag string").repartition(3)


def at(v, x):
    return [np.interp(x, np.arange(len(v)), v[:, c]) for c in (0, 1)]


def test_windows_hold_their_halo(signal):
    values, frames = signal
    rows = P.pack_windows(frames, ["a", "b"], RIG, keep=["tag"]).collect()
    assert len(rows) == sum(-(-n // 5) for n in LENGTHS)
    for r in rows:
        v = values[r.rec][r.win_idx * 5:r.win_idx * 5 + 7]
        assert r.a == v[:, 0].tolist() and r.b == v[:, 1].tolist() and r.n == min(5, len(v))
        assert [x.tag for x in r.rows] == [f"{r.rec}-{r.win_idx * 5 + i}" for i in range(r.n)]
    assert {(r.rec, r.n_frames) for r in P.packed_lengths(P.pack_windows(frames, ["a"], RIG), RIG).collect()} == set(enumerate(LENGTHS))


@pytest.mark.parametrize("rate", [0.3, 0.5, 1.0, 1.7, 2.0, 6.5])
def test_resample_every_length(signal, rate):
    values, frames = signal
    got = {(r.rec, r.out_frame): (r.a, r.b) for r in X.resample(frames, ["a", "b"], rate, RIG).collect()}
    want = {(r, t): tuple(x[t] for x in at(v, np.arange(int((len(v) - 1) // rate) + 1) * rate))
            for r, v in values.items() if len(v) > 1 for t in range(int((len(v) - 1) // rate) + 1)}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_runs_from_any_place(spark, signal):
    values, frames = signal
    runs = [(i, r, b, k, c) for i, (r, b, k, c) in enumerate(
        (r, b, k, c) for r, n in enumerate(LENGTHS) if n > 1 for b in range(n) for k in (0.4, 1.0, 1.3, 5.0)
        for c in (1, int((n - 1 - b) / k) + 1))]
    table = spark.createDataFrame(runs, "draw_id bigint, rec bigint, base bigint, k double, count bigint")
    got = {(r.draw_id, r.t): (r.a, r.b) for r in P.lerp_runs(
        table, P.pack_windows(frames, ["a", "b"], RIG), ["a", "b"], table["count"], rig=RIG).collect()}
    want = {(i, t): tuple(x[t] for x in at(values[r], b + k * np.arange(c))) for i, r, b, k, c in runs for t in range(c)}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_shift_repeats_edges(spark, signal):
    values, frames = signal
    lags = {r: s for r, s in zip(range(len(LENGTHS)), (30, -30, 0, 500, -500, 20, 70, -70, None, 110))}
    shifts = spark.createDataFrame([(r, None if s is None else float(s)) for r, s in lags.items() if r != 2], "rec bigint, lag_ms double")
    rows = X.variable_shift(frames, shifts, ["a"], rig=RIG).collect()
    assert len(rows) == sum(LENGTHS)
    for r in rows:
        step = round((lags[r.rec] or 0) / 10)
        assert r.a == values[r.rec][min(max(r.frame + step, 0), LENGTHS[r.rec] - 1), 0]
        assert (r.b, r.tag) == (values[r.rec][r.frame, 1], f"{r.rec}-{r.frame}")


def test_segments_start_anywhere(spark, signal):
    values, frames = signal
    placed = spark.createDataFrame([(1, 9, 3, 4), (2, 6, 0, 2), (3, 6, 4, 1), (4, 3, 0, 1)], "draw_id bigint, rec bigint, base bigint, len bigint")
    rows = M.segment_frames(placed, frames, ["a"], 4, RIG, pad=True).collect()
    assert len(rows) == 4 * 4 * 5
    for r in rows:
        start = r.base + min(r.step, r.len - 1) * 5
        assert start <= r.frame < start + 5 and r.a == values[r.rec][r.frame, 0] and r.valid == (r.step < r.len)
