"""Passes over packed frames hold bounded pieces and leave the frames where they are."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from sensorframe import Rig
from sensorframe.operators import scan as N
from sensorframe.operators import windows as W
from sensorframe.plans import features

RIG = Rig(window=20, fs=20.0)
AXES = ["ax", "ay", "az", "wx", "wy", "wz"]


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(5)
    parts = []
    for rec, n in (("a", 130), ("b", 45), ("c", 7)):
        x = rng.normal(size=(n, 6)) * 0.4
        x[:, 2] += 9.81
        parts.append(pd.DataFrame(x, columns=AXES).assign(rec=rec, frame=np.arange(n)))
    return spark.createDataFrame(pd.concat(parts)[["rec", "frame", *AXES]])


def test_a_batch_of_blocks_is_opened_in_bounded_pieces():
    sizes = [1024] * 700 + [3] * 10
    batch = pa.record_batch({"rec": pa.array(range(len(sizes))), "rows": pa.array([[1.0] * n for n in sizes])})
    pieces = list(N._pieces([batch]))
    padded = [b.num_rows * int(b.column("rows").value_lengths().to_numpy().max()) for b in pieces]
    assert max(padded) <= N.UP_CELLS
    assert sum(b.num_rows for b in pieces) == len(sizes)


def test_filters_of_one_pass_are_those_of_single_ones(frames):
    both = N.up_filters(frames, {"slow_": 0.005, "adapt_": N.adaptive_gain()}, RIG, block=32).toPandas().sort_values(["rec", "frame"])
    for name, gain in (("slow_", 0.005), ("adapt_", N.adaptive_gain())):
        one = N.up_filter(frames, gain, RIG, block=32, name=name).toPandas().sort_values(["rec", "frame"])
        for c in "xyz":
            assert np.allclose(both[f"{name}{c}"], one[f"{name}{c}"], atol=1e-12)


def test_directions_are_filtered_once_for_all_modes(frames):
    modes = ["slow", "adapt"]
    held = features.with_directions(frames, modes, RIG)
    for mode in modes:
        want = W.window_means(features.features(frames, mode, RIG), {c: c for c in features.MODES[mode]}, RIG).toPandas()
        got = W.window_means(features.features(held, mode, RIG), {c: c for c in features.MODES[mode]}, RIG).toPandas()
        order = ["rec", "win_idx"]
        pd.testing.assert_frame_equal(*(t.sort_values(order).reset_index(drop=True) for t in (want, got)))
    assert not features.with_directions(held, modes, RIG)._jdf.queryExecution().optimizedPlan().toString().count("Generate")
