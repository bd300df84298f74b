"""Passes over packed frames give what joins by frame gave, and move no frame."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorframe import Rig
from sensorframe.operators import scan as N
from sensorframe.operators import windows as W
from sensorframe.operators.summary import calm_after_anchor
from sensorframe.plans import features

RIG = Rig(window=20, fs=20.0)
AXES = ["ax", "ay", "az", "wx", "wy", "wz"]


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(11)
    parts = []
    for rec, n in (("a", 330), ("b", 145), ("c", 7), ("d", 60)):
        x = rng.normal(size=(n, 6)) * 0.2
        x[:, 2] += 9.81
        if rec == "d":
            x[3, 3] = np.nan  # no state is known from here on
        parts.append(pd.DataFrame(x, columns=AXES).assign(rec=rec, frame=np.arange(n)))
    return spark.createDataFrame(pd.concat(parts)[["rec", "frame", *AXES]]).localCheckpoint()


def same(got, want, order):
    got, want = (t.toPandas().sort_values(order).reset_index(drop=True) for t in (got, want))
    pd.testing.assert_frame_equal(got[want.columns.tolist()], want, atol=1e-9, check_dtype=False)


def moved(df) -> list[str]:
    """Columns that rows are dealt by in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)]


@pytest.mark.parametrize("fan_out", [3, 4096])
def test_states_of_packed_frames_are_those_of_plain_ones(frames, fan_out):
    anchors = W.rest_reference(frames, RIG)
    spot = anchors.select("rec", "anchor_at").localCheckpoint()
    packed = N.pack_frames(frames, {}, RIG, block=16)
    got = packed.rows((), packed.anchored(spot, fan_out=fan_out)).select("rec", "frame", "anchor_at", *N.Q, *N.S)
    want = N.anchored_states(frames, anchors, RIG).select("rec", "frame", "anchor_at", *N.Q, *N.S)
    same(got, want, ["rec", "frame"])


def test_widest_mode_is_the_join_of_its_parts_and_moves_no_frame(frames):
    got = features.features(frames, "slowdr", RIG)
    assert not [x for x in moved(got) if "frame" in x]
    anchors = W.rest_reference(frames, RIG).localCheckpoint()
    ref = anchors.select("rec", F.col("score").alias("rest_score"), "fx", "fy", "fz")
    want = (N.up_filter(frames, 0.005, RIG, name="slow_").join(frames, ["rec", "frame"]).join(ref, "rec")
            .join(N.dead_reckon(frames, anchors, RIG).select("rec", "frame", *features.CARRIED, *features.RECKONED), ["rec", "frame"])
            .withColumns({f"rest_d{c}": F.col(f"a{c}") - F.col(f"f{c}") for c in "xyz"}))
    want = features._decomposed(want, "slow").select("rec", "frame", *features.MODES["slowdr"])
    same(got, want, ["rec", "frame"])


@pytest.mark.parametrize("mode", ["none", "both", "slowrest", "slowrest2"])
def test_modes_share_packed_frames(frames, mode):
    packed = features.with_directions(frames, ["both", "slowrest2"], RIG, packed=True)
    got = features.features(packed, mode, RIG)
    assert not [x for x in moved(got) if "frame" in x]
    same(got, features.features(frames, mode, RIG), ["rec", "frame"])


def test_candidate_directions_come_with_the_asked_rows(frames):
    anchors = W.rest_anchor(frames, RIG).localCheckpoint()
    asked = frames.where("frame % 3 = 0 AND rec <> 'b'").select("rec", "frame", (F.col("ax") * 2).alias("s_x"))
    got = N.carried_up_by_map(frames, anchors, RIG, at=asked)
    assert not [x for x in moved(got) if "frame" in x]
    same(got, N.carried_up_by_map(frames, anchors, RIG).join(asked, ["rec", "frame"]), ["rec", "candidate", "frame"])
    turned = frames.select("rec", "frame", *AXES[:3], *[(-F.col(c)).alias(c) for c in AXES[3:]])
    plain = N.carried_up(N.attitude(turned, anchors, RIG), anchors)
    same(got.where("candidate = 'negated'").select("rec", "frame", "ux", "uy", "uz"), plain.join(asked.select("rec", "frame"), ["rec", "frame"]), ["rec", "frame"])


def test_calm_frames_are_smoothed_where_they_lie(frames):
    calm = calm_after_anchor(frames, W.rest_anchor(frames, RIG), RIG, earliest=0.0, latest=9.0, minimum=5)
    assert calm.count() > 100
    dealt = moved(calm)
    assert [x for x in dealt if x.startswith("rec, _block")] and not [x for x in dealt if x == "rec" and "_m_ax" in x]
    plan = calm._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi, ((rec") and "_block" in re.search(r"Join LeftSemi.*", plan)[0]
