"""State carried over micro-batches, channels under turns, and picks by counted places."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.functions import vec as V
from sensorframe.operators import chunks, sampling, scan
from sensorframe.operators.turns import heading_turn, turn_channels
from sensorframe.params import Rig
from sensorframe.session import scratch_path
from sensorframe.streaming.carried import stream_up_filter

RIG = Rig(window=50, fs=50.0)
AXES = (*V.ACC, *V.GYR)
SCHEMA = "rec long, frame long, " + ", ".join(f"{c} double" for c in AXES)


def frames(rec, n, seed=0):
    g = np.random.default_rng(seed + rec)
    x = np.concatenate([g.normal(size=(n, 3)) + [0, 0, 9.8], g.normal(size=(n, 3))], axis=1)
    return [(rec, i, *map(float, r)) for i, r in enumerate(x)]


def streamed(spark, batches, **more):
    """What the stream gives out when every list of rows is a batch of its own, and where it restarts in between."""
    path, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        live = spark.readStream.schema(SCHEMA).parquet(path)
        up = stream_up_filter(live, 0.05, RIG, **more)
        up.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(up.schema).parquet(out).collect()
    assert len({(r.rec, r.frame) for r in got}) == len(got)
    return {(r.rec, r.frame): (r.ux, r.uy, r.uz) for r in got}


def whole(spark, rows):
    return {(r.rec, r.frame): (r.ux, r.uy, r.uz) for r in scan.up_filter(spark.createDataFrame(rows, SCHEMA), 0.05, RIG).collect()}


def same(a, b):
    return a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-7) for k in a)


def test_batches_and_restarts_give_the_same_as_the_whole_table(spark):
    one, two = frames(1, 90), frames(2, 30)
    batches = [one[:20] + one[40:60] + two[10:], one[20:40][::-1] + two[:10], one[60:]]
    assert same(streamed(spark, batches), whole(spark, one + two))


def test_late_repeated_and_missing_frames(spark):
    rows = frames(1, 40)
    again = [(1, 5, *[9.0] * 6), (None, 3, *[1.0] * 6), (1, None, *[1.0] * 6)]
    got = streamed(spark, [rows[:10] + again[1:], again[:1] + rows[10:15] + rows[10:15], rows[20:]])
    assert same(got, whole(spark, rows[:15]))  # 15 to 19 are missing, the rest waits
    over = streamed(spark, [rows[:15], rows[20:]], reorder=12)
    assert sorted(f for _, f in over) == [*range(15), *range(20, 28)]


@pytest.mark.parametrize("mirror", (False, True))
def test_turned_increments_are_increments_of_turned_frames(spark, mirror):
    g = np.random.default_rng(3)
    rot = V.mat_cols("r")
    rows = []
    for k in range(6):
        q, _ = np.linalg.qr(g.normal(size=(3, 3)))
        q *= np.sign(np.linalg.det(q))
        rows.append((1, k, *map(float, q.ravel()), *map(float, g.normal(size=6)), 0.1, 0.0))
    velocity, outside = ("d_x", "d_y", "d_z"), ("i_x", "i_y", "i_z")
    ends = spark.createDataFrame(rows, "rec long, win_idx long, " + ", ".join(f"{c} double" for c in (*rot, *velocity, *outside, "since", "deviation")))
    m = heading_turn(F.lit(0.7))
    if mirror:
        m = V.matmul(m, tuple(F.lit(x) for x in (-1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)))
    change = ("c_x", "c_y", "c_z")
    for mode in ("end", "int", "zero"):  # a soft bound acts on single axes, before the turn: here it is out of reach
        after = turn_channels(chunks.window_increments(ends, mode, bound=1e6), m, [("polar", change), ("increment", chunks.INCREMENT)])
        turned = turn_channels(ends, m, [("polar", velocity), ("attitude", rot), ("fixed", outside)])
        before = chunks.window_increments(turned, mode, bound=1e6)
        a, b = ({r.win_idx: [r[c] for c in (*change, *chunks.INCREMENT)] for r in df.collect()} for df in (after, before))
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-9) for k in a)


def test_rates_labels_and_wrong_groups(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 1.0, 2.0, 3.0)], "a double, b double, c double, x double, y double, z double")
    flip = tuple(F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 1.0))
    quarter = heading_turn(F.lit(math.pi / 2))
    r = turn_channels(df, flip, [("axial", ("a", "b", "c")), ("label", ("x", "y", "z"))], quarter).first()
    assert np.allclose(r, (-1, 2, -3, -1, 2, 3)) and df.columns == list(r.asDict())
    for groups in ([("polar", ("a", "b"))], [("other", ("a",))], [("polar", ("a", "b", "c")), ("fixed", ("a",))]):
        with pytest.raises(ValueError):
            turn_channels(df, flip, groups)


def test_picks_are_even_on_every_level(spark):
    rows = [(0, 1, w, True) for w in range(9)] + [(0, 2, 0, True), (5, 3, 4, True), (7, 4, 0, False)]
    strata = spark.createDataFrame(rows, "cell int, rec long, win_idx int, rare boolean")
    got = [(r.cell, r.rec, r.win_idx) for r in sampling.stratified_picks(strata, 4000, 1).collect()]
    share = lambda test: sum(map(test, got)) / len(got)
    assert len(got) == 4000 and not any(c == 7 for c, *_ in got)
    assert abs(share(lambda x: x[0] == 5) - 1 / 2) < 0.03 and abs(share(lambda x: x[1] == 2) - 1 / 4) < 0.03
    assert abs(share(lambda x: x[1:] == (1, 8)) - 1 / 36) < 0.01
    assert sampling.stratified_picks(strata.where("NOT rare"), 10).count() == 0
