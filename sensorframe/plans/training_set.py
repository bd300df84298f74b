"""Training-set job: weighted draws placed, resampled and labelled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sensorframe.functions import vec as V
from sensorframe.operators import sampling as M
from sensorframe.params import DEFAULT_RIG, Rig


def recording_table(frames: DataFrame, platforms: DataFrame, rig: Rig = DEFAULT_RIG) -> DataFrame:
    """rec, platform, n_frames, n_windows."""
    n = frames.groupBy("rec").agg(F.count(F.lit(1)).alias("n_frames"))
    return n.join(platforms, "rec").withColumn(
        "n_windows", F.floor(F.col("n_frames") / rig.window).cast("bigint"))


def draw_windows(frames: DataFrame, recs: DataFrame, n_draws: int, seg_len: int = 1,
                 seed: int = 0, cols: Sequence[str] = (*V.ACC, *V.GYR, *V.VEL),
                 rig: Rig = DEFAULT_RIG, **weights) -> DataFrame:
    """Frames of balanced random segments, one row per draw, step and frame."""
    weighted = M.recording_weights(recs, **weights)
    draws = M.weighted_draw(weighted, n_draws, seed)
    placed = M.place_segments(draws, recs, seg_len, seed, rig)
    return M.segment_frames(placed, frames, cols, seg_len, rig)


def dilated_draws(frames: DataFrame, recs: DataFrame, n_draws: int, rates: tuple[float, float],
                  up: DataFrame, seg_len: int = 1, seed: int = 0,
                  scales: tuple[float, float] | None = None, rig: Rig = DEFAULT_RIG,
                  smooth: bool = False) -> DataFrame:
    """Segments replayed at random rates and scales with consistent physics.

    ``up`` gives the true up direction per frame (ux, uy, uz).
    """
    draws = M.weighted_draw(M.recording_weights(recs), n_draws, seed)
    rated = M.dilation_rates(draws, seed, rates, scales=scales)
    placed = M.place_dilated(rated, recs, seg_len, seed, rig=rig)
    table = frames.join(up.select("rec", "frame", "ux", "uy", "uz"), ["rec", "frame"])
    cols = (*V.ACC, *V.GYR, *V.VEL, "ux", "uy", "uz")
    make = M.smooth_dilated_frames if smooth else M.dilated_frames
    return M.apply_dilation(make(placed, table, cols, rig=rig), rig=rig)
