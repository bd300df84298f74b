"""Batch inference: index and frames to features, chunks, scores and predictions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sensorframe.functions import vec as V
from sensorframe.operators.chunks import score_chunks
from sensorframe.operators.windows import window_means
from sensorframe.params import CONTEXT_WINDOWS, DEFAULT_RIG, Rig
from sensorframe.plans.features import MODES, features


def infer(index: DataFrame, frames: DataFrame,
          model: Callable[[np.ndarray, np.ndarray], np.ndarray], mode: str = "none",
          k: int = CONTEXT_WINDOWS, stitch: str = "center", rig: Rig = DEFAULT_RIG) -> DataFrame:
    """One velocity per index window: window_id, vx, vy, vz.

    Only recordings in the index are read. Windows are scored inside overlapping
    chunks on their mean feature channels by the given vectorised model.
    """
    mine = frames.join(index.select("rec").distinct(), "rec", "left_semi")
    means = window_means(features(mine, mode, rig), {c: c for c in MODES[mode]}, rig)
    asked = means.join(index.select("rec", "win_idx"), ["rec", "win_idx"], "left_semi")
    scored = score_chunks(asked, MODES[mode], model, k, stitch)
    return index.join(scored, ["rec", "win_idx"]).select("window_id", *V.VEL)


def solution(index: DataFrame, frames: DataFrame, rig: Rig = DEFAULT_RIG) -> DataFrame:
    """Index windows with pose, time and truth, ready for scoring."""
    from sensorframe.operators.windows import pose_lookup
    posed = pose_lookup(index, frames, rig)
    return posed.withColumnsRenamed({c: f"{c}_gt" for c in V.VEL}).withColumn(
        "traj_id", F.col("rec"))
