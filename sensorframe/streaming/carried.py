"""Filters whose state is carried from one micro-batch of a stream to the next."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sensorframe.functions import vec as V
from sensorframe.operators.scan import _step_maps, run_one
from sensorframe.params import DEFAULT_RIG, SLOW_GAIN, Rig

#: What is kept of a recording: direction, rate of the last frame, the next frame, and frames that came too early.
STATE = "ux double, uy double, uz double, wx double, wy double, wz double, next bigint, held binary"
_FIELDS = 8  # frame, six axes, gain


def _first_direction(row: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(row[1:4])
    return row[1:4] / size if size > 1e-6 else np.array([0.0, 0.0, 1.0])


def _released(held: np.ndarray, after: int, reorder: int) -> int:
    """How many of the sorted frames go on: those without a gap, and any beyond ``reorder``."""
    ready = int(np.argmin(np.append(held[:, 0] == after + np.arange(len(held)), False)))
    return max(ready, len(held) - reorder)


def stream_up_filter(stream: DataFrame, gain: Column | float = SLOW_GAIN, rig: Rig = DEFAULT_RIG,
                     reorder: int = 10_000, patience: str | None = None, first: int = 0,
                     name: str = "u") -> DataFrame:
    """Filtered up direction of every frame of a live stream, as ``up_filter`` gives it for a whole table.

    ``stream``: rec, frame (numbered from ``first``), the six axes. A recording's
    direction, its last rate and the frames that came too early are keyed state. A
    frame is given out once, in order, when all before it came; where one is
    missing, at most ``reorder`` later frames wait, then the earliest goes on over
    the gap. Frames below those given out come too late and are left out; of
    several with one number in a batch the smallest (by its values) counts, and
    rows without rec or frame have no place. With ``patience`` (in milliseconds)
    what waits goes on when a recording is silent for so long; without it, it waits.
    """
    gain = gain if isinstance(gain, Column) else F.lit(float(gain))
    names = [f"{name}{c}" for c in "xyz"]
    axes = [*V.ACC, *V.GYR]
    rows = stream.where("rec IS NOT NULL AND frame IS NOT NULL").select(
        "rec", F.col("frame").cast("bigint").alias("frame"), *[F.col(c).cast("double").alias(c) for c in axes],
        gain.cast("double").alias("_gain"))
    dt, wait = rig.dt, int(patience) if patience is not None else None

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, rate, after, held = np.full(3, np.nan), np.full(3, np.nan), first, np.empty((0, _FIELDS))
        if state.exists:
            *numbers, after, kept = state.get
            up, rate = np.array(numbers[:3], float), np.array(numbers[3:], float)
            held = np.frombuffer(kept, float).reshape(-1, _FIELDS)
        silent = state.hasTimedOut
        new = [] if silent else [b[["frame", *axes, "_gain"]].to_numpy(float) for b in batches]
        held = np.concatenate([held, *new])
        held = held[held[:, 0] >= after]
        held = held[np.lexsort(held.T[::-1])]
        held = held[np.append(True, np.diff(held[:, 0]) > 0)[:len(held)]]
        n = len(held) if silent else _released(held, after, reorder)
        if n:
            go = held[:n]
            start = _first_direction(go[0]) if np.isnan(up).any() else up
            states = run_one(*(x[0] for x in _step_maps(go[None, :, 1:], rate[None], dt)), start)
            up, rate, after, held = states[-1], go[-1, 4:7], int(go[-1, 0]) + 1, held[n:]
            yield pd.DataFrame({"rec": key[0], "frame": go[:, 0].astype("int64"), **dict(zip(names, states.T))})
        state.update((*up.tolist(), *rate.tolist(), after, held.tobytes()))
        if wait is not None and len(held):
            state.setTimeoutDuration(wait)

    rec_type = stream.schema["rec"].dataType.simpleString()
    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("rec").applyInPandasWithState(
        step, f"rec {rec_type}, frame bigint, " + ", ".join(f"{n} double" for n in names), STATE, "append", timeout)
