"""Shared parameters of a sensor rig and the scoring constants.

Every operator takes these as arguments; nothing reads them as globals.
"""

from __future__ import annotations

from dataclasses import dataclass

# The result depends on them being exactly these numbers.
GRAVITY = 9.81
WINDOW_FRAMES = 200
SAMPLE_RATE_HZ = 200.0
CONTEXT_WINDOWS = 40
FAST_GAIN = 0.05
SLOW_GAIN = 0.005
ADAPTIVE_GAIN = 0.005
ADAPTIVE_SIGMA = 1.0
VELOCITY_SQUASH = 8.0
INCREMENT_SQUASH = 15.0
AVE_WEIGHT, ATE_WEIGHT = 0.6, 0.4
AVE_REFERENCE, ATE_REFERENCE = 0.7356, 3.1160
SHORT_RECORDING_SCORE = 9.0
SPEED_EDGES = (0.0, 2.0, 4.0, 6.0, 8.0, 10.0)
GYRO_AXIS_MAP = ((0.0, -1.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 0.0, -1.0))
PLATFORM_IDS = {"car": 0, "dog": 1, "drone": 2, "human": 3}


@dataclass(frozen=True)
class Rig:
    """How a table of frames was sampled: window length, rate, gravity."""

    window: int = WINDOW_FRAMES
    fs: float = SAMPLE_RATE_HZ
    g: float = GRAVITY

    @property
    def dt(self) -> float:
        return 1.0 / self.fs


DEFAULT_RIG = Rig()
