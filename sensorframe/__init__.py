"""sensorframe: Spark DataFrame operators for multi-axis sensor recordings."""

from sensorframe.params import DEFAULT_RIG, Rig
from sensorframe.session import build_session

__all__ = ["DEFAULT_RIG", "Rig", "build_session"]
