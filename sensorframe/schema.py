"""Table schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

FRAMES = T.StructType(
    [T.StructField("rec", T.StringType(), False), T.StructField("frame", T.LongType(), False),
     T.StructField("ts", T.DoubleType())]
    + [T.StructField(c, T.DoubleType()) for c in (
        "ax", "ay", "az", "wx", "wy", "wz", "vx", "vy", "vz", "qx", "qy", "qz", "qw",
        "px", "py", "pz")])

WINDOW_INDEX = T.StructType([
    T.StructField("window_id", T.StringType()), T.StructField("traj_id", T.StringType()),
    T.StructField("win_idx", T.LongType()), T.StructField("platform", T.StringType())])

TARGETS = T.StructType([T.StructField("window_id", T.StringType())] + [
    T.StructField(c, T.DoubleType()) for c in ("vx", "vy", "vz")])

PREDICTION = TARGETS

SOLUTION = T.StructType(
    [T.StructField("window_id", T.StringType()), T.StructField("traj_id", T.StringType()),
     T.StructField("win_idx", T.LongType()), T.StructField("platform", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in (
        "qx", "qy", "qz", "qw", "gx", "gy", "gz", "dt", "vx_gt", "vy_gt", "vz_gt")])

FOLD = T.StructType([
    T.StructField("held", T.ArrayType(T.StringType())),
    T.StructField("groups", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("note", T.StringType())])
