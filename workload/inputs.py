"""Spark inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorframe.operators.windows import window_means
from sensorframe.plans.evaluation import path_rmse, with_errors
from sensorframe.sources.views import LINE_RIG, platforms, sensor_view, with_platform
from sensorframe.plans.training_set import recording_table
from sensorframe.session import write_once
from workload.sql import RUNS

RIG = LINE_RIG
AXES = ("ax", "ay", "az", "wx", "wy", "wz", "vx", "vy", "vz")


def stored_frames(spark: SparkSession, d: str) -> DataFrame:
    """The frame table written once, for jobs that read it several times."""
    return write_once(sensor_view(spark, d), "frames")


def means(spark: SparkSession, d: str) -> DataFrame:
    return window_means(sensor_view(spark, d), {c: c for c in AXES}, RIG)


def truth(spark: SparkSession, d: str, f: DataFrame | None = None) -> DataFrame:
    return window_means(sensor_view(spark, d) if f is None else f, {c: c for c in ("vx", "vy", "vz")}, RIG)


def matched(spark: SparkSession, d: str, w: DataFrame | None = None) -> DataFrame:
    """Truth windows (``w``: written before) with the predictions of four runs (a fixed perturbation each)."""
    w = with_platform(truth(spark, d), spark, d) if w is None else w
    runs = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(a).alias("amp"),
                                        F.lit(p).alias("phase")) for t, a, p in RUNS]))
    wide = w.withColumn("r", runs)
    amp, at = F.col("r.amp"), F.col("win_idx") + F.col("r.phase")
    return wide.select(
        F.col("r.tag").alias("tag"), "rec", "win_idx", "platform",
        F.col("vx").alias("vx_gt"), F.col("vy").alias("vy_gt"), F.col("vz").alias("vz_gt"),
        (F.col("vx") + amp * F.sin(at)).alias("vx_pred"),
        (F.col("vy") + amp * F.sin(at + 1)).alias("vy_pred"),
        (F.col("vz") + amp * F.sin(at + 2)).alias("vz_pred"))


def stored_matched(spark: SparkSession, d: str) -> DataFrame:
    """Matched windows written once, for reports that read them several times."""
    return write_once(matched(spark, d), "matched")


def errors(spark: SparkSession, d: str, m: DataFrame | None = None) -> DataFrame:
    return with_errors(matched(spark, d) if m is None else m)


def path_errors(spark: SparkSession, d: str, m: DataFrame | None = None) -> DataFrame:
    """ate per (tag, platform, rec): the centred path error with the body as world frame."""
    return path_rmse(steps(spark, d, m), ["tag", "platform", "rec"], "win_idx").withColumnRenamed(
        "path_rmse", "ate")


def steps(spark: SparkSession, d: str, m: DataFrame | None = None) -> DataFrame:
    """Predicted (m_*) and true (t_*) displacement per window."""
    m = matched(spark, d) if m is None else m
    return m.withColumnsRenamed({**{f"v{a}_pred": f"m_{a}" for a in "xyz"},
                                 **{f"v{a}_gt": f"t_{a}" for a in "xyz"}})


def posed(spark: SparkSession, d: str) -> DataFrame:
    """Frames with a time stamp, an attitude and a position made from their axes."""
    return sensor_view(spark, d).withColumns({
        "ts": F.col("frame") / RIG.fs, "qx": F.col("wx"), "qy": F.col("wy"), "qz": F.col("wz"),
        "qw": F.lit(1.0), "px": F.col("ax"), "py": F.col("ay"), "pz": F.col("az")})


def recordings(spark: SparkSession, d: str, f: DataFrame | None = None) -> DataFrame:
    f = sensor_view(spark, d) if f is None else f
    return recording_table(f, platforms(spark, d), RIG)
