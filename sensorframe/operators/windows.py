"""Fixed windows over frames: targets, rest periods, slices and neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorframe.functions import vec as V
from sensorframe.operators.blocks import apply_local, keys_of
from sensorframe.params import DEFAULT_RIG, SHORT_RECORDING_SCORE, Rig

WINDOW_BLOCK = 4096


def with_window(frames: DataFrame, rig: Rig = DEFAULT_RIG) -> DataFrame:
    """Add ``win_idx``, the fixed window a frame falls in."""
    return frames.withColumn("win_idx", F.floor(F.col("frame") / rig.window).cast("bigint"))


def window_means(frames: DataFrame, cols: dict[str, Column | str], rig: Rig = DEFAULT_RIG,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Mean of each column over every complete window; unfinished tails are dropped."""
    aggs = [F.avg(c).alias(n) for n, c in cols.items()]
    return (with_window(frames, rig).groupBy("rec", "win_idx", *keep)
            .agg(F.count(F.lit(1)).alias("_n"), *aggs)
            .where(F.col("_n") == rig.window).drop("_n"))


def window_targets(frames: DataFrame, rig: Rig = DEFAULT_RIG) -> DataFrame:
    """The velocity label of a window: the mean over its frames."""
    return window_means(frames, {c: c for c in V.VEL}, rig)


def rest_scores(frames: DataFrame, rig: Rig = DEFAULT_RIG, ddof: int = 0) -> DataFrame:
    """How calm each window is (lower is calmer), with its mean force vector.

    score = |mean |a| - g| + mean |w| + 0.5 std |a|; ``ddof`` picks the
    population (0) or the sample (1) deviation.
    """
    spread = F.stddev_pop if ddof == 0 else F.stddev_samp
    return (with_window(frames, rig)
            .withColumns({"_a": V.norm(V.vec(*V.ACC)), "_w": V.norm(V.vec(*V.GYR))})
            .groupBy("rec", "win_idx")
            .agg(F.count(F.lit(1)).alias("_n"),
                 (F.abs(F.avg("_a") - rig.g) + F.avg("_w") + 0.5 * spread("_a")).alias("score"),
                 *[F.avg(c).alias(f"f{c[1]}") for c in V.ACC])
            .where(F.col("_n") == rig.window).drop("_n"))


def rest_anchor(frames: DataFrame, rig: Rig = DEFAULT_RIG, ddof: int = 0) -> DataFrame:
    """The calmest window of every recording; ties go to the earliest one."""
    best = rest_scores(frames, rig, ddof).groupBy("rec").agg(
        F.min(F.struct("score", "win_idx", "fx", "fy", "fz")).alias("b"))
    return best.select("rec", F.col("b.win_idx").alias("anchor_win"), "b.score",
                       "b.fx", "b.fy", "b.fz",
                       (F.col("b.win_idx") * rig.window + rig.window // 2).alias("anchor_at"))


def rest_reference(frames: DataFrame, rig: Rig = DEFAULT_RIG) -> DataFrame:
    """Rest force and score per recording.

    A recording shorter than one window has no anchor: its mean force is used
    with a fixed poor score and window 0. ``anchor_at`` is the centre frame of
    the anchor window, kept inside the recording.
    """
    whole = frames.groupBy("rec").agg(F.count(F.lit(1)).alias("_len"),
                                      *[F.avg(c).alias(f"_m{c[1]}") for c in V.ACC])
    return (whole.join(rest_anchor(frames, rig), "rec", "left")
            .select("rec", F.coalesce("anchor_win", F.lit(0)).alias("anchor_win"),
                    F.coalesce("score", F.lit(SHORT_RECORDING_SCORE)).alias("score"),
                    *[F.coalesce(f"f{a}", f"_m{a}").alias(f"f{a}") for a in "xyz"],
                    F.coalesce("anchor_at", F.least(F.lit(rig.window // 2), (F.col("_len") - 1)
                                                    .cast("bigint"))).alias("anchor_at")))


def rest_flag(frames: DataFrame, anchors: DataFrame, rig: Rig = DEFAULT_RIG) -> DataFrame:
    """1.0 on the frames of the anchor window, 0.0 elsewhere."""
    return (with_window(frames, rig).join(anchors.select("rec", "anchor_win"), "rec", "left")
            .withColumn("rest_flag", F.coalesce((F.col("win_idx") == F.col("anchor_win"))
                                                .cast("double"), F.lit(0.0)))
            .drop("anchor_win"))


def window_slices(windows: DataFrame, frames: DataFrame, rig: Rig = DEFAULT_RIG,
                  keep_partial: bool = False) -> DataFrame:
    """Frames of the listed windows: a range join written as an equi-join."""
    joined = windows.join(with_window(frames, rig), ["rec", "win_idx"])
    if keep_partial:
        return joined
    full = (with_window(frames, rig).groupBy("rec", "win_idx").agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") == rig.window).drop("_n"))
    return joined.join(full, ["rec", "win_idx"], "left_semi")


def _frames_at(windows: DataFrame, frames: DataFrame, places: dict[str, int], cols: Sequence[str],
               rig: Rig) -> DataFrame:
    """Rows of ``frames`` at fixed places of each window, as structs (frame and ``cols``).

    One aggregate per window combines before the shuffle, so only the wanted rows
    travel. A place past the end of the recording reads its last row. Windows of
    recordings without frames are left out.
    """
    row = F.struct("frame", *[c for c in cols if c != "frame"])
    inside = F.col("frame") % rig.window
    found = with_window(frames, rig).groupBy("rec", "win_idx").agg(
        *[F.max(F.when(inside == at, row)).alias(n) for n, at in places.items()], F.max_by(row, "frame").alias("_end"))
    tail = found.groupBy("rec").agg(F.max_by("_end", "win_idx").alias("_tail"))
    return windows.join(found, ["rec", "win_idx"], "left").join(tail, "rec").withColumns(
        {n: F.coalesce(n, "_end", "_tail") for n in places})


def pose_lookup(windows: DataFrame, frames: DataFrame, rig: Rig = DEFAULT_RIG,
                ts: str = "ts", middle: tuple[str, ...] = V.QUAT,
                last: tuple[str, ...] = ("px", "py", "pz")) -> DataFrame:
    """Pose of a window: attitude at its middle frame, position at its last one.

    Frames past the end of a recording are clamped to its last row. ``dt`` is
    the time from first to last frame plus one sample; null past the end.
    """
    at = _frames_at(windows, frames, {"_first": 0, "_mid": rig.window // 2, "_last": rig.window - 1},
                    sorted(set(middle) | set(last) | {ts}), rig)
    started = F.when(F.col("_first.frame") == F.col("win_idx") * rig.window, F.col(f"_first.{ts}"))
    return at.select(
        *windows.columns, *[F.col(f"_mid.{c}").alias(c) for c in middle],
        *[F.col(f"_last.{c}").alias(f"g{c[-1]}" if c in ("px", "py", "pz") else f"{c}_last") for c in last],
        (F.col(f"_last.{ts}") - started + rig.dt).alias("dt"))


def sub_window_means(frames: DataFrame, cols: tuple[str, ...], parts: int,
                     rig: Rig = DEFAULT_RIG) -> DataFrame:
    """Means over ``parts`` equal pieces of every complete window."""
    if rig.window % parts:
        raise ValueError(f"{parts} parts do not divide {rig.window} frames evenly")
    size = rig.window // parts
    pieces = (with_window(frames, rig)
              .withColumn("part", F.floor((F.col("frame") % rig.window) / size).cast("int"))
              .groupBy("rec", "win_idx", "part")
              .agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in cols]))
    full = (pieces.groupBy("rec", "win_idx").agg(F.sum("_n").alias("_all"))
            .where(F.col("_all") == rig.window).drop("_all"))
    return pieces.join(full, ["rec", "win_idx"], "left_semi").drop("_n")


def sub_window_samples(windows: DataFrame, frames: DataFrame, cols: tuple[str, ...], parts: int,
                       rig: Rig = DEFAULT_RIG) -> DataFrame:
    """Frames at the centres of equal window pieces, clamped to the last row."""
    places = {f"_p{i}": int((i + 0.5) * (rig.window / parts)) for i in range(parts)}
    at = _frames_at(windows.select("rec", "win_idx"), frames, places, cols, rig)
    each = at.select("rec", "win_idx", F.posexplode(F.array(*places)).alias("part", "_row"))
    return each.select("rec", "win_idx", "part", "_row.frame", *[F.col(f"_row.{c}").alias(c) for c in cols])


def neighbour_windows(windows: DataFrame, cols: tuple[str, ...], reach: int = 2) -> DataFrame:
    """Columns of the windows ``reach`` either side, with a presence flag.

    Missing neighbours read as zero. Windows of one recording are blocked, so a
    long recording is never sorted in one task.
    """
    def stage(w):
        out = {}
        for r in range(-reach, reach + 1):
            tag = f"m{-r}" if r < 0 else f"p{r}"
            there = F.lead("win_idx", r).over(w) == F.col("win_idx") + r if r else F.lit(True)
            out[f"has_{tag}"] = F.coalesce(there, F.lit(False))
            for c in cols:
                value = F.lead(c, r).over(w) if r else F.col(c)
                out[f"{c}_{tag}"] = F.when(F.coalesce(there, F.lit(False)), value).otherwise(0.0)
        return out
    return apply_local(windows, [stage], reach, reach, pos="win_idx", block=WINDOW_BLOCK)


def window_gaps(windows: DataFrame) -> DataFrame:
    """Windows that do not follow their predecessor by one (must be empty).

    Uses an anti-join with the shifted index, so it needs no ordering at all.
    """
    first = windows.groupBy("rec").agg(F.min("win_idx").alias("_first"))
    follow = windows.select("rec", (F.col("win_idx") + 1).alias("win_idx"))
    return (windows.select("rec", "win_idx").join(follow, ["rec", "win_idx"], "left_anti")
            .join(first, "rec").where(F.col("win_idx") > F.col("_first")).drop("_first"))


def window_runs(windows: DataFrame, length: int, row: str = "win_idx") -> DataFrame:
    """Every run of ``length`` consecutive windows, one row per run and step."""
    def stage(w):
        return {"_run": F.collect_list(F.struct("win_idx", row) if row != "win_idx"
                                       else F.struct("win_idx")).over(
            w.rowsBetween(0, length - 1))}
    runs = apply_local(windows, [stage], 0, length - 1, pos="win_idx", block=WINDOW_BLOCK)
    return (runs.where(F.size("_run") == length)
            .select("rec", F.col("win_idx").alias("run_start"),
                    F.posexplode("_run").alias("step", "_w"))
            .select("rec", "run_start", "step", F.col(f"_w.{row}").alias(row)))


def segment_stats(frames: DataFrame, cols: tuple[str, ...], segment: Column | str,
                  block: int = 8192) -> DataFrame:
    """Mean, sample deviation and step roughness of each channel per segment."""
    seg = F.col(segment) if isinstance(segment, str) else segment
    tagged = frames.withColumn("segment", seg)

    def stage(w):
        same = F.lag("segment").over(w) == F.col("segment")
        return {f"_step_{c}": F.when(same, F.abs(F.col(c) - F.lag(c).over(w))) for c in cols}
    stepped = apply_local(tagged, [stage], 1, 0, block=block)
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"),
                 F.avg(f"_step_{c}").alias(f"{c}_rough")]
    return stepped.groupBy("rec", "segment").agg(*aggs)


def window_vibration(frames: DataFrame, rig: Rig = DEFAULT_RIG) -> DataFrame:
    """Mean square of |a| about its own window mean (for the high-frequency rms)."""
    return (with_window(frames, rig).withColumn("_a", V.norm(V.vec(*V.ACC)))
            .groupBy("rec", "win_idx").agg(F.count(F.lit(1)).alias("_n"),
                                           F.var_pop("_a").alias("vibration"))
            .where(F.col("_n") == rig.window).drop("_n"))
