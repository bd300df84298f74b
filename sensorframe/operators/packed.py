"""Frames stored as one row per window: an array per channel, with a short halo.

Draws, shifts and resampling read stretches of a recording. Meeting them frame by
frame costs a join row for every frame; here a stretch meets the few windows it
touches on (rec, win_idx), and values are read from the arrays by index.

A row's arrays hold the window's own ``n`` frames and the first ``HALO`` frames
of the next window, so interpolation after the last own frame has its right
neighbour. A row whose arrays are shorter than that ends its recording.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sensorframe.params import DEFAULT_RIG, Rig

HALO = 2


def pack_windows(frames: DataFrame, cols: Sequence[str], rig: Rig = DEFAULT_RIG,
                 keep: Sequence[str] = ()) -> DataFrame:
    """``rec``, ``win_idx``, ``n`` and an array of doubles per column of ``cols``; frames count from 0 without gaps.

    Columns of ``keep`` stay as they are, in ``rows``: an array of structs with ``frame``, own frames only.
    """
    t = rig.window
    own = F.floor(F.col("frame") / t).cast("bigint")
    halo = (F.col("frame") % t < HALO) & (own > 0)
    placed = frames.withColumn("win_idx", F.explode(F.when(halo, F.array(own - 1, own)).otherwise(F.array(own))))
    fields = list(dict.fromkeys(["frame", *cols, *keep]))
    packed = placed.groupBy("rec", "win_idx").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_rows"))
    n = F.least(F.size("_rows"), F.lit(t))
    kept = [F.transform(F.slice("_rows", 1, n), lambda r: F.struct(*[r[k].alias(k) for k in dict.fromkeys(["frame", *keep])]))
            .alias("rows")] if keep else []
    return packed.select("rec", "win_idx", n.cast("int").alias("n"),
                         *[F.col(f"_rows.{c}").cast("array<double>").alias(c) for c in cols], *kept)


def packed_lengths(packed: DataFrame, rig: Rig = DEFAULT_RIG) -> DataFrame:
    """``rec``, ``n_frames`` from the windows alone."""
    return packed.groupBy("rec").agg(F.max(F.col("win_idx") * rig.window + F.col("n")).alias("n_frames"))


def _read(rows: DataFrame, at: Column, cols: Sequence[str], given: Sequence[str], rig: Rig) -> DataFrame:
    """Interpolate joined rows (one per output step, with a window's arrays) that belong to their window.

    The step on a recording's last frame is read from the frame before it, as
    its right neighbour.
    """
    t = rig.window
    size = F.size(cols[0])
    end = F.when(size < t + HALO, F.col("win_idx") * t + size - 2)  # null: the recording goes on
    rows = rows.withColumn("_at", at).withColumn("_i", F.least(F.floor("_at"), end))
    rows = rows.where(F.floor(F.col("_i") / t) == F.col("win_idx"))
    j, part = (F.col("_i") - F.col("win_idx") * t).cast("int"), F.col("_at") - F.col("_i")
    return rows.select(*given, *[(F.get(c, j) * (1 - part) + F.get(c, j + 1) * part).alias(c) for c in cols])


def _steps(base: Column, k: Column, count: Column, rig: Rig) -> Column:
    """Output steps whose position may lie in the row's window: one more on both sides than computed."""
    start = F.col("win_idx") * rig.window
    first = F.greatest(F.lit(0), F.ceil((start - base) / k) - 1).cast("bigint")
    last = F.least(count - 1, F.floor((start + rig.window - base) / k) + 1).cast("bigint")
    return F.when(first <= last, F.sequence(first, last))


def lerp_runs(runs: DataFrame, packed: DataFrame, cols: Sequence[str], count: Column,
              base: str = "base", rate: str = "k", rig: Rig = DEFAULT_RIG) -> DataFrame:
    """Columns of ``runs``, ``t`` and ``cols`` at base + rate * t for t = 0 .. count - 1, by linear interpolation.

    Positions must lie inside the recording. A run meets the windows it touches.
    """
    b, k, t = F.col(base), F.col(rate), rig.window
    touched = runs.withColumn("_count", count).withColumn("win_idx", F.explode(F.sequence(
        F.greatest(F.lit(0), F.floor((b - 1) / t)).cast("bigint"),
        F.floor((b + k * (F.col("_count") - 1)) / t).cast("bigint"))))
    met = touched.join(packed.select("rec", "win_idx", *cols), ["rec", "win_idx"])
    rows = met.withColumn("t", F.explode(_steps(b, k, F.col("_count"), rig)))
    return _read(rows, b + k * F.col("t"), cols, [*runs.columns, "t"], rig)


def resample_packed(packed: DataFrame, cols: Sequence[str], rate: float, rig: Rig = DEFAULT_RIG) -> DataFrame:
    """``rec``, ``out_frame``, ``cols``: each recording played ``rate`` times faster; no join at all."""
    k, far = F.lit(float(rate)), F.lit(1 << 62)
    rows = packed.withColumn("out_frame", F.explode(_steps(F.lit(0), k, far, rig)))
    size, at = F.size(cols[0]), F.col("out_frame") * k
    inside = (size >= rig.window + HALO) | (at <= F.col("win_idx") * rig.window + size - 1)
    return _read(rows.where(inside), at, cols, ["rec", "out_frame"], rig)


def stretch_frames(stretches: DataFrame, packed: DataFrame, cols: Sequence[str], start: Column,
                   rig: Rig = DEFAULT_RIG) -> DataFrame:
    """One window length of frames from ``start`` on: columns of ``stretches``, ``frame`` and ``cols``."""
    t = rig.window
    touched = stretches.withColumn("_start", start.cast("bigint")).withColumn("win_idx", F.explode(F.sequence(
        F.floor(F.col("_start") / t).cast("bigint"), F.floor((F.col("_start") + t - 1) / t).cast("bigint"))))
    met = touched.join(packed.select("rec", "win_idx", "n", *cols), ["rec", "win_idx"])
    first = F.greatest(F.col("_start"), F.col("win_idx") * t)
    last = F.least(F.col("_start") + t - 1, F.col("win_idx") * t + F.col("n") - 1)
    rows = met.withColumn("frame", F.explode(F.when(first <= last, F.sequence(first, last))))
    j = (F.col("frame") - F.col("win_idx") * t).cast("int")
    return rows.select(*stretches.columns, "frame", *[F.get(c, j).alias(c) for c in cols])


def shift_packed(packed: DataFrame, shifts: DataFrame, cols: Sequence[str], keep: Sequence[str],
                 step: str = "step", rig: Rig = DEFAULT_RIG) -> DataFrame:
    """Columns ``keep`` of every frame next to ``cols`` from ``step`` frames later, edge rows repeated.

    ``packed`` holds both (see ``pack_windows``); ``shifts``: rec, step (none: 0).
    A window reads the one or two windows its shifted frames lie in.
    """
    t = rig.window
    table = packed_lengths(packed.select("rec", "win_idx", "n"), rig).join(shifts, "rec", "left").select(
        "rec", "n_frames", F.coalesce(F.col(step), F.lit(0)).cast("bigint").alias("_step"))
    source = lambda f: F.greatest(F.lit(0), F.least(f + F.col("_step"), F.col("n_frames") - 1)).cast("bigint")
    begin = F.col("win_idx") * t
    own = packed.select("rec", "win_idx", "n", "rows").join(table, "rec").withColumn("_from", F.explode(F.sequence(
        F.floor(source(begin) / t), F.floor(source(begin + F.col("n") - 1) / t))))
    met = own.join(packed.select("rec", F.col("win_idx").alias("_from"), *cols), ["rec", "_from"])
    rows = met.withColumn("_row", F.explode("rows")).withColumn("_src", source(F.col("_row.frame")))
    rows = rows.where(F.floor(F.col("_src") / t) == F.col("_from"))
    j = (F.col("_src") - F.col("_from") * t).cast("int")
    return rows.select("rec", *[F.col(f"_row.{c}").alias(c) for c in dict.fromkeys(["frame", *keep])],
                       *[F.get(c, j).alias(c) for c in cols])
