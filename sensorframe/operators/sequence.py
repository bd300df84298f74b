"""Neighbour operators along a recording: smoothing, slopes, filters, resampling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sensorframe.functions import vec as V
from sensorframe.operators.blocks import FRAME_BLOCK, apply_local, double_field
from sensorframe.operators.packed import pack_windows, resample_packed, shift_packed
from sensorframe.params import DEFAULT_RIG, Rig


# Column builders: they read an ordered window handed over by apply_local.
def same_mean(c: Column, n: int, w) -> Column:
    """Moving average that pads with zeros and always divides by ``n``.

    Even ``n`` reaches one row further back than forward.
    """
    return F.sum(c).over(w.rowsBetween(-(n // 2), (n - 1) // 2)) / n


def slope(name: str, w) -> Column:
    """Central difference, one-sided at the two ends of a recording."""
    c, before, after = F.col(name), F.lag(name).over(w), F.lead(name).over(w)
    return (F.when(before.isNull(), after - c).when(after.isNull(), c - before)
            .otherwise((after - before) / 2))


def fir_taps(taps: int, cutoff: float) -> list[float]:
    """Hamming-windowed sinc low-pass; ``cutoff`` in cycles per sample."""
    n = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(2 * cutoff * n) * np.hamming(taps)
    return [float(x) for x in h / h.sum()]


def fir_sum(name: str, taps: Sequence[float], w) -> Column:
    """Centred symmetric filter; rows outside the recording count as zero."""
    half = len(taps) // 2
    terms = []
    for j, h in enumerate(taps):
        o = j - half
        value = F.col(name) if o == 0 else F.lead(name, o, 0.0).over(w)
        terms.append(F.lit(h) * value)
    return reduce(lambda a, b: a + b, terms)


# Whole operators.
def moving_average_same(frames: DataFrame, cols: Sequence[str], n: int, suffix: str = "_sm",
                        block: int = FRAME_BLOCK) -> DataFrame:
    return apply_local(frames, [lambda w: {f"{c}{suffix}": same_mean(F.col(c), n, w)
                                           for c in cols}], n // 2, (n - 1) // 2, block=block)


def central_gradient(frames: DataFrame, cols: Sequence[str], suffix: str = "_d",
                     block: int = FRAME_BLOCK) -> DataFrame:
    return apply_local(frames, [lambda w: {f"{c}{suffix}": slope(c, w) for c in cols}], 1, 1,
                       block=block)


def roughness(frames: DataFrame, cols: Sequence[str], block: int = FRAME_BLOCK) -> DataFrame:
    """Mean absolute step of each column per recording."""
    stepped = apply_local(frames, [lambda w: {f"_s_{c}": F.abs(F.col(c) - F.lag(c).over(w))
                                              for c in cols}], 1, 0, block=block)
    return stepped.groupBy("rec").agg(*[F.avg(f"_s_{c}").alias(f"{c}_rough") for c in cols])


def fir_decimate(frames: DataFrame, cols: Sequence[str], taps: Sequence[float], keep_every: int,
                 block: int = FRAME_BLOCK) -> DataFrame:
    """Low-pass filter, then keep every ``keep_every``-th frame."""
    half = len(taps) // 2
    out = apply_local(frames.select("rec", "frame", *cols),
                      [lambda w: {f"{c}_lp": fir_sum(c, taps, w) for c in cols}], half, half,
                      block=block)
    return (out.where(F.col("frame") % keep_every == 0)
            .select("rec", "frame", *[f"{c}_lp" for c in cols]))


def neighbourhood(frames: DataFrame, cols: Sequence[str], taps: Sequence[float],
                  keep_every: int = 4, reach: int = 2, rig: Rig = DEFAULT_RIG,
                  span: int | None = None) -> DataFrame:
    """Filtered, thinned signal of a window and ``reach`` windows on both sides.

    The stretch around each window is cut on its own, so filtering never sees
    past it, and windows outside the recording read as zero. ``span=1`` keeps
    only the centre window and zeroes the rest. One row per window, with an
    array per channel.
    """
    wanted = reach if span is None else span // 2
    t, half = rig.window, len(taps) // 2
    size = (2 * reach + 1) * t
    packed = (frames.withColumn("win_idx", F.floor(F.col("frame") / t).cast("bigint"))
              .groupBy("rec", "win_idx")
              .agg(F.array_sort(F.collect_list(F.struct("frame", *cols))).alias("_rows"))
              .where(F.size("_rows") == t)
              .select("rec", "win_idx", *[F.transform("_rows", double_field(c))
                                          .alias(c) for c in cols]))
    zeros = F.array_repeat(F.lit(0.0), t)

    def stage(w):
        out = {}
        for c in cols:
            pieces = []
            for r in range(-reach, reach + 1):
                near = (F.lead("win_idx", r).over(w) == F.col("win_idx") + r) if r else F.lit(True)
                value = F.lead(c, r).over(w) if r else F.col(c)
                use = near if abs(r) <= wanted else F.lit(False)
                pieces.append(F.when(F.coalesce(use, F.lit(False)), value).otherwise(zeros))
            out[f"_{c}_wide"] = F.concat(*pieces)
        return out
    wide = apply_local(packed, [stage], reach, reach, pos="win_idx", block=256)
    kernel = np.asarray(taps)
    names = [f"{c}_wide" for c in cols]

    def run(batches):
        for pdf in batches:
            for c, n in zip(cols, names):
                x = np.stack(pdf[f"_{c}_wide"].to_numpy()) if len(pdf) else np.zeros((0, size))
                padded = np.pad(x, ((0, 0), (half, half)))
                view = np.lib.stride_tricks.sliding_window_view(padded, len(kernel), axis=1)
                pdf[n] = list(view[:, ::keep_every] @ kernel[::-1])
            yield pdf[["rec", "win_idx", *names]]
    rec_type = frames.schema["rec"].dataType.simpleString()
    schema = f"rec {rec_type}, win_idx bigint, " + ", ".join(f"{n} array<double>" for n in names)
    return wide.select("rec", "win_idx", *[f"_{c}_wide" for c in cols]).mapInPandas(run, schema)


def variable_shift(frames: DataFrame, shifts: DataFrame, cols: Sequence[str],
                   lag_ms: str = "lag_ms", rig: Rig = DEFAULT_RIG) -> DataFrame:
    """Advance columns by each recording's own delay, repeating the edge rows.

    The offset differs per recording, so windows meet the windows that their
    shifted frames lie in; inside them values are read by index.
    """
    step = F.bround(F.col(lag_ms) * rig.fs / 1000.0).cast("bigint")
    keep = [c for c in frames.columns if c not in ("rec", "frame", *cols)]
    packed = pack_windows(frames, cols, rig, keep=["frame", *keep])
    return shift_packed(packed, shifts.select("rec", step.alias("step")), cols, keep, rig=rig)


def resample(frames: DataFrame, cols: Sequence[str], rate: float, rig: Rig = DEFAULT_RIG) -> DataFrame:
    """Play each recording ``rate`` times faster by linear interpolation."""
    return resample_packed(pack_windows(frames, cols, rig), cols, rate, rig)


def jerk_norm(w, cols=V.ACC) -> Column:
    """Length of the slope of a vector."""
    return V.norm(tuple(slope(c, w) for c in cols))
