"""Feature tables by mode: which channels a frame carries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sensorframe.functions import vec as V
from sensorframe.operators.scan import PackedFrames, adaptive_gain, dead_reckon, pack_frames
from sensorframe.operators.windows import rest_reference
from sensorframe.params import DEFAULT_RIG, FAST_GAIN, SLOW_GAIN, Rig
from sensorframe.session import cut_lineage

RAW = [*V.ACC, *V.GYR]
_SPLIT = ("a_up", "a_hx", "a_hy", "a_hz", "w_up", "w_hx", "w_hy", "w_hz")
REST = ["rest_dx", "rest_dy", "rest_dz", "rest_score"]
CARRIED = ["ux", "uy", "uz"]
RECKONED = ["d_x", "d_y", "d_z", "since"]


def _about(prefix: str) -> list[str]:
    return [f"{prefix}_{c}" for c in _SPLIT]


MODES = {
    "none": RAW,
    "slow": RAW + _about("slow"),
    "fast": RAW + _about("fast"),
    "both": RAW + _about("slow") + _about("fast"),
    "adapt": RAW + _about("adapt"),
    "slowrest": RAW + _about("slow") + REST,
    "slowrest2": RAW + _about("slow") + REST + CARRIED,
    "slowdr": RAW + _about("slow") + REST + CARRIED + RECKONED,
}


def _decomposed(df: DataFrame, prefix: str) -> DataFrame:
    parts = V.decompose_about_up(V.vec(*V.ACC), V.vec(*V.GYR),
                                 V.vec(*[f"{prefix}_{c}" for c in "xyz"]))
    return df.withColumns({f"{prefix}_{n}": c for n, c in parts.items()})


def with_directions(frames: DataFrame, modes: Sequence[str], rig: Rig = DEFAULT_RIG, keep: tuple[str, ...] = (),
                    packed: bool = False) -> DataFrame | PackedFrames:
    """Frames with the filtered directions (<filter>_x, _y, _z) that any of ``modes`` needs and the frames lack.

    With ``packed`` the frames stay packed, and each use runs the filters it needs
    from the solved starts: nothing as wide as all directions is written or moved.
    """
    gains = {"slow": SLOW_GAIN, "fast": FAST_GAIN, "adapt": adaptive_gain(g=rig.g)}
    needed = {f"{p}_": g for p, g in gains.items() if f"{p}_x" not in frames.columns
              and any(c.startswith(f"{p}_") for m in modes for c in MODES[m])}
    there = [f"{p}_{c}" for p in gains if f"{p}_x" in frames.columns for c in "xyz"]
    rows = frames.select("rec", "frame", *RAW, *keep, *there)
    if not (needed or packed):
        return rows
    made = pack_frames(rows, needed, rig, keep=(*keep, *there))
    return made if packed else made.rows(list(needed))


def features(frames: DataFrame | PackedFrames, mode: str = "slowdr", rig: Rig = DEFAULT_RIG,
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Frames with the channels of ``mode``; each wider mode contains the raw axes.

    Directions that the frames hold (see ``with_directions``) are not filtered again.
    """
    wanted = MODES[mode]
    used = [p for p in ("slow", "fast", "adapt") if any(c.startswith(f"{p}_") for c in wanted)]
    if "rest_score" in wanted:
        made = frames if isinstance(frames, PackedFrames) else with_directions(frames, [mode], rig, keep, packed=True)
        anchors = cut_lineage(rest_reference(made.rows(), rig).withColumns(
            {"rest_score": F.col("score"), **{f"_f{c}": F.col(f"f{c}") for c in "xyz"}}))
        ref = ["rest_score", *[f"_f{c}" for c in "xyz"]]
        if "ux" in wanted:
            out = dead_reckon(made, anchors, rig, keep=(*RAW, *keep, *[f"{p}_{c}" for p in used for c in "xyz"], *ref))
        else:
            out = made.rows([f"{p}_" for p in used if f"{p}_" in made.starts], made.per_block(anchors.select("rec", *ref)))
        out = out.withColumns({f"rest_d{c}": F.col(f"a{c}") - F.col(f"_f{c}") for c in "xyz"})
    elif isinstance(frames, PackedFrames):
        out = frames.rows([f"{p}_" for p in used if f"{p}_" in frames.starts])
    else:
        out = with_directions(frames, [mode], rig, keep)
    for prefix in used:
        out = _decomposed(out, prefix)
    return out.select("rec", "frame", *keep, *wanted)


def canonical_frames(frames: DataFrame, up: tuple[str, str, str],
                     rig: Rig = DEFAULT_RIG) -> DataFrame:
    """Turn every window so that its mean up direction points along +z."""
    from sensorframe.operators.windows import with_window
    w = with_window(frames, rig)
    mean = w.groupBy("rec", "win_idx").agg(*[F.avg(c).alias(f"_{i}") for i, c in enumerate(up)])
    mean = mean.select("rec", "win_idx", *V.named(
        V.canonical_up_matrix(V.vec("_0", "_1", "_2")), V.mat_cols("k")))
    both = w.join(mean, ["rec", "win_idx"])
    m = V.mat(V.mat_cols("k"))
    out = {}
    for group in (V.ACC, V.GYR, up):
        out.update(V.as_columns(V.matvec(m, V.vec(*group)), group))
    return both.withColumns(out)
