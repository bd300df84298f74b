"""One turn of the sensor applied to all channels of a table by their kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sensorframe.functions import vec as V

#: How many columns a group of each kind has.
SIZES = {"polar": 3, "axial": 3, "label": 3, "attitude": 9, "increment": 9, "fixed": None}


def heading_turn(angle: Column) -> V.Mat:
    """The matrix of a turn about the third axis."""
    c, s, zero = F.cos(angle), F.sin(angle), F.lit(0.0)
    return (c, -s, zero, s, c, zero, zero, zero, F.lit(1.0))


def turn_channels(df: DataFrame, m: V.Mat, groups: Sequence[tuple[str, Sequence[str]]],
                  mounting: V.Mat | None = None) -> DataFrame:
    """``df`` as a sensor would give it whose axes are turned (or mirrored) by ``m``.

    ``groups`` lists kinds with their columns:

    * polar: vectors in sensor axes (force, up, velocity), ``m v``;
    * axial: rates, ``det(m) m v``;
    * label: vectors in the axes that ``mounting`` leads to from the sensor's,
      turned by ``mounting m mounting^T`` (without a mounting as polar);
    * attitude: rotations from sensor axes to an outside frame, ``r m^T``;
    * increment: rotations from sensor axes to sensor axes, ``m r m^T``;
    * fixed: vectors of an outside frame and scalars, which stay.

    Columns in no group stay too. ``m`` is computed once per row.
    """
    used = [c for _, group in groups for c in group]
    if len(set(used)) != len(used):
        raise ValueError("a column belongs to one group")
    held = V.mat_cols("_turn")
    wide = df.withColumns(V.as_columns(m, held))
    m = V.mat(held)
    back = V.transpose(m)
    out: dict[str, Column] = {}
    for kind, group in groups:
        if kind not in SIZES:
            raise ValueError(f"kind must be one of {', '.join(SIZES)}, not {kind!r}")
        if SIZES[kind] not in (None, len(group)):
            raise ValueError(f"a group of kind {kind} has {SIZES[kind]} columns")
        if kind == "fixed":
            continue
        if kind == "attitude":
            new = V.matmul(V.mat(group), back)
        elif kind == "increment":
            new = V.matmul(V.matmul(m, V.mat(group)), back)
        elif kind == "label" and mounting is not None:
            new = V.matvec(mounting, V.matvec(m, V.mat_t_vec(mounting, V.vec(*group))))
        else:
            new = V.transform_axes(V.vec(*group), m, "axial" if kind == "axial" else "polar")
        out.update(V.as_columns(new, group))
    return wide.withColumns(out).drop(*held)
