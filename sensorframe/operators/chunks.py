"""Overlapping context chunks: cut, score, stitch, and work inside a chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sensorframe.functions import vec as V
from sensorframe.operators.blocks import apply_local
from sensorframe.operators.grouped import map_groups
from sensorframe.params import CONTEXT_WINDOWS, INCREMENT_SQUASH

WINDOW_BLOCK = 4096
INCREMENT = V.mat_cols("t")


def chunks(windows: DataFrame, k: int = CONTEXT_WINDOWS) -> DataFrame:
    """One row per chunk: first window and valid length.

    Windows must be consecutive from ``first_win``. Short recordings give one
    chunk with fewer valid windows instead of padding. Long recordings are cut
    into pieces first, so no array grows with the recording.
    """
    half = max(1, k // 2)
    n = windows.groupBy("rec").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                   F.min("win_idx").alias("first_win"))
    steps = n.withColumn("_last", F.greatest(F.col("n") - k, F.lit(0))).withColumn(
        "_steps", F.ceil(F.col("_last") / half).cast("bigint") + 1)
    pieces = steps.withColumn("_piece", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("_steps") - 1) / WINDOW_BLOCK).cast("bigint"))))
    ids = pieces.withColumn("chunk_id", F.explode(F.sequence(
        F.col("_piece") * WINDOW_BLOCK,
        F.least(F.col("_steps") - 1, (F.col("_piece") + 1) * WINDOW_BLOCK - 1))))
    start = F.least(F.col("chunk_id") * half, F.col("_last"))
    return ids.select("rec", "chunk_id", (start + F.col("first_win")).cast("bigint").alias("start"),
                      F.least(F.lit(k), F.col("n")).cast("bigint").alias("len"))


def chunk_windows(chunk_table: DataFrame) -> DataFrame:
    """Bridge from chunks to their windows: ``off`` counts inside the chunk."""
    return (chunk_table.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("len") - 1)))
            .withColumn("win_idx", F.col("start") + F.col("off")))


def _distance() -> Column:
    return F.abs(F.col("off") - (F.col("len") - 1) / 2.0)


def stitch_center(scored: DataFrame, cols: Sequence[str] = V.VEL) -> DataFrame:
    """Keep the value from the chunk whose centre is nearest; the earlier chunk wins ties."""
    best = scored.groupBy("rec", "win_idx").agg(
        F.min(F.struct(_distance().alias("d"), "start", *cols)).alias("b"))
    return best.select("rec", "win_idx", *[F.col(f"b.{c}").alias(c) for c in cols])


def stitch_mean(scored: DataFrame, cols: Sequence[str] = V.VEL) -> DataFrame:
    """Average overlapping chunks, weighted by closeness to each chunk's centre."""
    w = 1 - _distance() / (F.col("len") / 2.0 + 1)
    return scored.groupBy("rec", "win_idx").agg(*[
        (F.sum(w * F.col(c)) / F.greatest(F.sum(w), F.lit(1e-9))).alias(c) for c in cols])


def score_chunks(windows: DataFrame, features: Sequence[str],
                 model: Callable[[np.ndarray, np.ndarray], np.ndarray],
                 k: int = CONTEXT_WINDOWS, mode: str = "center",
                 chunks_per_batch: int = 256) -> DataFrame:
    """Score overlapping chunks with a vectorised model and stitch the result.

    ``model(x, lengths)`` takes (B, k, n_features) with repeated last windows as
    padding plus the valid lengths, and returns (B, k, 3). Features of a window
    are copied to the (at most three) chunks that hold it; a chunk is bounded by
    k windows, and batches never cross tasks.
    """
    rec_type = windows.schema["rec"].dataType.simpleString()
    placed = chunk_windows(chunks(windows, k)).join(
        windows.select("rec", "win_idx", *features), ["rec", "win_idx"])
    packed = placed.groupBy("rec", "chunk_id", "start", "len").agg(F.array_sort(F.collect_list(
        F.struct("off", F.array(*[F.col(c).cast("double") for c in features]).alias("x"))))
        .alias("_rows")).select("rec", "start", "len", F.flatten(F.transform(
            "_rows", lambda r: r["x"])).alias("_x"))
    schema = f"rec {rec_type}, start bigint, len bigint, off bigint, vx double, vy double, vz double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), chunks_per_batch):
                part = pdf.iloc[i:i + chunks_per_batch]
                lengths = part["len"].to_numpy()
                x = np.zeros((len(part), k, len(features)))
                for j, (row, n) in enumerate(zip(part["_x"], lengths)):
                    block = np.asarray(row).reshape(n, len(features))
                    x[j, :n], x[j, n:] = block, block[-1]
                v = np.asarray(model(x, lengths), float)
                which = np.repeat(np.arange(len(part)), lengths)
                off = np.concatenate([np.arange(n) for n in lengths])
                out = part[["rec", "start", "len"]].iloc[which].reset_index(drop=True)
                out["off"] = off
                for c, name in enumerate(V.VEL):
                    out[name] = v[which, off, c]
                yield out
    scored = packed.mapInPandas(run, schema).withColumn("win_idx", F.col("start") + F.col("off"))
    return stitch_center(scored) if mode == "center" else stitch_mean(scored)


# ---------------------------------------------------------- window-to-window motion
def window_ends(frames: DataFrame, window: int, cols: Sequence[str]) -> DataFrame:
    """The last frame of every complete window as one row per window."""
    return (frames.where((F.col("frame") + 1) % window == 0)
            .withColumn("win_idx", F.floor(F.col("frame") / window).cast("bigint"))
            .select("rec", "win_idx", *cols))


def window_increments(ends: DataFrame, mode: str = "end", turn: str = "gyro",
                      deviation_limit: float = 0.0, horizon: float = 0.0,
                      bound: float = INCREMENT_SQUASH) -> DataFrame:
    """Turn and velocity change between neighbouring windows from end-frame channels.

    ``ends`` holds per window the rotation r00..r22 to the anchor, the bounded
    velocity d_*, the anchor-frame velocity i_*, ``since`` and ``deviation``.
    ``mode``: "end" differences the bounded velocities, "int" rotates and softly
    bounds the anchor-frame difference, "zero" gives none. Windows past a limit
    (0 switches it off) are masked: no change, no turn. The first window has
    neither.
    """
    rot = V.mat_cols("r")
    held = [*rot, "d_x", "d_y", "d_z", "i_x", "i_y", "i_z"]

    def stage(w):
        return {f"_p_{c}": F.lag(c).over(w) for c in held}
    both = apply_local(ends, [stage], 1, 0, pos="win_idx", block=WINDOW_BLOCK)
    m, prev = V.mat(rot), V.mat([f"_p_{c}" for c in rot])
    rel = V.matmul(V.transpose(m), prev)
    both = both.withColumns(V.as_columns(rel, [f"_{c}" for c in INCREMENT]))
    rel = V.mat([f"_{c}" for c in INCREMENT])
    if mode == "end":
        change = V.sub(V.vec("d_x", "d_y", "d_z"),
                       V.matvec(rel, V.vec("_p_d_x", "_p_d_y", "_p_d_z")))
    elif mode == "int":
        diff = V.sub(V.vec("i_x", "i_y", "i_z"), V.vec("_p_i_x", "_p_i_y", "_p_i_z"))
        change = tuple(V.squash(c, bound) for c in V.mat_t_vec(m, diff))
    elif mode == "zero":
        change = V.vec(0, 0, 0)
    else:
        raise ValueError(f"mode must be end, int or zero, not {mode!r}")
    usable = F.lit(True)
    if deviation_limit > 0:
        usable = usable & (F.col("deviation") < deviation_limit)
    if horizon > 0:
        usable = usable & (F.abs("since") * 10 < horizon)
    first = F.col("_p_r00").isNull()
    live = usable & ~first
    eye = V.identity()
    spin = live & F.lit(turn != "none")
    return both.select(
        "rec", "win_idx",
        *[F.when(live, c).otherwise(0.0).alias(n) for c, n in zip(change, ("c_x", "c_y", "c_z"))],
        *[F.when(spin, c).otherwise(e).alias(n) for c, e, n in zip(rel, eye, INCREMENT)],
        usable.cast("double").alias("mask"),
        (F.col("deviation") / 10).alias("confidence"))


def gate_scalars(frames: DataFrame, window: int) -> DataFrame:
    """Per window: mean time since anchor, mean rest score, log1p of the mean speed."""
    w = frames.withColumn("win_idx", F.floor(F.col("frame") / window).cast("bigint"))
    means = w.groupBy("rec", "win_idx").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("since").alias("since"),
        F.avg("score").alias("rest_score"),
        *[F.avg(c).alias(f"_{c}") for c in ("d_x", "d_y", "d_z")]).where(F.col("_n") == window)
    return means.select("rec", "win_idx", "since", "rest_score", F.log1p(
        V.norm(V.vec("_d_x", "_d_y", "_d_z"))).alias("log_speed"))


# --------------------------------------------------------------- inside one chunk
def gated_recursion(chunked: DataFrame, gain: str = "gain", direct: Sequence[str] = V.VEL,
                    change: Sequence[str] = ("c_x", "c_y", "c_z"),
                    turn: Sequence[str] | None = INCREMENT,
                    keys: Sequence[str] = ("rec", "chunk_id"),
                    logits: Sequence[str] | None = None,
                    innovation: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """v_k = p_k + gain_k (direct_k - p_k) with p_k = turn_k v_{k-1} + change_k.

    Runs along a chunk (at most K windows) as an ordered fold on an array, in
    the JVM. The first window keeps its direct value. With ``logits`` (a column
    per axis, see ``gain_logits``) the gain of an axis is the logistic of its
    logit plus ``innovation`` times log1p |direct - p|, which only the fold knows.
    """
    turn, logits = turn or [], list(logits or [])
    fixed = [] if logits else [F.col(gain).alias("_gain")]
    row = F.struct("off", "win_idx", *direct, *change, *turn, *logits, *fixed)
    packed = chunked.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))

    def blend(acc, x):
        prev = F.element_at(acc, -1)
        v = (prev["x"], prev["y"], prev["z"])
        if turn:
            v = V.matvec(tuple(x[t] for t in turn), v)
        prop = tuple(a + x[c] for a, c in zip(v, change))
        miss = tuple(x[d] - p for p, d in zip(prop, direct))
        gains = ([V.logistic(x[c] + float(w) * F.log1p(V.norm(miss))) for c, w in zip(logits, innovation)]
                 if logits else [x["_gain"]] * 3)
        new = tuple(F.when(x["off"] == 0, x[d]).otherwise(p + g * m)
                    for p, d, g, m in zip(prop, direct, gains, miss))
        return F.array_append(acc, F.struct(
            x["win_idx"].alias("win_idx"), new[0].alias("x"), new[1].alias("y"),
            new[2].alias("z")))
    zero = F.array(F.struct(F.lit(-1).cast("bigint").alias("win_idx"), F.lit(0.0).alias("x"),
                            F.lit(0.0).alias("y"), F.lit(0.0).alias("z")))
    folded = packed.select(*keys, F.aggregate("_rows", zero, blend).alias("_out"))
    return folded.select(*keys, F.explode(F.slice("_out", 2, F.size("_out"))).alias("_o")).select(
        *keys, F.col("_o.win_idx").alias("win_idx"), F.col("_o.x").alias("vx"),
        F.col("_o.y").alias("vy"), F.col("_o.z").alias("vz"))


def gain_logits(base: Sequence[Column], mask: Column, confidence: Column,
                weights: Sequence[Sequence[float]], bias: Sequence[float],
                trust_direct: bool = False) -> list[Column]:
    """Per axis: base + w0 * mask + w2 * confidence + bias, for ``gated_recursion``.

    ``weights`` holds (mask, innovation, confidence) per axis. With
    ``trust_direct`` a masked-out window leans to its direct value (+6, fixed).
    """
    out = [b + mask * float(w[0]) + confidence * float(w[2]) + float(k) for b, w, k in zip(base, weights, bias)]
    return [c + 6.0 * (1.0 - mask) for c in out] if trust_direct else out


def anchored_smoothing(chunked: DataFrame, increments: Sequence[str] = ("e_x", "e_y", "e_z"),
                       mu: float = 5.0,
                       keys: Sequence[str] = ("rec", "chunk_id")) -> DataFrame:
    """Least-squares velocity that stays near slow anchors and follows increments.

    Per chunk it minimises sum w |q - p|^2 + mu sum |(q_k - q_{k-1}) - e_k|^2
    with w = 1 / (1 + |p|). Chunks are small, so many are solved per task.
    """
    types = {f.name: f.dataType.simpleString() for f in chunked.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + \
        ", win_idx bigint, vx double, vy double, vz double"

    def solve(p: np.ndarray, e: np.ndarray) -> np.ndarray:
        n = len(p)
        d = np.diff(np.eye(n), axis=0)
        a = np.diag(1.0 / (1.0 + np.linalg.norm(p, axis=1))) + mu * d.T @ d
        return np.linalg.solve(a, p / (1.0 + np.linalg.norm(p, axis=1))[:, None]
                               + mu * d.T @ e[1:])

    def run(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        p, e = pdf[list(V.VEL)].to_numpy(float), pdf[list(increments)].to_numpy(float)
        q = np.concatenate([solve(p[i:j], e[i:j]) for i, j in zip(bounds[:-1], bounds[1:])])
        out = {c: pdf[c].to_numpy() for c in (*keys, "win_idx")}
        out.update({c: q[:, i] for i, c in enumerate(V.VEL)})
        return pd.DataFrame(out)
    rows = chunked.select(*keys, "off", "win_idx", *V.VEL, *increments)
    return map_groups(rows, keys, ["off"], run, schema)


def block_corrections(size: int = 5) -> list[tuple[int, int, int, float]]:
    """Rows (n, i, j, s) of S_n = (I + D'D)^-1 D'D for blocks of 1..size windows."""
    rows = []
    for n in range(1, size + 1):
        d = np.diff(np.eye(n), axis=0)
        s = np.linalg.solve(np.eye(n) + d.T @ d, d.T @ d)
        rows += [(n, i, j, float(s[i, j])) for i in range(n) for j in range(n)]
    return rows


def block_difference(chunked: DataFrame, cols: Sequence[str] = ("e_x", "e_y", "e_z"),
                     size: int = 5, keys: Sequence[str] = ("rec", "chunk_id")) -> DataFrame:
    """Add S_n times the increments of each five-window block, keeping its mean.

    The last block of a chunk may be shorter and uses the table for its length.
    """
    table = chunked.sparkSession.createDataFrame(
        block_corrections(size), "_n int, _i int, _j int, _s double")
    own = chunked.withColumn("_blk", F.floor(F.col("off") / size).cast("bigint")).withColumn(
        "_n", F.least(F.lit(size), F.col("len") - F.col("_blk") * size)).withColumn(
        "_pos", (F.col("off") % size).cast("int"))
    spread = own.select(*keys, "_blk", "_n", F.col("_pos").alias("_j"), *cols).join(
        F.broadcast(table), ["_n", "_j"])
    fixes = spread.groupBy(*keys, "_blk", F.col("_i").alias("_pos")).agg(
        *[F.sum(F.col("_s") * F.col(c)).alias(f"_f_{c}") for c in cols])
    return (own.join(fixes, [*keys, "_blk", "_pos"])
            .select(*keys, "win_idx", "off",
                    *[(F.col(v) + F.col(f"_f_{c}")).alias(v) for v, c in zip(V.VEL, cols)]))


def context_split(segments: DataFrame, pick: Column, u: Column,
                  keys: Sequence[str] = ("draw_id",), margin: int = 5) -> DataFrame:
    """Cut chosen segments of at least 2 * margin windows into two pieces.

    The cut falls in [margin, len - margin]; the second piece is counted from
    zero again. ``pick`` chooses segments, ``u`` in [0, 1) places the cut.
    """
    cut = F.least(margin + F.floor(u * (F.col("len") - 2 * margin + 1)),
                  F.col("len") - margin).cast("bigint")
    chosen = pick & (F.col("len") >= 2 * margin)
    marked = segments.withColumn("_cut", F.when(chosen, cut))
    second = F.col("_cut").isNotNull() & (F.col("off") >= F.col("_cut"))
    return (marked.withColumn("piece", second.cast("int"))
            .withColumn("len", F.when(F.col("_cut").isNull(), F.col("len"))
                        .when(second, F.col("len") - F.col("_cut")).otherwise(F.col("_cut")))
            .withColumn("off", F.when(second, F.col("off") - F.col("_cut"))
                        .otherwise(F.col("off")).cast("bigint"))
            .drop("_cut"))


def linear_readout(chunked: DataFrame, cols: Sequence[str], matrix: Sequence[Sequence[float]],
                   bias: Sequence[float], gate: Column) -> DataFrame:
    """Add a gated linear map of window-mean channels to the velocity."""
    out = {}
    for v, row, b in zip(V.VEL, matrix, bias):
        lin = F.lit(float(b))
        for c, a in zip(cols, row):
            lin = lin + F.lit(float(a)) * F.col(c)
        out[v] = F.col(v) + V.logistic(gate) * lin
    return chunked.withColumns(out)
