"""Filters, keys, joins, sets and orderings over recording and window tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorframe.operators.blocks import number_rows, percentiles, top_k
from sensorframe.params import PLATFORM_IDS


# ------------------------------------------------------------------------ keys
def normalise_key(c: Column | str) -> Column:
    """Recording id without the file ending (removed wherever it appears)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(c.cast("string"), F.lit(".npz"), F.lit(""))


def platform_id(c: Column | str, ids: dict[str, int] = PLATFORM_IDS) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(None).cast("int")
    for name, number in ids.items():
        out = F.when(c == name, F.lit(number)).otherwise(out)
    return out


def tag_variant(c: Column | str, letter: str) -> Column:
    """Insert a letter before the seed suffix: run_s42 -> run<letter>_s42."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"_s[0-9]+$"), F.regexp_replace(c, r"_s([0-9]+)$", f"{letter}_s$1")
                  ).otherwise(F.concat(c, F.lit(letter)))


def recipe_of(c: Column | str) -> Column:
    """Run tag without its seed suffix."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"_s[0-9]+$", "")


def seed_of(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(c, r"_s([0-9]+)$", 1).try_cast("int")


def short_id(c: Column | str) -> Column:
    """All digits at the end of an id."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(c.cast("string"), "([0-9]+)$", 1)


def sequence_id(c: Column | str) -> Column:
    """Public sequence number of a recording: the number in its id plus one."""
    return short_id(c).try_cast("bigint") + 1


def in_family(c: Column | str, prefix: str, low: int, high: int) -> Column:
    """Recordings whose id starts with ``prefix`` and ends in a number in [low, high]."""
    c = F.col(c) if isinstance(c, str) else c
    return c.startswith(prefix) & short_id(c).try_cast("bigint").between(low, high)


def has_marker(c: Column | str, markers: Sequence[str]) -> Column:
    """Name markers of recordings that come from other collections."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(False)
    for m in markers:
        out = out | c.contains(m)
    return out


# --------------------------------------------------------------------- filters
def drop_null_columns(df: DataFrame) -> DataFrame:
    """Leave out columns that hold no value at all (one counting pass)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c] > 0])


def missing_recordings(windows: DataFrame, files: DataFrame) -> DataFrame:
    """Windows whose recording has no file."""
    return windows.join(files.select("rec"), "rec", "left_anti")


def fold_split(windows: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(held-out, remaining) windows by a list of recordings."""
    held = held.select("rec").distinct()
    return windows.join(held, "rec", "left_semi"), windows.join(held, "rec", "left_anti")


def expand_groups(groups: DataFrame) -> DataFrame:
    """Members of flight groups (map<rep, array<rec>>) without repeats."""
    return (groups.select(F.explode("groups").alias("representative", "members"))
            .select("representative", F.explode("members").alias("rec")).distinct())


def longer_than(recs: DataFrame, n_windows: int) -> DataFrame:
    return recs.where(F.col("n_windows") >= n_windows)


def every_kth(recs: DataFrame, k: int, order: str = "rec", slice_rows: int = 1_000_000) -> DataFrame:
    """Every k-th recording in id order.

    Ids are numbered inside slices between bounds taken from a hash sample, so
    that no task sorts more than about ``slice_rows`` of them; the numbering is the
    same for any bounds.
    """
    slices = -(-recs.count() // slice_rows)
    bounds = []
    if slices > 1:
        sample = recs.select(order).orderBy(F.xxhash64(order), order).limit(slices * 20)
        bounds = sorted(r[0] for r in sample.where(F.col(order).isNotNull()).collect())[20::20]
    ids = recs.select(F.col(order).alias("_o"), *[F.col(c).alias(f"_c_{c}") for c in recs.columns])
    coarse = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("_o"))) if bounds else F.lit(0)
    numbered = number_rows(ids.withColumn("_one", F.lit(1)), "_one", ["_o"], coarse, "_n")
    return numbered.where(F.col("_n") % k == 0).select(
        *[F.col(f"_c_{c}").alias(c) for c in recs.columns])


def recording_class(gyro_mean: Column, speed_p90: Column) -> Column:
    """hi-rot, fast or rest; the turn rate decides first."""
    return (F.when(gyro_mean > 1.5, F.lit("hi-rot")).when(speed_p90 > 6, F.lit("fast"))
            .otherwise(F.lit("rest")))


def drop_tilted(frames: DataFrame, errors: DataFrame, limit: float) -> DataFrame:
    """Keep recordings whose median tilt error stays within ``limit`` degrees."""
    med = percentiles(errors, ["rec"], {"tilt": (F.col("tilt"), [0.5])})
    good = med.where(F.col("tilt_p50") <= limit).select("rec")
    return frames.join(good, "rec", "left_semi")


def calibration_labels(recs: DataFrame, targets: DataFrame, identity_family: int = 6) -> DataFrame:
    """Calibration label per recording with a mask that says if gain and bias count.

    Recordings of the identity family use their fitted targets, or a clean
    calibration; other families only carry the axis-map class.
    """
    names = ["s_x", "s_y", "s_z", "b_x", "b_y", "b_z", "lag_ms"]
    both = recs.join(targets.select("rec", *[F.col(n).alias(f"_t_{n}") for n in names],
                                    F.lit(True).alias("_has")), "rec", "left")
    own = F.coalesce(F.col("family"), F.lit(identity_family)) == identity_family
    fitted = own & F.coalesce(F.col("_has"), F.lit(False))
    clean = dict(zip(names, (1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0)))
    return both.select(
        "rec", *[F.when(fitted, F.col(f"_t_{n}")).otherwise(clean[n]).alias(n) for n in names],
        F.when(own, 0.0).otherwise(1.0).alias("axis_class"),
        F.when(own, 1.0).otherwise(0.0).alias("mask"), fitted.alias("fitted"))


def out_of_range(windows: DataFrame, limit: float, cols=("vx", "vy", "vz")) -> DataFrame:
    """How many targets have a component outside [-limit, limit]."""
    worst = F.greatest(*[F.abs(F.col(c)) for c in cols])
    return windows.agg(F.count(F.lit(1)).alias("n"), F.count_if(worst > limit).alias("outside"))


# ----------------------------------------------------------------------- joins
def with_targets(windows: DataFrame, targets: DataFrame) -> DataFrame:
    return windows.join(targets, "window_id")


def with_prediction(truth: DataFrame, prediction: DataFrame, how: str = "left",
                    key: Sequence[str] = ("window_id",)) -> DataFrame:
    """Truth (vx_gt..) with predictions (vx_pred..); "left" keeps unpredicted windows."""
    renamed = prediction.select(*key, *[F.col(c).alias(f"{c}_pred") for c in ("vx", "vy", "vz")])
    return truth.join(renamed, list(key), how)


def with_parameters(frames: DataFrame, params: DataFrame) -> DataFrame:
    """Attach per-recording parameters to frames.

    No broadcast hint: Spark broadcasts the table when its size is small, and
    splits a hot recording in the shuffle join otherwise.
    """
    return frames.join(params, "rec")


def fold_of_tag(c: Column | str, folds: dict[str, str]) -> Column:
    """Which fold a run is judged on, from its tag prefix."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(None).cast("string")
    for prefix, fold in folds.items():
        out = F.when(c.startswith(prefix), F.lit(fold)).otherwise(out)
    return out


# --------------------------------------------------------- sets and orderings
def stack(*parts: DataFrame) -> DataFrame:
    """Concatenate tables with the same columns, keeping repeats."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def common_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("rec").intersect(b.select("rec"))


def ids_without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("rec").distinct().join(b.select("rec"), "rec", "left_anti")


def slowest_windows(windows: DataFrame, k: int = 200, speed: str = "speed") -> DataFrame:
    """The k slowest windows overall (a bounded top-k report)."""
    return windows.orderBy(F.col(speed), "rec", "win_idx").limit(k)


def best_per_group(df: DataFrame, keys: Sequence[str], metric: str, k: int = 1) -> DataFrame:
    """Lowest metric per group, ties broken by the remaining columns."""
    rest = [c for c in df.columns if c not in keys and c != metric]
    return top_k(df, keys, [F.col(metric), *[F.col(c) for c in rest]], k)


def rare_bins(df: DataFrame, cell: str) -> DataFrame:
    """Cells with fewer rows than the median non-empty cell."""
    counts = df.groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
    middle = percentiles(counts, [], {"n": (F.col("n"), [0.5])})
    return counts.join(F.broadcast(middle)).where(F.col("n") < F.col("n_p50")).select(cell, "n")


def in_row_order(df: DataFrame, *order: str) -> DataFrame:
    """Rows in the order of the index they were built from (``row_id``, or the given columns)."""
    return df.orderBy(*(order or ("row_id",)))


def quantile_edges(df: DataFrame, c: str, fractions: Sequence[float]) -> DataFrame:
    return percentiles(df, [], {"edge": (F.col(c), list(fractions))})


def digitise(c: Column, edges: Sequence[Column | float]) -> Column:
    """Bin number: how many edges are <= the value (right-open bins)."""
    out = F.lit(0)
    for e in edges:
        out = out + (c >= (e if isinstance(e, Column) else F.lit(float(e)))).cast("int")
    return out


def share_of(c: str, keys: Sequence[str]) -> Column:
    return F.col(c) / F.sum(c).over(Window.partitionBy(*keys))
