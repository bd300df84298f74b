"""One evaluation job from prediction files to the table of all runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from sensorframe.functions import vec as V
from sensorframe.operators.relational import fold_of_tag
from sensorframe.plans.evaluation import path_rmse, sweep_table, with_errors
from sensorframe.session import write_once
from sensorframe.sources.tables import read_runs


def sweep_from_files(spark: SparkSession, paths: Sequence[str], tag_pattern: str, truth: DataFrame,
                     folds: dict[str, str], held: DataFrame, classes: DataFrame,
                     bins: Sequence[tuple[float, float]] = ((6, 8), (8, 10), (10, 99))) -> DataFrame:
    """One row per run whose files have a row for every window of ``truth``; other files are not parsed.

    ``truth``: window_id, rec, win_idx, platform, vx_gt..vz_gt. A run is judged on
    the recordings that ``held`` (fold, rec) lists for the fold of its tag's prefix
    (``folds``). ``classes``: rec, cls.
    """
    runs = read_runs(spark, paths, tag_pattern, truth.count())
    # the errors and the paths read the pairs, so they are written once
    pairs = write_once(runs.withColumnsRenamed({c: f"{c}_pred" for c in V.VEL}).join(truth, "window_id")
             .withColumn("fold", fold_of_tag("tag", folds)).join(held, ["fold", "rec"], "left_semi"), "pairs")
    steps = pairs.withColumnsRenamed({**{f"v{a}_pred": f"m_{a}" for a in "xyz"}, **{f"v{a}_gt": f"t_{a}" for a in "xyz"}})
    ates = path_rmse(steps, ["tag", "rec"], "win_idx").withColumnRenamed("path_rmse", "ate")
    table = sweep_table(with_errors(pairs), ates.select("tag", "rec", "ate"), classes, None, bins)
    return table.withColumn("fold", fold_of_tag("tag", folds))
