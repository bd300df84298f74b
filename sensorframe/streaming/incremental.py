"""Structured Streaming jobs: score new results once, and causal rest windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorframe import schema as S
from sensorframe.functions import vec as V
from sensorframe.operators.relational import fold_of_tag
from sensorframe.params import DEFAULT_RIG, Rig
from sensorframe.sources.tables import lines_by_header

#: An entry of the commit log: the attempt of a batch that counts.
COMMIT = "batch bigint, attempt string"


def collect_results(spark: SparkSession, folder: str, checkpoint: str, folds: dict[str, str],
                    evaluate: Callable[[DataFrame, int], None], tag_pattern: str,
                    files_per_trigger: int = 100):
    """Pick up every new prediction file once and hand it to ``evaluate``.

    The stream's checkpoint remembers seen files. Each batch carries the run
    tag (from the file name) and the fold its prefix is judged on.
    """
    return _follow(spark, folder, checkpoint, folds, evaluate, tag_pattern, files_per_trigger)


def _follow(spark: SparkSession, folder: str, checkpoint: str, folds: dict[str, str],
            handle: Callable[[DataFrame, int], None], tag_pattern: str, files_per_trigger: int):
    lines = (spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
             .withColumn("_path", F.input_file_name()))

    def named(batch: DataFrame, batch_id: int) -> None:
        # a batch holds whole files, so each file's header is among its lines
        batch = batch.persist()
        rows = lines_by_header(batch, S.PREDICTION, S.PREDICTION.names[0])
        tagged = rows.select(*S.PREDICTION.names, F.regexp_extract("_path", tag_pattern, 1).alias("tag"))
        handle(tagged.withColumn("fold", fold_of_tag("tag", folds)), batch_id)
        batch.unpersist()
    return (lines.writeStream.foreachBatch(named).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def collect_once(spark: SparkSession, folder: str, checkpoint: str, out: str, folds: dict[str, str],
                 evaluate: Callable[[DataFrame], DataFrame], tag_pattern: str,
                 files_per_trigger: int = 100, before_commit: Callable[[int], None] | None = None):
    """As ``collect_results``, but the results of a file are counted exactly once.

    What ``evaluate`` returns is written under ``out/results`` as an attempt of its
    batch. The attempt counts from the moment the batch's entry in ``out/commits``
    names it; an entry is written whole or not at all. A batch replayed after a
    failure finds its entry and changes nothing, or finds none and makes a new
    attempt, beside which the broken one is never read (see ``committed``).
    ``before_commit`` is called between the two writes, for tests of that moment.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        if not _entries(spark, out).where(F.col("batch") == batch_id).isEmpty():
            return
        attempt = uuid.uuid4().hex
        evaluate(batch).write.parquet(f"{out}/results/batch={batch_id}/attempt={attempt}")
        if before_commit is not None:
            before_commit(batch_id)
        entry = spark.createDataFrame([(batch_id, attempt)], COMMIT).coalesce(1)
        entry.write.mode("append").parquet(f"{out}/commits")
    return _follow(spark, folder, checkpoint, folds, handle, tag_pattern, files_per_trigger)


def _entries(spark: SparkSession, out: str) -> DataFrame:
    try:
        return spark.read.schema(COMMIT).parquet(f"{out}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def committed(spark: SparkSession, out: str) -> DataFrame:
    """Results of all committed batches; attempts without an entry are left out."""
    rows = spark.read.option("basePath", f"{out}/results").parquet(f"{out}/results")
    return rows.join(_entries(spark, out), ["batch", "attempt"], "left_semi").drop("batch", "attempt")


def causal_rest_windows(stream: DataFrame, rig: Rig = DEFAULT_RIG, width: str = "1 second",
                        lateness: str = "5 seconds", ts: str = "ts") -> DataFrame:
    """Rest score of each time window of a live frame stream.

    Built-in windowed aggregation with a watermark: state is a few sums per
    open window, and a window is emitted once, when it is past the watermark.
    """
    a, w = V.norm(V.vec(*V.ACC)), V.norm(V.vec(*V.GYR))
    scored = (stream.withWatermark(ts, lateness)
              .groupBy("rec", F.window(ts, width).alias("span"))
              .agg(F.count(F.lit(1)).alias("n"),
                   (F.abs(F.avg(a) - rig.g) + F.avg(w) + 0.5 * F.stddev_pop(a)).alias("score")))
    return scored.select("rec", F.col("span.start").alias("start"), "n", "score")


def causal_statistics(stream: DataFrame, value: str, keys: tuple[str, ...], ts: str = "ts",
                      width: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Windowed count, mean and deviation of an irregular stream."""
    out = (stream.withWatermark(ts, lateness).groupBy(*keys, F.window(ts, width).alias("span"))
           .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
                F.stddev_pop(value).alias("std")))
    return out.select(*keys, F.col("span.start").alias("start"), "n", "mean", "std")
