"""Readers and writers for index, target, prediction, fold and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorframe import schema as S
from sensorframe.operators.relational import drop_null_columns, normalise_key


def lines_by_header(lines: DataFrame, wanted, marker: str) -> DataFrame:
    """CSV lines (``value``, ``_path``) as columns, each file by its own header line.

    The header of a file is its line with the column ``marker``. Columns may come
    in any order and number; those of ``wanted`` (a schema) are cast, others in
    any file are kept as text, and a column that a file lacks is null there.
    Only the distinct header lines are looked at on the driver.
    """
    clean = lambda c: F.regexp_replace(c, "[\r\ufeff]", "")
    is_header = F.array_contains(F.transform(F.split("value", ","), lambda c: F.trim(F.regexp_replace(c, '"', ""))), marker)
    lines = lines.withColumn("value", clean(F.col("value")))
    heads = lines.where(is_header).select("_path", F.col("value").alias("_head")).distinct()
    layouts = [r[0] for r in heads.select("_head").distinct().orderBy("_head").collect()]
    named = {h: [c.strip().strip('"') for c in h.split(",")] for h in layouts}
    types = {f.name: f.dataType for f in wanted.fields}
    names = list(dict.fromkeys([*types, *[c for h in layouts for c in named[h]]]))
    rows = lines.where(~is_header & (F.trim("value") != "")).join(heads, "_path")
    parsed = {h: F.from_csv("value", ", ".join(f"`{c}` STRING" for c in named[h])) for h in layouts}

    def column(c):
        found = F.lit(None).cast("string")
        for h in layouts:
            if c in named[h]:
                found = F.when(F.col("_head") == h, parsed[h][c]).otherwise(found)
        return (found.cast(types[c]) if c in types else found).alias(c)
    return rows.select("_path", *[column(c) for c in names])


def _read_csv(spark: SparkSession, path, wanted, marker: str | None = None) -> DataFrame:
    """CSV files read by column name; the first wanted column marks the header."""
    lines = spark.read.text(path).withColumn("_path", F.input_file_name())
    return lines_by_header(lines, wanted, marker or wanted.fields[0].name)


def read_window_index(spark: SparkSession, path: str) -> DataFrame:
    """Window index with clean recording ids; columns without any value are left out."""
    df = drop_null_columns(_read_csv(spark, path, S.WINDOW_INDEX).drop("_path"))
    return df.withColumn("rec", normalise_key("traj_id")).drop("traj_id")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, S.TARGETS).drop("_path")


def read_prediction(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, S.PREDICTION).drop("_path")


def read_frames(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Frame table; with ``split`` only that split's folder is read."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def read_runs(spark: SparkSession, paths: Sequence[str], tag_pattern: str,
              expected_rows: int | None = None) -> DataFrame:
    """Predictions of many runs; tag from the file name, origin from its folder.

    Runs with another number of rows than ``expected_rows`` are left out: their
    lines are counted first (each file has one header line) and never parsed.
    """
    lines = spark.read.text(list(paths)).withColumn("_path", F.input_file_name())
    tag, origin = F.regexp_extract("_path", tag_pattern, 1), F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1)
    if expected_rows is not None:
        sizes = (lines.where(F.trim("value") != "").groupBy("_path").agg(F.count(F.lit(1)).alias("_n"))
                 .select("_path", tag.alias("tag"), origin.alias("origin"), (F.col("_n") - 1).alias("_n")))
        whole = sizes.groupBy("tag", "origin").agg(F.sum("_n").alias("_n")).where(F.col("_n") == expected_rows)
        lines = lines.join(sizes.join(whole, ["tag", "origin"], "left_semi").select("_path"), "_path", "left_semi")
    raw = lines_by_header(lines, S.PREDICTION, S.PREDICTION.names[0]).select("_path", *S.PREDICTION.names)
    return raw.withColumn("tag", tag).withColumn("origin", origin).drop("_path")


def read_fold(spark: SparkSession, path: str) -> DataFrame:
    """A fold document: held recordings, flight groups and a note."""
    return spark.read.schema(S.FOLD).option("multiLine", True).json(path)


def held_recordings(fold: DataFrame) -> DataFrame:
    return fold.select(F.explode("held").alias("rec")).distinct()


_RESULT_NAMES = {"ATE20 (m)": "ate", "AVE (m/s)": "ave", "RTE (m)": "rte", "Score": "score",
                 "Seq. ID": "sequence", "Platform": "platform", "Method": "method",
                 "share of score": "share", "n_traj": "n_rec", "n_win": "n_win"}


def read_results(spark: SparkSession, paths: str | Sequence[str], kind: str) -> DataFrame:
    """Published result tables (``overall``, ``platform`` or ``sequences``) of many runs.

    Percent texts become numbers; the tag is the file name without its kind.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    return tidy_results(spark.read.option("header", True).csv(paths).withColumn("_path", F.input_file_name()), kind)


def tidy_results(raw: DataFrame, kind: str) -> DataFrame:
    """Result rows as text, with the file name in ``_path``, under plain names and types."""
    cols = [F.regexp_extract("_path", rf"([^/]+)_{kind}[^/]*\.csv$", 1).alias("tag")]
    for c in raw.columns:
        if c == "_path":
            continue
        name, value = _RESULT_NAMES.get(c, c), F.col(f"`{c}`")
        if name == "share":
            value = F.regexp_replace(value, "%", "").try_cast("double")
        elif name in ("n_rec", "n_win", "sequence"):
            value = value.try_cast("int")
        elif name not in ("platform", "method"):
            value = value.try_cast("double")
        cols.append(value.alias(name))
    return raw.select(*cols)


# ----------------------------------------------------------------------- sinks
def write_prediction(df: DataFrame, path: str, fmt: str = "csv") -> None:
    out = df.select("window_id", "vx", "vy", "vz").write.mode("overwrite")
    out.option("header", True).csv(path) if fmt == "csv" else out.format(fmt).save(path)


def write_solution(df: DataFrame, path: str, fmt: str = "csv") -> None:
    out = df.select(*[f.name for f in S.SOLUTION.fields]).write.mode("overwrite")
    out.option("header", True).csv(path) if fmt == "csv" else out.format(fmt).save(path)


def write_frames(df: DataFrame, path: str, partition: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(partition).parquet(path)
