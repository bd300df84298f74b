"""Recordings built from general tables, for trying the operators on any data.

``sensor_view`` turns order lines into 6-axis recordings (one per supplier),
``vector_view`` does the same for embedding vectors (one per label) and
``event_view`` exposes an irregular stream (one per user).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sensorframe.operators.blocks import number_rows
from sensorframe.params import Rig

LINE_RIG = Rig(window=50, fs=50.0)
VECTOR_RIG = Rig(window=10, fs=10.0)

_LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
               "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_slices(table: DataFrame, c: str, then: str, rows_per_slice: int = 10_000_000) -> Column:
    """Slices along a time and a whole number, thin enough that a third of all rows in one key fits.

    Row count and extents come from one pass over two columns (mostly file
    footers). Slices are of whole days, four weeks at most; where single days are
    still too thick, each instant is cut further along ``then``, the next sort
    column. The numbering is the same for any slices.
    """
    day = F.unix_date(F.to_date(c))
    n, first, last, top = table.agg(F.count(F.lit(1)), F.min(day), F.max(day), F.max(F.abs(F.col(then)))).first()
    days = (last - first + 1) if n and last is not None else 1
    wanted = max(1, -(-(n or 0) // 3 // rows_per_slice))  # slices that a third of all rows needs
    width = max(1, min(28, days // wanted))
    if wanted <= days or not top:
        return F.floor(day / width)
    parts = -(-wanted // days)
    return F.struct(F.col(c).alias("at"), F.floor(F.col(then) / max(1, -(-(top + 1) // parts))).alias("part"))


def sensor_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, frame, six axes and a truth velocity from ``lineitem``."""
    table = load(spark, sf_dir, "lineitem")
    lines = table.withColumn(
        "l_discount", F.col("l_discount") + 0.0).withColumn("l_tax", F.col("l_tax") + 0.0)
    frames = number_rows(lines, "l_suppkey", _LINE_ORDER, day_slices(table, "l_shipdate", "l_orderkey"))
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return frames.select(
        F.col("l_suppkey").alias("rec"), "frame",
        ((q - 25.5) / 10).alias("ax"), ((d - 0.05) * 20).alias("ay"),
        (9.81 + (t - 0.04) * 20).alias("az"), ((d - 0.05) * 4).alias("wx"),
        ((t - 0.04) * 4).alias("wy"), ((q - 25.5) / 50).alias("wz"),
        (F.col("l_extendedprice") / 20000).alias("vx"), (q / 25).alias("vy"),
        (t * 5).alias("vz"))


def platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec -> platform (the region a supplier belongs to)."""
    supplier = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("rec"), F.col("r_name").alias("platform")))


def with_platform(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return df.join(platforms(spark, sf_dir), "rec")


def _every_ninth(i: int) -> Column:
    """Sum of the embedding's components i, i + 9, i + 18, ..."""
    picked = F.filter("embedding", lambda x, k: k % 9 == i)
    return F.aggregate(picked, F.lit(0.0), lambda s, x: s + x)


def vector_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, frame, six axes and a truth velocity from ``embeddings``: component k adds to channel k mod 9."""
    e = load(spark, sf_dir, "embeddings")
    frames = number_rows(e.select("label", "vec_id", *[
        _every_ninth(i).alias(n)
        for i, n in enumerate(("ax", "ay", "az", "wx", "wy", "wz", "vx", "vy", "vz"))]),
        "label", ["vec_id"], F.floor(F.col("vec_id") / 4096))
    return frames.withColumnRenamed("label", "rec").drop("vec_id")


def wall_clock(c) -> Column:
    """A timestamp without zone read as UTC, whatever the session's time zone."""
    c = F.col(c) if isinstance(c, str) else c
    whole = (F.unix_date(F.to_date(c)).cast("bigint") * 86_400 + F.hour(c) * 3_600
             + F.minute(c) * 60) * 1_000_000
    part = (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    return F.timestamp_micros(whole + part)


def event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An irregular stream: rec, ts, value, numbered in time order."""
    table = load(spark, sf_dir, "events")
    e = table.select(
        F.col("user_id").alias("rec"), "ts", "event_id", "event_type",
        (F.col("value") + 0.0).alias("value"))
    return number_rows(e, "rec", ["ts", "event_id"], day_slices(table, "ts", "event_id"))
