"""Session helpers: a tuned local session for tests and bench, and checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sensorframe", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session for local runs. On a cluster, pass your own session instead."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (
        SparkSession.builder.appName(app).master(master)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_packages(spark: SparkSession, packages: tuple[str, ...] = ("sensorframe", "workload")) -> None:
    """Send the source of these packages to the executors, once per Spark context.

    Python workers import the functions that jobs run. A local session started
    where the packages can be imported anyway is left as it is.
    """
    root, sc = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if getattr(sc, "_packages_shipped", False) or sc.master.startswith("local") and root in [*known, os.getcwd()]:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "packages.zip")
    with zipfile.ZipFile(path, "w") as z:
        for package in packages:
            for folder, _, names in os.walk(os.path.join(root, package)):
                for name in names:
                    if name.endswith(".py"):
                        file = os.path.join(folder, name)
                        z.write(file, os.path.relpath(file, root))
    sc.addPyFile(path)
    sc._packages_shipped = True


def check_skew_splitting(spark: SparkSession) -> bool:
    """Whether adaptive execution may split hot keys in joins; warns if it may not."""
    on = all(spark.conf.get(k, "false") == "true" for k in (
        "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled", "spark.sql.adaptive.forceOptimizeSkewedJoin"))
    if not on:
        warnings.warn("joins on hot recordings are split only with spark.sql.adaptive.enabled, skewJoin.enabled "
                      "and forceOptimizeSkewedJoin set to true", stacklevel=2)
    return on


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; make a scratch one only locally."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder for written tables."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and go on from the written table.

    Unlike a checkpoint, later reads take only the columns and row groups they need.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Write ``df`` once in buckets of ``keys``, so that joins and groups on them leave its rows where they are."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", scratch_path(spark, name)).saveAsTable(known, format="parquet")
    return spark.read.table(known)
