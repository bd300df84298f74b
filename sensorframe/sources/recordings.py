"""Recording files: discovery, decoding into frames, fingerprints, feature tables."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorframe import schema as S

STEM = r"([^/]+)\.[^./]+$"


def discover(spark: SparkSession, root: str, pattern: str = "*.npz") -> DataFrame:
    """Recording files below ``root``: rec (file stem), path, size. Content is not read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", True).load(root))
    return files.select(F.regexp_extract("path", STEM, 1).alias("rec"), "path", "length")


def content_md5(spark: SparkSession, path: str) -> DataFrame:
    """md5 of each file's bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.md5("content").alias("md5"))


def decode_recording(content: bytes) -> dict[str, np.ndarray]:
    """One file's arrays as frame columns, cut to the shortest array."""
    with np.load(io.BytesIO(content), allow_pickle=False) as d:
        parts = {"imu": ("ax", "ay", "az", "wx", "wy", "wz"), "vel_body": ("vx", "vy", "vz"),
                 "quat": ("qx", "qy", "qz", "qw"), "pos": ("px", "py", "pz"), "ts": ("ts",)}
        arrays = {k: np.asarray(d[k], float) for k in parts if k in d.files}
        fs = float(d["fs"]) if "fs" in d.files else None
    n = min(len(a) for a in arrays.values())
    out = {}
    for k, a in arrays.items():
        a = a[:n].reshape(n, -1)
        for i, c in enumerate(parts[k]):
            out[c] = a[:, i]
    if "ts" not in out and fs:
        out["ts"] = np.arange(n) / fs
    out["frame"] = np.arange(n, dtype=np.int64)
    return out


def decode(spark: SparkSession, root: str, pattern: str = "*.npz",
           rows_per_batch: int = 50_000) -> DataFrame:
    """All recordings below ``root`` as frames; fields a file lacks are null.

    A task decodes one file at a time and hands its frames on in batches.
    """
    names = [f.name for f in S.FRAMES.fields]
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", True).load(root)
             .select(F.regexp_extract("path", STEM, 1).alias("rec"), "content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rec, content in zip(pdf["rec"], pdf["content"]):
                cols = decode_recording(content)
                n = len(cols["frame"])
                for i in range(0, n, rows_per_batch):
                    part = {c: cols[c][i:i + rows_per_batch] if c in cols else None
                            for c in names if c != "rec"}
                    out = pd.DataFrame({c: v for c, v in part.items() if v is not None})
                    out.insert(0, "rec", rec)
                    for c, v in part.items():
                        if v is None:
                            out[c] = np.nan
                    yield out[names]
    frames = files.mapInPandas(run, S.FRAMES)
    keep = ("rec", "frame")
    return frames.select(*[F.col(c) if c in keep else F.nanvl(F.col(c), F.lit(None)).alias(c)
                           for c in names])


def ingest(spark: SparkSession, root: str, split: str, out: str) -> None:
    """Decode one split once and keep it as Parquet under ``split=<name>``."""
    decode(spark, f"{root}/{split}").write.mode("overwrite").parquet(f"{out}/split={split}")


# ----------------------------------------------------------- feature tables
def fingerprint(index: DataFrame, kind: str, version: int) -> str:
    """Content key of an index: row count, first and last id, and a row hash."""
    row = index.agg(F.count(F.lit(1)).alias("n"), F.min("window_id").alias("lo"),
                    F.max("window_id").alias("hi"),
                    F.bit_xor(F.xxhash64("window_id")).alias("h")).first()
    return f"{row['n']}_{row['lo']}_{row['hi']}_{row['h'] & 0xFFFFFFFFFFFFFFFF:016x}"


def materialise(index: DataFrame, kind: str, version: int, root: str,
                build: Callable[[], DataFrame]) -> DataFrame:
    """Read the feature table for exactly this index, building it only if absent."""
    spark = index.sparkSession
    path = f"{root}/kind={kind}/version={version}/fingerprint={fingerprint(index, kind, version)}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
