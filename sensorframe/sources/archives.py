"""Recording archives as a Spark data source, for batch and streaming reads.

    spark.dataSource.register(RecordingSource)
    spark.read.format("recordings").load(root)                          # root/<split>/**/<rec>.npz
    spark.readStream.format("recordings").option("split", "test").load(root)

Files are listed when the scan is planned and dealt to partitions of about
``bytesPerPartition``. The options ``split`` and ``rec`` (names, comma-joined) leave
out files before any is opened; so do filters on these columns with the option
``pushdown`` = true, which needs ``spark.sql.python.filterPushdown.enabled``. Paths may be of any file system that pyarrow
opens by its address.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from sensorframe import schema as S
from sensorframe.sources.recordings import decode_recording

SCHEMA = StructType([StructField("split", StringType()), *S.FRAMES.fields])
ROWS_PER_BATCH = 50_000


def file_system(path: str) -> tuple[pfs.FileSystem, str]:
    """The file system of an address and the path inside it."""
    return pfs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (pfs.LocalFileSystem(), path)


@dataclass
class Archive:
    """One file: its split (first folder below the root), recording (file stem), path and size."""
    split: str
    rec: str
    path: str
    size: int
    changed: int


def listed(root: str, wanted: dict[str, set[str]]) -> list[Archive]:
    """Archives below ``root`` that pass ``wanted`` (column -> allowed names), ordered by path; contents are not read."""
    fs, base = file_system(root)
    base = base.rstrip("/")
    tops = [x.path for x in fs.get_file_info(pfs.FileSelector(base, allow_not_found=True)) if x.type == pfs.FileType.Directory]
    found = []
    for top in tops:
        split = top.rsplit("/", 1)[1]
        if "split" in wanted and split not in wanted["split"]:
            continue
        for f in fs.get_file_info(pfs.FileSelector(top, recursive=True)):
            if f.type == pfs.FileType.File and f.path.endswith(".npz"):
                rec = f.base_name.rsplit(".", 1)[0]
                if "rec" not in wanted or rec in wanted["rec"]:
                    found.append(Archive(split, rec, f.path, f.size, f.mtime_ns))
    return sorted(found, key=lambda a: a.path)


class Files(InputPartition):
    """Archives that one task reads."""

    def __init__(self, archives: list[Archive]):
        super().__init__(len(archives))
        self.archives = archives


def dealt(archives: list[Archive], limit: int) -> list[Files]:
    """Runs of archives of about ``limit`` bytes; a larger one stands alone."""
    out, held, size = [], [], 0
    for a in archives:
        if held and size + a.size > limit:
            out.append(Files(held))
            held, size = [], 0
        held.append(a)
        size += a.size
    return out + ([Files(held)] if held else [])


class _Options:
    def __init__(self, options):
        self.root = options["path"]
        self.limit = int(options.get("bytesperpartition", options.get("bytesPerPartition", 64 << 20)))
        self.wanted = {k: set(options[k].split(",")) for k in ("split", "rec") if options.get(k)}

    def read_files(self, files: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.root)
        for a in files.archives:
            with fs.open_input_stream(a.path) as f:
                columns = decode_recording(f.read())
            n = len(columns["frame"])
            for at in range(0, n, ROWS_PER_BATCH):
                size = min(ROWS_PER_BATCH, n - at)
                arrays = [pa.array([a.split] * size), pa.array([a.rec] * size)]
                for field in SCHEMA.fields[2:]:
                    kind = pa.int64() if field.name == "frame" else pa.float64()
                    values = columns.get(field.name)
                    arrays.append(pa.nulls(size, kind) if values is None else pa.array(
                        values[at:at + size], kind, from_pandas=True))
                yield pa.RecordBatch.from_arrays(arrays, SCHEMA.names)


class RecordingReader(_Options, DataSourceReader):
    def partitions(self) -> list[Files]:
        return dealt(listed(self.root, self.wanted), self.limit) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.read_files(partition)


class FilteredReader(RecordingReader):
    """Takes filters on ``split`` and ``rec`` as well; Spark allows such a reader only where pushdown is enabled."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("split",), ("rec",)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                column = f.attribute[0]
                self.wanted[column] = self.wanted.get(column, names) & names
            else:
                yield f


class RecordingStream(_Options, DataSourceStreamReader):
    """New archives by time of arrival: an archive is read once, in the batch after it was put in place.

    The offset is the (time, path) of the last archive seen, so archives should be
    moved into the folder whole and not changed there.
    """

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((a.changed, a.path) for a in listed(self.root, self.wanted)), default=(-1, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((o["changed"], o["path"]) for o in (start, end))
        return dealt([a for a in listed(self.root, self.wanted) if low < (a.changed, a.path) <= high], self.limit)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.read_files(partition)


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> RecordingReader:
        return FilteredReader(self.options) if self.options.get("pushdown") == "true" else RecordingReader(self.options)

    def streamReader(self, schema: StructType) -> RecordingStream:
        return RecordingStream(self.options)


def read_archives(spark: SparkSession, root: str, split: str | None = None, recs: list[str] | None = None) -> DataFrame:
    """Frames of the archives below ``root``; only files of the asked split and recordings are opened."""
    spark.dataSource.register(RecordingSource)
    reader = spark.read.format("recordings")
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    for key, value in (("split", split), ("rec", ",".join(recs) if recs else None), ("pushdown", pushdown)):
        if value:
            reader = reader.option(key, value)
    return reader.load(root)


def follow_archives(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """The same as a stream of new archives."""
    spark.dataSource.register(RecordingSource)
    reader = spark.readStream.format("recordings")
    return (reader.option("split", split) if split else reader).load(root)


def write_archive(root: str, split: str, rec: str, arrays: dict[str, np.ndarray]) -> None:
    """One archive, written aside and moved in place, so a retried task or a stream never sees half of it."""
    fs, base = file_system(root)
    folder = f"{base}/{split}"
    fs.create_dir(folder, recursive=True)
    aside = f"{folder}/{rec}.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside) as f:
        np.savez(f, **arrays)
    fs.move(aside, f"{folder}/{rec}.npz")
