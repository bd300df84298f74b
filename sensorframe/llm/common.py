"""Small helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from sensorframe.operators.grouped import give_back
from sensorframe.session import scratch_path

#: Words are runs of anything but these six characters (ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"
#: Input bytes that a Python task works on at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and go on from the written table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8_of(name: str = "text") -> Column:
    """The text's UTF-8 bytes: Arrow hands them to Python without decoding."""
    return text_of(name).cast("binary")


def words_in(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def map_rows(df: DataFrame, schema: str, keep: Sequence[str],
             make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """Add columns computed batch by batch in Python.

    ``make`` is called once per task and returns a function from a batch to the
    new columns, in the order of ``schema`` (a DDL string); the columns in
    ``keep`` are passed on. Spark bounds a batch by
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` and ``maxBytesPerBatch``; it is
    worked on in slices of about ``SLICE_BYTES``, so a task holds little at once.
    """
    keep = list(keep)
    fields = [df.schema[k] for k in keep]
    full = StructType(fields + list(StructType.fromDDL(schema).fields))
    names = [f.name for f in full.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, part = make(), None
        for b in batches:
            step = max(1, b.num_rows * SLICE_BYTES // max(1, b.nbytes))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + fn(part), names)
        del fn, part
        give_back()

    return df.mapInArrow(run, full)
