"""Vectorised Python over many small groups of rows at once.

``groupBy().applyInPandas`` pays a fixed price per group. Here the rows are
hash-partitioned and sorted by group in Spark, and each task reads its Arrow
batches in order: a batch holds many whole groups (a group cut by a batch edge
is carried over), so the price is paid per batch. A task never holds more than
one batch and one unfinished group; callers keep groups bounded.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def give_back() -> None:
    """Return freed memory to the system: a Python worker stays alive between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library offers it
        pass


def group_bounds(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Row numbers where a new group starts, plus the end (rows sorted by group)."""
    change = np.zeros(len(pdf), bool)
    change[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), len(pdf))


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str],
               fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame],
               schema: str) -> DataFrame:
    """Apply ``fn(rows, bounds)`` to runs of whole groups, sorted by ``order`` inside.

    ``bounds`` holds the start row of each group and the end. The rows are placed
    by a hash column of their own: a repartition by the bare keys may be left out
    when a join below already has that partitioning, and adaptive execution may
    then split the join's output, because ``mapInPandas`` states no need for it.
    """
    keys, order = list(keys), list(order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            if held:
                first, last = held[-1][keys].iloc[-1], pdf[keys].iloc[-1]
                if (first == last).all() and (pdf[keys] == first).all(axis=None):
                    held.append(pdf)  # the unfinished group goes on through this batch
                    continue
                pdf = pd.concat([*held, pdf], ignore_index=True)
            bounds = group_bounds(pdf, keys)
            cut = bounds[-2]
            held = [pdf.iloc[cut:]]
            if cut:
                yield fn(pdf.iloc[:cut].reset_index(drop=True), bounds[:-1])
        if held:
            pdf = pd.concat(held, ignore_index=True)
            held = []
            yield fn(pdf, group_bounds(pdf, keys))
            del pdf
        give_back()
    rows = df.withColumn("_place", F.xxhash64(*keys)).repartition("_place")
    return rows.sortWithinPartitions(*keys, *order).drop("_place").mapInPandas(run, schema)


def positions(bounds: np.ndarray) -> np.ndarray:
    """Place of every row inside its group."""
    sizes = np.diff(bounds)
    return np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)


def spread(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One value per group, repeated on the group's rows."""
    return np.repeat(values, np.diff(bounds), axis=0)


def running_sum(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the earlier rows of the group, for every row.

    Groups are summed one by one so that a large group before does not cost
    the small ones precision.
    """
    out = np.zeros_like(x)
    for a, b in zip(bounds[:-1], bounds[1:]):
        np.cumsum(x[a:b - 1], axis=0, out=out[a + 1:b])
    return out
