"""Which rows a classifier may learn from, all of them or bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(key: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def some_ids(rows: DataFrame, n: int, seed: str, *more: str) -> DataFrame:
    """At most ``n`` ids of learnable rows, the same in every run: those of the smallest hash."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    return (rows.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", *more)
            .orderBy(order, "doc_id", *more).limit(n))


def texts_of(docs: DataFrame, ids: DataFrame, *keep: str) -> DataFrame:
    """The rows of ``docs`` with one of at most a few thousand ids: the ids are broadcast, texts stay in place."""
    return docs.select("doc_id", "text", *keep).join(F.broadcast(ids), "doc_id")


#: Bits that mark wanted ids, by hash: 16 MB when all are used.
MARKS, _PART = 1 << 27, 1 << 15


def texts_of_many(docs: DataFrame, ids: DataFrame, *keep: str) -> DataFrame:
    """The rows of ``docs`` whose id is marked as one of ``ids``, any number of them: all wanted rows and few others.

    A bitmap of hashed ids, of bounded size, is broadcast, so texts stay in place;
    rows let through by chance are left to the join or group that follows.
    """
    at = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    part, place = F.floor(at / _PART).alias("_part"), (at % _PART).alias("_place")
    marks = ids.select(part, place).groupBy("_part").agg(F.bitmap_construct_agg("_place").alias("_marks"))
    byte = F.conv(F.hex(F.substring("_marks", F.floor(F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.floor(byte / F.pow(F.lit(2), F.col("_place") % 8)) % 2 == 1
    return docs.select("doc_id", "text", *keep, part, place).join(F.broadcast(marks), "_part").where(hit).select(
        "doc_id", "text", *keep)
