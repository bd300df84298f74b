"""Awkward rows that every document operator must take."""

from __future__ import annotations

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("spans", T.StringType()),
                     T.StructField("ids", T.StringType()), T.StructField("size", T.StringType())])
LONG = "The quick brown fox, it's 12 jumps over\n\n  the lazy dog. " * 4000


def documents(spark, rows=None):
    """Nulls in every column, empty and very long texts, repeated rows, clashing column names."""
    rows = [(1, "", "en", "a"), (2, None, None, None), (None, "token = \"abcdef123\" ümlaut", "de", "b"),
            (3, LONG, "en", "a"), (4, "same text here again and again", "en", "a"),
            (4, "same text here again and again", "en", "a"), (5, "same text here again and again", None, "c"),
            (6, " \t\n ", "fr", None), (7, "日本語 🙂 'll ſecret: KEY=abcdefgh", "ja", "z")] if rows is None else rows
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z") for r in rows], DOCS)
