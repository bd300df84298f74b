"""Percentiles of values that differ in their last bits each time they are computed."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sensorframe.operators import blocks as B


def test_percentiles_meet_the_same_values_in_every_pass(spark):
    shaken = F.udf(lambda v: v * (1 + random.random() * 1e-12), "double").asNondeterministic()
    rows = spark.range(400).select((F.col("id") % 80).alias("k"), shaken((F.col("id") % 5 + 1).cast("double")).alias("v"))
    got = B.percentiles(rows, ["k"], {"v": (F.col("v"), [0.0, 0.9, 1.0])}).collect()
    assert len(got) == 80
    assert all(r.v_p0 <= r.v_p90 <= r.v_p100 for r in got)
