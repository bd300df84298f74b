"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sensorframe.llm.common import stored

#: Parts that the edges of a node are dealt to.
PARTS = 256

def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of an edge.

    Alternates large-star and small-star steps: all neighbours of a node move to
    its smallest neighbour, until every node hangs on the root of its component.
    The number of steps grows with the logarithm of the longest path. Only edges
    are held, each step is written to the shared folder, nothing is collected.
    The edges of a node meet in ``PARTS`` hashed parts, each told the node's
    smallest neighbour, so the many edges of one root are not one task's.
    Edges with a null end and loops are left out.
    """
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
               .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges")
    while True:
        both = (e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
                .withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS))))
        parts = both.groupBy("u", "part").agg(F.min("v").alias("m"))
        least = parts.groupBy("u").agg(F.min("m").alias("m")).withColumn("m", F.least("u", "m"))
        told = parts.select("u", "part").join(least, "u")
        large = (both.join(told, ["u", "part"]).where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = stored(small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                   .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        roots = e.select(F.col("v").alias("u")).distinct()
        if e.join(roots, "u", "left_semi").isEmpty() and e.groupBy("u").count().where("count > 1").isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
