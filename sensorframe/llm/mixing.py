"""Mixing sources to target sizes with hash thresholds.

Every document has a hash of its id. A source that must give R words takes the
documents whose hash lies below a threshold; the threshold is found from
histograms: sizes are summed by source and leading hash digits, the digit where
the running sum passes R is the boundary bucket, and only that bucket is split
by the next digits. Nothing is sorted, and a larger budget always contains a
smaller one. A source whose target exceeds its size repeats all its documents
as often as fits and takes the rest by threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorframe.llm.common import stored, text_of, words_in

#: The hash has 60 bits, refined 12 bits at a time.
HASH_BITS, STEP_BITS = 60, 12


def id_hash(key: Column, seed: str = "mix") -> Column:
    """60 bits of the MD5 of seed and key; a null key hashes as the text "null"."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def fill_targets(sources: DataFrame, total: Column, most: float = 3.0) -> DataFrame:
    """Add ``target``: ``total`` shared by ``weight``, none above ``most`` times its ``source_size``.

    The excess of capped sources is shared again by weight until none is above.
    That ends at one level L with target = min(L * weight, cap): sources are
    capped in the order of cap / weight, so running sums over the source table
    (one row per source) give L. If all caps together are below the total, every
    source stops at its cap.
    """
    cap, ratio = F.lit(most) * F.col("source_size"), F.lit(most) * F.col("source_size") / F.col("weight")
    before = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = (sources.withColumn("_ratio", ratio).withColumn("_total", total)
         .withColumn("_caps", F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
         .withColumn("_free", F.sum("weight").over(every)
                     - F.coalesce(F.sum("weight").over(before), F.lit(0)))
         .withColumn("_level", (F.col("_total") - F.col("_caps")) / F.col("_free")))
    # where the level no longer overfills a source the capping ends; later levels are lower
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(every)
    return (s.withColumn("target", F.when(F.col("_ratio") <= F.coalesce(level, F.lit(float("inf"))), cap)
                         .otherwise(level * F.col("weight")).cast("double"))
            .drop("_ratio", "_total", "_caps", "_free", "_level"))


def weighted_sources(sizes: DataFrame, weights=(1, 2, 3), most: float = 3.0) -> DataFrame:
    """Sources in code point order, null last, with repeating weights and their targets.

    ``sizes`` has ``source``, ``size`` rows; returned: ``source``, ``source_size``, ``target``.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per.withColumn("_rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          (F.col("_rank") % len(weights) + 1).cast("int"))
    total = F.sum("source_size").over(Window.partitionBy()).cast("double")
    return (fill_targets(ranked.withColumn("weight", weight), total, most)
            .select("source", "source_size", "target"))


def source_key(name: str = "source") -> Column:
    """A key that is never null: joins then treat a null source like any other."""
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit(""))


def thresholds(hashed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Find the hash below which each budget of each source is met.

    ``hashed``: ``key``, ``size``, ``h``; ``budgets``: ``key``, ``budget`` (name), ``wanted``.
    Returned: ``key``, ``budget``, ``threshold``; documents with h < threshold are
    taken, so budgets of one source nest. Of the two sides of the document at the
    boundary the nearer one is chosen, the upper on ties. Rows of one hash
    (repeated ids) stay together. A budget that wants nothing has threshold 0.
    """
    zero = F.lit(0).cast("bigint")
    # low: first hash of the bucket at the boundary; below, inside: sizes before and in it
    state = budgets.select("key", "budget", "wanted", zero.alias("low"), zero.alias("below"),
                           zero.alias("inside"))
    for bits in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        # where even all documents do not reach a budget, the threshold lies beyond every hash
        beyond = F.lit(1 << HASH_BITS) if bits == HASH_BITS - STEP_BITS else F.col("low")
        parent = F.shiftright("h", bits + STEP_BITS)
        marks = state.select("key", F.shiftright("low", bits + STEP_BITS).alias("parent"), "budget",
                             "wanted", "low", "below")
        rows = hashed.select("key", "size", parent.alias("parent"), F.shiftright("h", bits).alias("bucket"))
        rows = rows.join(marks.select("key", "parent").distinct(), ["key", "parent"], "left_semi")
        sums = (rows.groupBy("key", "parent", "bucket").agg(F.sum("size").cast("bigint").alias("size"))
                .where(F.col("size") > 0))
        run = Window.partitionBy("key", "parent").orderBy("bucket").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("run", F.sum("size").over(run))
        # the first bucket whose running sum reaches what is wanted
        first = F.min(F.when(F.col("below") + F.col("run") >= F.col("wanted"),
                             F.struct("bucket", "run", "size")))
        found = (marks.join(sums, ["key", "parent"], "left")
                 .groupBy("key", "budget", "wanted", "low", "below").agg(first.alias("f")))
        state = stored(found.select(
            "key", "budget", "wanted",
            F.coalesce(F.shiftleft("f.bucket", bits), beyond).alias("low"),
            (F.col("below") + F.coalesce(F.col("f.run") - F.col("f.size"), zero)).alias("below"),
            F.coalesce(F.col("f.size"), zero).alias("inside")), "thresholds")
    upper = F.col("below") + F.col("inside") - F.col("wanted") <= F.col("wanted") - F.col("below")
    return state.select("key", "budget", F.when(F.col("wanted") <= 0, F.lit(0)).when(upper, F.col("low") + 1)
                        .otherwise(F.col("low")).cast("bigint").alias("threshold"))


def mix_plan(sized: DataFrame, weights=(1, 2, 3), most: float = 3.0) -> DataFrame:
    """One row per source of ``sized`` (``key``, ``source``, ``size``, ``h``): how to mix it.

    ``source_size``, ``target``, ``repeats`` (of every document), ``threshold``
    (documents with a smaller hash are taken once more).
    """
    targets = weighted_sources(sized, weights, most).select(
        source_key().alias("key"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0).cast("bigint").alias("repeats"))
    targets = stored(targets, "targets")
    rest = targets.select("key", F.lit("rest").alias("budget"),
                          (F.col("target") - F.col("repeats") * F.col("source_size")).alias("wanted"))
    return stored(targets.join(thresholds(sized, rest), "key").drop("budget"), "plan")


def sized_rows(docs: DataFrame, keep, seed: str) -> DataFrame:
    return stored(docs.select(*keep, "source", source_key().alias("key"), words_in(text_of()).alias("size"),
                              id_hash(F.col("doc_id"), seed).alias("h")), "sizes")


def mix(docs: DataFrame, keep=("doc_id",), weights=(1, 2, 3), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """How often the mix takes every document of ``docs`` (``doc_id``, ``text``, ``source``).

    Returned: ``keep`` columns, ``source``, ``size`` (words; a null text has none),
    ``source_size``, ``target``, ``copies`` (0 to ``most``), ``taken`` = copies * size.
    Rows that share a doc_id share its hash and are taken together. A source
    without words has target 0 and takes nothing. An empty table gives no rows.
    """
    sized = sized_rows(docs, keep, seed)
    copies = F.col("repeats") + (F.col("h") < F.col("threshold")).cast("bigint")
    return (sized.join(mix_plan(sized, weights, most), "key")
            .select(*keep, "source", "size", "source_size", "target", copies.alias("copies"))
            .withColumn("taken", F.col("copies") * F.col("size")))


def apply_mix(docs: DataFrame, weights=(1, 2, 3), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    The plan is a written table with a row per source, so Spark knows its size
    and sends it to the texts; only a plan too large to broadcast moves them.
    """
    plan = mix_plan(sized_rows(docs, [], seed), weights, most).select(
        F.col("key").alias("_key"), F.col("repeats").alias("_repeats"), F.col("threshold").alias("_threshold"))
    copies = F.col("_repeats") + (id_hash(F.col("doc_id"), seed) < F.col("_threshold")).cast("bigint")
    return (docs.withColumn("_key", source_key()).join(plan, "_key")
            .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*docs.columns))
