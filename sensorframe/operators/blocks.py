"""Building blocks that keep long recordings spread over many tasks.

A recording may hold a third of all frames, so no operator here sorts or
collects a whole recording in one task. Three tools make that possible:

* ``apply_local``  - neighbour expressions (lag, lead, moving sums) on blocks
  of a recording with a small halo of repeated rows at the block edges;
* ``prefix_sums``  - running sums built in three levels (inside a block, over
  blocks, over groups of blocks);
* ``order_statistics`` - exact ranks by histogram refinement, and
  ``percentiles`` of many columns by mergeable sketches: only the few values
  around a wanted rank are ever sorted.
"""

from __future__ import annotations

from functools import reduce
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorframe.session import write_once

BLOCK = "_block"
FRAME_BLOCK = 8192
FAN_OUT = 4096


def keys_of(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def field(name: str) -> Callable[[Column], Column]:
    """Reader of one field of an array's structs, for ``transform``."""
    return lambda row: row[name]


def double_field(name: str) -> Callable[[Column], Column]:
    return lambda row: row[name].cast("double")


def block_of(pos: str, block: int) -> Column:
    return F.floor(F.col(pos) / block)


# ------------------------------------------------------------------- neighbours
def with_halo(df: DataFrame, pos: str, before: int, after: int, block: int) -> DataFrame:
    """Repeat rows near a block edge in the neighbouring blocks that read them."""
    if not before and not after:
        return df.withColumn(BLOCK, block_of(pos, block))
    first = F.greatest(F.floor((F.col(pos) - after) / block), F.lit(0))
    last = F.floor((F.col(pos) + before) / block)
    return df.withColumn(BLOCK, F.explode(F.sequence(first, last)))


def apply_local(df: DataFrame, stages: Sequence[Callable[[Window], dict[str, Column]]],
                before: int, after: int, key="rec", pos: str = "frame",
                block: int = FRAME_BLOCK, placed: bool = False) -> DataFrame:
    """Add columns that read rows up to ``before`` earlier or ``after`` later.

    Each stage gets the ordered window and returns new columns; later stages
    may read earlier ones. ``pos`` counts rows of the recording from zero.
    All stages share one shuffle on (key, block). With ``placed`` the block stays as
    a column, so that joins on key and block leave the rows where they are.
    """
    out = with_halo(df, pos, before, after, block)
    w = Window.partitionBy(*keys_of(key), BLOCK).orderBy(pos)
    for stage in stages:
        out = out.withColumns(stage(w))
    own = out.where(F.col(BLOCK) == block_of(pos, block))
    return own if placed else own.drop(BLOCK)


# ------------------------------------------------------------------ running sums
def prefix_sums(df: DataFrame, sums: dict[str, Column], key="rec", pos: str = "frame",
                block: int = FRAME_BLOCK, fan_out: int = FAN_OUT,
                inclusive: bool = True) -> DataFrame:
    """Running sums along a recording without sorting it in one task.

    Level 1 sums inside blocks of ``block`` rows, level 2 over ``fan_out``
    blocks, level 3 over what is left (rows / (block * fan_out) per recording).
    """
    keys = keys_of(key)
    names = list(sums)
    raw = {n: f"_raw_{n}" for n in names}
    base = df.withColumns({raw[n]: c for n, c in sums.items()}).withColumn(
        BLOCK, block_of(pos, block))
    totals = (base.groupBy(*keys, BLOCK)
              .agg(*[F.sum(raw[n]).alias(f"_t_{n}") for n in names])
              .withColumn("_super", F.floor(F.col(BLOCK) / fan_out)))
    # one row per group of blocks, carrying its (at most fan_out) block totals
    upper = totals.groupBy(*keys, "_super").agg(
        F.collect_list(F.struct(BLOCK, *[f"_t_{n}" for n in names])).alias("_blocks"),
        *[F.sum(f"_t_{n}").alias(f"_u_{n}") for n in names])
    w_top = Window.partitionBy(*keys).orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.select(*keys, "_super", "_blocks", *[
        F.coalesce(F.sum(f"_u_{n}").over(w_top), F.lit(0.0)).alias(f"_top_{n}") for n in names])
    w_mid = (Window.partitionBy(*keys, "_super").orderBy(BLOCK)
             .rowsBetween(Window.unboundedPreceding, -1))
    middle = upper.select(*keys, "_super", *[f"_top_{n}" for n in names],
                          F.explode("_blocks").alias("_b")).select("*", "_b.*").drop("_b")
    offsets = middle.select(*keys, BLOCK, *[
        (F.col(f"_top_{n}") + F.coalesce(F.sum(f"_t_{n}").over(w_mid), F.lit(0.0)))
        .alias(f"_off_{n}") for n in names])
    last = Window.currentRow if inclusive else -1
    w_in = (Window.partitionBy(*keys, BLOCK).orderBy(pos)
            .rowsBetween(Window.unboundedPreceding, last))
    inner = base.withColumns({f"_in_{n}": F.coalesce(F.sum(raw[n]).over(w_in), F.lit(0.0))
                              for n in names})
    joined = inner.join(offsets, [*keys, BLOCK])
    return joined.withColumns({n: F.col(f"_in_{n}") + F.col(f"_off_{n}") for n in names}).drop(
        BLOCK, *raw.values(), *[f"_in_{n}" for n in names], *[f"_off_{n}" for n in names])


def number_rows(df: DataFrame, key, order: Sequence[str], coarse: Column,
                name: str = "frame") -> DataFrame:
    """Zero-based row number per key, sorted only inside coarse slices.

    ``coarse`` must not decrease along the first sort column (for a timestamp:
    its date). Slice sizes are counted first, so each task sorts one slice.
    """
    keys = keys_of(key)
    tagged = df.withColumn("_slice", coarse)
    w_slices = (Window.partitionBy(*keys).orderBy("_slice")
                .rowsBetween(Window.unboundedPreceding, -1))
    starts = (tagged.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
              .select(*keys, "_slice",
                      F.coalesce(F.sum("_n").over(w_slices), F.lit(0)).alias("_start")))
    w_rows = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (tagged.withColumn("_row", F.row_number().over(w_rows) - 1)
            .join(starts, [*keys, "_slice"])
            .withColumn(name, (F.col("_start") + F.col("_row")).cast("bigint"))
            .drop("_slice", "_start", "_row"))


# ----------------------------------------------------------------- exact ranks
#: Parts that a bucket with a wanted rank is cut into.
PARTS = 1 << 20
#: Percentiles: places of a sketch's grid, its accuracy, and values of one group that are gathered around a rank.
GRID, SKETCH, GATHERED = 256, 10_000, 1_000_000
#: Rows of a group up to which its values are gathered and sorted whole, without sketches.
WHOLE = 100_000


def _fine_bucket(v: Column) -> Column:
    """A whole number that never decreases with the value (1/512 octave wide)."""
    size = F.when(F.abs(v) == float("inf"), F.lit(2_000_000)).otherwise(F.floor(F.log2(F.abs(v)) * 512) + 600_000)
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("long") * size)


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where a null key equals a null key."""
    other = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys]
    return left.join(other, reduce(lambda x, y: x & y, on), how).drop(*[f"_same_{k}" for k in keys])


def _with_wanted(counts: DataFrame, within: Sequence[str], along: str) -> DataFrame:
    """Keep the rows of ``counts`` that hold a wanted rank; ``_begin`` moves up to their first row."""
    run = (Window.partitionBy(*within).orderBy(along).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = counts.withColumn("_stop", F.col("_begin") + F.sum("_c").over(run)).withColumn("_begin", F.col("_stop") - F.col("_c"))
    inside = F.filter("_wanted", lambda r: (r >= F.col("_begin")) & (r < F.col("_stop")))
    return spans.withColumn("_wanted", inside).where(F.size("_wanted") > 0).drop("_stop")


def order_statistics(df: DataFrame, keys: Sequence[str], value: str,
                     ranks: Column) -> DataFrame:
    """The values at given ranks, exactly, for every group (null keys are a group too).

    ``ranks`` is an array<bigint> of zero-based ranks that may use ``_total``,
    the group's row count. Returns keys, ``_total``, ``_rank``, ``_value``.
    Values are counted in narrow buckets; buckets with a wanted rank are cut
    into a million parts between their least and largest value, and only the
    distinct values of parts with a wanted rank are sorted. Nulls and NaN are
    left out, infinite values count.
    """
    keys = list(keys)
    v = (df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
         .select(*keys, F.col(value).cast("double").alias("_v"))
         .withColumn("_b", _fine_bucket(F.col("_v"))))
    counts = v.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    counts = counts.withColumn("_total", F.sum("_c").over(Window.partitionBy(*keys))).withColumn(
        "_wanted", F.array_distinct(ranks)).withColumn("_begin", F.lit(0).cast("bigint"))
    hit = _with_wanted(counts, keys, "_b").drop("_c")
    part = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS)).otherwise(0)
    near = join_same(v, hit, [*keys, "_b"]).withColumn("_part", part)
    same = [*keys, "_b"]
    held = [*same, "_total", "_begin", "_wanted"]
    parts = _with_wanted(near.groupBy(*held, "_part").agg(F.count(F.lit(1)).alias("_c")), same, "_part").drop("_c")
    few = join_same(near.drop("_total", "_begin", "_wanted"), parts, [*same, "_part"])
    last = few.groupBy(*held, "_part", "_v").agg(F.count(F.lit(1)).alias("_c"))
    return (_with_wanted(last, [*same, "_part"], "_v").withColumn("_rank", F.explode("_wanted"))
            .select(*keys, "_total", "_rank", F.col("_v").alias("_value")))


def percentiles(df: DataFrame, keys: Sequence[str],
                wanted: dict[str, tuple[Column, Sequence[float]]]) -> DataFrame:
    """Linearly interpolated percentiles, exact, several columns at once.

    ``wanted`` maps a prefix to (column, fractions); the result has one row per
    group with columns ``<prefix>_p<percent>``. Null and NaN values are left out
    of that column only; a group without a value, or with a null key, keeps its
    row.

    The values are written once, so every pass meets the same ones: a mean that
    is computed again may differ in its last bit. While no group has more than
    ``WHOLE`` rows, one aggregate gathers and sorts each group's values.

    Otherwise one wide aggregate makes a mergeable sketch of every column. Its grid of
    values brackets each wanted rank, and a group's brackets go back to its rows,
    where values below are counted and only those inside are gathered and
    sorted. While some group would gather more than ``GATHERED`` values, another
    sketch of the values inside narrows the brackets. A sketch can only cost time:
    a rank outside its bracket raises an error.
    """
    keys = list(keys)
    by, values, spots = keys or ["_all"], [], []
    for i, (c, fractions) in enumerate(wanted.values()):
        v = c.cast("double")
        values.append(F.when(~F.isnan(v), v).alias(f"_m{i}"))
        spots += [(i, f"{i}_{j}", float(q)) for j, q in enumerate(fractions)]
    rows = write_once(df.select(*keys, *([] if keys else [F.lit(1).alias("_all")]), *values), "values")
    most = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c")).first()[0]
    if (most or 0) <= min(WHOLE, GATHERED):
        return _whole_percentiles(rows, keys, by, wanted)
    grid = F.array(*[F.lit(g / GRID) for g in range(GRID + 1)])
    sketch = rows.groupBy(*by).agg(*[F.count(f"_m{i}").alias(f"_n{i}") for i in range(len(wanted))],
                                   *[F.percentile_approx(f"_m{i}", grid, SKETCH).alias(f"_g{i}") for i in range(len(wanted))])

    def ranks(i: int, q: float) -> tuple[Column, Column]:
        spot = F.lit(q) * (F.col(f"_n{i}") - 1)
        return F.floor(spot), F.ceil(spot)

    def bracket(values: Column, first: Column, last: Column, n: Column) -> tuple[Column, Column, Column]:
        """Grid values around the ranks ``first`` to ``last`` of ``n``, and how many values lie between, about."""
        n = F.nullif(n, F.lit(0))
        margin = F.greatest(F.lit(2), F.ceil(2.0 * GRID / n))
        lo = F.greatest(F.lit(0), F.floor(first / n * GRID) - margin).cast("int")
        hi = F.least(F.lit(GRID), F.ceil((last + 1) / n * GRID) + margin).cast("int")
        return F.get(values, lo), F.get(values, hi), F.ceil((hi - lo) / GRID * n)

    state, more = sketch, []
    for i, at, q in spots:
        lo, hi, inside = bracket(F.col(f"_g{i}"), *ranks(i, q), F.col(f"_n{i}"))
        more += [lo.alias(f"_lo{at}"), hi.alias(f"_hi{at}"), inside.alias(f"_in{at}")]
    state = state.select(*by, *[f"_n{i}" for i in range(len(wanted))], *more)
    before = None
    while True:
        state = write_once(state, "brackets")
        largest = state.agg(F.max(F.greatest(*[F.coalesce(f"_in{at}", F.lit(0)) for _, at, _ in spots], F.lit(0)))).first()[0]
        met = join_same(rows, state, by)
        below = lambda i, at: F.count_if(F.col(f"_m{i}") < F.col(f"_lo{at}")).alias(f"_b{at}")
        between = lambda i, at: F.when(F.col(f"_m{i}").between(F.col(f"_lo{at}"), F.col(f"_hi{at}")), F.col(f"_m{i}"))
        counts = [F.first(f"_n{i}").alias(f"_n{i}") for i in range(len(wanted))]
        if (largest or 0) <= GATHERED or before is not None and largest > before / 2:  # as narrow as ties let it be
            break
        before = largest
        finer = met.groupBy(*by).agg(*counts, *[x for i, at, _ in spots for x in (
            below(i, at), F.count(between(i, at)).alias(f"_c{at}"),
            F.percentile_approx(between(i, at), grid, SKETCH).alias(f"_g{at}"))])
        more = []
        for i, at, q in spots:
            first, last = (r - F.col(f"_b{at}") for r in ranks(i, q))
            lo, hi, inside = bracket(F.col(f"_g{at}"), first, last, F.col(f"_c{at}"))
            same = F.col(f"_g{at}")[0] == F.col(f"_g{at}")[GRID]  # one value, however often: nothing to gather
            more += [lo.alias(f"_lo{at}"), hi.alias(f"_hi{at}"), F.when(same, 0).otherwise(inside).alias(f"_in{at}")]
        state = finer.select(*by, *[f"_n{i}" for i in range(len(wanted))], *more)

    # a bracket of one value needs no list
    gathered = met.groupBy(*by).agg(*counts, *[x for i, at, _ in spots for x in (
        below(i, at), F.count(between(i, at)).alias(f"_c{at}"), F.first(f"_lo{at}").alias(f"_lo{at}"), F.sort_array(F.collect_list(F.when(
            F.col(f"_lo{at}") < F.col(f"_hi{at}"), between(i, at)))).alias(f"_v{at}"))])
    out = []
    for prefix, (_, fractions) in wanted.items():
        for q in fractions:
            i, at, q = spots[len(out)]
            first, last = ranks(i, q)

            def pick(r: Column) -> Column:
                place = (r - F.col(f"_b{at}")).cast("int")
                held = F.when(F.size(f"_v{at}") > 0, F.get(f"_v{at}", place)).otherwise(F.col(f"_lo{at}"))
                return F.when((place >= 0) & (place < F.col(f"_c{at}")), held).otherwise(
                    F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))
            lo, hi = pick(first), pick(last)
            part = F.lit(q) * (F.col(f"_n{i}") - 1) - first
            value = F.when(lo == hi, lo).otherwise(lo + (hi - lo) * part)
            out.append(F.when(F.col(f"_n{i}") > 0, value).alias(percentile_name(prefix, q)))
    return gathered.select(*keys, *out)


def _whole_percentiles(rows: DataFrame, keys: list[str], by: list[str],
                       wanted: dict[str, tuple[Column, Sequence[float]]]) -> DataFrame:
    """``percentiles`` of groups small enough to gather: column i of ``rows`` is ``_m<i>``."""
    lists = rows.groupBy(*by).agg(*[F.sort_array(F.collect_list(f"_m{i}")).alias(f"_v{i}") for i in range(len(wanted))])
    out = []
    for i, (prefix, (_, fractions)) in enumerate(wanted.items()):
        for q in fractions:
            spot = F.lit(float(q)) * (F.size(f"_v{i}") - 1)
            lo, hi = (F.get(f"_v{i}", r(spot).cast("int")) for r in (F.floor, F.ceil))
            value = F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (spot - F.floor(spot)))
            out.append(F.when(F.size(f"_v{i}") > 0, value).alias(percentile_name(prefix, q)))
    return lists.select(*keys, *out)


def percentile_name(prefix: str, q: float) -> str:
    return f"{prefix}_p{q * 100:g}".replace(".", "_")


# ------------------------------------------------------------------------ top-k
def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          rank: str = "rank", shards: int = 64, spread: Sequence[str] | None = None) -> DataFrame:
    """The first ``k`` rows of every group, with their rank.

    Each group is cut into hash shards, the best ``k`` of every shard are kept,
    and only those (at most shards * k per group) are ranked together.
    """
    names = spread or [c for c in df.columns if c not in keys]
    salted = df.withColumn("_shard", F.pmod(F.xxhash64(*names), F.lit(shards)))
    w1 = Window.partitionBy(*keys, "_shard").orderBy(*order)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return (salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k)
            .withColumn(rank, F.row_number().over(w2)).where(F.col(rank) <= k)
            .drop("_shard", "_r"))


def spread_distinct(df: DataFrame, keys: Sequence[str], item: str, name: str) -> DataFrame:
    """Distinct items per group, deduplicated on (group, item) before counting."""
    return df.select(*keys, item).distinct().groupBy(*keys).agg(F.count(item).alias(name))
