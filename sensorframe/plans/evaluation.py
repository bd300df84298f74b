"""Scores and reports: window error up to recording, platform and overall level.

Input is one table of matched windows: tag (the run), rec, win_idx, platform,
truth vx_gt.. and prediction vx_pred... Each report aggregates windows per
(tag, rec) first, with map-side partial sums, and only then goes up a level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorframe.functions import vec as V
from sensorframe.operators.blocks import apply_local, percentiles, prefix_sums, top_k
from sensorframe.operators.relational import digitise, recipe_of, share_of
from sensorframe.params import (ATE_REFERENCE, ATE_WEIGHT, AVE_REFERENCE, AVE_WEIGHT, SPEED_EDGES)
from sensorframe.session import cut_lineage

TRUE = ("vx_gt", "vy_gt", "vz_gt")
PRED = ("vx_pred", "vy_pred", "vz_pred")


def with_errors(matched: DataFrame) -> DataFrame:
    """Add err, true_speed and pred_speed to matched windows."""
    t, p = V.vec(*TRUE), V.vec(*PRED)
    return matched.withColumns({"err": V.norm(V.sub(p, t)), "true_speed": V.norm(t),
                                "pred_speed": V.norm(p)})


def score(ave: Column, ate: Column) -> Column:
    return AVE_WEIGHT * ave / AVE_REFERENCE + ATE_WEIGHT * ate / ATE_REFERENCE


def recording_ave(errors: DataFrame, keys: Sequence[str] = ("tag", "platform", "rec")) -> DataFrame:
    """Mean velocity error per recording."""
    return errors.groupBy(*keys).agg(F.avg("err").alias("ave"), F.count("err").alias("n_win"))


def platform_scores(recs: DataFrame, keys: Sequence[str] = ("tag", "platform")) -> DataFrame:
    """Means over recordings (ave, ate) per platform; non-finite ones are left out."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    good = recs.where(finite("ave") & finite("ate"))
    out = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rec"), F.avg("ate").alias("ate"),
                                  F.avg("ave").alias("ave"))
    return out.withColumn("score", score(F.col("ave"), F.col("ate")))


def macro_score(platform_table: DataFrame, keys: Sequence[str] = ("tag",)) -> DataFrame:
    """Overall score: the plain mean of the platform scores."""
    return platform_table.groupBy(*keys).agg(
        F.avg("score").alias("score"), F.avg("ate").alias("ate"), F.avg("ave").alias("ave"))


def score_share(platform_table: DataFrame, keys: Sequence[str] = ("tag",)) -> DataFrame:
    return platform_table.withColumn("share", share_of("score", keys))


def _paths(steps: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Running sums c_* of predicted steps m_* and g_* of true steps t_* in one scan."""
    sums = {f"{to}_{a}": F.col(f"{frm}_{a}") for to, frm in (("c", "m"), ("g", "t")) for a in "xyz"}
    if "t_x" not in steps.columns:  # true positions g_* are given instead
        sums = {n: c for n, c in sums.items() if n.startswith("c_")}
    return prefix_sums(steps, sums, key=list(keys), pos=pos, block=4096)


def path_rmse(steps: DataFrame, keys: Sequence[str] = ("rec", "segment"),
              pos: str = "off") -> DataFrame:
    """Root mean square distance of two paths after taking out their means.

    ``steps`` has per window a predicted displacement m_x..m_z in the world and
    either true displacements t_x..t_z or true positions g_x..g_z. The result is
    the root of the summed variances of the coordinate differences.
    """
    run = _paths(steps, keys, pos)
    spread = sum((F.var_pop(F.col(f"c_{a}") - F.col(f"g_{a}")) for a in "xyz"), F.lit(0.0))
    return run.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_steps"),
                                  F.sqrt(spread + 1e-8).alias("path_rmse"))


def world_steps(windows: DataFrame, velocity: Sequence[str], quat: Sequence[str] = V.QUAT,
                dt: str = "dt") -> DataFrame:
    """Displacement m_* of each window: its velocity turned to the world, times dt."""
    turned = V.scale(V.matvec(V.quat_matrix(V.vec4(quat)), V.vec(*velocity)), F.col(dt))
    return windows.withColumns(V.as_columns(turned, ("m_x", "m_y", "m_z")))


def relative_error(steps: DataFrame, span: int = 5, keys: Sequence[str] = ("rec",),
                   pos: str = "win_idx") -> DataFrame:
    """Root mean square difference of predicted and true motion over ``span`` windows."""
    run = _paths(steps, keys, pos)

    def stage(w):
        return {f"e_{a}": (F.lead(f"c_{a}", span).over(w) - F.col(f"c_{a}"))
                - (F.lead(f"g_{a}", span).over(w) - F.col(f"g_{a}")) for a in "xyz"}
    out = apply_local(run, [stage], 0, span, key=list(keys), pos=pos, block=4096)
    e = V.vec("e_x", "e_y", "e_z")
    return out.groupBy(*keys).agg(F.count("e_x").alias("n_pairs"),
                                  F.sqrt(F.avg(V.dot(e, e))).alias("rte"))


# ---------------------------------------------------------------------- reports
def speed_bin(c: Column, edges: Sequence[float] = SPEED_EDGES) -> Column:
    """Lower edge of the speed bin [lo, hi); the last bin is open."""
    out = F.lit(None).cast("double")
    for lo in edges:
        out = F.when(c >= lo, F.lit(float(lo))).otherwise(out)
    return out


def speed_bin_report(errors: DataFrame, keys: Sequence[str] = ("tag",),
                     edges: Sequence[float] = SPEED_EDGES) -> DataFrame:
    """Windows, error and predicted / true speed ratio per true-speed bin."""
    return (errors.withColumn("bin", speed_bin(F.col("true_speed"), edges))
            .groupBy(*keys, "bin").agg(
                F.count(F.lit(1)).alias("n"), F.avg("err").alias("ave"),
                (F.avg("pred_speed") / F.avg("true_speed")).alias("ratio")))


def speed_weights(errors: DataFrame, cap: float, edges: Sequence[float] = SPEED_EDGES,
                  speed: str = "true_speed") -> DataFrame:
    """Loss weight per speed bin: rare bins up to ``cap``, common bins 1."""
    spark = errors.sparkSession
    all_bins = spark.createDataFrame([(float(e),) for e in edges], "bin double")
    counts = errors.groupBy(speed_bin(F.col(speed), edges).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    full = all_bins.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = full.agg(F.sum("n").alias("_all"))
    rate = F.col("_all") / len(edges) / F.greatest(F.col("n"), F.lit(1))
    return full.join(F.broadcast(total)).select("bin", "n", F.least(
        F.lit(float(cap)), F.greatest(F.lit(1.0), rate)).alias("weight"))


def class_report(errors: DataFrame, classes: DataFrame,
                 keys: Sequence[str] = ("tag",)) -> DataFrame:
    """Mean of recording errors per recording class."""
    per = errors.groupBy(*keys, "rec").agg(F.avg("err").alias("ave"))
    return per.join(classes.select("rec", "cls"), "rec").groupBy(*keys, "cls").agg(
        F.count(F.lit(1)).alias("n_rec"), F.avg("ave").alias("ave"))


def sprint_report(errors: DataFrame, sprint: Sequence, fast: float = 8.0) -> DataFrame:
    """One row per run: listed recordings side by side, their mean, and fast windows."""
    per = errors.groupBy("tag", "rec").agg(
        F.avg("err").alias("ave"),
        *[F.sum(F.when(F.col("true_speed") > fast, F.col(c))).alias(f"_s_{c}")
          for c in ("err", "pred_speed", "true_speed")],
        F.count_if(F.col("true_speed") > fast).alias("_n"))
    mine = F.col("rec").isin(list(sprint))
    n = F.sum("_n")
    return per.groupBy("tag").agg(
        *[F.max(F.when(F.col("rec") == r, F.col("ave"))).alias(f"ave_{r}") for r in sprint],
        F.avg(F.when(mine, F.col("ave"))).alias("sprint_mean"),
        (F.sum("_s_err") / n).alias("ave_fast"),
        (F.sum("_s_pred_speed") / F.sum("_s_true_speed")).alias("ratio_fast"),
        (F.sum(F.col("_s_pred_speed") - F.col("_s_true_speed")) / n).alias("radial_fast"),
        F.avg("ave").alias("fold_ave"))


def sweep_table(errors: DataFrame, ates: DataFrame, classes: DataFrame,
                expected: DataFrame | None = None,
                bins: Sequence[tuple[float, float]] = ((6, 8), (8, 10), (10, 99))) -> DataFrame:
    """One row per run: score, errors, speed ratios per bin, class errors.

    Runs whose window count differs from ``expected`` (column n) are left out.
    ``ates`` has tag, rec, ate.
    """
    if expected is not None:
        size = errors.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
        errors = errors.join(size.join(F.broadcast(expected), "n").select("tag"), "tag",
                             "left_semi")
    picks, label = [], lambda lo: f"{lo:g}".replace(".", "_")
    for lo, hi in bins:
        inside = (F.col("true_speed") >= lo) & (F.col("true_speed") < hi)
        picks += [F.sum(F.when(inside, F.col(c))).alias(f"_{c[:4]}_{label(lo)}")
                  for c in ("pred_speed", "true_speed")]
    per = (errors.groupBy("tag", "rec").agg(F.avg("err").alias("ave"), *picks)
           .join(ates, ["tag", "rec"]).join(classes.select("rec", "cls"), "rec"))
    return per.groupBy("tag").agg(
        score(F.avg("ave"), F.avg("ate")).alias("score"), F.avg("ave").alias("ave"),
        F.avg("ate").alias("ate"),
        *[(F.sum(f"_pred_{label(lo)}") / F.sum(f"_true_{label(lo)}")).alias(f"ratio_{label(lo)}")
          for lo, _ in bins],
        *[F.avg(F.when(F.col("cls") == c, F.col("ave"))).alias("ave_" + c.replace("-", "_"))
          for c in ("hi-rot", "fast")])


def tail_share(recs: DataFrame, k: int = 5, keys: Sequence[str] = ("tag",)) -> DataFrame:
    """The k worst recordings of a run and the share of all error they make up."""
    total = recs.groupBy(*keys).agg(F.sum("ave").alias("total_ave"))
    top = top_k(recs.select(*keys, "rec", "ave"), list(keys),
                [F.col("ave").desc(), F.col("rec")], k)
    run = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("tail_sum", F.sum("ave").over(run)).join(total, list(keys)).select(
        *keys, "rank", "rec", "ave", "tail_sum", (F.col("tail_sum") / F.col("total_ave"))
        .alias("tail_share"))


def run_change(recs: DataFrame, before: str, after: str,
               fractions: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Distribution of per-recording changes between two runs."""
    both = recs.where(F.col("tag").isin(before, after)).groupBy("rec").agg(
        F.max(F.when(F.col("tag") == before, F.col("ave"))).alias("_b"),
        F.max(F.when(F.col("tag") == after, F.col("ave"))).alias("_a"))
    delta = both.where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).select(
        (F.col("_a") - F.col("_b")).alias("change"))
    base = delta.agg(F.count(F.lit(1)).alias("n_rec"), F.avg("change").alias("mean_change"),
                     F.count_if(F.col("change") < 0).alias("improved"))
    return base.join(F.broadcast(percentiles(delta, [], {
        "change": (F.col("change"), list(fractions))})))


def seed_spread(overall: DataFrame, metric: str = "score") -> DataFrame:
    """Sample deviation and range over the seeds of each recipe."""
    return overall.groupBy(recipe_of("tag").alias("recipe")).agg(
        F.count(F.lit(1)).alias("n_seeds"), F.stddev_samp(metric).alias("sd"),
        (F.max(metric) - F.min(metric)).alias("spread"))


def paired_bootstrap(recs: DataFrame, before: str, after: str, replicates: int = 200,
                     seed: int = 0) -> DataFrame:
    """Bootstrap of the macro error change, paired by recording, per platform.

    Every recording gets a hash-seeded Poisson(1) weight in every replicate, so
    a replicate is one grouped sum; replicates are a bounded number of rows per
    recording, combined before the shuffle.
    """
    pairs = recs.groupBy("platform", "rec").agg(
        F.max(F.when(F.col("tag") == before, F.col("ave"))).alias("_b"),
        F.max(F.when(F.col("tag") == after, F.col("ave"))).alias("_a")).where(
        F.col("_a").isNotNull() & F.col("_b").isNotNull())
    drawn = pairs.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = drawn.withColumn("_w", poisson_weight(seed, "replicate", "platform", "rec"))
    per = drawn.groupBy("replicate", "platform").agg(
        F.sum("_w").alias("_n"), F.sum(F.col("_w") * (F.col("_a") - F.col("_b"))).alias("_d"))
    return per.where(F.col("_n") > 0).groupBy("replicate").agg(
        F.avg(F.col("_d") / F.col("_n")).alias("change"))


def poisson_weight(seed: int, *keys: str) -> Column:
    """Poisson(1) count from one hash uniform (inverse of its distribution)."""
    import math
    from sensorframe.operators.sampling import hash_uniform
    u = hash_uniform(seed, *keys)
    total, out, i = 0.0, F.lit(0), 0
    while 1.0 - total > 2.0 ** -52 and i < 30:  # what lies beyond is finer than the uniform's steps
        total += math.exp(-1.0) / math.factorial(i)
        out = out + (u >= total).cast("int")
        i += 1
    return out


def bootstrap_interval(replicated: DataFrame) -> DataFrame:
    """Share of replicates that improve, and the central 95 %."""
    q = percentiles(replicated, [], {"change": (F.col("change"), [0.025, 0.5, 0.975])})
    return replicated.agg(F.count(F.lit(1)).alias("n_replicates"), F.avg(
        (F.col("change") < 0).cast("double")).alias("improved_share")).join(F.broadcast(q))


def run_decision(recs: DataFrame, before: str, after: str, replicates: int = 200, seed: int = 0,
                 factor: float = 2.0) -> DataFrame:
    """Whether recipe ``after`` replaces ``before``: one row with the change, its spread and ``decision``.

    ``recs`` has tag, platform, rec, ave of the runs of all recipes. A recording's
    error is averaged over a recipe's seeds; the macro change (platforms alike) is
    bootstrapped by recording inside platforms. The threshold is ``factor`` times
    the spread that recordings and seeds make together, where the variance of
    seeds is pooled over all recipes: sqrt(sd_boot^2 + sd_seed^2 (1 / n_before +
    1 / n_after)). ``accept``: better by more than the threshold and the whole
    central 95 % of replicates better; ``reject``: worse by more than it;
    otherwise ``more seeds``.
    """
    named = recs.withColumn("recipe", recipe_of("tag"))
    mean = named.groupBy(F.col("recipe").alias("tag"), "platform", "rec").agg(F.avg("ave").alias("ave"))
    drawn = cut_lineage(paired_bootstrap(mean, before, after, replicates, seed))
    spread = drawn.agg(F.stddev_samp("change").alias("sd_boot"))
    part = mean.groupBy("platform", "rec").agg(*[F.max(F.when(F.col("tag") == t, F.col("ave"))).alias(c)
                                                 for t, c in ((before, "_b"), (after, "_a"))])
    change = part.groupBy("platform").agg(F.avg(F.col("_a") - F.col("_b")).alias("_d")).agg(F.avg("_d").alias("change"))
    runs = (named.groupBy("recipe", "tag", "platform").agg(F.avg("ave").alias("_p"))
            .groupBy("recipe", "tag").agg(F.avg("_p").alias("_m")))
    seeds = runs.groupBy("recipe").agg(F.count(F.lit(1)).alias("_n"), F.var_samp("_m").alias("_v"))
    several = F.col("_n") > 1
    pooled = seeds.agg(
        F.sqrt(F.sum(F.when(several, (F.col("_n") - 1) * F.col("_v"))) / F.sum(F.when(several, F.col("_n") - 1))).alias("sd_seed"),
        *[F.max(F.when(F.col("recipe") == t, F.col("_n"))).alias(c) for t, c in ((before, "n_before"), (after, "n_after"))])
    row = bootstrap_interval(drawn).join(F.broadcast(spread)).join(F.broadcast(change)).join(F.broadcast(pooled))
    noise = F.pow("sd_boot", F.lit(2.0)) + F.pow("sd_seed", F.lit(2.0)) * (1 / F.col("n_before") + 1 / F.col("n_after"))
    row = row.withColumn("threshold", factor * F.sqrt(noise))
    verdict = (F.when((F.col("change") < -F.col("threshold")) & (F.col("change_p97_5") < 0), "accept")
               .when(F.col("change") > F.col("threshold"), "reject").otherwise("more seeds"))
    return row.withColumn("decision", verdict)


def metric_line(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Straight line between two metrics with its fit."""
    return pairs.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                     F.regr_r2(y, x).alias("r2"))


def board_mix(public: Column, private: Column, share: float = 0.4632) -> Column:
    """Full-set score from the two board scores."""
    return share * public + (1 - share) * private


def prediction_difference(a: DataFrame, b: DataFrame,
                          keys: Sequence[str] = ("rec", "win_idx")) -> DataFrame:
    """Mean, p99 and largest component difference of two prediction tables."""
    other = b.select(*keys, *[F.col(c).alias(f"o_{c}") for c in V.VEL])
    gap = a.join(other, list(keys)).select(F.explode(F.array(*[
        F.abs(F.col(c) - F.col(f"o_{c}")) for c in V.VEL])).alias("gap"))
    return gap.agg(F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap")).join(
        F.broadcast(percentiles(gap, [], {"gap": (F.col("gap"), [0.99])})))


def estimator_duel(table: DataFrame, masked: Column, margin: float = 0.0,
                   direct: Sequence[str] = PRED,
                   other: Sequence[str] = ("p_x", "p_y", "p_z")) -> DataFrame:
    """How often a second estimate beats the direct one, split by a mask."""
    t = V.vec(*TRUE)
    rated = table.select(masked.alias("masked"), V.norm(V.sub(V.vec(*direct), t)).alias("ed"),
                         V.norm(V.sub(V.vec(*other), t)).alias("ep"))
    wins = F.avg((F.col("ed") >= F.col("ep") + margin).cast("double"))
    base = rated.groupBy("masked").agg(F.count(F.lit(1)).alias("n"), wins.alias("other_better"),
                                       F.avg("ed").alias("direct_err"),
                                       F.avg("ep").alias("other_err"))
    return base.join(percentiles(rated, ["masked"], {"other": (F.col("ep"), [0.99])}), "masked")


def error_by_distance(errors: DataFrame, away: str = "away", edges=(10, 20),
                      keys: Sequence[str] = ("rec",)) -> DataFrame:
    """Mean error by windows since the anchor: first, second and later stretch."""
    a = F.col(away)
    lo, hi = edges
    return errors.groupBy(*keys).agg(
        F.avg(F.when(a < lo, F.col("err"))).alias("err_near"),
        F.avg(F.when((a >= lo) & (a < hi), F.col("err"))).alias("err_mid"),
        F.avg(F.when(a >= hi, F.col("err"))).alias("err_far"))


def tilt_report(frames: DataFrame, estimate: Sequence[str], truth: Sequence[str],
                limit: float = 5.0) -> DataFrame:
    """Median and p90 tilt error per recording with the share above a limit."""
    rated = frames.select("rec", V.angle_deg(V.vec(*estimate), V.vec(*truth)).alias("tilt"))
    share = rated.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.avg("tilt").alias("tilt_mean"),
                                     F.count_if(F.col("tilt") > limit).alias("n_above"))
    return share.join(percentiles(rated, ["rec"], {"tilt": (F.col("tilt"), [0.5, 0.9])}), "rec")


def tilt_overview(per_rec: DataFrame, metric: str = "tilt_p50", limit: float = 5.0) -> DataFrame:
    """Mean, median and count above a limit over recordings."""
    return per_rec.agg(F.count(F.lit(1)).alias("n_rec"), F.avg(metric).alias("mean"),
                       F.count_if(F.col(metric) > limit).alias("n_above")).join(
        F.broadcast(percentiles(per_rec, [], {"overall": (F.col(metric), [0.5])})))


def family_medians(table: DataFrame, metrics: Sequence[str], family: str = "family") -> DataFrame:
    """Exact median of each metric and the number of recordings per family."""
    return table.groupBy(family).agg(F.count(F.lit(1)).alias("n_rec")).join(
        percentiles(table, [family], {m: (F.col(m), [0.5]) for m in metrics}), family)


def scale_sensitivity(speeds: DataFrame, base: float = 1.0, raised: float = 1.5) -> DataFrame:
    """p90 and largest speed per scale, and the ratio of two scales' p90."""
    per = percentiles(speeds, ["rec", "scale"], {"speed": (F.col("speed"), [0.9])}).join(
        speeds.groupBy("rec", "scale").agg(F.max("speed").alias("speed_max")), ["rec", "scale"])
    ratio = per.groupBy("rec").agg(
        (F.max(F.when(F.col("scale") == raised, F.col("speed_p90")))
         / F.max(F.when(F.col("scale") == base, F.col("speed_p90")))).alias("sensitivity"))
    return per.join(ratio, "rec")


def zero_prediction(truth: DataFrame) -> DataFrame:
    return truth.withColumns({c: F.lit(0.0) for c in PRED})


def truth_prediction(truth: DataFrame) -> DataFrame:
    return truth.withColumns({p: F.col(t) for p, t in zip(PRED, TRUE)})


def solution_summary(solution: DataFrame) -> DataFrame:
    """Windows, recordings and mean window time per platform."""
    per = solution.groupBy("platform", "rec").agg(F.count(F.lit(1)).alias("_n"),
                                                  F.sum("dt").alias("_t"))
    return per.groupBy("platform").agg(F.sum("_n").alias("windows"),
                                       F.count(F.lit(1)).alias("recordings"),
                                       (F.sum("_t") / F.sum("_n")).alias("dt_mean"))


def masked_huber(table: DataFrame, valid: Column, beta: float = 0.25) -> DataFrame:
    """Mean vector Huber loss over valid windows (0 when none is valid)."""
    loss = V.vector_huber(V.vec(*PRED), V.vec(*TRUE), beta)
    return table.agg((F.coalesce(F.sum(F.when(valid, loss)), F.lit(0.0))
                      / F.greatest(F.count_if(valid), F.lit(1))).alias("huber"),
                     F.count_if(valid).alias("n_valid"))
