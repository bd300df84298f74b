"""Queries: scores, reports and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe.functions import vec as V
from sensorframe.operators import relational as R
from sensorframe.operators import summary as S
from sensorframe.operators import windows as W
from sensorframe.operators.blocks import percentiles
from sensorframe.plans import evaluation as E
from sensorframe.plans import sweep
from sensorframe.session import write_once
from sensorframe.sources.views import sensor_view, with_platform
from workload import inputs as I
from workload import sql as Q
from workload.registry import query

EDGES = (0.0, 2.2, 2.4, 2.6, 2.8, 3.0)
_BIN = ("CASE WHEN true_speed >= 3.0 THEN 3.0 WHEN true_speed >= 2.8 THEN 2.8 "
        "WHEN true_speed >= 2.6 THEN 2.6 WHEN true_speed >= 2.4 THEN 2.4 "
        "WHEN true_speed >= 2.2 THEN 2.2 ELSE 0.0 END")
_SCORE = "0.6 * ave / 0.7356 + 0.4 * ate / 3.1160"


@query("window_targets", "rec:bigint win_idx:int", "vx vy vz",
       f"{Q.WINDOWS} SELECT rec, win_idx, vx, vy, vz FROM wm")
def window_targets(spark, d):
    return W.window_targets(sensor_view(spark, d), I.RIG)


@query("rest_scores", "rec:bigint win_idx:int", "score fx fy fz",
       f"{Q.BASE}, {Q.SCORES} SELECT * FROM sc")
def rest_scores(spark, d):
    return W.rest_scores(sensor_view(spark, d), I.RIG)


@query("rest_anchor", "rec:bigint anchor_win:int", "score fx fy fz", f"{Q.REST} SELECT * FROM an")
def rest_anchor(spark, d):
    return W.rest_anchor(sensor_view(spark, d), I.RIG)


@query("vector_rest_anchor", "rec:bigint anchor_win:int", "score fx fy fz",
       f"WITH {Q.VECTOR}, {Q.SCORES.replace('/ 50', '/ 10').replace('= 50', '= 10').replace('sv', 'vv')}, {Q.ANCHOR} SELECT * FROM an")
def vector_rest_anchor(spark, d):
    from sensorframe.sources.views import VECTOR_RIG, vector_view
    return W.rest_anchor(vector_view(spark, d), VECTOR_RIG)


@query("recording_ave", "tag:string platform:string rec:bigint n_win:bigint", "ave",
       f"{Q.EVAL} SELECT tag, platform, rec, count(*) AS n_win, avg(err) AS ave FROM er GROUP BY 1, 2, 3")
def recording_ave(spark, d):
    return E.recording_ave(I.errors(spark, d))


@query("unmatched_predictions", "rec:bigint win_idx:int", "vx_gt vx_pred",
       f"""{Q.WINDOWS} SELECT rec, win_idx, vx AS vx_gt,
       CASE WHEN win_idx % 3 <> 0 THEN vx * 1.1 END AS vx_pred FROM wm""")
def unmatched_predictions(spark, d):
    """Left join keeps windows a run did not predict."""
    t = I.truth(spark, d)
    pred = t.where(F.col("win_idx") % 3 != 0).withColumns({c: F.col(c) * 1.1 for c in V.VEL})
    gt = t.withColumnsRenamed({c: f"{c}_gt" for c in V.VEL})
    return R.with_prediction(gt, pred, "left", ("rec", "win_idx"))


def _platforms(spark, d):
    m = I.stored_matched(spark, d)
    recs = E.recording_ave(I.errors(spark, d, m)).join(
        I.path_errors(spark, d, m), ["tag", "platform", "rec"])
    return E.platform_scores(recs)


_PLAT = f"""{Q.EVAL}, {Q.PATHS},
ps AS (SELECT tag, platform, count(*) AS n_rec, avg(ave) AS ave, avg(ate) AS ate
FROM (SELECT tag, platform, rec, avg(err) AS ave FROM er GROUP BY 1, 2, 3)
JOIN pe USING (tag, platform, rec) GROUP BY 1, 2),
pz AS MATERIALIZED (SELECT *, {_SCORE} AS score FROM ps)"""


@query("path_rmse", "tag:string platform:string rec:bigint n_steps:bigint", "ate",
       f"{Q.EVAL}, {Q.PATHS} SELECT * FROM pe")
def path_rmse(spark, d):
    return I.path_errors(spark, d)


@query("platform_scores", "tag:string platform:string n_rec:bigint", "ate ave score",
       f"{_PLAT} SELECT * FROM pz")
def platform_scores(spark, d):
    return _platforms(spark, d)


@query("macro_score", "tag:string", "score ate ave",
       f"{_PLAT} SELECT tag, avg(score) AS score, avg(ate) AS ate, avg(ave) AS ave FROM pz GROUP BY tag")
def macro_score(spark, d):
    return E.macro_score(_platforms(spark, d))


@query("score_share", "tag:string platform:string", "share",
       f"{_PLAT} SELECT tag, platform, score / sum(score) OVER (PARTITION BY tag) AS share FROM pz")
def score_share(spark, d):
    return E.score_share(_platforms(spark, d))


@query("relative_error", "tag:string rec:bigint n_pairs:bigint", "rte", f"""{Q.EVAL}, {Q.PATHS},
d5 AS (SELECT tag, rec, (lead(cx, 5) OVER w - cx) - (lead(gx, 5) OVER w - gx) AS ex,
       (lead(cy, 5) OVER w - cy) - (lead(gy, 5) OVER w - gy) AS ey,
       (lead(cz, 5) OVER w - cz) - (lead(gz, 5) OVER w - gz) AS ez
FROM st WINDOW w AS (PARTITION BY tag, rec ORDER BY win_idx))
SELECT tag, rec, count(ex) AS n_pairs, sqrt(avg(ex*ex + ey*ey + ez*ez)) AS rte
FROM d5 GROUP BY tag, rec""")
def relative_error(spark, d):
    return E.relative_error(I.steps(spark, d), 5, ("tag", "rec"))


@query("speed_bin_report", "tag:string n:bigint", "bin ave ratio",
       f"""{Q.EVAL} SELECT tag, {_BIN} AS bin, count(*) AS n, avg(err) AS ave,
       avg(pred_speed) / avg(true_speed) AS ratio FROM er GROUP BY 1, 2""")
def speed_bin_report(spark, d):
    return E.speed_bin_report(I.errors(spark, d), edges=EDGES)


@query("speed_weights", "n:bigint", "bin weight",
       f"""{Q.EVAL}, bc AS (SELECT {_BIN} AS bin, count(*) AS n FROM er GROUP BY 1),
b0 AS (SELECT * FROM (VALUES (0.0), (2.2), (2.4), (2.6), (2.8), (3.0)) AS b(bin))
SELECT b0.bin, coalesce(n, 0) AS n, least(4.0, greatest(1.0,
       (SELECT sum(n) FROM bc) / 6 / greatest(coalesce(n, 0), 1))) AS weight
FROM b0 LEFT JOIN bc ON b0.bin = bc.bin""")
def speed_weights(spark, d):
    return E.speed_weights(I.errors(spark, d), 4.0, EDGES)


_CLASSES = """cl AS MATERIALIZED (SELECT rec, avg(sqrt(wx*wx + wy*wy + wz*wz)) AS gm,
       quantile_cont(sqrt(vx*vx + vy*vy + vz*vz), 0.9) AS sp FROM sv GROUP BY rec),
cls AS MATERIALIZED (SELECT rec, CASE WHEN gm * 5 > 1.5 THEN 'hi-rot' WHEN sp * 1.25 > 6 THEN 'fast'
       ELSE 'rest' END AS cls FROM cl)"""


def _classes(spark, d, f=None):
    f = I.stored_frames(spark, d) if f is None else f
    rate = f.groupBy("rec").agg(F.avg(V.norm(V.vec(*V.GYR))).alias("gm"))
    sp = percentiles(f, ["rec"], {"sp": (V.norm(V.vec(*V.VEL)), [0.9])})
    return rate.join(sp, "rec").select(
        "rec", R.recording_class(F.col("gm") * 5, F.col("sp_p90") * 1.25).alias("cls"))


@query("recording_class", "rec:bigint cls:string", "", f"{Q.BASE}, {_CLASSES} SELECT rec, cls FROM cls")
def recording_class(spark, d):
    return _classes(spark, d)


@query("class_report", "tag:string cls:string n_rec:bigint", "ave",
       f"""{Q.EVAL}, {_CLASSES} SELECT tag, cls, count(*) AS n_rec, avg(ave) AS ave
FROM (SELECT tag, rec, avg(err) AS ave FROM er GROUP BY 1, 2) JOIN cls USING (rec) GROUP BY 1, 2""")
def class_report(spark, d):
    return E.class_report(I.errors(spark, d), _classes(spark, d))


@query("sprint_report", "tag:string",
       "ave_1 ave_2 ave_3 sprint_mean ave_fast ratio_fast radial_fast fold_ave",
       f"""{Q.EVAL}, pr AS (SELECT tag, rec, avg(err) AS ave FROM er GROUP BY 1, 2)
SELECT tag, max(ave) FILTER (rec = 1) AS ave_1, max(ave) FILTER (rec = 2) AS ave_2,
       max(ave) FILTER (rec = 3) AS ave_3, avg(ave) FILTER (rec IN (1, 2, 3)) AS sprint_mean,
       any_value(ave_fast) AS ave_fast, any_value(ratio_fast) AS ratio_fast,
       any_value(radial_fast) AS radial_fast, avg(ave) AS fold_ave
FROM pr JOIN (SELECT tag, avg(err) AS ave_fast, avg(pred_speed) / avg(true_speed) AS ratio_fast,
              avg(pred_speed - true_speed) AS radial_fast FROM er WHERE true_speed > 2.7
              GROUP BY tag) USING (tag) GROUP BY tag""")
def sprint_report(spark, d):
    return E.sprint_report(I.errors(spark, d), [1, 2, 3], fast=2.7)


@query("sweep_table", "tag:string",
       "score ave ate ratio_2_2 ratio_2_4 ratio_2_6 ave_hi_rot ave_fast",
       f"""{Q.EVAL}, {Q.PATHS}, {_CLASSES},
pr AS (SELECT tag, rec, avg(err) AS ave FROM er GROUP BY 1, 2),
bi AS (SELECT tag, avg(pred_speed) FILTER (true_speed >= 2.2 AND true_speed < 2.4)
       / avg(true_speed) FILTER (true_speed >= 2.2 AND true_speed < 2.4) AS r1,
       avg(pred_speed) FILTER (true_speed >= 2.4 AND true_speed < 2.6)
       / avg(true_speed) FILTER (true_speed >= 2.4 AND true_speed < 2.6) AS r2,
       avg(pred_speed) FILTER (true_speed >= 2.6 AND true_speed < 99)
       / avg(true_speed) FILTER (true_speed >= 2.6 AND true_speed < 99) AS r3 FROM er GROUP BY tag)
SELECT tag, 0.6 * avg(ave) / 0.7356 + 0.4 * avg(ate) / 3.1160 AS score, avg(ave) AS ave,
       avg(ate) AS ate, any_value(r1) AS ratio_2_2, any_value(r2) AS ratio_2_4,
       any_value(r3) AS ratio_2_6, avg(ave) FILTER (cls = 'hi-rot') AS ave_hi_rot,
       avg(ave) FILTER (cls = 'fast') AS ave_fast
FROM pr JOIN pe USING (tag, rec) JOIN cls USING (rec) JOIN bi USING (tag) GROUP BY tag""")
def sweep_table(spark, d):
    m = I.stored_matched(spark, d)
    n = m.where(F.col("tag") == "alpha_s1").agg(F.count(F.lit(1)).alias("n"))
    return E.sweep_table(I.errors(spark, d, m), I.path_errors(spark, d, m).select("tag", "rec", "ate"),
                         _classes(spark, d), n, ((2.2, 2.4), (2.4, 2.6), (2.6, 99)))


@query("tail_share", "tag:string rank:int rec:bigint", "ave tail_sum tail_share", f"""{Q.EVAL},
pr AS (SELECT tag, rec, round(avg(err), 9) AS ave FROM er GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY ave DESC, rec) AS rank,
       sum(ave) OVER (PARTITION BY tag) AS total FROM pr)
SELECT tag, rank, rec, ave, sum(ave) OVER (PARTITION BY tag ORDER BY rank) AS tail_sum,
       sum(ave) OVER (PARTITION BY tag ORDER BY rank) / total AS tail_share
FROM rk WHERE rank <= 5""")
def tail_share(spark, d):
    recs = E.recording_ave(I.errors(spark, d), ("tag", "rec"))
    return E.tail_share(recs.withColumn("ave", F.round("ave", 9)), 5)


@query("run_change", "n_rec:bigint improved:bigint", "mean_change change_p10 change_p50 change_p90",
       f"""{Q.EVAL}, pr AS (SELECT tag, rec, avg(err) AS ave FROM er GROUP BY 1, 2),
dl AS (SELECT a.ave - b.ave AS c FROM pr a JOIN pr b USING (rec)
       WHERE a.tag = 'beta_s2' AND b.tag = 'beta_s1')
SELECT count(*) AS n_rec, sum((c < 0)::INT) AS improved, avg(c) AS mean_change,
       quantile_cont(c, 0.1) AS change_p10, quantile_cont(c, 0.5) AS change_p50,
       quantile_cont(c, 0.9) AS change_p90 FROM dl""")
def run_change(spark, d):
    return E.run_change(E.recording_ave(I.errors(spark, d), ("tag", "rec")), "beta_s1", "beta_s2")


@query("seed_spread", "recipe:string n_seeds:bigint", "sd spread",
       f"""{_PLAT}, ov AS (SELECT tag, avg(score) AS score FROM pz GROUP BY tag)
SELECT regexp_replace(tag, '_s[0-9]+$', '') AS recipe, count(*) AS n_seeds,
       stddev_samp(score) AS sd, max(score) - min(score) AS spread FROM ov GROUP BY 1""")
def seed_spread(spark, d):
    return E.seed_spread(E.macro_score(_platforms(spark, d)))


_POISSON = " + ".join(f"(u >= {c!r})::INT" for c in __import__("itertools").accumulate(
    __import__("math").exp(-1.0) / __import__("math").factorial(i) for i in range(12)))


@query("paired_bootstrap", "replicate:int", "change", f"""{Q.EVAL},
pr AS (SELECT platform, rec, avg(err) FILTER (tag = 'beta_s2') - avg(err) FILTER (tag = 'beta_s1')
       AS c FROM er GROUP BY 1, 2),
dr AS (SELECT replicate, platform, c, {Q.uniform('0', 'replicate', 'platform', 'rec')} AS u
       FROM pr CROSS JOIN range(50) AS t(replicate)),
wt AS (SELECT replicate, platform, sum({_POISSON}) AS n, sum(({_POISSON}) * c) AS s
       FROM dr GROUP BY 1, 2)
SELECT replicate, avg(s / n) AS change FROM wt WHERE n > 0 GROUP BY replicate""")
def paired_bootstrap(spark, d):
    recs = E.recording_ave(I.errors(spark, d), ("tag", "platform", "rec"))
    return E.paired_bootstrap(recs, "beta_s1", "beta_s2", 50)


@query("run_decision", "decision:string n_replicates:bigint n_before:bigint n_after:bigint",
       "change sd_boot sd_seed threshold improved_share change_p2_5 change_p97_5", f"""{Q.EVAL},
mr AS (SELECT regexp_replace(tag, '_s[0-9]+$', '') AS recipe, platform, rec, avg(a) AS a
       FROM (SELECT tag, platform, rec, avg(err) AS a FROM er GROUP BY 1, 2, 3) GROUP BY 1, 2, 3),
pr AS MATERIALIZED (SELECT platform, rec, max(a) FILTER (recipe = 'beta') - max(a) FILTER (recipe = 'alpha') AS c FROM mr GROUP BY 1, 2),
dr AS (SELECT replicate, platform, c, {Q.uniform('0', 'replicate', 'platform', 'rec')} AS u FROM pr CROSS JOIN range(40) AS t(replicate)),
wt AS (SELECT replicate, platform, sum({_POISSON}) AS n, sum(({_POISSON}) * c) AS s FROM dr GROUP BY 1, 2),
bo AS MATERIALIZED (SELECT replicate, avg(s / n) AS change FROM wt WHERE n > 0 GROUP BY replicate),
ru AS (SELECT tag, avg(p) AS m FROM (SELECT tag, platform, avg(a) AS p FROM (SELECT tag, platform, rec, avg(err) AS a FROM er GROUP BY 1, 2, 3)
       GROUP BY 1, 2) GROUP BY tag),
se AS (SELECT regexp_replace(tag, '_s[0-9]+$', '') AS recipe, count(*) AS n, var_samp(m) AS v FROM ru GROUP BY 1),
al AS (SELECT (SELECT avg(d) FROM (SELECT avg(c) AS d FROM pr GROUP BY platform)) AS change,
       (SELECT stddev_samp(change) FROM bo) AS sd_boot, (SELECT count(*) FROM bo) AS n_replicates,
       (SELECT avg((change < 0)::INT) FROM bo) AS improved_share, (SELECT quantile_cont(change, 0.025) FROM bo) AS change_p2_5,
       (SELECT quantile_cont(change, 0.975) FROM bo) AS change_p97_5, (SELECT sqrt(sum((n - 1) * v) / sum(n - 1)) FROM se WHERE n > 1) AS sd_seed,
       (SELECT n FROM se WHERE recipe = 'alpha') AS n_before, (SELECT n FROM se WHERE recipe = 'beta') AS n_after),
th AS (SELECT *, 2 * sqrt(sd_boot * sd_boot + sd_seed * sd_seed * (1.0::DOUBLE / n_before + 1.0::DOUBLE / n_after)) AS threshold FROM al)
SELECT CASE WHEN change < -threshold AND change_p97_5 < 0 THEN 'accept' WHEN change > threshold THEN 'reject' ELSE 'more seeds' END AS decision,
       n_replicates, n_before, n_after, change, sd_boot, sd_seed, threshold, improved_share, change_p2_5, change_p97_5 FROM th""")
def run_decision(spark, d):
    """Recipe beta against alpha, two seeds each."""
    recs = E.recording_ave(I.errors(spark, d, I.stored_matched(spark, d)), ("tag", "platform", "rec"))
    return E.run_decision(recs, "alpha", "beta", 40)


_JUDGED = "(tag LIKE 'alpha%' AND rec % 2 = 0 OR tag = 'beta_s1' AND rec % 2 = 1)"


@query("sweep_from_files", "tag:string fold:string", "score ave ate ratio_2_2 ratio_2_4 ratio_2_6 ave_hi_rot ave_fast",
       f"""{Q.EVAL}, {Q.PATHS}, {_CLASSES},
pr AS (SELECT tag, rec, avg(err) AS ave FROM er WHERE {_JUDGED} GROUP BY 1, 2),
bi AS (SELECT tag, {', '.join(f"avg(pred_speed) FILTER (true_speed >= {a} AND true_speed < {b}) / avg(true_speed) FILTER (true_speed >= {a} AND true_speed < {b}) AS r{i}"
                              for i, (a, b) in enumerate(((2.2, 2.4), (2.4, 2.6), (2.6, 99))))} FROM er WHERE {_JUDGED} GROUP BY tag)
SELECT tag, CASE WHEN tag LIKE 'alpha%' THEN 'fold_one' ELSE 'fold_two' END AS fold,
       0.6 * avg(ave) / 0.7356 + 0.4 * avg(ate) / 3.1160 AS score, avg(ave) AS ave, avg(ate) AS ate, any_value(r0) AS ratio_2_2,
       any_value(r1) AS ratio_2_4, any_value(r2) AS ratio_2_6, avg(ave) FILTER (cls = 'hi-rot') AS ave_hi_rot, avg(ave) FILTER (cls = 'fast') AS ave_fast
FROM pr JOIN pe USING (tag, rec) JOIN cls USING (rec) JOIN bi USING (tag) GROUP BY tag""")
def sweep_from_files(spark, d):
    """Files of four runs to one table; the run that lacks windows is left out, each is judged on its own fold."""
    from workload.jobs import _run_files
    f = I.stored_frames(spark, d)
    windows = write_once(with_platform(I.truth(spark, d, f), spark, d), "windows")
    truth = windows.withColumn("window_id", F.format_string("w%d_%d", "rec", "win_idx"))
    held = truth.select(F.when(F.col("rec") % 2 == 0, "fold_one").otherwise("fold_two").alias("fold"), "rec").distinct()
    return sweep.sweep_from_files(spark, [_run_files(spark, d, windows) + "/*"], r"tag=([^/]+)/", truth.withColumnsRenamed(
        {c: f"{c}_gt" for c in V.VEL}), {"alpha": "fold_one", "beta": "fold_two"}, held, _classes(spark, d, f), ((2.2, 2.4), (2.4, 2.6), (2.6, 99)))


def _turned_sql(angle, name, out):
    return (f"(cos({angle}) * vx_{name} - sin({angle}) * vy_{name}) * 0.5 AS {out}x, "
            f"(sin({angle}) * vx_{name} + cos({angle}) * vy_{name}) * 0.5 AS {out}y, vz_{name} * 0.5 AS {out}z")


@query("world_path_rmse", "tag:string rec:bigint n_steps:bigint", "path_rmse", f"""{Q.EVAL},
wd AS (SELECT tag, rec, win_idx, {_turned_sql('0.1 * win_idx + 0.04', 'pred', 'm')}, {_turned_sql('0.1 * win_idx', 'gt', 't')} FROM mt),
ws AS (SELECT tag, rec, {', '.join(f"sum(m{c}) OVER w - sum(t{c}) OVER w AS e{c}" for c in 'xyz')}
       FROM wd WINDOW w AS (PARTITION BY tag, rec ORDER BY win_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT tag, rec, count(*) AS n_steps, sqrt(var_pop(ex) + var_pop(ey) + var_pop(ez) + 1e-8) AS path_rmse FROM ws GROUP BY 1, 2""")
def world_path_rmse(spark, d):
    """Path error in the world: windows of half a second under a turning attitude whose estimate is off by a constant angle."""
    half, zero = F.col("win_idx") * 0.05, F.lit(0.0)
    quats = {f"{p}{c}": e for p, h in (("e", half + 0.02), ("g", half))
             for c, e in zip(("qx", "qy", "qz", "qw"), (zero, zero, F.sin(h), F.cos(h)))}
    m = I.stored_matched(spark, d).withColumns({**quats, "dt": F.lit(0.5)})
    names = lambda p: [f"{p}{c}" for c in ("qx", "qy", "qz", "qw")]
    true = E.world_steps(m, [f"{c}_gt" for c in V.VEL], names("g")).withColumnsRenamed({f"m_{a}": f"t_{a}" for a in "xyz"})
    return E.path_rmse(E.world_steps(true, [f"{c}_pred" for c in V.VEL], names("e")), ["tag", "rec"], "win_idx")


@query("metric_line", "", "slope intercept r2", f"""{Q.EVAL}, {Q.PATHS},
pr AS (SELECT tag, rec, avg(err) AS ave FROM er GROUP BY 1, 2)
SELECT regr_slope(ate, ave) AS slope, regr_intercept(ate, ave) AS intercept,
       regr_r2(ate, ave) AS r2 FROM pr JOIN pe USING (tag, rec)""")
def metric_line(spark, d):
    m = I.stored_matched(spark, d)
    recs = E.recording_ave(I.errors(spark, d, m), ("tag", "rec")).join(
        I.path_errors(spark, d, m).select("tag", "rec", "ate"), ["tag", "rec"])
    return E.metric_line(recs, "ave", "ate")


@query("board_mix", "recipe:string", "mixed", f"""{_PLAT},
ov AS (SELECT tag, avg(score) AS score FROM pz GROUP BY tag)
SELECT regexp_replace(tag, '_s[0-9]+$', '') AS recipe,
       0.4632 * max(score) FILTER (tag LIKE '%_s1') + (1 - 0.4632) * max(score) FILTER (tag LIKE '%_s2')
       AS mixed FROM ov GROUP BY 1""")
def board_mix(spark, d):
    o = E.macro_score(_platforms(spark, d)).groupBy(R.recipe_of("tag").alias("recipe")).agg(
        F.max(F.when(R.seed_of("tag") == 1, F.col("score"))).alias("a"),
        F.max(F.when(R.seed_of("tag") == 2, F.col("score"))).alias("b"))
    return o.select("recipe", E.board_mix(F.col("a"), F.col("b")).alias("mixed"))


@query("prediction_difference", "", "mean_gap max_gap gap_p99", f"""{Q.EVAL},
a AS (SELECT * FROM mt WHERE tag = 'alpha_s1'), b AS (SELECT * FROM mt WHERE tag = 'alpha_s2'),
g AS (SELECT unnest([abs(a.vx_pred - b.vx_pred), abs(a.vy_pred - b.vy_pred),
       abs(a.vz_pred - b.vz_pred)]) AS gap FROM a JOIN b USING (rec, win_idx))
SELECT avg(gap) AS mean_gap, max(gap) AS max_gap, quantile_cont(gap, 0.99) AS gap_p99 FROM g""")
def prediction_difference(spark, d):
    m = I.stored_matched(spark, d)
    pick = lambda t: m.where(F.col("tag") == t).select(
        "rec", "win_idx", *[F.col(f"{c}_pred").alias(c) for c in V.VEL])
    return E.prediction_difference(pick("alpha_s1"), pick("alpha_s2"))


@query("estimator_duel", "masked:boolean n:bigint", "other_better direct_err other_err other_p99",
       f"""{Q.EVAL}, a AS (SELECT * FROM er WHERE tag = 'alpha_s1'),
b AS (SELECT rec, win_idx, err AS ep FROM er WHERE tag = 'beta_s2'),
r AS (SELECT a.win_idx % 4 = 0 AS masked, a.err AS ed, ep FROM a JOIN b USING (rec, win_idx))
SELECT masked, count(*) AS n, avg(CASE WHEN ed >= ep + 0.01 THEN 1.0 ELSE 0.0 END) AS other_better,
       avg(ed) AS direct_err, avg(ep) AS other_err, quantile_cont(ep, 0.99) AS other_p99
FROM r GROUP BY masked""")
def estimator_duel(spark, d):
    m = I.stored_matched(spark, d)
    other = m.where(F.col("tag") == "beta_s2").select(
        "rec", "win_idx", *[F.col(f"v{a}_pred").alias(f"p_{a}") for a in "xyz"])
    both = m.where(F.col("tag") == "alpha_s1").join(other, ["rec", "win_idx"])
    return E.estimator_duel(both, F.col("win_idx") % 4 == 0, 0.01)


@query("error_by_distance", "rec:bigint tag:string", "err_near err_mid err_far", f"""{Q.EVAL},
{Q.SCORES}, {Q.ANCHOR}, aw AS (SELECT er.rec, tag, err, abs(win_idx - anchor_win) AS away
FROM er JOIN an ON er.rec = an.rec)
SELECT rec, tag, avg(err) FILTER (away < 2) AS err_near, avg(err) FILTER (away >= 2 AND away < 5)
       AS err_mid, avg(err) FILTER (away >= 5) AS err_far FROM aw GROUP BY rec, tag""")
def error_by_distance(spark, d):
    e = I.errors(spark, d)
    a = W.rest_anchor(sensor_view(spark, d), I.RIG).select("rec", "anchor_win")
    away = e.join(a, "rec").withColumn("away", F.abs(F.col("win_idx") - F.col("anchor_win")))
    return E.error_by_distance(away, edges=(2, 5), keys=("rec", "tag"))


_TILT = "degrees(acos(least(1, greatest(-1, az / greatest(sqrt(ax*ax + ay*ay + az*az), 1e-9)))))"


@query("tilt_error", "rec:bigint n:bigint n_above:bigint", "tilt_mean tilt_p50 tilt_p90",
       f"""{Q.BASE}, tl AS (SELECT rec, {_TILT} AS tilt FROM sv)
SELECT rec, count(*) AS n, sum((tilt > 5.0)::INT) AS n_above, avg(tilt) AS tilt_mean,
       quantile_cont(tilt, 0.5) AS tilt_p50, quantile_cont(tilt, 0.9) AS tilt_p90
FROM tl GROUP BY rec""")
def tilt_error(spark, d):
    f = I.stored_frames(spark, d).withColumns({"ux": F.lit(0.0), "uy": F.lit(0.0), "uz": F.lit(1.0)})
    return E.tilt_report(f, V.ACC, ("ux", "uy", "uz"))


@query("tilt_overview", "n_rec:bigint n_above:bigint", "mean overall_p50",
       f"""{Q.BASE}, tl AS (SELECT rec, quantile_cont({_TILT}, 0.5) AS t FROM sv GROUP BY rec)
SELECT count(*) AS n_rec, sum((t > 9.0)::INT) AS n_above, avg(t) AS mean,
       quantile_cont(t, 0.5) AS overall_p50 FROM tl""")
def tilt_overview(spark, d):
    f = I.stored_frames(spark, d).withColumns({"ux": F.lit(0.0), "uy": F.lit(0.0), "uz": F.lit(1.0)})
    return E.tilt_overview(E.tilt_report(f, V.ACC, ("ux", "uy", "uz")), limit=9.0)


@query("family_medians", "family:int n_rec:bigint", "rate_p50 force_p50",
       f"""{Q.BASE}, pr AS (SELECT rec, avg(sqrt(wx*wx + wy*wy + wz*wz)) AS rate,
       avg(sqrt(ax*ax + ay*ay + az*az)) AS force FROM sv GROUP BY rec)
SELECT rec % 7 AS family, count(*) AS n_rec, quantile_cont(rate, 0.5) AS rate_p50,
       quantile_cont(force, 0.5) AS force_p50 FROM pr GROUP BY 1""")
def family_medians(spark, d):
    per = sensor_view(spark, d).groupBy("rec").agg(
        F.avg(V.norm(V.vec(*V.GYR))).alias("rate"), F.avg(V.norm(V.vec(*V.ACC))).alias("force"))
    return E.family_medians(per.withColumn("family", F.col("rec") % 7), ["rate", "force"])


_UP0 = "fx / greatest(fn, 1e-6)"
_SCALED = f"""{Q.REST}, up AS (SELECT rec, fx / fn AS u0, fy / fn AS u1, fz / fn AS u2
FROM (SELECT *, sqrt(fx*fx + fy*fy + fz*fz) AS fn FROM an)),
pa AS (SELECT sv.rec, frame, s, ax, ay, az, ax*u0 + ay*u1 + az*u2 AS along, u0, u1, u2
FROM sv JOIN up ON sv.rec = up.rec CROSS JOIN (VALUES (CAST(1.0 AS DOUBLE)), (1.5), (2.0)) AS k(s)),
hz AS (SELECT rec, CAST(floor(frame / 50) AS INTEGER) AS win_idx, s AS scale,
       avg(along*u0 + s*(ax - along*u0)) AS hx, avg(along*u1 + s*(ay - along*u1)) AS hy,
       avg(along*u2 + s*(az - along*u2)) AS hz FROM pa GROUP BY 1, 2, 3 HAVING count(*) = 50)"""


def _scaled_windows(spark, d):
    f = I.stored_frames(spark, d)
    up = W.rest_anchor(f, I.RIG).select("rec", *V.named(V.unit(V.vec("fx", "fy", "fz")),
                                                        ("u0", "u1", "u2")))
    wide = f.join(up, "rec").withColumn("scale", F.explode(F.array(
        F.lit(1.0), F.lit(1.5), F.lit(2.0))))
    out = V.scale_horizontal(V.vec(*V.ACC), V.vec("u0", "u1", "u2"), F.col("scale"))
    return W.window_means(wide, dict(zip(("hx", "hy", "hz"), out)), I.RIG, keep=("scale",))


@query("counterfactual_scale", "rec:bigint win_idx:int", "scale hx hy hz",
       f"{_SCALED} SELECT rec, win_idx, scale, hx, hy, hz FROM hz")
def counterfactual_scale(spark, d):
    return _scaled_windows(spark, d)


@query("scale_sensitivity", "rec:bigint", "scale speed_p90 speed_max sensitivity",
       f"""{_SCALED}, sp AS (SELECT rec, scale, sqrt(hx*hx + hy*hy + hz*hz) AS speed FROM hz),
pr AS (SELECT rec, scale, quantile_cont(speed, 0.9) AS speed_p90, max(speed) AS speed_max
FROM sp GROUP BY 1, 2)
SELECT pr.rec, pr.scale, speed_p90, speed_max, max(speed_p90) FILTER (scale = 1.5) OVER w
       / max(speed_p90) FILTER (scale = 1.0) OVER w AS sensitivity
FROM pr WINDOW w AS (PARTITION BY rec)""")
def scale_sensitivity(spark, d):
    speeds = _scaled_windows(spark, d).withColumn("speed", V.norm(V.vec("hx", "hy", "hz")))
    return E.scale_sensitivity(speeds)


@query("calibration_deviation", "rec:bigint", "deviation", f"""{Q.WINDOWS},
p AS (SELECT rec, 1 + 0.05 * sin(rec) AS s0, 1 + 0.05 * cos(rec) AS s1, 1.01 AS s2, avg(ax) AS b0,
      avg(ay) AS b1, avg(wz) AS b2, avg(wx) * 10 AS lg FROM wm GROUP BY rec)
SELECT rec, greatest(abs(s0 - 1), abs(s1 - 1), abs(s2 - 1)) / 0.05
       + sqrt(b0*b0 + b1*b1 + b2*b2) / 0.5 + (1 - abs(tanh(lg / 2))) AS deviation FROM p""")
def calibration_deviation(spark, d):
    p = I.means(spark, d).groupBy("rec").agg(*[F.avg(c).alias(c) for c in ("ax", "ay", "wz", "wx")])
    gain = (1 + 0.05 * F.sin("rec"), 1 + 0.05 * F.cos("rec"), F.lit(1.01))
    return p.select("rec", V.calibration_deviation(gain, V.vec("ax", "ay", "wz"),
                                                   F.col("wx") * 10).alias("deviation"))


@query("recording_statistics", "rec:bigint n_win:bigint", "gyro_mean gyro_p90 acc_std acc_p90_dev",
       f"""{Q.BASE}, n AS (SELECT rec, sqrt(ax*ax + ay*ay + az*az) AS a,
       sqrt(wx*wx + wy*wy + wz*wz) AS w FROM sv)
SELECT rec, floor(count(*) / 50) AS n_win, avg(w) AS gyro_mean, quantile_cont(w, 0.9) AS gyro_p90,
       stddev_pop(a) AS acc_std, quantile_cont(abs(a - 9.81), 0.9) AS acc_p90_dev
FROM n GROUP BY rec""")
def recording_statistics(spark, d):
    return S.recording_statistics(I.stored_frames(spark, d), I.RIG)


@query("trivial_predictors", "predictor:string", "huber", f"""{Q.EVAL}
SELECT 'zero' AS predictor, avg(true_speed - 0.125) AS huber FROM er
UNION ALL SELECT 'truth', 0.0""")
def trivial_predictors(spark, d):
    m = I.matched(spark, d)
    zero = E.masked_huber(E.zero_prediction(m), F.lit(True)).withColumn("predictor", F.lit("zero"))
    same = E.masked_huber(E.truth_prediction(m), F.lit(True)).withColumn(
        "predictor", F.lit("truth"))
    return zero.unionByName(same)


@query("masked_huber", "n_valid:bigint", "huber", f"""{Q.EVAL}
SELECT sum((win_idx % 2 = 0)::INT) AS n_valid,
       avg(CASE WHEN err < 0.25 THEN 0.5 * err * err / 0.25 ELSE err - 0.125 END)
       FILTER (win_idx % 2 = 0) AS huber FROM er""")
def masked_huber(spark, d):
    return E.masked_huber(I.matched(spark, d), F.col("win_idx") % 2 == 0)


@query("solution_summary", "platform:string windows:bigint recordings:bigint", "dt_mean",
       f"""{Q.WINDOWS}, {Q.PLATFORM} SELECT platform, count(*) AS windows,
       count(DISTINCT wm.rec) AS recordings, 1.0 AS dt_mean FROM wm JOIN pf ON wm.rec = pf.rec
GROUP BY platform""")
def solution_summary(spark, d):
    f = I.posed(spark, d)
    wins = with_platform(W.window_targets(f, I.RIG).select("rec", "win_idx"), spark, d)
    return E.solution_summary(W.pose_lookup(wins, f, I.RIG))
