"""Queries: keys, filters, folds, joins, sets and orderings."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sensorframe.session import cut_lineage
from sensorframe.functions import vec as V
from sensorframe.operators import relational as R
from sensorframe.operators import summary as S
from sensorframe.operators import windows as W
from sensorframe.operators.sequence import variable_shift
from sensorframe.sources.views import (event_view, load, sensor_view, wall_clock,
                                       with_platform)
from workload import inputs as I
from workload import sql as Q
from workload.registry import query


@query("platform_ids", "rec:bigint platform:string platform_id:int", "", f"""WITH {Q.PLATFORM}
SELECT rec, platform, CASE platform WHEN 'AFRICA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2
       WHEN 'EUROPE' THEN 3 WHEN 'MIDDLE EAST' THEN 4 END AS platform_id FROM pf""")
def platform_ids(spark, d):
    from sensorframe.sources.views import platforms
    ids = {n: i for i, n in enumerate(("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))}
    return platforms(spark, d).withColumn("platform_id", R.platform_id("platform", ids))


@query("key_normalise", "vec_id:bigint rec:string short:string sequence:bigint variant:string", "",
       """SELECT vec_id, 'a_' || CAST(vec_id AS VARCHAR) AS rec, CAST(vec_id AS VARCHAR) AS short, vec_id + 1 AS sequence,
       'run' || CAST(label AS VARCHAR) || 'w_s' || CAST(vec_id AS VARCHAR) AS variant
FROM embeddings""")
def key_normalise(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "label")
    named = e.withColumn("file", F.concat(F.lit("a_"), F.col("vec_id").cast("string"), F.lit(".npz")))
    rec = R.normalise_key("file")
    tag = F.concat(F.lit("run"), F.col("label").cast("string"), F.lit("_s"),
                   F.col("vec_id").cast("string"))
    return named.select("vec_id", rec.alias("rec"), R.short_id(rec).alias("short"),
                        R.sequence_id(rec).alias("sequence"), R.tag_variant(tag, "w")
                        .alias("variant"))


@query("sequence_join", "rec:bigint sequence:bigint tag:string", "ave", f"""{Q.EVAL}
SELECT rec, rec + 1 AS sequence, tag, avg(err) AS ave FROM er GROUP BY 1, 2, 3""")
def sequence_join(spark, d):
    """Published per-sequence errors joined back to recordings by id = index + 1."""
    e = I.errors(spark, d)
    published = e.groupBy("tag", (F.col("rec") + 1).alias("sequence")).agg(
        F.avg("err").alias("ave"))
    recs = I.truth(spark, d).select("rec").distinct().withColumn(
        "name", F.concat(F.lit("seq_"), F.col("rec").cast("string"))).withColumn(
        "sequence", R.sequence_id("name"))
    return recs.join(published, "sequence").select("rec", "sequence", "tag", "ave")


@query("missing_files", "rec:bigint win_idx:int", "", f"""{Q.WINDOWS} SELECT rec, win_idx FROM wm
WHERE rec NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0)""")
def missing_files(spark, d):
    files = load(spark, d, "supplier").where(F.col("s_suppkey") % 5 != 0).select(
        F.col("s_suppkey").alias("rec"))
    return R.missing_recordings(I.truth(spark, d).select("rec", "win_idx"), files)


_FOLD = """fg AS (SELECT s_nationkey AS rep, s_suppkey AS rec FROM supplier WHERE s_nationkey % 4 = 0)"""


def _fold(spark, d):
    """Flight groups: suppliers of a nation move together; repeats are in the lists."""
    s = load(spark, d, "supplier").where(F.col("s_nationkey") % 4 == 0)
    # a list holds at most 1000 ids; a large group is given as several lists
    lists = s.groupBy("s_nationkey", F.floor(F.col("s_suppkey") / 1000)).agg(
        F.collect_list("s_suppkey").alias("members"))
    return lists.select(F.create_map(F.col("s_nationkey").cast("string"), F.concat(
        "members", F.slice("members", 1, 1))).alias("groups"))


@query("fold_split", "rec:bigint win_idx:int part:string", "", f"""{Q.WINDOWS}, {_FOLD}
SELECT rec, win_idx, CASE WHEN rec IN (SELECT rec FROM fg) THEN 'held' ELSE 'train' END AS part
FROM wm""")
def fold_split(spark, d):
    held, train = R.fold_split(I.truth(spark, d).select("rec", "win_idx"),
                               R.expand_groups(_fold(spark, d)))
    return R.stack(held.withColumn("part", F.lit("held")),
                   train.withColumn("part", F.lit("train")))


@query("expand_groups", "representative:string rec:bigint", "",
       f"WITH {_FOLD} SELECT CAST(rep AS VARCHAR) AS representative, rec FROM fg")
def expand_groups(spark, d):
    return R.expand_groups(_fold(spark, d))


@query("long_recordings", "rec:bigint platform:string n_windows:int", "",
       f"""{Q.RECS} SELECT rec, platform, n_windows FROM rc WHERE n_windows >= 12
AND platform IN ('ASIA', 'EUROPE')""")
def long_recordings(spark, d):
    return R.longer_than(I.recordings(spark, d), 12).where(
        F.col("platform").isin("ASIA", "EUROPE"))


@query("family_filter", "name:string family:boolean marked:boolean", "",
       """SELECT s_name AS name, s_name LIKE 'Supplier#%' AND
       coalesce(TRY_CAST(right(s_name, 4) AS INTEGER), -1) BETWEEN 3 AND 60 AS family,
       s_name LIKE '%07%' OR s_name LIKE '%_ext_%' AS marked FROM supplier""")
def family_filter(spark, d):
    s = load(spark, d, "supplier")
    return s.select(F.col("s_name").alias("name"), F.coalesce(
        R.in_family("s_name", "Supplier#", 3, 60), F.lit(False)).alias("family"),
        R.has_marker("s_name", ("07", "_ext_")).alias("marked"))


@query("calm_predicate", "rec:bigint n:bigint n_calm:bigint", "", f"""{Q.BASE}
SELECT rec, count(*) AS n, sum((abs(sqrt(ax*ax + ay*ay + az*az) - 9.81) < 0.5)::INT) AS n_calm
FROM sv GROUP BY rec""")
def calm_predicate(spark, d):
    return sensor_view(spark, d).groupBy("rec").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(S.near_gravity(I.RIG)).alias("n_calm"))


@query("calm_frames", "rec:bigint n_calm:bigint last_calm:int", "", f"""{Q.BASE},
g AS (SELECT rec, frame, sqrt(wx*wx + wy*wy + wz*wz) AS r FROM sv),
k AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY r, frame) AS rk,
      sum((r < 0.2)::INT) OVER (PARTITION BY rec) AS slow, count(*) OVER (PARTITION BY rec) AS n FROM g),
c AS (SELECT *, CASE WHEN slow >= 120 THEN r < 0.2
      ELSE rk <= greatest(120, floor(n / 20)) END AS calm FROM k)
SELECT rec, sum(calm::INT) AS n_calm, max(frame) FILTER (calm) AS last_calm FROM c GROUP BY rec""")
def calm_frames(spark, d):
    c = S.calm_frames(I.stored_frames(spark, d), 0.2, 120)
    return c.groupBy("rec").agg(F.count_if("calm").alias("n_calm"),
                                F.max(F.when(F.col("calm"), F.col("frame"))).alias("last_calm"))


_SMOOTH = ", ".join(f"sum({c}) OVER (PARTITION BY rec ORDER BY frame ROWS BETWEEN 12 PRECEDING "
                    f"AND 12 FOLLOWING) / 25 AS {c}" for c in ("ax", "ay", "az", "wx", "wy", "wz"))


@query("calm_after_anchor", "rec:bigint n:bigint", "sx sy sz", f"""{Q.REST},
sm AS (SELECT rec, frame, {_SMOOTH} FROM sv),
cm AS (SELECT sm.*, sqrt(ax*ax + ay*ay + az*az) AS n FROM sm JOIN an ON sm.rec = an.rec
WHERE abs(sqrt(ax*ax + ay*ay + az*az) - 9.81) < 0.5 AND sqrt(wx*wx + wy*wy + wz*wz) < 0.5
AND abs(frame - anchor_at) / 50 > 1.0 AND abs(frame - anchor_at) / 50 < 20.0)
SELECT rec, count(*) AS n, avg(ax / n) AS sx, avg(ay / n) AS sy, avg(az / n) AS sz FROM cm
GROUP BY rec HAVING count(*) >= 50""")
def calm_after_anchor(spark, d):
    f = I.stored_frames(spark, d)
    c = S.calm_after_anchor(f, W.rest_anchor(f, I.RIG), I.RIG)
    return c.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), *[
        F.avg(f"s_{a}").alias(f"s{a}") for a in "xyz"])


@query("every_kth", "rec:bigint n_windows:int", "", f"""{Q.RECS}
SELECT rec, n_windows FROM (SELECT *, row_number() OVER (ORDER BY rec) - 1 AS k FROM rc)
WHERE k % 3 = 0""")
def every_kth(spark, d):
    return R.every_kth(I.recordings(spark, d).select("rec", "n_windows"), 3)


@query("drop_tilted", "rec:bigint n:bigint", "", f"""{Q.BASE},
tl AS (SELECT rec, degrees(acos(least(1, greatest(-1, az / sqrt(ax*ax + ay*ay + az*az))))) AS t FROM sv)
SELECT rec, count(*) AS n FROM tl GROUP BY rec HAVING quantile_cont(t, 0.5) <= 9.0""")
def drop_tilted(spark, d):
    f = I.stored_frames(spark, d)
    tilt = f.select("rec", V.angle_deg(V.vec(*V.ACC), V.vec(0, 0, 1)).alias("tilt"))
    return R.drop_tilted(f, tilt, 9.0).groupBy("rec").agg(F.count(F.lit(1)).alias("n"))


@query("calibration_labels", "rec:bigint fitted:boolean", "s_x b_x lag_ms axis_class mask",
       f"""{Q.WINDOWS}, t AS (SELECT rec, avg(ax) AS a, avg(ay) AS b FROM wm WHERE rec % 2 = 0 GROUP BY rec),
r AS (SELECT s_suppkey AS rec, CASE WHEN s_suppkey % 3 = 0 THEN 4 WHEN s_suppkey % 3 = 1 THEN 6 END AS family
      FROM supplier)
SELECT r.rec, coalesce(family, 6) = 6 AND t.rec IS NOT NULL AS fitted,
       CASE WHEN coalesce(family, 6) = 6 AND t.rec IS NOT NULL THEN 1 + a / 10 ELSE 1 END AS s_x,
       CASE WHEN coalesce(family, 6) = 6 AND t.rec IS NOT NULL THEN b ELSE 0 END AS b_x,
       CASE WHEN coalesce(family, 6) = 6 AND t.rec IS NOT NULL THEN b * 100 ELSE 0 END AS lag_ms,
       CASE WHEN coalesce(family, 6) = 6 THEN 0 ELSE 1 END AS axis_class,
       CASE WHEN coalesce(family, 6) = 6 THEN 1 ELSE 0 END AS mask
FROM r LEFT JOIN t ON r.rec = t.rec""")
def calibration_labels(spark, d):
    m = I.means(spark, d).where(F.col("rec") % 2 == 0).groupBy("rec").agg(
        F.avg("ax").alias("a"), F.avg("ay").alias("b"))
    targets = m.select("rec", *[(1 + F.col("a") / 10).alias(f"s_{c}") for c in "xyz"],
                       *[F.col("b").alias(f"b_{c}") for c in "xyz"],
                       (F.col("b") * 100).alias("lag_ms"))
    recs = load(spark, d, "supplier").select(F.col("s_suppkey").alias("rec"), F.when(
        F.col("s_suppkey") % 3 == 0, 4).when(F.col("s_suppkey") % 3 == 1, 6).alias("family"))
    return R.calibration_labels(recs, targets)


@query("out_of_range", "n:bigint outside:bigint", "", f"""{Q.WINDOWS} SELECT count(*) AS n,
sum((greatest(abs(vx), abs(vy), abs(vz)) > 2.6)::INT) AS outside FROM wm""")
def out_of_range(spark, d):
    return R.out_of_range(I.truth(spark, d), 2.6)


@query("calibrated_windows", "rec:bigint win_idx:int", "ax ay az wx wy wz", f"""{Q.BASE},
pm AS (SELECT s_suppkey AS rec, 1 + (s_suppkey % 5) * 0.01 AS s, (s_suppkey % 7) * 0.02 AS b,
       s_suppkey % 2 = 0 AS flip FROM supplier)
SELECT sv.rec, CAST(floor(frame / 50) AS INTEGER) AS win_idx, avg((ax - b) / s) AS ax,
       avg((ay - b) / s) AS ay, avg((az - b) / s) AS az,
       avg(CASE WHEN flip THEN -wy ELSE wx END) AS wx, avg(CASE WHEN flip THEN -wx ELSE wy END) AS wy,
       avg(CASE WHEN flip THEN -wz ELSE wz END) AS wz
FROM sv JOIN pm ON sv.rec = pm.rec GROUP BY 1, 2 HAVING count(*) = 50""")
def calibrated_windows(spark, d):
    p = load(spark, d, "supplier").select(
        F.col("s_suppkey").alias("rec"), (1 + (F.col("s_suppkey") % 5) * 0.01).alias("s"),
        ((F.col("s_suppkey") % 7) * 0.02).alias("b"), (F.col("s_suppkey") % 2 == 0).alias("flip"))
    f = R.with_parameters(sensor_view(spark, d), p)
    acc = V.calibrate_force(V.vec(*V.ACC), V.vec("s", "s", "s"), V.vec("b", "b", "b"))
    gyr = V.flip_gyro(V.vec(*V.GYR), F.col("flip"))
    return W.window_means(f, {**V.as_columns(acc, V.ACC), **V.as_columns(gyr, V.GYR)}, I.RIG)


@query("variable_shift", "rec:bigint win_idx:int", "wx wz", f"""{Q.BASE},
nn AS (SELECT rec, count(*) AS n FROM sv GROUP BY rec),
lc AS (SELECT sv.rec, frame, greatest(0, least(frame + (sv.rec % 9 - 4), n - 1)) AS src
       FROM sv JOIN nn ON sv.rec = nn.rec)
SELECT lc.rec, CAST(floor(lc.frame / 50) AS INTEGER) AS win_idx, avg(sv.wx * (lc.frame % 7)) AS wx,
       avg(sv.wz * (lc.frame % 7)) AS wz
FROM lc JOIN sv ON sv.rec = lc.rec AND sv.frame = lc.src GROUP BY 1, 2 HAVING count(*) = 50""")
def variable_shift_query(spark, d):
    lag = load(spark, d, "supplier").select(F.col("s_suppkey").alias("rec"), (
        (F.col("s_suppkey") % 9 - 4) * 20.0).alias("lag_ms"))
    moved = variable_shift(sensor_view(spark, d), lag, V.GYR, rig=I.RIG)
    # weighted by frame so that a wrong shift inside a window shows
    return W.window_means(moved, {c: F.col(c) * (F.col("frame") % 7) for c in ("wx", "wz")}, I.RIG)


@query("window_slices", "rec:bigint win_idx:int n:bigint", "first_ax last_ax", f"""{Q.BASE}, {Q.MEANS},
wk AS (SELECT rec, win_idx FROM wm)
SELECT wk.rec, wk.win_idx, count(*) AS n, max(ax) FILTER (frame % 50 = 0) AS first_ax,
       max(ax) FILTER (frame % 50 = 49) AS last_ax
FROM wk JOIN sv ON sv.rec = wk.rec AND frame >= win_idx * 50 AND frame < win_idx * 50 + 50
GROUP BY 1, 2""")
def window_slices(spark, d):
    f = sensor_view(spark, d).select("rec", "frame", "ax")
    wins = I.truth(spark, d).select("rec", "win_idx")
    s = W.window_slices(wins, f, I.RIG)
    at = F.col("frame") % I.RIG.window
    return s.groupBy("rec", "win_idx").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(at == 0, F.col("ax"))).alias("first_ax"),
        F.max(F.when(at == I.RIG.window - 1, F.col("ax"))).alias("last_ax"))


@query("pose_lookup", "rec:bigint win_idx:int", "qx qy qz qw gx gy gz dt", f"""{Q.BASE},
nn AS (SELECT rec, CAST(count(*) AS INTEGER) AS n FROM sv GROUP BY rec),
sp AS (SELECT rec, win_idx, win_idx * 50 AS s, least(win_idx * 50 + 25, n - 1) AS m,
       least(win_idx * 50 + 49, n - 1) AS e
       FROM (SELECT rec, n, unnest(range(CAST(ceil(n / 50) AS INTEGER))) AS win_idx FROM nn))
SELECT sp.rec, win_idx, m.wx AS qx, m.wy AS qy, m.wz AS qz, 1.0 AS qw, e.ax AS gx, e.ay AS gy,
       e.az AS gz, sp.e * 0.02 - sp.s * 0.02 + 0.02 AS dt
FROM sp JOIN sv m ON m.rec = sp.rec AND m.frame = sp.m JOIN sv e ON e.rec = sp.rec AND e.frame = sp.e""")
def pose_lookup(spark, d):
    f = I.posed(spark, d)
    wins = W.with_window(f, I.RIG).select("rec", "win_idx").distinct()
    return W.pose_lookup(wins, f, I.RIG)


@query("calm_pairs", "rec:bigint win_idx:int o_win_idx:int", "weight", f"""{Q.BASE}, {Q.SCORES},
cd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY score, win_idx) AS rk
       FROM sc) WHERE rk <= 4)
SELECT a.rec, a.win_idx, b.win_idx AS o_win_idx, 1 / (1e-3 + b.score) AS weight
FROM cd a JOIN cd b ON a.rec = b.rec AND a.win_idx <> b.win_idx""")
def calm_pairs(spark, d):
    return S.calm_pairs(S.calm_candidates(W.rest_scores(sensor_view(spark, d), I.RIG), 4))


@query("slowest_windows", "rec:bigint win_idx:int", "speed", f"""{Q.WINDOWS}
SELECT rec, win_idx, s AS speed FROM (SELECT rec, win_idx,
round(sqrt(vx*vx + vy*vy + vz*vz) + 3.1e-10, 9) AS s FROM wm) ORDER BY s, rec, win_idx LIMIT 200""")
def slowest_windows(spark, d):
    w = I.truth(spark, d).withColumn("speed", F.round(V.norm(V.vec(*V.VEL)) + 3.1e-10, 9))
    return R.slowest_windows(w, 200)


@query("rare_bins", "cell:int n:bigint", "", f"""{Q.WINDOWS},
cc AS (SELECT CAST(floor(az * 5) AS INTEGER) % 8 AS cell, count(*) AS n FROM wm GROUP BY 1)
SELECT cell, n FROM cc WHERE n < (SELECT quantile_cont(n, 0.5) FROM cc)""")
def rare_bins(spark, d):
    w = I.means(spark, d).withColumn("cell", (F.floor(F.col("az") * 5) % 8).cast("int"))
    return R.rare_bins(w, "cell")


@query("best_run", "platform:string rank:int tag:string", "ave", f"""{Q.EVAL},
pa AS (SELECT platform, tag, round(avg(ave), 9) AS ave FROM (SELECT platform, tag, rec,
       avg(err) AS ave FROM er GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT * FROM (SELECT platform, tag, ave, row_number() OVER (PARTITION BY platform
ORDER BY ave, tag) AS rank FROM pa) WHERE rank <= 2""")
def best_run(spark, d):
    from sensorframe.plans.evaluation import recording_ave
    per = recording_ave(I.errors(spark, d)).groupBy("platform", "tag").agg(
        F.round(F.avg("ave"), 9).alias("ave"))
    return R.best_per_group(per, ["platform"], "ave", 2)


@query("row_order", "row_id:bigint rec:bigint win_idx:int", "vx", f"""{Q.WINDOWS}
SELECT row_number() OVER (ORDER BY rec, win_idx) - 1 AS row_id, rec, win_idx, vx FROM wm""")
def row_order(spark, d):
    """The place of every row in the ordered table, read off its partitions."""
    placed = R.in_row_order(I.truth(spark, d), "rec", "win_idx").withColumn("_at", F.monotonically_increasing_id())
    placed = cut_lineage(placed.withColumn("_part", F.shiftright("_at", 33)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").count().select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_part").withColumn(
        "row_id", F.col("_start") + F.col("_at") - F.shiftleft("_part", 33))


@query("union_splits", "split:string n:bigint n_distinct:bigint", "", f"""{Q.WINDOWS},
un AS (SELECT 'train' AS split, rec FROM wm WHERE rec % 3 <> 0 UNION ALL
       SELECT 'val', rec FROM wm WHERE rec % 3 = 0 UNION ALL SELECT 'val', rec FROM wm WHERE rec % 3 = 0)
SELECT split, count(*) AS n, count(DISTINCT rec) AS n_distinct FROM un GROUP BY split""")
def union_splits(spark, d):
    from sensorframe.operators.blocks import spread_distinct
    t = I.truth(spark, d).select("rec")
    val = t.where(F.col("rec") % 3 == 0).withColumn("split", F.lit("val"))
    both = R.stack(t.where(F.col("rec") % 3 != 0).withColumn("split", F.lit("train")), val, val)
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n")).join(
        spread_distinct(both, ["split"], "rec", "n_distinct"), "split")


@query("common_ids", "rec:bigint", "", """SELECT DISTINCT l_suppkey AS rec FROM lineitem
INTERSECT SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0""")
def common_ids(spark, d):
    a = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("rec"))
    b = load(spark, d, "supplier").where(F.col("s_suppkey") % 2 == 0).select(
        F.col("s_suppkey").alias("rec"))
    return R.common_ids(a, b)


@query("ids_without", "rec:bigint", "", """SELECT DISTINCT l_suppkey AS rec FROM lineitem
EXCEPT SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0""")
def ids_without(spark, d):
    a = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("rec"))
    b = load(spark, d, "supplier").where(F.col("s_suppkey") % 2 == 0).select(
        F.col("s_suppkey").alias("rec"))
    return R.ids_without(a, b)


@query("fold_dispatch", "tag:string fold:string n:bigint", "", f"""{Q.EVAL}
SELECT tag, CASE WHEN tag LIKE 'alpha%' THEN 'fold_one' WHEN tag LIKE 'beta%' THEN 'fold_two' END
       AS fold, count(*) AS n FROM er GROUP BY 1, 2""")
def fold_dispatch(spark, d):
    m = I.matched(spark, d)
    fold = R.fold_of_tag("tag", {"alpha": "fold_one", "beta": "fold_two"})
    return m.groupBy("tag", fold.alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("quantile_bins", "bin:int n:bigint", "mean_speed", f"""{Q.WINDOWS},
sp AS (SELECT sqrt(vx*vx + vy*vy + vz*vz) AS s FROM wm),
ed AS (SELECT quantile_cont(s, 0.2) AS e1, quantile_cont(s, 0.4) AS e2, quantile_cont(s, 0.6) AS e3,
       quantile_cont(s, 0.8) AS e4 FROM sp)
SELECT (s >= e1)::INT + (s >= e2)::INT + (s >= e3)::INT + (s >= e4)::INT AS bin, count(*) AS n,
       avg(s) AS mean_speed FROM sp, ed GROUP BY 1""")
def quantile_bins(spark, d):
    w = I.truth(spark, d).withColumn("s", V.norm(V.vec(*V.VEL)))
    edges = R.quantile_edges(w, "s", (0.2, 0.4, 0.6, 0.8))
    both = w.join(F.broadcast(edges))
    return both.groupBy(R.digitise(F.col("s"), [F.col(c) for c in edges.columns]).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean_speed"))


@query("sample_weights", "rec:bigint win_idx:int platform:string", "weight", f"""{Q.WINDOWS}, {Q.PLATFORM},
pw AS (SELECT wm.rec, win_idx, platform FROM wm JOIN pf ON wm.rec = pf.rec)
SELECT rec, win_idx, platform, 1.0 / (count(*) OVER (PARTITION BY rec) *
(SELECT count(DISTINCT rec) FROM pw q WHERE q.platform = pw.platform)) AS weight FROM pw""")
def sample_weights(spark, d):
    from sensorframe.operators.sampling import sample_weights as weigh
    return weigh(with_platform(I.truth(spark, d), spark, d))


@query("event_gaps", "rec:bigint n:bigint", "gap_mean gap_max rough", f"""WITH {Q.EVENTS},
g AS (SELECT rec, epoch(ts) - lag(epoch(ts)) OVER w AS gap, abs(value - lag(value) OVER w) AS step
FROM ev WINDOW w AS (PARTITION BY rec ORDER BY frame))
SELECT rec, count(*) AS n, avg(gap) AS gap_mean, max(gap) AS gap_max, avg(step) AS rough
FROM g GROUP BY rec""")
def event_gaps(spark, d):
    from sensorframe.operators.blocks import apply_local
    e = event_view(spark, d).withColumn("t", F.unix_micros(wall_clock("ts")) / 1e6)
    g = apply_local(e, [lambda w: {"gap": F.col("t") - F.lag("t").over(w),
                                   "step": F.abs(F.col("value") - F.lag("value").over(w))}], 1, 0)
    return g.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("gap_mean"),
                                F.max("gap").alias("gap_max"), F.avg("step").alias("rough"))
