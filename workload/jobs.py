"""Queries: whole jobs - features, inference, baseline, files and streams."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, functions as F

from sensorframe.functions import vec as V
from sensorframe.operators import windows as W
from sensorframe.operators.grouped import map_groups
from sensorframe.operators.relational import normalise_key
from sensorframe.operators.sampling import sample_weights
from sensorframe.plans import baseline, evaluation, features, inference
from sensorframe.session import scratch_path, write_once
from sensorframe.sources import tables
from sensorframe.sources.archives import follow_archives, read_archives, write_archive
from sensorframe.sources.recordings import materialise
from sensorframe.sources.views import sensor_view, wall_clock, with_platform
from sensorframe.streaming import incremental
from sensorframe.streaming.carried import stream_up_filter as stream_up
from workload import inputs as I
from workload import sql as Q
from workload.registry import query
from workload.sequences import _CHUNKS, _DR, _UP, _WIN, _avg_sql, _filter_sql

_NAMES = features.MODES["slowdr"]
_SU = ("su0", "su1", "su2")


def _about(v, prefix):
    along = Q.dot(v, _SU)
    return [f"avg({along}) AS slow_{prefix}_up"] + [
        f"avg({c} - {along} * {u}) AS slow_{prefix}_h{a}" for c, u, a in zip(v, _SU, "xyz")]


@query("feature_channels", "rec:bigint win_idx:int", " ".join(_NAMES), Q.recursive(f"""{Q.REST}, {_DR},
{_filter_sql('CAST(0.005 AS DOUBLE)')},
al AS (SELECT sv.*, uf.ux AS su0, uf.uy AS su1, uf.uz AS su2, rk.dx, rk.dy, rk.dz, rk.since, rk.x, rk.y, rk.z, rk.w, fx, fy, fz, score, u0, u1, u2
FROM sv JOIN uf USING (rec, frame) JOIN rk USING (rec, frame) JOIN an ON an.rec = sv.rec JOIN up ON up.rec = sv.rec)
SELECT rec, {_WIN} AS win_idx, {', '.join(f'avg({c}) AS {c}' for c in (*V.ACC, *V.GYR))}, {', '.join(_about(V.ACC, 'a') + _about(V.GYR, 'w'))},
       avg(ax - fx) AS rest_dx, avg(ay - fy) AS rest_dy, avg(az - fz) AS rest_dz, avg(score) AS rest_score,
       avg({_UP[0]}) AS ux, avg({_UP[1]}) AS uy, avg({_UP[2]}) AS uz, avg(dx) AS d_x, avg(dy) AS d_y, avg(dz) AS d_z, avg(since) AS since
FROM al GROUP BY 1, 2 HAVING count(*) = 50"""), digits=4)
def feature_channels(spark, d):
    """All 25 channels of the widest mode, averaged per window."""
    f = features.features(I.stored_frames(spark, d), "slowdr", I.RIG)
    return W.window_means(f, {c: c for c in _NAMES}, I.RIG)


def _up_sql(name, gain):
    """The up recursion under CTE names of its own."""
    return re.sub(r"\buf\b", f"uf_{name}", re.sub(r"\bnx\b", f"nx_{name}", _filter_sql(gain)))


_GAINS = {"slow": "CAST(0.005 AS DOUBLE)", "fast": "CAST(0.05 AS DOUBLE)",
          "adapt": "0.005 * exp(-((sqrt(ax*ax + ay*ay + az*az) - 9.81) * (sqrt(ax*ax + ay*ay + az*az) - 9.81)))"}
_PARTS = ("a_up", "a_hx", "a_hy", "a_hz", "w_up", "w_hx", "w_hy", "w_hz")


def _mode_sql(mode, names, up):
    """Per window, the means of a mode's parts about up to two directions, in long form."""
    out = []
    for prefix in up:
        u = [f"{prefix}_{i}" for i in range(3)]
        for kind, v in (("a", V.ACC), ("w", V.GYR)):
            along = Q.dot(v, u)
            parts = [along] + [f"({c} - {along} * {x})" for c, x in zip(v, u)]
            out += [f"avg({e}) AS {prefix}_{kind}_{n}" for e, n in zip(parts, ("up", "hx", "hy", "hz"))]
    cols = ", ".join(out + [f"avg({e}) AS {n}" for n, e in names.items()])
    every = [f"{p}_{x}" for p in up for x in _PARTS] + list(names)
    rows = " UNION ALL ".join(f"SELECT '{mode}' AS mode, rec, win_idx, '{c}' AS channel, {c} AS value FROM mode_{mode}" for c in every)
    return f"mode_{mode} AS MATERIALIZED (SELECT rec, {_WIN} AS win_idx, {cols} FROM al GROUP BY 1, 2 HAVING count(*) = 50)", rows


_RAWS = {c: c for c in (*V.ACC, *V.GYR)}
_RESTS = {"rest_dx": "ax - fx", "rest_dy": "ay - fy", "rest_dz": "az - fz", "rest_score": "score"}
_RUN_MODES = {"none": (_RAWS, ()), "slow": (_RAWS, ("slow",)), "fast": (_RAWS, ("fast",)), "both": (_RAWS, ("slow", "fast")),
              "adapt": (_RAWS, ("adapt",)), "slowrest": (_RAWS | _RESTS, ("slow",)),
              "slowrest2": (_RAWS | _RESTS | dict(zip(("ux", "uy", "uz"), _UP)), ("slow",))}
_MODE_SQL = {m: _mode_sql(m, *x) for m, x in _RUN_MODES.items()}


@query("feature_modes", "mode:string rec:bigint win_idx:int channel:string", "value", Q.recursive(f"""{Q.REST}, {_DR},
{', '.join(_up_sql(n, g) for n, g in _GAINS.items())},
al AS MATERIALIZED (SELECT sv.*, {', '.join(f'uf_{n}.u{c} AS {n}_{i}' for n in _GAINS for i, c in enumerate('xyz'))},
       rk.x, rk.y, rk.z, rk.w, fx, fy, fz, score, u0, u1, u2
FROM sv {' '.join(f'JOIN uf_{n} ON uf_{n}.rec = sv.rec AND uf_{n}.frame = sv.frame' for n in _GAINS)}
JOIN rk ON rk.rec = sv.rec AND rk.frame = sv.frame JOIN an ON an.rec = sv.rec JOIN up ON up.rec = sv.rec),
{', '.join(cte for cte, _ in _MODE_SQL.values())}
{' UNION ALL '.join(rows for _, rows in _MODE_SQL.values())}"""), digits=4)
def feature_modes(spark, d):
    """The channels of every narrower mode, averaged per window, in long form."""
    f = features.with_directions(I.stored_frames(spark, d), list(_RUN_MODES), I.RIG, packed=True)

    def one(mode):
        cols = features.MODES[mode]
        made = W.window_means(features.features(f, mode, I.RIG), {c: c for c in cols}, I.RIG)
        long = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in cols]))
        return made.select(F.lit(mode).alias("mode"), "rec", "win_idx", long.alias("_x")).select("mode", "rec", "win_idx", "_x.*")
    return reduce(DataFrame.unionByName, map(one, _RUN_MODES))


def _index(spark, d):
    return I.truth(spark, d).select(
        F.format_string("w%d_%d", "rec", "win_idx").alias("window_id"), "rec", "win_idx")


@query("batch_inference", "window_id:string", "vx vy vz", f"""{Q.WINDOWS}, {_CHUNKS},
cm AS (SELECT cw.rec, start, avg(ax) AS m FROM cw JOIN wm USING (rec, win_idx) GROUP BY 1, 2),
cs AS (SELECT cw.*, 1 - abs(off - (len - 1) / 2.0) / (len / 2.0 + 1) AS g, ax - m AS vx, ay + m AS vy, wz * off AS vz
FROM cw JOIN wm USING (rec, win_idx) JOIN cm USING (rec, start))
SELECT 'w' || rec || '_' || win_idx AS window_id, sum(g*vx)/sum(g) AS vx, sum(g*vy)/sum(g) AS vy, sum(g*vz)/sum(g) AS vz
FROM cs GROUP BY rec, win_idx""")
def batch_inference(spark, d):
    """Index to predictions: features, chunks, a model, stitching by weighted mean."""
    def model(x, lengths):
        k = np.arange(x.shape[1])
        valid = (k[None, :] < lengths[:, None]).astype(float)
        m = (x[:, :, 0] * valid).sum(1) / lengths
        return np.stack([x[:, :, 0] - m[:, None], x[:, :, 1] + m[:, None], x[:, :, 5] * k], axis=2)
    return inference.infer(_index(spark, d), sensor_view(spark, d), model, "none", 5, "mean",
                           I.RIG)


@query("solution_table", "window_id:string platform:string", "qx qy qz qw gx gy gz dt vx_gt", f"""{Q.WINDOWS}, {Q.PLATFORM}
SELECT 'w' || wm.rec || '_' || win_idx AS window_id, platform, m.wx AS qx, m.wy AS qy, m.wz AS qz, 1.0 AS qw, e.ax AS gx, e.ay AS gy, e.az AS gz,
       1.0 AS dt, wm.vx AS vx_gt FROM wm JOIN pf ON pf.rec = wm.rec JOIN sv m ON m.rec = wm.rec AND m.frame = win_idx * 50 + 25
JOIN sv e ON e.rec = wm.rec AND e.frame = win_idx * 50 + 49""")
def solution_table(spark, d):
    f = I.posed(spark, d)
    index = with_platform(W.window_targets(f, I.RIG), spark, d).withColumn(
        "window_id", F.format_string("w%d_%d", "rec", "win_idx"))
    return inference.solution(index, f, I.RIG)


_WLS = {c: (f"(sum(wt) * sum(wt*az*{c}) - sum(wt*az) * sum(wt*{c})) / (sum(wt) * sum(wt*az*az) - sum(wt*az) * sum(wt*az))")
        for c in ("vx", "vy", "vz")}


@query("baseline_fit", "rec:bigint win_idx:int", "vx vy vz", f"""{Q.WINDOWS}, {Q.PLATFORM},
pw AS (SELECT wm.*, platform FROM wm JOIN pf ON wm.rec = pf.rec),
ww AS MATERIALIZED (SELECT *, 1.0 / (count(*) OVER (PARTITION BY rec) * (SELECT count(DISTINCT rec) FROM pw q WHERE q.platform = pw.platform)) AS wt FROM pw),
fit AS (SELECT {', '.join(f'{e} AS s_{c}, sum(wt*{c}) / sum(wt) AS m_{c}' for c, e in _WLS.items())}, sum(wt*az) / sum(wt) AS m FROM ww)
SELECT rec, win_idx, {', '.join(f'm_{c} + s_{c} * (az - m) AS {c}' for c in _WLS)} FROM ww, fit""", digits=5)
def baseline_fit(spark, d):
    """Weighted least squares fitted on the cluster, one model per axis."""
    w = with_platform(write_once(I.means(spark, d), "means"), spark, d)
    w = write_once(sample_weights(w), "weighted")  # three fits and the prediction read it
    return baseline.predict_baseline(w, baseline.fit_baseline(w, ["az"], ridge=0.0), ["az"])


@query("materialised_targets", "window_id:string", "vx vy vz",
       f"{Q.WINDOWS} SELECT 'w' || rec || '_' || win_idx AS window_id, vx, vy, vz FROM wm")
def materialised_targets(spark, d):
    """A feature table keyed by its index: written by the first call, found by the second."""
    index, root = _index(spark, d), scratch_path(spark, "features")
    build = lambda: index.join(I.truth(spark, d), ["rec", "win_idx"])
    materialise(index, "targets", 1, root, build)
    return materialise(index, "targets", 1, root, lambda: index.sparkSession.range(0))


def _run_files(spark, d, w=None):
    """Prediction files of the four runs, one folder per run, one run cut short."""
    path = scratch_path(spark, "runs")
    m = I.matched(spark, d, w).where((F.col("tag") != "beta_s2") | (F.col("win_idx") % 2 == 0))
    m.select("tag", F.format_string("w%d_%d", "rec", "win_idx").alias("window_id"),
             *[F.col(f"{c}_pred").alias(c) for c in V.VEL]).write.partitionBy("tag").option(
        "header", True).csv(path)
    return path


@query("run_files", "tag:string n:bigint", "vx", f"""{Q.EVAL} SELECT tag, count(*) AS n, avg(vx_pred) AS vx
FROM er WHERE tag <> 'beta_s2' GROUP BY tag""")
def run_files(spark, d):
    """Runs read back from their files; the one with missing windows is left out."""
    n = I.truth(spark, d).count()
    runs = tables.read_runs(spark, [_run_files(spark, d) + "/*"], r"tag=([^/]+)/", n)
    return runs.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.avg("vx").alias("vx"))


@query("incremental_scores", "tag:string fold:string n:bigint", "ave", f"""{Q.EVAL} SELECT tag,
CASE WHEN tag LIKE 'alpha%' THEN 'fold_one' ELSE 'fold_two' END AS fold, count(*) AS n, avg(err) AS ave
FROM er WHERE tag <> 'beta_s2' OR win_idx % 2 = 0 GROUP BY 1, 2""")
def incremental_scores(spark, d):
    """New prediction files are scored once each by a file stream."""
    truth = I.truth(spark, d).select(F.format_string("w%d_%d", "rec", "win_idx").alias("window_id"),
                                     *[F.col(c).alias(f"{c}_gt") for c in V.VEL])
    out = scratch_path(spark, "scores")

    def evaluate(batch, batch_id):
        m = batch.withColumnsRenamed({c: f"{c}_pred" for c in V.VEL}).join(truth, "window_id")
        e = evaluation.with_errors(m)
        e.groupBy("tag", "fold").agg(F.count("err").alias("n"), F.sum("err").alias("total")).write.mode(
            "overwrite").parquet(f"{out}/batch={batch_id}")
    q = incremental.collect_results(
        spark, _run_files(spark, d) + "/*", scratch_path(spark, "seen"),
        {"alpha": "fold_one", "beta": "fold_two"}, evaluate, r"tag=([^/]+)/")
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("tag", "fold").agg(
        F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("ave"))


def _follow(spark, d, name):
    """A table as a file stream; the pattern matches one file or a folder of files."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/[{name[0]}]{name[1:]}.parquet")


def _run_stream(spark, out):
    path = scratch_path(spark, "stream")
    q = (out.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", scratch_path(spark, "stream-state")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


@query("stream_windows", "event_type:string start_s:bigint n:bigint", "mean std", """
SELECT event_type, CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS start_s, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std
FROM events GROUP BY 1, 2 HAVING max(CAST(floor(epoch(ts) / 21600) AS BIGINT)) * 21600 + 21600 <= (SELECT epoch(max(ts)) - 3600 FROM events)""")
def stream_windows(spark, d):
    """Six-hour statistics of a live stream; windows past the watermark are out."""
    stream = _follow(spark, d, "events")
    stream = stream.withColumn("ts", wall_clock("ts")).withColumn("value", F.col("value") + 0.0)
    out = incremental.causal_statistics(stream, "value", ("event_type",), width="6 hours",
                                        lateness="1 hour")
    return _run_stream(spark, out).withColumn("start_s", F.unix_seconds("start"))


@query("stream_rest_scores", "rec:bigint start_s:bigint n:bigint", "score", f"""WITH b AS (SELECT l_suppkey AS rec, epoch(l_shipdate) AS e,
(l_quantity - 25.5) / 10 AS ax, ((l_discount + 0.0) - 0.05) * 20 AS ay, 9.81 + ((l_tax + 0.0) - 0.04) * 20 AS az,
((l_discount + 0.0) - 0.05) * 4 AS wx, ((l_tax + 0.0) - 0.04) * 4 AS wy, (l_quantity - 25.5) / 50 AS wz FROM lineitem),
c AS (SELECT *, CAST(floor(e / 2592000) AS BIGINT) * 2592000 AS start_s FROM b)
SELECT rec, start_s, count(*) AS n, abs(avg(sqrt(ax*ax + ay*ay + az*az)) - 9.81) + avg(sqrt(wx*wx + wy*wy + wz*wz))
       + 0.5 * stddev_pop(sqrt(ax*ax + ay*ay + az*az)) AS score FROM c
WHERE start_s + 2592000 <= (SELECT max(e) - 86400 FROM b) GROUP BY 1, 2""")
def stream_rest_scores(spark, d):
    """Rest score of thirty-day windows, computed causally from a frame stream."""
    s = _follow(spark, d, "lineitem")
    q, dc, t = F.col("l_quantity"), F.col("l_discount") + 0.0, F.col("l_tax") + 0.0
    frames = s.select(
        F.col("l_suppkey").alias("rec"), wall_clock("l_shipdate").alias("ts"),
        ((q - 25.5) / 10).alias("ax"), ((dc - 0.05) * 20).alias("ay"),
        (9.81 + (t - 0.04) * 20).alias("az"), ((dc - 0.05) * 4).alias("wx"),
        ((t - 0.04) * 4).alias("wy"), ((q - 25.5) / 50).alias("wz"))
    out = incremental.causal_rest_windows(frames, I.RIG, "30 days", "1 day")
    return _run_stream(spark, out).withColumn("start_s", F.unix_seconds("start"))


@query("stream_up_filter", "rec:bigint win_idx:int", "ux uy uz", Q.recursive(
    f"{Q.BASE}, {_filter_sql('CAST(0.05 AS DOUBLE)')} " + _avg_sql(("ux", "uy", "uz"), "uf")), digits=5)
def stream_up_filter(spark, d):
    """The up filter over frames that arrive in several batches, a third of the runs of twenty too late for its batch."""
    f, path = I.stored_frames(spark, d), scratch_path(spark, "live")
    late = F.floor(F.col("frame") / 20) % 3 == 1
    for part in (~late, late):
        f.where(part).write.mode("append").parquet(path)
    live = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 8).parquet(path)
    up = _run_stream(spark, stream_up(live, 0.05, I.RIG))
    return W.window_means(up, {c: c for c in ("ux", "uy", "uz")}, I.RIG)


@query("content_md5", "text:string n:bigint", "",
       "SELECT md5(coalesce(url, '') || chr(10) || coalesce(html, '')) AS text, count(*) AS n FROM pages GROUP BY 1")
def content_md5(spark, d):
    """Content fingerprints, counted to find repeats."""
    from sensorframe.sources.views import load
    return load(spark, d, "pages").groupBy(F.md5(F.concat(F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce("html", F.lit(""))).cast("binary")).alias("text")).agg(
        F.count(F.lit(1)).alias("n"))


@query("index_keys", "window_id:string rec:string", "",
       f"{Q.WINDOWS} SELECT 'w' || rec || '_' || win_idx AS window_id, CAST(rec AS VARCHAR) AS rec FROM wm")
def index_keys(spark, d):
    """An index written as CSV and read back: ids cleaned, empty columns gone."""
    path = scratch_path(spark, "index")
    I.truth(spark, d).select(
        F.format_string("w%d_%d", "rec", "win_idx").alias("window_id"),
        F.concat(F.col("rec").cast("string"), F.lit(".npz")).alias("traj_id"), "win_idx",
        F.lit(None).cast("string").alias("note")).write.option("header", True).csv(path)
    df = tables.read_window_index(spark, path)
    if "note" in df.columns:
        raise ValueError("an all-null column was kept")
    return df.withColumn("rec", normalise_key("rec"))


# ---------------------------------------------------- files written and read back
@query("targets_file", "window_id:string", "vx vy vz", f"{Q.WINDOWS} SELECT 'w' || rec || '_' || win_idx AS window_id, vx, vy, vz FROM wm")
def targets_file(spark, d):
    """Targets as two CSV files with different column orders, read by name."""
    path = scratch_path(spark, "targets")
    t = I.truth(spark, d).select(F.format_string("w%d_%d", "rec", "win_idx").alias("window_id"), *V.VEL, "win_idx")
    even = F.col("win_idx") % 2 == 0
    t.where(even).select("window_id", "vx", "vy", "vz").write.option("header", True).csv(f"{path}/a")
    t.where(~even).select("vz", "win_idx", "window_id", "vy", "vx").write.option("header", True).csv(f"{path}/b")
    return tables.read_targets(spark, f"{path}/*")


def _archive(spark, d, root, block=4096):
    """Frames written as archives, one per recording and ``block`` frames, so that a task holds a bounded part."""
    cols = ("ax", "ay", "az", "wx", "wy", "wz", "vx", "vy", "vz")

    def write(pdf, bounds):
        for i, j in zip(bounds[:-1], bounds[1:]):
            g = pdf.iloc[i:j]
            rec, part = int(g["rec"].iloc[0]), int(g["part"].iloc[0])
            write_archive(root, f"s{rec % 3}", f"{rec}_{part}", {
                "imu": g[list(cols[:6])].to_numpy(), "vel_body": g[list(cols[6:])].to_numpy(), "fs": np.array(I.RIG.fs)})
        return pdf.iloc[bounds[:-1]][["rec", "part"]]
    parts = sensor_view(spark, d).select("rec", F.floor(F.col("frame") / block).alias("part"), "frame", *cols)
    return map_groups(parts, ["rec", "part"], ["frame"], write, "rec bigint, part bigint").count()


@query("recordings_by_split", "rec:bigint n:bigint", "ax vz ts", f"""{Q.BASE} SELECT rec, count(*) AS n, avg(ax) AS ax, avg(vz) AS vz,
avg((frame % 4096) / 50.0) AS ts FROM sv WHERE rec % 3 = 1 GROUP BY rec""")
def recordings_by_split(spark, d):
    """Archives written from the frames and read back by the data source; other splits are not opened."""
    root = scratch_path(spark, "archives")
    _archive(spark, d, root)
    frames = read_archives(spark, root, split="s1")
    return frames.groupBy(F.split("rec", "_")[0].cast("bigint").alias("rec")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("ax", "vz", "ts")])


@query("recordings_stream", "split:string n:bigint", "wz", f"""{Q.BASE} SELECT 's' || rec % 3 AS split, count(*) AS n, avg(wz) AS wz
FROM sv GROUP BY 1""")
def recordings_stream(spark, d):
    """All archives read once by a stream of the data source."""
    root = scratch_path(spark, "archives")
    _archive(spark, d, root)
    frames = follow_archives(spark, root).select("split", "wz")
    return _run_stream(spark, frames).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("wz").alias("wz"))


@query("exactly_once_scores", "tag:string fold:string n:bigint", "ave", f"""{Q.EVAL} SELECT tag,
CASE WHEN tag LIKE 'alpha%' THEN 'fold_one' ELSE 'fold_two' END AS fold, count(*) AS n, avg(err) AS ave
FROM er WHERE tag <> 'beta_s2' OR win_idx % 2 = 0 GROUP BY 1, 2""")
def exactly_once_scores(spark, d):
    """The stream breaks down between evaluation and commit, is started again, and counts every file once."""
    truth = I.truth(spark, d).select(F.format_string("w%d_%d", "rec", "win_idx").alias("window_id"),
                                     *[F.col(c).alias(f"{c}_gt") for c in V.VEL])
    files, out, seen = _run_files(spark, d) + "/*", scratch_path(spark, "scores"), scratch_path(spark, "seen")

    def evaluate(batch):
        m = batch.withColumnsRenamed({c: f"{c}_pred" for c in V.VEL}).join(truth, "window_id")
        return evaluation.with_errors(m).groupBy("tag", "fold").agg(F.count("err").alias("n"), F.sum("err").alias("total"))

    def run(before_commit=None):
        q = incremental.collect_once(spark, files, seen, out, {"alpha": "fold_one", "beta": "fold_two"}, evaluate,
                                     r"tag=([^/]+)/", before_commit=before_commit)
        q.awaitTermination()

    def breakdown(batch_id):
        raise RuntimeError("broken off between evaluation and commit")
    try:
        run(breakdown)
    except StreamingQueryException:
        pass
    run()
    run()  # nothing new
    return incremental.committed(spark, out).groupBy("tag", "fold").agg(
        F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("ave"))


@query("frames_by_split", "rec:bigint n:bigint", "ax vz", f"""{Q.BASE} SELECT rec, count(*) AS n, avg(ax) AS ax, avg(vz) AS vz
FROM sv WHERE rec % 3 = 1 GROUP BY rec""")
def frames_by_split(spark, d):
    """The frame table written by split; only the asked split's folder is read."""
    path = scratch_path(spark, "frames")
    named = F.concat(F.lit("s"), (F.col("rec") % 3).cast("string"))
    tables.write_frames(sensor_view(spark, d).select("rec", "frame", "ax", "vz", named.alias("split")), path)
    return tables.read_frames(spark, path, "s1").groupBy("rec").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ax").alias("ax"), F.avg("vz").alias("vz"))


@query("fold_document", "rec:string", "", "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS rec FROM lineitem WHERE l_suppkey % 4 = 0")
def fold_document(spark, d):
    """A fold document written as JSON; its held recordings are read back."""
    path = scratch_path(spark, "fold")
    held = I.truth(spark, d).where(F.col("rec") % 4 == 0).select(F.col("rec").cast("string").alias("rec")).distinct()
    held.agg(F.collect_set("rec").alias("held")).withColumn("note", F.lit("every fourth")).write.json(path)
    return tables.held_recordings(tables.read_fold(spark, path))


@query("result_tables", "tag:string platform:string n_rec:int", "ave share", f"""{Q.EVAL},
p AS (SELECT tag, platform, count(DISTINCT rec) AS n_rec, avg(err) AS ave FROM er GROUP BY 1, 2)
SELECT tag, platform, n_rec, ave, round(100 * ave / sum(ave) OVER (PARTITION BY tag), 1) AS share FROM p""", digits=4)
def result_tables(spark, d):
    """Published platform tables of all runs: one CSV per run, percent texts, read back with the run's tag."""
    from pyspark.sql import Window
    path = scratch_path(spark, "results")
    p = I.errors(spark, d).groupBy("tag", "platform").agg(F.countDistinct("rec").alias("n_traj"), F.avg("err").alias("ave"))
    share = F.round(100 * F.col("ave") / F.sum("ave").over(Window.partitionBy("tag")), 1)
    p = p.withColumn("share", share).select(F.concat("tag", F.lit("_platform.csv")).alias("file"), F.col("platform").alias("Platform"),
                                            F.col("ave").alias("AVE (m/s)"), "n_traj", F.concat(F.col("share").cast("string"), F.lit("%")).alias("share of score"))
    p.write.partitionBy("file").option("header", True).csv(path)
    found = spark.read.option("header", True).csv(path)
    # one folder per file name: the reader takes the tag from the path's name
    return tables.tidy_results(found.withColumnRenamed("file", "_path"), "platform")


@query("solution_file", "window_id:string", "qx gz vx_gt", Q.recursive(f"""{Q.WINDOWS}
SELECT 'w' || rec || '_' || win_idx AS window_id, wx AS qx, az AS gz, vx AS vx_gt FROM wm"""))
def solution_file(spark, d):
    """A solution table written as CSV and read back with its schema."""
    from sensorframe import schema
    path = scratch_path(spark, "solution")
    t = I.means(spark, d).select(F.format_string("w%d_%d", "rec", "win_idx").alias("window_id"), F.col("rec").cast("string").alias("traj_id"),
                                 "win_idx", F.lit("p").alias("platform"), *[F.col(a).alias(b) for a, b in (
                                     ("wx", "qx"), ("wy", "qy"), ("wz", "qz"), ("ax", "qw"), ("ax", "gx"), ("ay", "gy"), ("az", "gz"))],
                                 F.lit(1.0).alias("dt"), *[F.col(f"v{a}").alias(f"v{a}_gt") for a in "xyz"])
    tables.write_solution(t, path)
    return spark.read.schema(schema.SOLUTION).option("header", True).csv(path)


@query("index_with_targets", "window_id:string rec:bigint win_idx:bigint", "vx vz", f"""{Q.WINDOWS}
SELECT 'w' || rec || '_' || win_idx AS window_id, rec, win_idx, vx, vz FROM wm WHERE win_idx % 4 <> 3""")
def index_with_targets(spark, d):
    """The index joined to a target table that lacks some windows."""
    from sensorframe.operators.relational import with_targets
    targets = I.truth(spark, d).where(F.col("win_idx") % 4 != 3).select(
        F.format_string("w%d_%d", "rec", "win_idx").alias("window_id"), *V.VEL)
    return with_targets(_index(spark, d), targets)
