"""Files: recordings, index tables, folds, results, feature tables, published numbers."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.plans import evaluation as E
from sensorframe.sources import recordings as R
from sensorframe.sources import tables as T


def write_recording(path, n, quat=True, ragged=0):
    rng = np.random.default_rng(n)
    arrays = {"imu": rng.normal(size=(n, 6)), "vel_body": rng.normal(size=(n - ragged, 3)),
              "pos": rng.normal(size=(n, 3)), "ts": np.arange(n) / 200.0, "fs": np.array(200.0)}
    if quat:
        arrays["quat"] = rng.normal(size=(n, 4))
    path.parent.mkdir(parents=True, exist_ok=True)
    np.savez(path, **arrays)
    return arrays


def test_decode_recordings(spark, tmp_path):
    a = write_recording(tmp_path / "car" / "car_0001.npz", 450, ragged=10)
    write_recording(tmp_path / "dog" / "dog_0002.npz", 30, quat=False)
    got = R.decode(spark, str(tmp_path), rows_per_batch=100)
    n = dict(got.groupBy("rec").count().collect())
    assert n == {"car_0001": 440, "dog_0002": 30}
    row = got.where("rec = 'car_0001' and frame = 439").first()
    assert row["wz"] == a["imu"][439, 5] and row["qw"] == a["quat"][439, 3]
    assert got.where("rec = 'dog_0002' and qw is not null").count() == 0
    assert {r["rec"] for r in R.discover(spark, str(tmp_path)).collect()} == set(n)
    assert R.content_md5(spark, str(tmp_path)).count() == 2
    R.ingest(spark, str(tmp_path), "car", str(tmp_path / "out"))
    back = T.read_frames(spark, str(tmp_path / "out"), "car")
    assert back.count() == 440


def test_index_fold_and_results(spark, tmp_path):
    (tmp_path / "w.csv").write_text("window_id,traj_id,win_idx,empty\na,r_0001.npz,0,\nb,r_0002,1,\n")
    idx = T.read_window_index(spark, str(tmp_path / "w.csv"))
    assert sorted(idx.columns) == ["rec", "win_idx", "window_id"]
    assert {r["rec"] for r in idx.collect()} == {"r_0001", "r_0002"}
    (tmp_path / "f.json").write_text(json.dumps(
        {"held": ["a", "b"], "groups": {"a": ["a", "b", "a"]}, "note": "n"}, indent=1))
    fold = T.read_fold(spark, str(tmp_path / "f.json"))
    assert T.held_recordings(fold).count() == 2
    (tmp_path / "x_s42_platform.csv").write_text(
        "Platform,ATE20 (m),AVE (m/s),RTE (m),n_traj,n_win,share of score\nCar,0.5,0.1,0.2,18,100,9.8%\n")
    row = T.read_results(spark, str(tmp_path / "x_s42_platform.csv"), "platform").first()
    assert (row["tag"], row["share"], row["n_rec"], row["ate"]) == ("x_s42", 9.8, 18, 0.5)


def test_prediction_and_solution_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "window_id string, vx double, vy double, vz double")
    T.write_prediction(df, str(tmp_path / "p"))
    assert T.read_prediction(spark, str(tmp_path / "p")).collect() == df.collect()


def test_feature_table_is_built_once(spark, tmp_path):
    idx = spark.createDataFrame([("a",), ("b",)], "window_id string")
    calls = []
    build = lambda: calls.append(1) or idx.withColumn("v", F.lit(1))
    R.materialise(idx, "k", 1, str(tmp_path), build)
    assert R.materialise(idx, "k", 1, str(tmp_path), build).count() == 2 and len(calls) == 1
    R.materialise(idx, "k", 2, str(tmp_path), build)
    R.materialise(idx.limit(1), "k", 1, str(tmp_path), build)
    assert len(calls) == 3


def test_published_platform_numbers(spark):
    # fixed values: platform means of one published run and its overall score
    rows = [("r", "car", 0.34105, 0.0703), ("r", "human", 0.58245, 0.05459),
            ("r", "dog", 0.3451, 0.08106), ("r", "drone", 1.19955, 0.67472),
            ("r", "drone2", float("nan"), 1.0)]
    recs = spark.createDataFrame(rows, "tag string, platform string, ate double, ave double")
    table = E.platform_scores(recs.withColumn("rec", F.lit("x")))
    assert E.macro_score(table).first()["score"] == pytest.approx(0.25878, abs=1.5e-5)
    share = {r["platform"]: r["share"] * 100 for r in E.score_share(table).collect()}
    for p, want in (("car", 9.8), ("human", 11.5), ("dog", 10.7), ("drone", 68.0)):
        assert share[p] == pytest.approx(want, abs=0.05)
