"""Workers find the packages wherever the driver was started; CSV columns are found by name."""

from __future__ import annotations

import os
import subprocess
import sys


from sensorframe import schema
from sensorframe.session import check_skew_splitting
from sensorframe.sources import tables
from sensorframe.streaming import incremental

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_python_workers_import_the_packages(tmp_path):
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "import __spark_entry__ as e\nfrom sensorframe import build_session\n"
            "s = build_session('elsewhere', 'local[2]', 2)\n"
            "print('ROWS', e.queries()['lag_correlation'](s, '/root/testdata/sf0.001').count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in run.stdout and run.returncode == 0, run.stderr[-2000:]


def _write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def _files(tmp_path):
    _write(tmp_path / "in", "one_s1.csv", "window_id,vx,vy,vz\na,1,2,3\n")
    _write(tmp_path / "in", "two_s1.csv", "vz,note,window_id,vy,vx\r\n6,x,b,5,4\r\n\r\n")
    _write(tmp_path / "in", "three_s1.csv", '"window_id","vy","vx"\n"c",8,7\n')
    return str(tmp_path / "in")


def test_columns_by_name_across_files(spark, tmp_path):
    folder = _files(tmp_path)
    want = {("a", 1.0, 2.0, 3.0), ("b", 4.0, 5.0, 6.0), ("c", 7.0, 8.0, None)}
    rows = tables.read_prediction(spark, folder)
    assert {tuple(r) for r in rows.select("window_id", "vx", "vy", "vz").collect()} == want
    assert {r.note for r in rows.collect()} == {None, "x"}
    runs = tables.read_runs(spark, [folder], r"/(\w+)_s1\.csv$")
    assert {(r.tag, r.vx) for r in runs.collect()} == {("one", 1.0), ("two", 4.0), ("three", 7.0)}


def test_columns_by_name_in_the_stream(spark, tmp_path):
    folder, out = _files(tmp_path), []
    q = incremental.collect_results(spark, folder, str(tmp_path / "seen"), {"one": "f1"}, lambda b, _: out.extend(b.collect()),
                                    r"/(\w+)_s1\.csv$", files_per_trigger=1)
    q.awaitTermination()
    assert {(r.tag, r.window_id, r.vx, r.vz) for r in out} == {("one", "a", 1.0, 3.0), ("two", "b", 4.0, 6.0), ("three", "c", 7.0, None)}


def test_no_lines_no_rows(spark):
    lines = spark.createDataFrame([], "value string, _path string")
    got = tables.lines_by_header(lines, schema.PREDICTION, "window_id")
    assert got.count() == 0 and got.columns == ["_path", "window_id", "vx", "vy", "vz"]


def test_skew_setting_is_checked(spark):
    assert check_skew_splitting(spark)
