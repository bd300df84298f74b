"""Registered queries against their SQL on the smallest tables.

Set SENSORFRAME_ALL=1 to run every query (several minutes).
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"
SOME = ("rest_anchor", "window_targets", "macro_score", "sweep_table", "tail_share", "fold_split",
        "calm_frames", "pose_lookup", "variable_shift", "truth_up", "canonical_up",
        "moving_average_same", "lerp_resample", "chunks", "stitch_center", "gated_recursion",
        "attitude_scan", "window_increments", "up_filter_blocked", "histogram_percentiles",
        "lag_correlation", "recording_summary", "weighted_draw", "time_dilation", "yaw_turn",
        "stream_windows", "incremental_scores", "materialised_targets")
NAMES = list(entry.queries()) if os.environ.get("SENSORFRAME_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    good, note = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert good, note


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 10
