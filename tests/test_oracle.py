"""Registered queries against their SQL. ORACLE_ALL=1 runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = ("segment_flights", "dedupe_observations", "merge_intervals", "infer_runway", "assess_operations", "asof_weather", "flag_impossible",
         "sliding_windows", "suppression_recoverable", "severity_band", "reconstruction_scores", "knn_score", "isolation_forest", "bootstrap_ci", "reject_summary", "error_position_report",
         "column_profile")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = sorted(QUERIES) if os.environ.get("ORACLE_ALL") else QUICK


def test_every_sql_has_a_query():
    assert not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    result = compare(spark, connect(SF), name, QUERIES[name], SQL.get(name), SF)
    assert result["ok"], result["note"]
