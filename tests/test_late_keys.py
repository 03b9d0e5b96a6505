"""Queries on order keys far beyond those of the given tables, whose derived times lie decades later."""

import duckdb
import pytest

import __spark_entry__ as entry
from skyledger.sources import day_ranges
from tests.compare import compare, connect


@pytest.fixture(scope="module", params=[900_000, 9_000_000])
def late(request, tmp_path_factory):
    """A folder whose orders have keys that lead to times after 2033, or after 2200."""
    folder = tmp_path_factory.mktemp("late")
    duckdb.sql(f"COPY (SELECT o_orderkey + {request.param} AS o_orderkey FROM '/root/testdata/sf0.001/orders.parquet') TO '{folder}/orders.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["build_master_table", "scan_by_day_ranges"])
def test_late_flights_match_sql(spark, late, name):
    result = compare(spark, connect(late), name, entry.queries()[name], entry.oracle_sql()[name], late)
    assert result["ok"] and result["rows"] > 0, result["note"]


def test_a_task_writes_to_few_day_ranges(spark, tmp_path):
    rows = spark.range(0, 400, numPartitions=8).selectExpr("(id * 37) % 400 * 86400 AS time", "id")
    day_ranges.write_by_day_ranges(rows, str(tmp_path / "days"), days=10)
    files = list((tmp_path / "days").glob("range_start=*/*.parquet"))
    assert len({f.parent for f in files}) == 40 and len(files) < 60
    assert day_ranges.scan_stored_day_ranges(spark, str(tmp_path / "days"), rows.schema, days=10).count() == 400
