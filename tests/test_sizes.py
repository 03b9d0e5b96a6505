"""What keeps time and disk of a query in proportion to its tables, and that its results stay exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skyledger.operators import checks, disclosure, draws, inject, metrics
from skyledger.operators.splits import hash_uniform
from skyledger.plans import queries_assess
from skyledger.plans.views import Views
from skyledger.sources import derived, readers

SMALL = "/root/testdata/sf0.001"


def test_draws_in_numpy_are_those_of_the_hash(spark):
    ids = ["a00012_1496620800#1", None, "", "é" * 30, *["x" * n for n in range(44, 60)], "z" * 130]
    rows = spark.createDataFrame(list(enumerate(ids)), "at int, id string").crossJoin(spark.range(120).withColumnRenamed("id", "rep"))
    drawn = rows.select("at", "rep", metrics.poisson_draw(hash_uniform(F.col("id"), 42, F.col("rep").cast("string"))).alias("w")).collect()
    got = draws.poisson_weights(ids, 42, 120)
    assert len(drawn) == got.size and all(got[r.at, r.rep] == r.w for r in drawn)


def brute(rows, replicates):
    weights = draws.poisson_weights([r[0] for r in rows], 42, replicates).astype(float)
    score, positive = np.array([r[1] for r in rows]), np.array([r[2] == 1 for r in rows])
    won = (score[positive][:, None] > score[~positive][None, :]) + 0.5 * (score[positive][:, None] == score[~positive][None, :])
    found = []
    for w in weights.T:
        p, n = w[positive], w[~positive]
        if p.sum() * n.sum():
            found.append(p @ won @ n / (p.sum() * n.sum()))
    return (*np.quantile(found, [0.025, 0.975]), len(found))


@pytest.mark.parametrize("block", (4_000, 30, 1))
def test_bootstrap_with_ties_nulls_and_copies(spark, block):
    rows = [(f"s{i % 331}" if i % 50 else None, float(i % 7) if i % 3 else i / 100, None if i % 41 == 0 else int(i % 5 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "segment_id string, score double, label int")
    assert tuple(metrics.bootstrap_auroc(df, replicates=60, rows_per_block=block).first()) == pytest.approx(brute(rows, 60), abs=1e-12)


def test_bootstrap_pieces_are_not_joined_into_one_task(spark):
    rows = spark.range(3_000).select(F.col("id").cast("string").alias("segment_id"), (F.col("id") % 997).cast("double").alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    plan = metrics.bootstrap_auroc(rows, replicates=10, rows_per_block=100)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "REPARTITION_BY_NUM" in plan


def test_row_numbers_move_no_row(spark, tmp_path):
    spark.range(1_000).select(F.col("id").cast("string").alias("a")).coalesce(1).write.csv(str(tmp_path / "in"), header=True)
    rows = readers.scan_upload_csv(spark, str(tmp_path / "in"), ["a"])
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    numbered, sizes = plan.split("BroadcastExchange", 1)
    assert "Exchange hashpartitioning" not in numbered and "Exchange hashpartitioning" in sizes


def test_reports_by_month_are_the_observations(spark):
    obs = derived.observations(spark, SMALL).withColumn("month", F.date_format(F.timestamp_seconds("time"), "yyyyMM"))
    found = derived.observations_by_month(spark, SMALL, 23)
    assert found.rdd.getNumPartitions() == 23
    assert obs.count() == found.count() and obs.exceptAll(found.select(obs.columns)).isEmpty()
    tasks = found.select("month", F.spark_partition_id().alias("t")).distinct().groupBy("month").count()
    assert tasks.filter("count > 1").isEmpty()


def test_orders_at_the_turn_of_a_month_and_repeated_ones(spark, tmp_path):
    """An order whose reports reach into the next month, the same order twice, and one without a key."""
    turn = spark.range(400_000).selectExpr("id AS o_orderkey")
    turn.write.parquet(str(tmp_path / "all" / "orders.parquet"))
    obs = derived.observations(spark, str(tmp_path / "all")).withColumn("month", F.date_format(F.timestamp_seconds("time"), "yyyyMM"))
    split = obs.groupBy((F.col("k") * 10 + F.expr("i div 8")).alias("o_orderkey")).agg(F.count_distinct("month").alias("n")).filter("n > 1").select("o_orderkey").limit(5)
    some = [r.o_orderkey for r in split.collect()]
    assert some
    spark.createDataFrame([(o,) for o in [*some, some[0], None, 11, 11]], "o_orderkey long").write.parquet(str(tmp_path / "few" / "orders.parquet"))
    few = str(tmp_path / "few")
    want = derived.observations(spark, few).withColumn("month", F.date_format(F.timestamp_seconds("time"), "yyyyMM"))
    got = derived.observations_by_month(spark, few, 3).select(want.columns)
    assert want.count() > 0 and want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_cells_of_an_upload_are_read_once(spark):
    text = spark.createDataFrame([("1", "a", "1", "2", "null", "False", "x"), (None, " NaN ", "95", "2", "3", "maybe", "y" * 17), ("1.5", "b", "fast", "inf", "3", "1.0", "na")],
                                 "time string, icao24 string, lat string, lon string, velocity string, onground string, aircraft_typecode string")
    bad = checks.error_report(checks.canonical_values(text))
    filters = [line for line in bad._jdf.queryExecution().executedPlan().toString().splitlines() if "Filter" in line]
    assert filters and not any("trim(" in line for line in filters)
    got = {r.icao24: ({(e.field, e.code) for e in r.errors}, r.onground, r.velocity) for r in bad.collect()}
    assert got == {None: ({("time", "required"), ("icao24", "required"), ("position", "range"), ("onground", "boolean"), ("aircraft_typecode", "length")}, None, 3.0),
                   "b": ({("time", "range"), ("lat", "numeric"), ("lon", "numeric")}, True, 3.0)}


def test_comparison_kinds_share_one_shuffle_and_sort(spark):
    found = entry.queries()["inject_comparison_kinds"](spark, SMALL)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("Union") == 0 and text.count("FileScan") <= 3
    assert sum("Sort [flight_id" in line for line in text.splitlines()) <= 1


@pytest.mark.parametrize("kind,size", inject.COMPARISON_KINDS)
def test_a_prefix_keeps_the_channels_and_adds_the_same_changes(spark, kind, size):
    rows = [("f", "f#1", 10 * i, i, 8, 4, max(0.0, (i - 4) / 3), "comparison", 40.4 + i / 100, -3.5, 900.0 - i, 80.0, -4.0, 170.0) for i in range(8)]
    df = spark.createDataFrame(rows, "flight_id string, segment_id string, time long, step int, n long, onset long, ramp double, kind string, lat double, lon double, baroaltitude double, velocity double, vertrate double, heading double")
    df = df.withColumn("geoaltitude", F.col("baroaltitude"))
    alone = {r.step: r.asDict() for r in inject.inject_comparison(df, kind, size).collect()}
    beside = inject.inject_comparison(df, kind, size, into="x_")
    got = {r.step: r.asDict() for r in beside.collect()}
    for r in df.collect():
        assert {c: got[r.step][c] for c in df.columns} == r.asDict()
        assert {c: got[r.step].get(f"x_{c}", got[r.step].get(c)) for c in alone[r.step]} == alone[r.step]
    assert "x_dist_to_runway_m" in beside.columns and not any(c.endswith("0_") for c in beside.columns)


def test_recoverable_cells_count_the_attempts_once(spark):
    cells = [("a", "x", 1), ("a", "y", 10), ("b", "x", 3), ("b", "y", 40), ("c", "x", 5)]
    counts = spark.createDataFrame(cells, "section string, key string, n long").withColumn("n", F.col("n") + F.expr("CAST(0 * length(uuid()) AS BIGINT)"))
    found = disclosure.suppression_recoverable(counts, ["section"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "uuid" not in plan
    assert {(r.section, r.key) for r in found.collect()} == {("a", "x"), ("c", "x")}


def test_facts_of_the_context_are_not_derived_again(spark, monkeypatch):
    derived_again = []
    monkeypatch.setattr(Views, "context", property(lambda v: derived_again.append(v)))
    assert queries_assess.contextual(Views(spark, SMALL)).count() > 0
    assert not derived_again
