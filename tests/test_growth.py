"""What keeps the work of a query in proportion to its tables: tasks, stored steps and where columns are computed."""

from pyspark.sql import functions as F

from skyledger.operators import approach, inject, resample
from skyledger.plans import queries_assess, queries_research
from skyledger.plans.views import PREP, Views
from skyledger.sources import derived

SMALL = "/root/testdata/sf0.001"


def test_attempts_are_dealt_over_the_tasks_asked_for(spark):
    obs = derived.observations(spark, SMALL)
    found = approach.extract_attempts(obs, tasks=23)
    assert found.rdd.getNumPartitions() == 23
    assert found.exceptAll(approach.extract_attempts(obs)).isEmpty()


def test_shared_columns_are_computed_once_per_order(spark):
    plan = derived.observations(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode", 1)
    assert "concat(FLT" in below and "concat(FLT" not in above
    assert {"flight_id", "t0", "squawk"}.isdisjoint(derived.MOVING) and {"lat", "time", "velocity"} <= derived.MOVING


def test_fits_derive_the_attempts_once(spark):
    v = Views(spark, SMALL)
    train, every = queries_assess.train_attempts(v), queries_assess.typed_attempts(v)
    for rows in (train, every):
        assert "visit0" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert every.count() == v.stored_attempts.count() > 0
    assert train.agg(F.max("time")).first()[0] < 1_546_300_800 + 3_600 and train.count() > 0


def test_cleaning_deals_flights_over_the_tasks_asked_for(spark):
    v = Views(spark, SMALL)
    clean = resample.preprocess(v.d21, PREP, 23)
    assert clean.rdd.getNumPartitions() == 23
    assert clean.exceptAll(resample.preprocess(v.d21, PREP)).isEmpty()


def test_one_sort_serves_the_windows_of_a_segment(spark):
    plan = resample.preprocess(Views(spark, SMALL).d21, PREP, 23)._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort [flight_id" in line and "segment_id" in line]
    assert sorts and all("time" in line for line in sorts)


def test_draws_are_made_only_for_the_kind_that_uses_them(spark, monkeypatch):
    uses = {"mag_": "zone_violation", "climb_": "altitude_high", "target_": "final_approach_intercept", "factor_": "speed_spike"}
    monkeypatch.setattr(inject, "replay_derived", lambda df: df.withColumns({f"seen_{c}": F.col(c) for c in uses}))
    rows = inject.inject(queries_research.eval_source(Views(spark, SMALL)))
    for name, kind in uses.items():
        assert {r.kind for r in rows.filter(F.col(f"seen_{name}").isNotNull()).select("kind").distinct().collect()} <= {kind}


def test_the_corridors_share_one_backward_sort(spark):
    plan = approach.extract_attempts(Views(spark, SMALL).masked)._jdf.queryExecution().executedPlan().toString()
    assert "visit0" in plan
    assert sum("Sort [flight_id" in line for line in plan.splitlines()) <= 5


def test_variants_are_listed_without_an_array_per_row(spark):
    rows = derived.with_masks(derived.observations(spark, SMALL))
    assert "array_compact" not in (plan := rows._jdf.queryExecution().optimizedPlan().toString()) and "filter(array" not in plan
    kinds = {r.variant: r.n for r in rows.selectExpr("CASE WHEN lat_missing THEN 1 WHEN lat IS NULL THEN 3 ELSE 0 END AS variant").groupBy("variant").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = derived.observations(spark, SMALL).selectExpr("count_if((k + i) % 7 = 3) AS a", "count_if((k + i) % 13 = 5) AS b").first()
    assert (kinds[1], kinds[3]) == (want.a, want.b)
