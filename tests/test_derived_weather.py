"""The derived half-hourly reports: dealt over the tasks, and never broadcast by the as-of join."""

from skyledger.operators import context
from skyledger.sources import derived

DAY = 86_400


def span(spark, days):
    return spark.sql(f"SELECT * FROM VALUES (3600L), ({days * DAY + 5000}L) AS t(time)")


def test_reports_of_a_long_span_are_spread_and_complete(spark):
    wx = derived.weather_reports(span(spark, 40))
    assert wx.rdd.getNumPartitions() > 1
    ends = range(3_600, 40 * DAY + 7_200 + 1, 1_800)
    assert sorted(r.observed_at for r in wx.select("observed_at").collect()) == [t for t in ends if t // 1_800 % 20 != 7]


def test_asof_join_broadcasts_one_row_per_station_only(spark):
    wx = derived.weather_reports(span(spark, 40))
    attempts = spark.sql("SELECT * FROM VALUES ('a', 1L, 10000L, '08221099999'), ('b', 1L, 9999999L, '08221099999'), ('c', 1L, 0L, '08221099999'), ('d', 1L, 10000L, 'x') AS t(flight_id, cluster, midpoint, station)")
    joined = context.asof_weather(attempts, wx)
    assert joined._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1
    got = {r.flight_id: (r.observed_at, r.weather_reason) for r in joined.collect()}
    assert got["a"] == (9_000, None) and got["d"] == (None, "weather_observation_unavailable")
    assert got["b"][0] == 40 * DAY + 7_200 and got["b"][1] == "latest_prior_weather_observation_too_old"
    assert got["c"] == (None, "weather_observation_not_yet_available")


def test_tasks_for_flights_grow_with_the_orders(spark, tmp_path):
    spark.range(1000).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    assert derived.flight_tasks(spark, str(tmp_path), 10) == 100
    assert derived.flight_tasks(spark, str(tmp_path)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
