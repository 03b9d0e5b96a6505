"""Registered queries: profiles and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import checks, disclosure, profiles, sequence
from skyledger.plans.queries_rows import wild
from skyledger.plans.queries_sequences import parked
from skyledger.plans.views import register

NUM = ("time", "lat", "lon", "baroaltitude", "velocity", "heading", "vertrate", "dist_to_runway_m")


@register("endpoint_stats")
def _(v):
    return profiles.endpoint_stats(v.d21)


@register("engagement_flags")
def _(v):
    return profiles.engagement_flags(v.d21)


@register("engagement_subsets")
def _(v):
    return profiles.engagement_flags(v.d21).groupBy("by_approach", "by_onground", "by_takeoff").agg(F.count(F.lit(1)).alias("flights"))


@register("direction_of_operation")
def _(v):
    rows = v.d21.withColumn("onground", F.expr("(k % 3 = 0 AND i < 2) OR (k % 4 = 0 AND i >= 25)"))
    return profiles.direction_of_operation(profiles.endpoint_stats(rows))


@register("phase_composition")
def _(v):
    return profiles.phase_composition(v.d21)


@register("operation_flights")
def _(v):
    return v.d21.withColumn("operation", F.expr("CASE WHEN k % 3 = 0 THEN 'arrival' WHEN k % 3 = 1 THEN 'departure' ELSE 'unknown' END")).groupBy("operation").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("flight_id").alias("flights"))


@register("column_profile")
def _(v):
    return profiles.column_profile(v.d21, NUM, ("flight_id", "callsign", "flight_phase"))


@register("null_by_state")
def _(v):
    return profiles.null_by_state(parked(v), ("velocity", "baroaltitude", "heading"))


@register("scale_profile")
def _(v):
    return profiles.scale_profile(v.d21, NUM[1:])


@register("length_quantiles")
def _(v):
    return profiles.length_quantiles(v.obs)


@register("length_ecdf")
def _(v):
    return profiles.length_ecdf(v.obs)


@register("long_tail_profile")
def _(v):
    # flights are joined per aircraft, to one to five of uneven length, so that some lie above the mark
    joined = v.obs.withColumn("flight_id", F.expr("concat(icao24, '_', CAST(k div 60 % (1 + k % 5) AS STRING))"))
    return profiles.long_tail_profile(joined)


@register("gap_histogram")
def _(v):
    return profiles.gap_histogram(v.obs)


@register("histogram_60")
def _(v):
    return profiles.histogram_60(v.d21, ("lat", "lon", "velocity", "vertrate", "dist_to_runway_m"))


@register("motion_tail_counts")
def _(v):
    return profiles.motion_tail_counts(wild(v).withColumn("heading", F.expr("pmod(heading + (i % 5) * 9, 360D)")))


@register("extreme_topk")
def _(v):
    return profiles.extreme_topk(wild(v).withColumn("velocity", F.expr("velocity + k * 1e-3D")))


@register("extreme_quantiles", digits=1)
def _(v):
    return profiles.extreme_quantiles(wild(v).withColumn("velocity", F.expr("velocity + k * 1e-3D")))


@register("impossible_share")
def _(v):
    return profiles.impossible_share(wild(v))


@register("ground_air_split")
def _(v):
    return profiles.ground_air_split(v.d21.withColumns({"heading": F.expr("pmod(heading + (i % 5) * 9, 360D)"), "onground": F.expr("i < 6")}))


@register("derived_vs_reported")
def _(v):
    return profiles.derived_vs_reported(v.obs, 5)


@register("volume_coverage")
def _(v):
    return profiles.volume_coverage(v.obs.withColumn("batch", F.expr("CASE WHEN time < 1530000000 THEN 'a' ELSE 'b' END")), "batch")


@register("turning_and_range")
def _(v):
    return profiles.turning_and_range(v.seg.withColumn("heading", F.expr("pmod(heading + (i % 4) * 40, 360D)")))


@register("channel_summary")
def _(v):
    return profiles.channel_summary(v.seg, ("lat", "vertrate", "dist_to_runway_m"))


# ---- checks -----------------------------------------------------------------------------------

@register("check_critical_nulls")
def _(v):
    return checks.critical_nulls(v.d21)


@register("check_bounds")
def _(v):
    return checks.bounds_report(wild(v))


@register("check_region")
def _(v):
    spread = v.obs.withColumns({"lat": F.expr("lat + (k % 9 - 4) * 0.6D"), "lon": F.expr("lon + (k % 7 - 3) * 0.8D")})
    return spread.agg(F.count_if(checks.outside_region()).alias("outside"), F.count(F.lit(1)).alias("n_rows"))


@register("check_consistency")
def _(v):
    drift = v.d21.withColumn("flight_phase", F.expr("CASE WHEN i = 7 THEN 'cruise' ELSE flight_phase END"))
    return checks.consistency_report(drift)


@register("dataset_verdict")
def _(v):
    return checks.dataset_verdict(v.d21.drop("k", "i", "lastposupdate"))


@register("dataset_digest")
def _(v):
    """Digests agree for two orders of the same rows and differ for other rows."""
    rows = v.obs.withColumns({"dataset": F.expr("CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END")}).select("dataset", "icao24", "time", "lat", "lon")
    first, again = disclosure.dataset_digest(rows, "dataset"), disclosure.dataset_digest(rows.repartition(13, "time"), "dataset")
    same = first.join(again.withColumnRenamed("digest", "d2").drop("n_rows"), "dataset")
    return same.select("dataset", "n_rows", (F.col("digest") == F.col("d2")).alias("stable"))


@register("referential_integrity")
def _(v):
    left = v.obs.select("flight_id").distinct().filter("flight_id NOT LIKE '%1'")
    right = v.obs.groupBy("flight_id").agg(F.min("k").alias("k")).select("flight_id", F.explode(F.expr("CASE WHEN k % 50 = 0 THEN array(1, 2) ELSE array(1) END")).alias("n"))
    return disclosure.membership_violations(left, right, "flight_id")


@register("recomputed_parity")
def _(v):
    stored = v.obs.groupBy("flight_id").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("n_rows"), F.max("time").alias("end_time")).select(
        "flight_id", F.expr("CASE WHEN k % 40 = 0 THEN n_rows + 1 ELSE n_rows END").alias("n_rows"), F.expr("CASE WHEN k % 60 = 0 THEN NULL ELSE end_time END").alias("end_time"))
    fresh = v.obs.groupBy("flight_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("time").alias("end_time"))
    return disclosure.parity_violations(stored, fresh, "flight_id", ["n_rows", "end_time"])


@register("count_map")
def _(v):
    """Counts by two categories as one long table."""
    rows = v.d21.select(F.explode(F.array(F.struct(F.lit("phase").alias("map"), F.col("flight_phase").alias("key")), F.struct(F.lit("squawk").alias("map"), F.col("squawk").cast("string").alias("key")))).alias("e"))
    return rows.groupBy("e.map", "e.key").agg(F.count(F.lit(1)).alias("n"))


@register("id_set_overlap")
def _(v):
    sets = v.obs.groupBy("flight_id").agg(F.max(F.col("vertrate") > 0).alias("a"), F.max(F.col("onground") | (F.col("velocity") > 80.5)).alias("b"))
    sets = sets.select(F.coalesce("a", F.lit(False)).alias("a"), F.coalesce("b", F.lit(False)).alias("b"))
    a, b = F.col("a"), F.col("b")
    return sets.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"),
                    (F.count_if(a & b) / F.greatest(F.count_if(a), F.count_if(b), F.lit(1))).alias("overlap"))
