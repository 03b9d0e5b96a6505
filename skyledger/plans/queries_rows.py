"""Registered queries: projections, filters and de-duplication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyledger.functions import decode, geo
from skyledger.operators import checks, dedupe, derive, profiles, queue, reference, resample, splits, windows
from skyledger.operators.approach import in_corridor, runway_candidates, usable_track
from skyledger.config import DEFAULT, LANDING_RUNWAYS
from skyledger.operators.sequence import ordered
from skyledger.plans.views import register

ROW = ("flight_id", "time")


def at_runways(v, *extra):
    return runway_candidates(v.obs.select(*ROW, "lat", "lon", *extra))


@register("haversine_m")
def _(v):
    r = LANDING_RUNWAYS[0]
    return v.obs.select(*ROW, geo.haversine_m("lat", "lon", r.lat, r.lon).alias("dist"))


@register("dist_to_closest_runway")
def _(v):
    return v.obs.select(*ROW, geo.closest_runway_m().alias("dist_to_runway_m"))


@register("runway_relative")
def _(v):
    return at_runways(v).select(*ROW, "runway", "along", "cross", "dist")


@register("runway_relative_inverse")
def _(v):
    return at_runways(v).select(*ROW, "runway", geo.runway_to_lat("along", "cross").alias("lat2"), geo.runway_to_lon("along", "cross").alias("lon2"))


@register("circular_difference")
def _(v):
    return at_runways(v, "heading").select(*ROW, "runway", geo.angle_between("heading", "bearing").alias("angle"))


@register("signed_track_offset")
def _(v):
    return at_runways(v, "heading").select(*ROW, "runway", geo.signed_angle("heading", "bearing").alias("offset"))


@register("heading_change_wrapped")
def _(v):
    w = ordered(["flight_id"])
    turned = v.obs.withColumn("heading", F.expr("pmod(heading + i * 37, 360D)"))
    return turned.select(*ROW, geo.folded_change("heading", F.lag("heading").over(w)).alias("heading_change"))


@register("heading_components")
def _(v):
    mixed = v.obs.select(*ROW, F.expr("sin(radians(heading)) * (i % 3)").alias("hdg_sin"), F.expr("cos(radians(heading)) * (i % 3)").alias("hdg_cos"))
    return derive.normalised_heading(mixed)


@register("derived_replay")
def _(v):
    return derive.replay_derived(v.obs.withColumn("hdg_sin", F.lit(9.0))).select(*ROW, "hdg_sin", "hdg_cos", "dist_to_runway_m")


@register("velocity_kmh")
def _(v):
    return v.d21.select(*ROW, "velocity_kmh")


@register("time_utc")
def _(v):
    return v.d21.select(*ROW, F.date_format("time_utc", "yyyy-MM-dd HH:mm:ss").alias("time_utc"))


@register("flight_phase")
def _(v):
    return v.d21.select(*ROW, "flight_phase")


@register("enu_offsets")
def _(v):
    return v.obs.select(*ROW, geo.east_of_airport_m().alias("east"), geo.north_of_airport_m().alias("north"))


@register("time_of_day_cyclic")
def _(v):
    return v.obs.select(*ROW, *[c.alias(n) for n, c in derive.hour_cycle().items()])


@register("altitude_fallback")
def _(v):
    alt = v.obs.select(*ROW, F.coalesce("baroaltitude", "geoaltitude").alias("alt"))
    return resample.interpolate(alt, ["alt"], ["flight_id"])


@register("height_above_threshold")
def _(v):
    return at_runways(v, "baroaltitude").select(*ROW, "runway", (F.col("baroaltitude") - F.col("elevation")).alias("height"))


@register("distance_bin")
def _(v):
    return at_runways(v).select(*ROW, "runway", geo.distance_bin("along").alias("bin"))


def masked(v):
    return v.obs.withColumns({"velocity_missing": F.expr("CASE WHEN i % 4 = 0 THEN NULL WHEN i % 4 = 1 THEN TRUE ELSE FALSE END")})


@register("observed_mask")
def _(v):
    df = masked(v)
    return df.select(*ROW, *[dedupe.observed(df, c).alias(f"seen_{c}") for c in ("velocity", "baroaltitude", "spoiler")])


@register("usable_track")
def _(v):
    df = masked(v)
    return df.select(*ROW, F.coalesce(usable_track(df, DEFAULT), F.lit(False)).alias("usable"))


@register("wind_components")
def _(v):
    return v.wx.select("observed_at", "wind_from_deg", "wind_speed", F.inline(geo.landing_runways())).select(
        "observed_at", "runway", decode.headwind().alias("headwind"), decode.crosswind_from_right().alias("crosswind"))


@register("qnh_bias")
def _(v):
    return v.wx.withColumn("qnh_hpa", F.expr("qnh_hpa - (h % 90)")).select("observed_at", decode.qnh_bias_m().alias("bias"), decode.supported_bias().alias("usable_bias"))


def segment_names(v):
    return v.obs.select(F.concat_ws("#", "flight_id", F.expr("1 + i div 40")).alias("segment_id")).distinct()


@register("case_identity")
def _(v):
    return segment_names(v).select("segment_id", F.sha2("segment_id", 256).alias("digest"), *[c.alias(n) for n, c in queue.case_identity().items()])


@register("operation_key")
def _(v):
    return segment_names(v).select("segment_id", queue.operation_key().alias("operation_key"))


@register("operation_ref")
def _(v):
    return segment_names(v).select("segment_id", queue.operation_ref().alias("operation_ref"))


@register("severity_band")
def _(v):
    return v.obs.select(*ROW, F.expr("CAST((k * 7 + i * 13) % 101 AS DOUBLE)").alias("pct")).withColumn("band", queue.severity_band())


@register("scale_unscale")
def _(v):
    rows = v.d21.filter("velocity IS NOT NULL AND baroaltitude IS NOT NULL AND vertrate IS NOT NULL").select("flight_id", "time", *windows.SCALED, F.lit(0.0).alias("hdg_sin"), F.lit(1.0).alias("hdg_cos"), "onground")
    scaler = windows.fit_scaler(rows)
    back = windows.unscale(windows.scale(rows, scaler), scaler)
    return back.select(*ROW, "z_baroaltitude", "z_velocity", "u_baroaltitude", "u_velocity")


# ---- filters ----------------------------------------------------------------------------------

@register("filter_bbox")
def _(v):
    spread = v.obs.withColumns({"lat": F.expr("lat + (k % 9 - 4) * 0.6D"), "lon": F.expr("lon + (k % 7 - 3) * 0.8D")})
    return derive.filter_bbox(spread).select(*ROW, "lat", "lon")


@register("filter_radius")
def _(v):
    spread = v.obs.withColumn("lat", F.expr("lat + (k % 9 - 4) * 0.6D"))
    near = derive.filter_bbox(spread).withColumn("dist_to_runway_m", geo.closest_runway_m())
    return derive.filter_radius(near, 150_000.0).select(*ROW, "dist_to_runway_m")


@register("filter_canonical_positions")
def _(v):
    df = v.obs.withColumns({"lat": F.expr("CASE WHEN i % 11 = 3 THEN NULL ELSE lat END"), "lon_missing": F.expr("i % 13 = 5"),
                            "time": F.expr("CASE WHEN i % 17 = 6 THEN 'late' ELSE CAST(time AS STRING) END")})
    return dedupe.canonical_positions(df).select(*ROW, "lat", "lon")


@register("filter_b")
def _(v):
    return derive.filter_b(v.d21).select(*ROW)


@register("filter_c")
def _(v):
    return profiles.filter_c(profiles.endpoint_stats(v.d21)).select("flight_id", "pass_c1", "pass_c2", "pass_c3")


@register("filter_d")
def _(v):
    return derive.filter_d(v.seg).select("segment_id", "time")


@register("filter_min_length")
def _(v):
    return resample.filter_min_length(v.seg, 30).select("segment_id", "time", "n_steps")


@register("filter_stale_contact")
def _(v):
    return derive.filter_stale_contact(v.obs).select(*ROW, "lastcontact")


def by_year(v):
    """Fold by year for every segment."""
    year = F.year(F.timestamp_seconds(F.min("time")))
    return v.seg.groupBy("flight_id", "segment_id").agg(F.when(year <= 2018, "train").when(year == 2019, "val").otherwise("test").alias("fold"))


@register("filter_ids")
def _(v):
    ids = by_year(v).filter("fold = 'val'").select("segment_id")
    return v.seg.join(ids, "segment_id", "left_semi").select("segment_id", "time")


@register("cohort_operations")
def _(v):
    return splits.cohort_operations(v.obs, by_year(v), "train").select(*ROW)


@register("cohort_first_operations")
def _(v):
    return splits.cohort_operations(v.obs, by_year(v), "train", limit=25).select(*ROW)


@register("fold_semi")
def _(v):
    flights = by_year(v).filter("fold = 'test'").select("flight_id").distinct()
    return v.obs.join(flights, "flight_id", "left_semi").groupBy("flight_id").agg(F.count(F.lit(1)).alias("n_rows"))


@register("identity_gate")
def _(v):
    known = v.reg.select("icao24").withColumn("known", F.lit(True))
    flights = v.obs.groupBy("flight_id", "icao24").agg(F.count(F.lit(1)).alias("n_rows"))
    gate = flights.join(known, "icao24", "left").withColumn("status", F.when(F.col("known"), "CLEARED").otherwise("UNIDENTIFIED"))
    return gate.groupBy("status").agg(F.count(F.lit(1)).alias("flights"), F.sum("n_rows").alias("n_rows"))


@register("airport_association")
def _(v):
    md = v.obs.groupBy("flight_id", "k").agg(F.count(F.lit(1)).alias("n")).select(
        "flight_id", *[F.expr(f"CASE WHEN k % {m} = 0 THEN 'LEMD' ELSE 'LEBL' END").alias(c) for c, m in (("origin", 3), ("destination", 4), ("landing", 5), ("diverted", 11))])
    at = {c: F.col(c) == "LEMD" for c in ("origin", "destination", "landing", "diverted")}
    return md.agg(F.count_if(at["origin"] | at["destination"] | at["landing"] | at["diverted"]).alias("associated"), F.count_if(at["landing"] | at["destination"]).alias("arriving"),
                  F.count_if(at["origin"]).alias("departing"), F.count_if(at["diverted"]).alias("diverted_to"))


@register("radius_ladder")
def _(v):
    return profiles.radius_ladder(v.d21)


def wild(v):
    """Rows with some values outside the physical bounds."""
    return v.seg.withColumns({
        "velocity": F.expr("CASE WHEN (k + i) % 29 = 0 THEN 450D WHEN (k + i) % 31 = 0 THEN 0D ELSE velocity END"),
        "vertrate": F.expr("CASE WHEN (k + i) % 37 = 0 THEN -60D ELSE vertrate END"),
        "baroaltitude": F.expr("CASE WHEN (k + i) % 43 = 0 THEN 17000D WHEN (k + i) % 47 = 0 THEN -150D ELSE baroaltitude END")})


@register("flag_impossible")
def _(v):
    return resample.flag_impossible(wild(v)).select("segment_id", "time", "velocity", "vertrate", "baroaltitude", "imp_velocity", "imp_vertrate", "imp_baroaltitude")


@register("plausible_values")
def _(v):
    rows = wild(v).select("velocity", "vertrate")
    return rows.agg(F.count_if(reference.plausible_speed("velocity")).alias("speed_samples"), F.count_if(reference.plausible_rate("vertrate")).alias("rate_samples"))


@register("geo_subset")
def _(v):
    rows = wild(v)
    corner = (F.col("lat") < 40.45) & (F.col("lon") > -3.55)
    return rows.filter(corner).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("flight_id").alias("flights"))


@register("envelope_outliers")
def _(v):
    s, a = F.col("velocity"), F.col("baroaltitude")
    return wild(v).agg(F.count_if((s < 80) & (a > 1000)).alias("slow_high"), F.count_if((s > 280) & (a < 3000)).alias("fast_low"), F.count_if(a > 16000).alias("too_high"))


@register("low_slow_subset")
def _(v):
    s, a = F.col("velocity"), F.col("baroaltitude")
    rows = wild(v)
    low, tiny = (a < 1500) & (s < 51), (a < 620) & (s < 15)
    return rows.agg(F.count_if(low).alias("rows_low"), F.count_distinct(F.when(low, F.col("icao24"))).alias("aircraft_low"), F.count_if(tiny).alias("rows_tiny"),
                    F.count_distinct(F.when(tiny, F.col("icao24"))).alias("aircraft_tiny"))


# ---- de-duplication ---------------------------------------------------------------------------

@register("dedupe_flight_time")
def _(v):
    jitter = v.raw.withColumn("time", F.expr("CAST(time AS DOUBLE) + 0.5D * (i % 2)"))
    return dedupe.dedupe_rounded_time(jitter).select(*ROW, "velocity", "lat")


@register("dedupe_observations")
def _(v):
    return dedupe.canonical_observations(v.raw).select(*ROW, "lat", "velocity")


@register("duplicate_profile")
def _(v):
    keys = {"flight_time": ["flight_id", "time"], "flight_time_position": ["flight_id", "time", "lat", "lon"], "full_row": v.raw.columns}
    return dedupe.duplicate_profile(v.raw, keys)


@register("duplicate_multiplicity")
def _(v):
    return dedupe.full_row_counts(v.raw).groupBy("copies").agg(F.count(F.lit(1)).alias("unique_rows"), F.sum("copies").alias("instances"))


@register("most_repeated_row")
def _(v):
    return dedupe.most_repeated(v.raw.select("flight_id", "time", "icao24", "lat", "lon", "baroaltitude", "velocity"), 3)


@register("duplicates_by_day")
def _(v):
    counts = dedupe.full_row_counts(v.raw)
    return counts.groupBy(F.expr("time div 86400").alias("day")).agg(F.sum(F.col("copies") - 1).alias("extras"), F.sum("copies").alias("total"))


@register("dedupe_full_rows")
def _(v):
    return dedupe.full_row_counts(v.raw).agg(F.sum("copies").alias("before"), F.count(F.lit(1)).alias("after"))
