"""Registered queries: segmentation, islands, resampling and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyledger.config import FEATURES, MEASURED
from skyledger.operators import approach, checks, profiles, resample, segments, sequence, windows
from skyledger.plans.queries_rows import wild
from skyledger.plans.views import PREP, WINDOW, register

SEG = ("flight_id", "segment_id")


@register("segment_flights")
def _(v):
    rows = v.raw.drop("flight_id").select("icao24", "time", "lat", "velocity")
    return sequence.segment_flights(rows).select("flight_id", "icao24", "time", "lat", "velocity")


@register("segment_gaps")
def _(v):
    return sequence.segment_gaps(v.obs, 60).select("segment_id", "time")


@register("segment_gap_or_jump")
def _(v):
    return sequence.segment_gap_or_jump(v.obs).select("seg_id", "time", "n_rows")


@register("movement_speed")
def _(v):
    return sequence.with_step_speed(v.seg).select("segment_id", "time", "step_s", "step_m", "step_speed")


def parked(v):
    """Segments with on-ground rows at both ends, the outer ones standing still, and some that never fly."""
    edge = F.expr("i < 6 OR i >= 40")
    still = F.expr("i < 3 OR i >= 50")
    ground = F.expr("k % 10 = 3") | edge
    rows = v.seg.withColumns({"onground": ground, "lat": F.when(still, F.lit(40.5)).otherwise(F.col("lat")), "lon": F.when(still, F.lit(-3.55)).otherwise(F.col("lon"))})
    return sequence.with_step_speed(rows)


@register("trim_idle")
def _(v):
    return sequence.trim_idle(parked(v), 2.5).select("segment_id", "time")


@register("idle_runs")
def _(v):
    return sequence.idle_runs(parked(v), 2.5)


@register("corridor_visits")
def _(v):
    return approach.corridor_visits(v.masked)


@register("merge_intervals")
def _(v):
    return approach.merge_intervals(approach.corridor_visits(v.masked))


@register("attempt_extension")
def _(v):
    return approach.attempt_rows(v.masked).groupBy("flight_id", "cluster").agg(
        F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count(F.lit(1)).alias("n_rows"))


@register("extract_attempts")
def _(v):
    return v.attempts.groupBy("flight_id", "cluster", "geometry_runway").agg(
        F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count(F.lit(1)).alias("n_rows"))


@register("persistent_spans")
def _(v):
    return sequence.persistent_spans(v.obs, F.expr("(i div 7) % 3 = 1"), ["flight_id"], 3, 20)


@register("airborne_runs")
def _(v):
    runs = segments.with_airborne_runs(parked(v)).filter("NOT onground")
    return runs.groupBy(*SEG, "run").agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count(F.lit(1)).alias("n_rows")).drop("run")


@register("max_null_run")
def _(v):
    rows = v.obs.withColumn("velocity", F.expr("CASE WHEN (k + i) % 12 < 5 THEN NULL ELSE velocity END"))
    return profiles.max_null_runs(rows)


def repeated(v):
    """A feed that repeats its position every third row."""
    held = F.expr("i % 3 = 1")
    w = sequence.ordered(["flight_id"])
    return v.obs.withColumns({c: F.when(held, F.coalesce(F.lag(c).over(w), F.col(c))).otherwise(F.col(c)) for c in ("lat", "lon")})


@register("value_repeat_rate")
def _(v):
    return profiles.value_repeat_rate(repeated(v))


@register("update_intervals")
def _(v):
    return profiles.update_intervals(repeated(v))


@register("gap_spatial_profile")
def _(v):
    return profiles.gap_spatial_profile(v.obs, 60)


@register("split_threshold_sweep")
def _(v):
    return profiles.split_threshold_sweep(v.obs, [2, 4, 60, 90, 180])


@register("row_step_quality")
def _(v):
    rows = sequence.with_step_speed(v.obs.select("flight_id", "time", "lat", "lon", "baroaltitude"), ["flight_id"])
    rise = F.abs(F.col("baroaltitude") - F.lag("baroaltitude").over(sequence.ordered(["flight_id"]))) / F.col("step_s")
    return rows.withColumn("rise", rise).groupBy("flight_id").agg(
        F.max("step_s").alias("max_gap_s"), F.max("step_speed").alias("max_ground_speed"), F.max("rise").alias("max_vertical_rate"))


@register("previous_first_last_k")
def _(v):
    return profiles.first_k_sets(v.d21.withColumn("onground", F.expr("k % 6 = 1 AND i < 2")).withColumn(
        "flight_phase", F.expr("CASE WHEN k % 4 = 1 AND i = 3 THEN 'takeoff' ELSE flight_phase END")))


# ---- resampling -------------------------------------------------------------------------------

@register("snap_to_grid")
def _(v):
    return resample.snap_to_grid(v.seg).select("segment_id", "time", "grid_time")


@register("expand_grid")
def _(v):
    return resample.expand_grid(resample.snap_to_grid(v.seg), MEASURED).select("segment_id", "time", "lat")


def grid(v):
    return resample.missing_masks(resample.expand_grid(resample.snap_to_grid(v.seg), (*MEASURED, "onground", "flight_phase", "squawk")))


@register("missing_masks")
def _(v):
    return grid(v).select("segment_id", "time", *[f"{c}_missing" for c in MEASURED])


@register("interpolate_linear")
def _(v):
    return resample.interpolate(grid(v).select(*SEG, "time", "baroaltitude", "velocity"), ["baroaltitude", "velocity"]).select("segment_id", "time", "baroaltitude", "velocity")


@register("interpolate_heading")
def _(v):
    turned = v.seg.withColumn("heading", F.expr("CASE WHEN (k + i) % 9 = 4 THEN NULL ELSE pmod(heading + (i % 4) * 40, 360D) END"))
    parts = resample.expand_grid(resample.snap_to_grid(turned), MEASURED).withColumns(
        {"hdg_sin": F.sin(F.radians("heading")), "hdg_cos": F.cos(F.radians("heading"))})
    from skyledger.operators.derive import normalised_heading
    full = normalised_heading(resample.interpolate(parts.drop("heading"), ["hdg_sin", "hdg_cos"]))
    return full.select("segment_id", "time", "hdg_sin", "hdg_cos")


@register("ffill_bfill")
def _(v):
    some = grid(v).withColumns({"squawk": F.expr("CASE WHEN i % 3 = 0 THEN squawk + i END")})
    return resample.fill_nearest(some, ["onground", "flight_phase", "squawk"]).select("segment_id", "time", "onground", "flight_phase", "squawk")


@register("resample_segments")
def _(v):
    return resample.resample(v.seg).select("segment_id", "time", "lat", "lon", "baroaltitude", "velocity", "vertrate", "heading", "hdg_sin", "hdg_cos",
                                           "onground", "flight_phase", "squawk", "dist_to_runway_m", "velocity_missing")


@register("assert_grid")
def _(v):
    # a damaged grid: some steps shifted by five seconds, some latitudes lost
    damaged = v.clean.withColumns({"lat": F.expr("CASE WHEN time div 10 % 90 = 7 THEN NULL ELSE lat END"), "time": F.expr("time + CASE WHEN time div 10 % 70 = 3 THEN 5 ELSE 0 END")})
    return resample.grid_violations(damaged).groupBy("null_feature", "bad_step").agg(F.count(F.lit(1)).alias("n"))


@register("project_grid_size")
def _(v):
    return resample.project_grid_size(v.obs, 60)


@register("preprocess")
def _(v):
    return v.clean.select("segment_id", "flight_id", "icao24", "time", "lat", "lon", "baroaltitude", "velocity", "vertrate", "heading", "dist_to_runway_m", "onground",
                          "flight_phase", "squawk", *[f"{c}_missing" for c in MEASURED], "is_emergency", "n_imputed_impossible", "n_imputed_missing", "n_steps")


@register("reject_summary")
def _(v):
    return checks.step_losses(lambda tap: resample.preprocess_steps(v.d21, PREP, tap))


@register("imputation_counters")
def _(v):
    counted = resample.with_counters(resample.flag_impossible(wild(v), PREP))
    return counted.groupBy("segment_id").agg(F.max("n_imputed_impossible").alias("n_imputed_impossible"), F.max("n_imputed_missing").alias("n_imputed_missing"))


@register("emergency_segments")
def _(v):
    counted = resample.with_counters(resample.flag_impossible(v.seg, PREP))
    return counted.groupBy("segment_id").agg(F.max("is_emergency").alias("is_emergency"))


@register("per_segment_broadcast")
def _(v):
    """Attributes of some segments on every row, with defaults for the others."""
    hits = v.seg.filter("squawk IN (7500, 7600, 7700)").groupBy(*SEG).agg(F.count(F.lit(1)).alias("hits"))
    return v.seg.join(hits, list(SEG), "left").select("segment_id", "time", F.coalesce("hits", F.lit(0)).alias("hits"), F.col("hits").isNotNull().alias("is_emergency"))


# ---- windows ----------------------------------------------------------------------------------

@register("to_sequences")
def _(v):
    clean = v.stored_clean
    seqs = windows.to_sequences(windows.scale(clean, windows.fit_scaler(clean)), WINDOW)
    rows = seqs.select("segment_id", "was_truncated", F.posexplode(F.arrays_zip("x", "mask", "loss_mask")).alias("step", "r"))
    return rows.select("segment_id", "was_truncated", "step", "r.mask", "r.loss_mask", *[F.get("r.x", F.lit(i)).alias(f"z_{c}") for i, c in enumerate(FEATURES)])


@register("loss_mask")
def _(v):
    return v.clean.select("segment_id", "time", (~windows.any_mask()).alias("observed"))


@register("sequence_length_p95")
def _(v):
    return windows.sequence_length(v.stored_clean)


@register("truncation_tradeoff")
def _(v):
    return windows.truncation_tradeoff(v.clean, [10, 12, 14, 16, 18])


@register("sliding_windows")
def _(v):
    return windows.sliding_windows(v.seg, 20).groupBy("segment_id", "window_no").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("time").alias("start_time"), F.max("time").alias("end_time"))


@register("worst_window_score")
def _(v):
    scored = windows.sliding_windows(v.seg, 20).groupBy("segment_id", "window_no").agg(F.avg(F.abs(F.col("vertrate") + 3.9)).alias("score"))
    return scored.groupBy("segment_id").agg(F.max("score").alias("score"))


@register("summary_features")
def _(v):
    clean = v.stored_clean
    return windows.summary_features(windows.window_rows(windows.scale(clean, windows.fit_scaler(clean)), WINDOW)).drop("flight_id")


@register("fit_scaler")
def _(v):
    return windows.fit_scaler(v.clean)
