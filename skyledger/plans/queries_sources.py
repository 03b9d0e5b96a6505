"""Registered queries: scans, sinks and text decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.config import STATE_COLUMNS
from skyledger.functions import decode
from skyledger.operators import checks, context
from skyledger.operators.dedupe import collapse_or_conflict
from skyledger.plans.views import STATION, register
from skyledger.session import scratch_path
from skyledger.sources import day_ranges, derived, readers, writers

STATE_OUT = ("icao24", "time", "lat", "lon", "velocity", "baroaltitude", "onground", "squawk", "lastcontact")


def state_text(v):
    """The sixteen state columns as text, with a few unreadable cells."""
    text = v.obs.withColumn("velocity", F.when(F.expr("(k + i) % 50 = 0"), "n/a").otherwise(F.col("velocity").cast("string")))
    return text.select(*[F.col(c).cast("string").alias(c) for c in STATE_COLUMNS])


def flight_list(v):
    return v.obs.groupBy("flight_id", "icao24", "k").agg(F.min("callsign").alias("callsign"), F.min("time").alias("firstseen"), F.max("time").alias("lastseen")).select(
        "icao24", "callsign", "firstseen", "lastseen", F.expr("CASE WHEN k % 3 = 0 THEN 'LEMD' ELSE 'LEBL' END").alias("arrival_airport"),
        F.expr("CASE WHEN k % 3 = 1 THEN 'LEMD' ELSE 'LEVC' END").alias("departure_airport"), F.expr("firstseen div 86400 * 86400").alias("day"))


@register("scan_states_csv")
def _(v):
    path = scratch_path(v.spark, "states")
    state_text(v).write.option("header", True).option("compression", "gzip").csv(path)
    return readers.scan_states_csv(v.spark, path).select(*STATE_OUT)


@register("scan_parquet_cohort")
def _(v):
    path = scratch_path(v.spark, "cohort")
    writers.write_snapshot(v.obs, path)
    return readers.scan_parquet_cohort(v.spark, path, ["flight_id", "time", "lat", "lon", "baroaltitude"])


@register("scan_validated_input")
def _(v):
    path = scratch_path(v.spark, "upload")
    v.d21.drop("k", "i", "lastposupdate").write.parquet(path)
    df = readers.scan_validated_input(v.spark, path)
    return df.select("icao24", "time", "lat", "lon", "heading", "onground", "squawk", F.lit(len(df.columns)).alias("n_columns"))


@register("scan_weather_csv")
def _(v):
    path = scratch_path(v.spark, "weather")
    v.wxt.withColumn("DATE", F.date_format(F.timestamp_seconds("observed_at"), "yyyy-MM-dd'T'HH:mm:ss")).drop("observed_at", "h").write.option("header", True).csv(path)
    return readers.scan_weather_csv(v.spark, path, STATION).select(
        "observed_at", F.col("REPORT_TYPE").alias("report_type"), "wind_from_deg", "wind_speed", "qnh_hpa", "temperature_c", "dew_point_c", "missing_reasons")


@register("scan_aircraft_registry")
def _(v):
    path = scratch_path(v.spark, "registry")
    v.reg.withColumn("icao24", F.upper("icao24")).write.option("header", True).csv(path)
    return readers.scan_aircraft_registry(v.spark, path, v.obs.select("icao24"))


@register("source_flights_sql")
def _(v):
    return readers.flights_of_airport(flight_list(v), "LEMD", 1_496_620_800, 1_596_620_800)


@register("source_track_sql")
def _(v):
    states = v.obs.withColumn("hour", F.expr("time div 3600 * 3600"))
    return readers.track_of(states, "a00007", 1_496_620_800, 1_600_000_000).select("time", "icao24", "lat", "lon", "velocity", "lastcontact")


@register("build_master_table")
def _(v):
    flights = readers.flights_of_airport(flight_list(v), "LEMD")
    return readers.build_master_table(flights, v.obs.drop("flight_id", "k", "i")).select(
        "flight_id", "time", "operation", "velocity_kmh", "dist_to_runway_m", "flight_phase", "callsign")


@register("flight_track_range")
def _(v):
    flights = flight_list(v).select("icao24", F.col("firstseen"), F.col("lastseen"))
    return readers.flight_track_range(flights, v.obs.select("icao24", "time")).groupBy("icao24", "firstseen").agg(F.count(F.lit(1)).alias("n_rows"))


@register("flights_dedupe_slices")
def _(v):
    flights = flight_list(v).select("icao24", "callsign", "firstseen", "lastseen")
    late = flights.withColumn("callsign", F.concat("callsign", F.lit("X")))
    return readers.dedupe_flight_slices(flights.unionByName(late))


@register("scan_by_day_ranges")
def _(v):
    """Rows per day, read back through the splits of thirty days each that cover every row exactly once."""
    path = scratch_path(v.spark, "days")
    rows = v.obs.select("time", "icao24", "lat", "lon")
    day_ranges.write_by_day_ranges(rows, path, days=30)
    read = day_ranges.scan_stored_day_ranges(v.spark, path, rows.schema, days=30)
    return read.groupBy(F.expr("time div 86400 * 86400").alias("range_start")).agg(F.count(F.lit(1)).alias("n_rows"))


@register("choose_canonical_batches")
def _(v):
    week = F.date_format(writers.weekly_date(), "yyyyMMdd")
    files = v.obs.select(week.alias("w")).distinct().select("w", F.explode(F.expr(
        "CASE WHEN substring(w, 8, 1) IN ('0', '2', '4', '6', '8') THEN array('snapshot', 'deduped') ELSE array('snapshot') END")).alias("kind"))
    return readers.canonical_batches(files.select(F.concat(F.lit("/data/lemd_"), "w", F.lit("__"), "kind", F.lit("_20260101.parquet")).alias("path")))


@register("sink_partitioned_parquet")
def _(v):
    path = scratch_path(v.spark, "weekly")
    rows = v.obs.withColumn("monday", writers.weekly_date()).select("flight_id", "time", "lat", "monday")
    writers.write_partitioned(rows, path, "monday")
    writers.write_partitioned(rows, path, "monday")
    return v.spark.read.parquet(path).groupBy("monday").agg(F.count(F.lit(1)).alias("n_rows"), F.min("time").alias("first_time"))


@register("sink_snapshot_parquet")
def _(v):
    path = scratch_path(v.spark, "snapshot")
    writers.write_snapshot(v.obs.select("flight_id", "time", "vertrate"), path)
    return v.spark.read.parquet(path)


@register("sink_keyed_upsert")
def _(v):
    """Copies with a newer version replace the stored row of the same aircraft and second."""
    stored = v.obs.select("icao24", "time", "velocity", F.lit(1).alias("version"))
    changes = v.obs.filter("velocity IS NOT NULL AND vertrate < -10").select("icao24", "time", (F.col("velocity") + 1.0).alias("velocity"), F.lit(2).alias("version"))
    return writers.upsert(stored, changes, ["icao24", "time"], "version")


@register("pick_evenly_spaced_dates")
def _(v):
    weeks = v.obs.select(writers.weekly_date().alias("monday")).distinct().filter("NOT monday BETWEEN date'2020-03-15' AND date'2022-01-01'")
    return writers.pick_evenly(weeks, 18, "monday")


@register("scan_external_units")
def _(v):
    foreign = v.obs.select(
        F.col("time").alias("timestamp"), "icao24", F.col("lat").alias("latitude"), F.expr("CASE WHEN i % 9 = 4 THEN NULL ELSE lon END").alias("longitude"),
        (F.col("baroaltitude") / 0.3048).alias("altitude"), (F.col("velocity") / 0.514444).alias("groundspeed"), F.col("heading").alias("track"),
        (F.col("vertrate") / 0.00508).alias("vertical_rate"), "squawk", "callsign")
    return readers.from_aviation_units(foreign).select("icao24", "time", "lat", "lon", "baroaltitude", "velocity", "vertrate", "onground")


@register("normalize_column_aliases")
def _(v):
    foreign = v.obs.select("icao24", "time", F.col("baroaltitude").alias("baro_altitude"), F.col("heading").alias("true_track"),
                           F.col("vertrate").alias("vertical_rate"), F.col("onground").alias("on_ground"))
    return readers.normalize_aliases(foreign)


@register("file_manifest")
def _(v):
    return readers.file_manifest(v.spark, f"{v.sf_dir}/*.parquet")


@register("union_batches")
def _(v):
    early = v.obs.filter("time < 1530000000").select("flight_id", "time", "lat")
    late = v.obs.filter("time >= 1530000000").select("flight_id", "time", "lat", "lon")
    return readers.union_batches({"early": early, "late": late}).groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"), F.count("lon").alias("with_lon"))


# ---- decoding ---------------------------------------------------------------------------------

@register("decode_wind")
def _(v):
    return v.wxt.select("observed_at", "REPORT_TYPE", decode.wind_direction().alias("wind_from_deg"), decode.wind_speed().alias("wind_speed"))


@register("decode_pressure")
def _(v):
    return v.wxt.select("observed_at", "REPORT_TYPE", decode.station_pressure().alias("ma1_hpa"), decode.report_pressure().alias("metar_hpa"))


@register("decode_temperature")
def _(v):
    return v.wxt.select("observed_at", "REPORT_TYPE", decode.signed_tenths("TMP").alias("temperature_c"), decode.signed_tenths("DEW").alias("dew_point_c"))


@register("weather_quality_flags")
def _(v):
    return readers.decode_weather(v.wxt).select("observed_at", "REPORT_TYPE", "qnh_hpa", "qnh_matches", "missing_reasons")


@register("prefer_report_type")
def _(v):
    return context.prefer_report_type(v.wxt.withColumn("file_order", F.col("h"))).select("observed_at", "REPORT_TYPE", "WND")


def upload_text(v):
    """Uploaded rows as text with the usual defects."""
    return v.raw.select(*uploaded(v))


def uploaded(v):
    return (
        F.expr("CASE WHEN (k + i) % 61 = 0 THEN concat(time, '.5') ELSE CAST(time AS STRING) END").alias("time"),
        F.expr("CASE WHEN (k + i) % 67 = 0 THEN ' NaN ' ELSE concat(' ', upper(icao24), ' ') END").alias("icao24"),
        F.expr("CASE WHEN (k + i) % 71 = 0 THEN '95.5' ELSE CAST(lat AS STRING) END").alias("lat"), F.col("lon").cast("string").alias("lon"),
        F.col("baroaltitude").cast("string").alias("baroaltitude"), F.expr("CASE WHEN (k + i) % 73 = 0 THEN 'fast' ELSE CAST(velocity AS STRING) END").alias("velocity"),
        F.col("heading").cast("string").alias("heading"), F.col("vertrate").cast("string").alias("vertrate"),
        F.expr("CASE WHEN i % 5 = 0 THEN 'null' WHEN i % 5 = 1 THEN '0' WHEN onground THEN 'TRUE' ELSE 'False' END").alias("onground"),
        F.expr("CASE WHEN i % 7 = 0 THEN '360' ELSE CAST(i AS STRING) END").alias("wind_from_direction_deg"),
        F.expr("CASE WHEN i % 13 = 0 THEN '1200' ELSE '1013.256' END").alias("qnh_hpa"),
        F.expr("CASE WHEN k % 5 = 0 THEN 'a320 ' ELSE 'na' END").alias("aircraft_typecode"))


@register("canonical_values")
def _(v):
    return checks.canonical_values(upload_text(v)).withColumn("errors", F.transform("errors", lambda e: F.concat_ws(":", e["field"], e["code"])))


@register("null_and_bool_tokens")
def _(v):
    text = upload_text(v).select("onground", "aircraft_typecode")
    return text.select("*", decode.clean_text("aircraft_typecode").alias("type_text"), decode.clean_boolean("onground").alias("flag"),
                       decode.clean_boolean("onground", True).alias("flag_or_false")).groupBy("onground", "aircraft_typecode", "type_text", "flag", "flag_or_false").agg(F.count(F.lit(1)).alias("n"))


@register("error_position_report")
def _(v):
    """Uploads of a month as one file each, in order: field, code and row number of every error."""
    path = scratch_path(v.spark, "uploads")
    text = upload_text(v)
    months = derived.with_copies(derived.observations_by_month(v.spark, v.sf_dir, v.flight_tasks)).sortWithinPartitions("month", "flight_id", "time")
    months.select("month", *uploaded(v)).write.partitionBy("month").option("header", True).option("compression", "gzip").csv(path)
    read = readers.scan_upload_csv(v.spark, path, text.columns)
    bad = checks.error_report(checks.canonical_values(read))
    return bad.select(F.regexp_extract("file", r"month=(\d+)/", 1).alias("month"), F.col("row").alias("row_number"), F.inline("errors"))


@register("collapse_or_conflict")
def _(v):
    clean, conflicts = collapse_or_conflict(v.raw.select("icao24", "time", "lat", "lon", "velocity"), ["icao24", "time"])
    return clean.select("icao24", "time", "duplicates", F.lit("kept").alias("result")).unionByName(
        conflicts.select("icao24", "time", (F.col("copies") - 1).alias("duplicates"), F.lit("conflict").alias("result")))
