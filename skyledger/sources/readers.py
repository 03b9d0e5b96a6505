"""Readers for state files, weather, registry and stored tables."""

from __future__ import annotations

import csv
import hashlib
from collections.abc import Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.config import STATE_COLUMNS, WEATHER_STATION
from skyledger.functions.decode import clean_boolean, clean_number, clean_text, weather_columns
from skyledger.functions.geo import closest_runway_m
from skyledger.operators.checks import require_flat, validate_columns
from skyledger.operators.context import prefer_report_type
from skyledger.operators.derive import filter_radius, flight_phase
from skyledger.sources.day_ranges import open_path

_DOUBLE = ("lat", "lon", "velocity", "heading", "vertrate", "baroaltitude", "geoaltitude")
_LONG = ("time", "lastposupdate", "lastcontact")
_BOOL = ("onground", "alert", "spi")
# Other names of the canonical columns.
ALIASES = {"baro_altitude": "baroaltitude", "geo_altitude": "geoaltitude", "true_track": "heading", "vertical_rate": "vertrate", "on_ground": "onground"}
WEATHER_COLUMNS = ("STATION", "DATE", "REPORT_TYPE", "WND", "TMP", "DEW", "MA1", "REM")


def text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def typed_states(text: DataFrame) -> DataFrame:
    """Typed state columns; a malformed cell becomes null instead of spoiling its column."""
    return text.select(
        *[clean_number(c).alias(c) for c in _DOUBLE], *[clean_number(c).cast("long").alias(c) for c in _LONG],
        *[clean_boolean(c).alias(c) for c in _BOOL], clean_text("icao24").alias("icao24"), clean_text("callsign").alias("callsign"),
        clean_number("squawk").cast("int").alias("squawk")).select(*STATE_COLUMNS)


def scan_states_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV (gzip is read as is) with the sixteen state columns, found by their names in any order.

    Files of one folder must share a header; one that differs is an error, not a shift of columns.
    """
    return typed_states(spark.read.option("header", True).option("enforceSchema", False).csv(path))


def scan_parquet_cohort(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_validated_input(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """An upload with a checked header: derived columns dropped, unknown ones refused, no nesting."""
    if kind == "csv":
        names = next(csv.reader([spark.read.text(path).first().value]))
        kept = validate_columns([n.strip() for n in names])  # before Spark renames a repeated name
        df = spark.read.schema(text_schema([n.strip() for n in names])).option("header", True).option("mode", "FAILFAST").csv(path)
        return df.select(*kept)
    else:
        df = require_flat(spark.read.parquet(path))
    return df.select(*validate_columns(df.columns))


def decode_weather(text: DataFrame) -> DataFrame:
    return text.withColumns(weather_columns())


def scan_weather_csv(spark: SparkSession, path: str, station: str = WEATHER_STATION) -> DataFrame:
    """Decoded reports of one station, one per timestamp, the METAR type preferred."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.select(*WEATHER_COLUMNS, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                                F.monotonically_increasing_id().alias("row")).alias("file_order"))
    mine = raw.filter(F.trim("STATION") == station).withColumns({
        "STATION": F.trim("STATION"), "REPORT_TYPE": F.trim("REPORT_TYPE"), "observed_at": F.unix_timestamp(F.col("DATE").try_cast("timestamp"))})
    return decode_weather(prefer_report_type(mine.filter("observed_at IS NOT NULL"))).drop("file_order")


def scan_aircraft_registry(spark: SparkSession, path: str, requested: DataFrame) -> DataFrame:
    """Registry rows of the requested aircraft, the first row per key in file order."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.select("*", F.lower(F.trim("icao24")).alias("key_"), F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("r")).alias("order_"))
    wanted = requested.select(F.lower(F.trim("icao24")).alias("key_")).distinct()
    names = [c for c in raw.columns if c not in ("key_", "order_", "icao24")]
    best = F.min(F.struct("order_", *names)).alias("b")
    return raw.join(wanted, "key_", "left_semi").groupBy("key_").agg(best).select(F.col("key_").alias("icao24"), *[f"b.{c}" for c in names])


def normalize_aliases(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in ALIASES.items() if a in df.columns})


def from_aviation_units(df: DataFrame) -> DataFrame:
    """Feet, knots and feet per minute to metric units; rows without time or position are dropped."""
    return df.select(
        F.col("timestamp").cast("long").alias("time"), F.col("icao24").cast("string").alias("icao24"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
        (F.col("altitude") * 0.3048).alias("baroaltitude"), (F.col("altitude") * 0.3048).alias("geoaltitude"), (F.col("groundspeed") * 0.514444).alias("velocity"),
        F.col("track").alias("heading"), (F.col("vertical_rate") * 0.00508).alias("vertrate"), F.lit(False).alias("onground"), "squawk",
        F.col("callsign").cast("string").alias("callsign")).dropna(subset=["lat", "lon", "time"])


def flights_of_airport(flights: DataFrame, airport: str, start: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame:
    """Flights of a stored list by day partition, airport and time, oldest first. A bound of None is open."""
    arrival, departure = F.col("arrival_airport") == airport, F.col("departure_airport") == airport
    wanted = arrival | departure
    if start is not None:
        wanted = wanted & (F.col("day") >= start // 86_400 * 86_400) & (F.col("firstseen") >= start)
    if end is not None:
        wanted = wanted & (F.col("day") <= end // 86_400 * 86_400) & (F.col("lastseen") <= end)
    found = flights.filter(wanted).select(
        "icao24", "callsign", "firstseen", "lastseen", F.when(arrival, "arrival").when(departure, "departure").otherwise("unknown").alias("operation"))
    found = found.orderBy("firstseen", "icao24")
    return found.limit(limit) if limit is not None else found


def track_of(states: DataFrame, icao24: str, start: int, end: int) -> DataFrame:
    """State rows of one aircraft and time range, from the matching hour partitions, fresh contacts only."""
    return states.filter(F.col("hour").between(start // 3600 * 3600, end // 3600 * 3600 + 3600) & (F.col("icao24") == icao24)
                         & F.col("time").between(start, end) & (F.col("time") - F.col("lastcontact") <= 15)).orderBy("time")


def flight_track_range(flights: DataFrame, states: DataFrame, bucket_s: int = 3_600) -> DataFrame:
    """States of each flight: an equi-join on (aircraft, hour) with the exact range behind it.

    The hour key keeps one busy aircraft from landing in one task.
    """
    spans = flights.withColumn("hour_", F.explode(F.sequence(F.floor(F.col("firstseen") / bucket_s), F.floor(F.col("lastseen") / bucket_s))))
    rows = states.withColumn("hour_", F.floor(F.col("time") / bucket_s))
    return rows.join(spans, ["icao24", "hour_"]).filter(F.col("time").between(F.col("firstseen"), F.col("lastseen"))).drop("hour_")


def build_master_table(flights: DataFrame, states: DataFrame) -> DataFrame:
    """All tracks of a flight list with ids and derivations, by one join."""
    fresh = states.drop("callsign").filter(F.col("time") - F.col("lastcontact") <= 15)
    joined = flight_track_range(flights.select("icao24", "callsign", "firstseen", "lastseen", "operation"), fresh)
    rows = filter_radius(joined.withColumn("dist_to_runway_m", closest_runway_m()))
    return rows.withColumns({
        "flight_id": F.concat_ws("_", "icao24", F.col("firstseen").cast("string")), "time_utc": F.timestamp_seconds("time"),
        "velocity_kmh": F.col("velocity") * 3.6, "flight_phase": flight_phase(), "callsign": F.trim("callsign")})


def dedupe_flight_slices(slices: DataFrame) -> DataFrame:
    """One row per aircraft and first second over overlapping pulls, smallest remaining values first."""
    rest = [c for c in slices.columns if c not in ("icao24", "firstseen")]
    return slices.groupBy("icao24", "firstseen").agg(F.min(F.struct(*rest)).alias("r")).select("icao24", "firstseen", "r.*").orderBy("firstseen", "icao24")


def with_row_numbers(df: DataFrame, file: str = "file", row: str = "row") -> DataFrame:
    """Add the file and the number (from 1) of each row in it to rows read from files, before any shuffle.

    A task numbers its rows as it reads them, and a split keeps the order of its rows. So a row's number follows from the
    first one of its split and the rows of the splits before it: one row per split, which is broadcast. The rows stay.
    Both reads deal the files alike; a row outside its split says they did not.
    """
    read = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias("block_")).withColumn("at_", F.monotonically_increasing_id())
    before = Window.partitionBy(file).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = read.groupBy(file, "block_").agg(F.count(F.lit(1)).alias("n_"), F.min("at_").alias("first_"))
    sizes = sizes.withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0)))
    place = F.col("at_") - F.col("first_")
    number = F.when(place.between(0, F.col("n_") - 1), F.col("before_") + place + 1).otherwise(F.raise_error(F.lit("the splits of a file changed while it was read")).cast("long"))
    return read.join(F.broadcast(sizes), [file, "block_"], "left").withColumn(row, number).drop("block_", "at_", "n_", "first_", "before_")


def scan_upload_csv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Text columns of header CSV files with the file and row number of every row."""
    return with_row_numbers(spark.read.schema(text_schema(names)).option("header", True).csv(path))


def day_ranges(first: int, last: int, column: str = "time") -> list[str]:
    """Disjoint day predicates covering [first, last], for a partitioned remote read."""
    return [f"{column} >= {d} AND {column} < {d + 86_400}" for d in range(first // 86_400 * 86_400, last + 1, 86_400)]


def scan_by_day_ranges(spark: SparkSession, url: str, table: str, first: int, last: int, properties: dict | None = None) -> DataFrame:
    """One task per day of a remote table."""
    return spark.read.jdbc(url, table, predicates=day_ranges(first, last), properties=properties or {})


def tables_in_range(spark: SparkSession, prefix: str, start: str, end: str) -> list[str]:
    """Names prefix_YYYYMMDD in the catalog between two ISO dates."""
    low, high = start.replace("-", ""), end.replace("-", "")
    names = (t.name for t in spark.catalog.listTables())
    return sorted(n for n in names if n.startswith(prefix + "_") and n[len(prefix) + 1:].isdigit() and low <= n[len(prefix) + 1:] <= high)


def canonical_batches(files: DataFrame, path: str = "path") -> DataFrame:
    """Per batch the de-duplicated file if there is one, else the snapshot."""
    name = F.regexp_extract(path, r"([^/]+?)(?:\.parquet)?$", 1)
    kind = F.when(name.contains("__deduped_"), "deduped").when(name.contains("__snapshot_"), "snapshot")
    tagged = files.withColumns({"name": name, "kind": kind, "batch": F.regexp_replace(name, "__(snapshot|deduped)_.*$", "")}).filter("kind IS NOT NULL")
    best = F.min(F.struct("kind", "name", F.col(path).alias("path_"))).alias("b")
    return tagged.groupBy("batch").agg(best).select("batch", "b.kind", F.col("b.path_").alias("path"))


def union_batches(batches: dict[str, DataFrame]) -> DataFrame:
    result = None
    for tag, df in batches.items():
        tagged = df.withColumn("batch", F.lit(tag))
        result = tagged if result is None else result.unionByName(tagged, allowMissingColumns=True)
    return result


def file_manifest(spark: SparkSession, path: str, chunk_bytes: int = 8 << 20, max_tasks: int = 10_000) -> DataFrame:
    """Name, size and SHA-256 of each input file, empty ones included.

    Only the names pass through the driver. A task reads each of its files in chunks, so a file of any length takes
    the memory of one chunk.
    """
    def run(batches):
        for batch in batches:
            sizes, sums = [], []
            for uri in batch.column("path").to_pylist():
                digest, size = hashlib.sha256(), 0
                where, place = open_path(uri)
                with where.open_input_stream(place) as stream:
                    while chunk := stream.read(chunk_bytes):
                        digest.update(chunk)
                        size += len(chunk)
                sizes.append(size)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], names=["path", "bytes", "sha256"])

    names = sorted(unquote(f) for f in spark.read.format("binaryFile").load(path).inputFiles())
    files = spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, min(len(names), max_tasks)))
    return files.mapInArrow(run, "path string, bytes long, sha256 string").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "bytes", "sha256")
