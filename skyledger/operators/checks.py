"""Data-quality checks. Each returns rows of facts; a verdict is a column, never an exception."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.config import DERIVED_STATE_COLUMNS, IGNORED_COLUMNS, OPTIONAL_COLUMNS, REQUIRED_COLUMNS
from skyledger.functions.decode import boolean_of, clean_text, number_of
from skyledger.functions.geo import closest_runway_m
from skyledger.operators.derive import flight_phase
from skyledger.operators.profiles import unpivot

# Columns that must be filled, numeric and boolean columns.
CRITICAL = ("time", "icao24", "lat", "lon", "baroaltitude", "flight_id")
NUMERIC = ("time", "lat", "lon", "baroaltitude", "geoaltitude", "velocity", "heading", "vertrate", "lastcontact", "velocity_kmh", "dist_to_runway_m")
BOOLEAN = ("onground", "alert", "spi")
# Physical bounds of the feed.
BOUNDS = {"lat": (-90, 90), "lon": (-180, 180), "baroaltitude": (-500, 50_000), "geoaltitude": (-500, 50_000), "velocity": (0, 400),
          "heading": (0, 360), "vertrate": (-100, 100), "velocity_kmh": (0, 1500), "dist_to_runway_m": (0, 200_000)}
# The region of the feed.
REGION = {"lat": (38.5, 42.5), "lon": (-6.0, -1.1)}
# Decimals kept per canonical column.
PRECISION = {"lat": 8, "lon": 8, "baroaltitude": 6, "geoaltitude": 6, "velocity": 6, "heading": 6, "vertrate": 6, "lastcontact": 6,
             "qnh_hpa": 2, "wind_from_direction_deg": 2, "wind_speed_mps": 3}
MAX_TIME = 4_102_444_800


def schema_report(df: DataFrame, expected: Sequence[str] = DERIVED_STATE_COLUMNS) -> list[tuple[str, str, str]]:
    """(column, problem, type) for missing, extra and wrongly typed columns; looks at the schema only."""
    types = {f.name: f.dataType for f in df.schema}
    found = [(c, "missing", "") for c in expected if c not in types] + [(c, "extra", types[c].simpleString()) for c in types if c not in expected]
    for c, t in types.items():
        if c in NUMERIC and not isinstance(t, T.NumericType):
            found.append((c, "expected_numeric", t.simpleString()))
        if c in BOOLEAN and not isinstance(t, T.BooleanType):
            found.append((c, "expected_boolean", t.simpleString()))
    return sorted(found)


def schema_report_df(df: DataFrame, expected: Sequence[str] = DERIVED_STATE_COLUMNS) -> DataFrame:
    return df.sparkSession.createDataFrame(schema_report(df, expected), "column string, problem string, type string")


def critical_nulls(df: DataFrame, columns: Sequence[str] = CRITICAL) -> DataFrame:
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"k_{c}") for c in columns])
    return unpivot(row, "column", {c: {"nulls": F.col(f"k_{c}"), "passes": F.col(f"k_{c}") == 0} for c in columns})


def bounds_report(df: DataFrame) -> DataFrame:
    aggs = []
    for c, (lo, hi) in BOUNDS.items():
        aggs += [F.count_if(F.col(c) < lo).alias(f"b_{c}"), F.count_if(F.col(c) > hi).alias(f"a_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
    return unpivot(df.agg(*aggs), "column", {c: {"below_min": F.col(f"b_{c}"), "above_max": F.col(f"a_{c}"), "min_seen": F.col(f"lo_{c}").cast("double"),
                                                 "max_seen": F.col(f"hi_{c}").cast("double")} for c in BOUNDS})


def outside_region() -> F.Column:
    return ~(F.col("lat").between(*REGION["lat"]) & F.col("lon").between(*REGION["lon"]))


def consistency_report(df: DataFrame) -> DataFrame:
    """Recompute the four derived columns and compare."""
    zero = F.lit(0.0)
    fresh = df.withColumn("phase_", flight_phase())
    return fresh.agg(
        F.coalesce(F.max(F.abs(F.col("velocity_kmh") - F.col("velocity") * 3.6)), zero).alias("max_kmh"),
        F.coalesce(F.max(F.abs(F.col("dist_to_runway_m") - closest_runway_m())), zero).alias("max_dist"),
        F.avg((F.coalesce("flight_phase", F.lit("")) == F.col("phase_")).cast("double")).alias("phase_match"),
        F.coalesce(F.max(F.abs(F.unix_timestamp("time_utc") - F.col("time"))), F.lit(0)).cast("double").alias("max_seconds"),
    ).withColumn("passes", (F.col("max_kmh") < 1e-6) & (F.col("max_dist") < 1.0) & (F.col("phase_match") >= 1.0) & (F.col("max_seconds") < 1.0))


def dataset_verdict(df: DataFrame, expected: Sequence[str] = DERIVED_STATE_COLUMNS) -> DataFrame:
    """real, usable and enough, from three small aggregates over the feed."""
    shape_ok = not schema_report(df, expected)
    bad = F.lit(False)
    for c, (lo, hi) in BOUNDS.items():
        bad = bad | F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False))
    empty = F.lit(False)
    for c in CRITICAL:
        empty = empty | F.col(c).isNull()
    rows = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.count_if(outside_region()).alias("outside"), F.count_if(empty).alias("empty"))
    days = df.groupBy("flight_id", F.floor(F.col("time") / 86_400).alias("day")).agg(F.count(F.lit(1)).alias("c")).agg(
        F.count_distinct("flight_id").alias("trajectories"), F.count_distinct("day").alias("days"))
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("copies"))
    facts = rows.crossJoin(days).crossJoin(copies).crossJoin(consistency_report(df).select(F.col("passes").alias("consistent")))
    t, d = F.col("trajectories"), F.col("days")
    return facts.select(
        ((F.lit(shape_ok)) & (F.col("bad") == 0) & (F.try_divide(F.col("outside") * 100.0, F.col("n")) < 1.0)).alias("real"),
        ((F.col("empty") == 0) & (F.col("copies") == 0) & F.col("consistent")).alias("usable"),
        F.when(t < 500, "NOT_YET").when((d < 30) | (t < 5_000), "SOFT_DEV").when((d < 90) | (t < 20_000), "CONDITIONAL").otherwise("PASS").alias("enough"),
        "trajectories", "days", "copies")


# ---- uploads ----------------------------------------------------------------------------------

def validate_columns(names: Sequence[str]) -> list[str]:
    """The accepted columns of a header; a repeated, missing or unknown one is an error."""
    if len(set(names)) != len(names):
        raise ValueError("duplicate_columns")
    accepted = (*REQUIRED_COLUMNS, *OPTIONAL_COLUMNS)
    missing = [c for c in REQUIRED_COLUMNS if c not in names]
    unknown = sorted(set(names) - set(accepted) - set(IGNORED_COLUMNS))
    if missing or unknown:
        raise ValueError(f"invalid_schema missing={missing} unknown={unknown[:20]}")
    return [c for c in names if c in accepted]


def require_flat(df: DataFrame) -> DataFrame:
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if nested:
        raise ValueError(f"nested_columns {nested}")
    return df


def require_at_most(df: DataFrame, cap: int) -> DataFrame:
    """Refuse, never trim, an upload above the cap; the count stops one row past it."""
    if df.limit(cap + 1).count() > cap:
        raise ValueError("too_many_rows")
    return df


def canonical_values(df: DataFrame) -> DataFrame:
    """Canonical columns plus errors: an array of (field, code) per row, empty when the row is good.

    Every cell is read once: texts, numbers and flags are made by a generator of one row, through which no filter on the
    errors is pushed, as that would read all cells again for each of its terms.
    """
    have = set(df.columns)
    flags = [c for c in ("onground", "alert", "spi") if c in have]
    numbers = [c for c in ("time", *PRECISION, "squawk") if c in have]
    texts = [*numbers, *flags, *[c for c in ("icao24", "aircraft_typecode", "callsign") if c in have]]
    # one small expression over an array of cells: code of its own for every column is too long to be compiled
    read = df.withColumn("texts_", F.transform(F.array(*[F.col(c).cast("string") for c in texts]), lambda x: clean_text(x)))
    some = [F.slice("texts_", 1, len(numbers)), F.slice("texts_", 1 + len(numbers), len(flags))]
    cells = F.struct("texts_", F.transform(some[0], lambda x: number_of(x)).alias("numbers_"), F.transform(some[1], lambda x: boolean_of(x)).alias("flags_"))
    read = read.select(*df.columns, F.inline(F.array(cells)))
    text = {c: F.get("texts_", F.lit(i)) for i, c in enumerate(texts)}
    numeric = {c: F.get("numbers_", F.lit(i)) for i, c in enumerate(numbers)}
    flag = {c: F.get("flags_", F.lit(i)) for i, c in enumerate(flags)}
    number, time = {c: v for c, v in numeric.items() if c in PRECISION}, numeric["time"]

    def problem(cond, field: str, code: str):
        return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(code).alias("code")))

    errors = [problem(text["time"].isNull(), "time", "required"), problem(text["time"].isNotNull() & time.isNull(), "time", "numeric"),
              problem((time != F.floor(time)) | ~time.between(0, MAX_TIME), "time", "range"),
              problem(text["icao24"].isNull(), "icao24", "required")]
    for c in ("lat", "lon"):
        errors += [problem(text[c].isNull(), c, "required")]
    for c in number:
        errors.append(problem(text[c].isNotNull() & number[c].isNull(), c, "numeric"))
    errors += [problem((F.abs(number["lat"]) > 90) | (F.abs(number["lon"]) > 180), "position", "range")]
    for c in flags:
        errors.append(problem(text[c].isNotNull() & flag[c].isNull(), c, "boolean"))
    onground = F.when(text["onground"].isNull(), False).otherwise(flag["onground"])
    out = {"time": time.cast("long"), "icao24": F.lower(text["icao24"]), "onground": onground}
    out |= {c: F.round(v, PRECISION[c]) for c, v in number.items()}
    if "squawk" in have:
        code = numeric["squawk"]
        errors.append(problem(text["squawk"].isNotNull() & (code.isNull() | (code != F.floor(code))), "squawk", "integer"))
        out["squawk"] = code.cast("int")
    if "qnh_hpa" in have:
        errors.append(problem(~number["qnh_hpa"].between(850, 1100), "qnh_hpa", "range"))
    if "wind_from_direction_deg" in have:
        wind = number["wind_from_direction_deg"]
        errors.append(problem(~wind.between(0, 360), "wind_from_direction_deg", "range"))
        out["wind_from_direction_deg"] = F.round(F.when(wind == 360, 0.0).otherwise(wind), 2)
    if "wind_speed_mps" in have:
        errors.append(problem(number["wind_speed_mps"] < 0, "wind_speed_mps", "range"))
    if "aircraft_typecode" in have:
        code = F.upper(text["aircraft_typecode"])
        errors.append(problem(F.length(code) > 16, "aircraft_typecode", "length"))
        out["aircraft_typecode"] = code
    if "callsign" in have:
        out["callsign"] = text["callsign"]
    out |= {c: flag[c] for c in flags if c != "onground"}
    return read.withColumn("errors_", F.array_compact(F.array(*errors))).select(
        *[c for c in df.columns if c not in out], *[v.alias(c) for c, v in out.items()], F.col("errors_").alias("errors"))


def error_report(canonical: DataFrame) -> DataFrame:
    """Rows with errors, all of them named, with their number."""
    return canonical.filter(F.size("errors") > 0).withColumn("n_errors", F.size("errors"))


def step_losses(build: Callable[[Callable[[str, DataFrame], DataFrame]], dict[str, DataFrame]], keys: tuple[str, ...] = ("flight_id", "segment_id"), order: str = "time") -> DataFrame:
    """Rows and segments left after each step of a job, from metrics that one run of its last step observes.

    build(tap) makes the steps and passes each through tap. A segment is counted at its first row, by a window on the
    partitioning that the steps have anyway; steps without the keys have no segments. Nothing is stored.
    """
    taken: dict[str, Observation] = {}

    def tap(name: str, df: DataFrame) -> DataFrame:
        taken[name] = Observation()
        rows = F.count(F.lit(1)).alias("rows")
        if not set(keys) <= set(df.columns):
            return df.observe(taken[name], rows)
        first = F.lag(F.lit(1)).over(Window.partitionBy(*keys).orderBy(order)).isNull()
        return df.withColumn("first_", first).observe(taken[name], rows, F.count_if("first_").alias("segments")).drop("first_")

    last = list(build(tap).values())[-1]
    last.write.format("noop").mode("overwrite").save()
    found = [(i, name, int(o.get["rows"]), o.get.get("segments")) for i, (name, o) in enumerate(taken.items())]
    return last.sparkSession.createDataFrame(found, "step_no int, step string, rows long, segments long")
