"""Weather and registry context for attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.config import DEFAULT, WEATHER_MAX_AGE_S, ApproachConfig
from skyledger.functions.decode import crosswind_from_right, headwind, qnh_bias_m, supported_bias
from skyledger.operators.approach import ATTEMPT, assess
from skyledger.session import materialize

SHOWN = ("report_age_s", "temperature_c", "dew_point_c", "headwind", "crosswind")
HOUR_S = 3_600
DAY_S = 86_400


def prefer_report_type(reports: DataFrame, preferred: str = "FM-15", order: str = "file_order") -> DataFrame:
    """One report per station and time: the preferred type wins, else the first in file order."""
    rest = [c for c in reports.columns if c not in ("STATION", "observed_at")]
    rank = (F.col("REPORT_TYPE") != preferred).cast("int")
    best = F.min(F.struct(rank.alias("rank_"), F.col(order).alias("order_"), *rest)).alias("b")
    return reports.groupBy("STATION", "observed_at").agg(best).select("STATION", "observed_at", *[f"b.{c}" for c in rest])


def asof_weather(attempts: DataFrame, reports: DataFrame, at: str = "midpoint", station: str = "station",
                 max_age_s: int = WEATHER_MAX_AGE_S) -> DataFrame:
    """Latest report at or before each attempt, as one equi-join on (station, hour).

    Each report is valid until the next one, so it is listed once for every hour it covers; an
    attempt then finds exactly one. Attempts after a station's last report use one row per station.
    Adds observed_at, age_s, weather (null if too old) and weather_reason.
    """
    fields = [c for c in reports.columns if c not in (station, "observed_at")]
    # the next report of a day's last one is the first of the next day that has any: one row per station and day
    days = Window.partitionBy(station).orderBy("day_")
    dated = reports.select(station, "observed_at", F.struct(*fields).alias("w"), F.floor(F.col("observed_at") / DAY_S).alias("day_"))
    firsts = dated.groupBy(station, "day_").agg(F.min("observed_at").alias("first_")).withColumn("next_", F.lead("first_").over(days))
    follow = Window.partitionBy(station, "day_").orderBy("observed_at")
    # merge joins: a plan cannot know how many reports derived rows hold, and a broadcast would pass all of them through the driver
    spans = dated.withColumn("until", F.lead("observed_at").over(follow)).join(firsts.select(station, "day_", "next_").hint("merge"), [station, "day_"])
    spans = spans.withColumn("until", F.coalesce("until", "next_")).drop("day_", "next_")
    closed = spans.filter("until IS NOT NULL").withColumn("hour", F.explode(F.sequence(
        F.floor(F.col("observed_at") / HOUR_S), F.floor((F.col("until") - 1) / HOUR_S))))
    last = spans.filter("until IS NULL").select(station, F.col("observed_at").alias("last_at"), F.col("w").alias("last_w"))
    keyed = attempts.withColumn("hour", F.floor(F.col(at) / HOUR_S)).alias("a")
    spans_at = closed.select(F.col(station).alias("s_"), F.col("hour").alias("h_"), F.col("observed_at").alias("from_"), "until", "w").hint("merge")
    hit = (F.col(f"a.{station}") == F.col("s_")) & (F.col("a.hour") == F.col("h_")) & (
        F.col(f"a.{at}") >= F.col("from_")) & (F.col(f"a.{at}") < F.col("until"))
    joined = keyed.join(spans_at, hit, "left").drop("s_", "h_", "until").join(F.broadcast(last), station, "left")  # one row per station
    late = F.col(at) >= F.col("last_at")
    joined = joined.withColumns({
        "observed_at": F.when(late, F.col("last_at")).otherwise(F.col("from_")),
        "w": F.when(late, F.col("last_w")).otherwise(F.col("w")),
    })
    joined = joined.withColumn("age_s", F.col(at) - F.col("observed_at"))
    reason = (F.when(F.col("last_at").isNull(), "weather_observation_unavailable")
              .when(F.col("observed_at").isNull(), "weather_observation_not_yet_available")
              .when(F.col("age_s") > max_age_s, "latest_prior_weather_observation_too_old"))
    return joined.withColumns({
        "weather_reason": reason, "weather": F.when(reason.isNull(), F.col("w")),
    }).drop("from_", "last_at", "last_w", "w", "hour")


def attempt_keys(attempts: DataFrame, station: str) -> DataFrame:
    """One row per attempt with its midpoint (whole seconds) and aircraft."""
    return (
        attempts.groupBy(*ATTEMPT).agg(F.min("time").alias("a"), F.max("time").alias("z"), F.first("bearing").alias("bearing"))
        .select(*ATTEMPT, F.expr("(a + z) div 2").alias("midpoint"), "bearing",
                F.lower(F.substring_index("flight_id", "_", 1)).alias("icao24"), F.lit(station).alias("station"))
    )


def aircraft_lookup(attempts: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry fields by the aircraft part of the flight id; typecode trimmed, upper, blank to null."""
    typed = registry.withColumns({
        "icao24": F.lower(F.trim("icao24")),
        "typecode": F.nullif(F.upper(F.trim(F.coalesce("typecode", F.lit("")))), F.lit(""))})
    rest = [c for c in typed.columns if c not in ("icao24", "typecode")]
    # of repeated keys the row with the smallest type code counts, then the smallest rest; no code comes last
    best = F.min(F.struct(F.col("typecode").isNull().alias("none_"), "typecode", *rest)).alias("b")
    fields = typed.groupBy("icao24").agg(best).select("icao24", "b.*").drop("none_").withColumn("registered", F.lit(True))
    return attempts.join(fields, "icao24", "left").withColumn("registered", F.coalesce("registered", F.lit(False)))


def attempt_context(attempts: DataFrame, reports: DataFrame, registry: DataFrame, station: str) -> DataFrame:
    """Weather, wind components, altitude bias and type of every attempt."""
    joined = asof_weather(aircraft_lookup(attempt_keys(attempts, station), registry), reports)
    flat = joined.withColumns({c: F.col(f"weather.{c}") for c in ("qnh_hpa", "wind_from_deg", "wind_speed")})
    given = set(reports.columns)
    flat = flat.withColumns({c: F.col(f"weather.{c}") if c in given else F.lit(None).cast("double") for c in ("temperature_c", "dew_point_c")})
    return flat.withColumns({
        "headwind": headwind(), "crosswind": crosswind_from_right(), "qnh_bias": qnh_bias_m(),
        "bias_override": supported_bias(), "bias_override_source": F.lit("qnh_pressure_altitude_proxy"),
        "speed_class": F.coalesce("typecode", F.lit("unknown")),
        "report_age_s": F.when(F.col("weather_reason").isNull(), F.col("age_s")),
    })


def assess_contextual(attempts: DataFrame, context: DataFrame, envelope: DataFrame, cfg: ApproachConfig = DEFAULT) -> DataFrame:
    """Assess with the pressure-derived bias and the aircraft's own class.

    Wind, report age, temperature, dew point and the class that counted are shown only; the class is that of the
    envelope rows used, so an attempt that fell back on the unknown class shows both.
    """
    context = materialize(context, "context")  # one row per attempt, read twice
    facts = context.select(*ATTEMPT, "bias_override", "bias_override_source", "speed_class")
    judged = assess(attempts.drop("speed_class").join(facts, list(ATTEMPT)), cfg, envelope)
    shown = context.select(*ATTEMPT, *[c for c in SHOWN if c not in judged.columns], F.col("speed_class").alias("own_class"))
    fallback = F.array_contains(F.split("fallbacks", ","), "unknown_speed_class") if dict(judged.dtypes)["fallbacks"] == "string" else F.array_contains("fallbacks", "unknown_speed_class")
    classes = F.when(fallback, F.when(F.col("own_class") == "unknown", F.lit("unknown")).otherwise(F.concat_ws(",", "own_class", F.lit("unknown")))).otherwise(F.col("own_class"))
    return judged.join(shown, list(ATTEMPT), "left").withColumn("effective_classes", classes).drop("own_class")


def supplied_context_violations(df: DataFrame) -> DataFrame:
    """Operations whose supplied weather is not co-located or whose type code is not unique."""
    fields = ("qnh_hpa", "wind_from_direction_deg", "wind_speed_mps")
    typecode = F.nullif(F.upper(F.trim("aircraft_typecode")), F.lit(""))
    anywhere = df.groupBy("flight_id").agg(
        *[F.max(F.col(f).isNotNull()).alias(f"has_{f}") for f in fields],
        F.array_sort(F.collect_set(F.array_join(F.transform(
            F.array(*[F.col(f).isNotNull() for f in fields]), lambda x: F.when(x, "1").otherwise("0")), ""))).alias("patterns"),
        F.min(typecode).alias("type_lo"), F.max(typecode).alias("type_hi"))
    full = F.array_join(F.array(*[F.when(F.col(f"has_{f}"), "1").otherwise("0") for f in fields]), "")
    sparse = F.exists("patterns", lambda p: (p != "000") & (p != full))
    return anywhere.select(
        "flight_id", sparse.alias("sparse_weather_context"),
        (~F.col("type_lo").eqNullSafe(F.col("type_hi"))).alias("conflicting_aircraft_context")
    ).filter("sparse_weather_context OR conflicting_aircraft_context")
