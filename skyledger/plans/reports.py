"""Reports over assessed attempts. Every count map of a report comes from one grouped pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.decode import crosswind_from_right, headwind, qnh_bias_m, supported_bias
from skyledger.operators.approach import ATTEMPT, CRITERIA
from skyledger.operators.context import aircraft_lookup, asof_weather
from skyledger.operators.disclosure import published_rate, suppress_small_cells


def _entry(section: str, key: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), key.alias("key"))


def count_sections(assessed: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """(section, key, n): statuses, outcomes, directions, reasons, advisories and criterion statuses."""
    single = [_entry("status", F.col("status")), _entry("outcome", F.col("outcome")), _entry("direction", F.coalesce("direction", F.lit("unknown"))),
              *[_entry(f"criterion:{c}", F.col(c)) for c in CRITERIA], *[_entry(s, F.col(c)) for s, c in (extra or {}).items()]]
    entries = F.concat(F.array(*single), F.transform("reasons", lambda x: _entry("reason", x)), F.transform("advisories", lambda x: _entry("advisory", x)))
    return assessed.select(F.inline(entries)).groupBy("section", "key").agg(F.count(F.lit(1)).alias("n"))


def headline(obs: DataFrame, assessed: DataFrame) -> DataFrame:
    """Rows, operations, attempts and the two rates, as one row."""
    size = obs.groupBy("flight_id").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("operations"))
    can = F.col("status") != "not_assessable"
    per_flight = assessed.groupBy("flight_id").agg(F.count(F.lit(1)).alias("a"), F.count_if(can).alias("ok"), F.count_if(F.col("status") == "review_required").alias("review"))
    totals = per_flight.agg(F.count(F.lit(1)).alias("operations_with_attempts"), F.coalesce(F.sum("a"), F.lit(0)).alias("attempts"),
                            F.coalesce(F.sum("ok"), F.lit(0)).alias("assessable_attempts"), F.coalesce(F.sum("review"), F.lit(0)).alias("review_"))
    n, ok = F.col("attempts"), F.col("assessable_attempts")
    return size.crossJoin(totals).withColumns({
        "abstention_rate": F.round((n - ok) / F.nullif(n, F.lit(0)), 4), "review_rate_among_assessable": F.round(F.col("review_") / F.nullif(ok, F.lit(0)), 4)}).drop("review_")


def dataset_audit(obs: DataFrame, assessed: DataFrame) -> DataFrame:
    """The audit as a long table: headline figures and count maps."""
    top = headline(obs, assessed)
    figures = F.array(*[F.struct(F.lit("headline").alias("section"), F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in top.columns])
    return top.select(F.inline(figures)).unionByName(count_sections(assessed).select("section", "key", F.col("n").cast("double").alias("value")))


def feasibility_counts(assessed: DataFrame) -> DataFrame:
    return count_sections(assessed, {"specificity": "specificity", "altitude_source": "bias_source"})


def feasibility_examples(assessed: DataFrame, k: int = 25) -> DataFrame:
    """The first k attempts by operation and number: a listing, so the limit is the feature."""
    return assessed.orderBy("flight_id", "attempt_no").limit(k).select("flight_id", "attempt_no", "status", "runway", "reasons", "failed")


def allowed_fold(fold: str) -> str:
    if fold not in ("train", "val"):
        raise ValueError("only train and val may be examined")
    return fold


def attempt_facts(assessed: DataFrame, reports: DataFrame, registry: DataFrame, station: str) -> DataFrame:
    """Context availability per attempt, at the middle of its assessed rows.

    missing_reasons: why no report was matched, else what the matched report itself lacks, and a pressure whose
    altitude bias is beyond the supported one.
    """
    keyed = assessed.select(*ATTEMPT, "status", "bearing", "barometric_path_proxy", F.expr("(start_time + end_time) div 2").alias("midpoint"),
                            F.lower(F.substring_index("flight_id", "_", 1)).alias("icao24"), F.lit(station).alias("station"))
    joined = asof_weather(aircraft_lookup(keyed, registry), reports)
    flat = joined.withColumns({c: F.col(f"weather.{c}") for c in ("qnh_hpa", "wind_from_deg", "wind_speed")})
    own = F.col("weather.missing_reasons") if "missing_reasons" in reports.columns else F.lit(None)
    lacking = F.when(F.col("weather_reason").isNotNull(), F.array("weather_reason")).otherwise(F.coalesce(own.cast("array<string>"), F.array().cast("array<string>")))
    unsupported = F.when(qnh_bias_m().isNotNull() & supported_bias().isNull(), "qnh_pressure_altitude_proxy_outside_supported_bias")
    return flat.withColumns({"headwind": headwind(), "crosswind": F.abs(crosswind_from_right()), "missing_reasons": F.array_compact(F.concat(lacking, F.array(unsupported)))})


def context_coverage(facts: DataFrame) -> DataFrame:
    """The nine availability rates and the three gates, as one row."""
    seen = {"weather_match": F.col("weather").isNotNull(), "qnh": F.col("qnh_hpa").isNotNull(), "wind_speed": F.col("wind_speed").isNotNull(),
            "wind_direction": F.col("wind_from_deg").isNotNull(), "wind_components": F.col("headwind").isNotNull(), "aircraft_metadata": F.col("registered"),
            "aircraft_typecode": F.col("typecode").isNotNull(), "path_current": F.col("barometric_path_proxy") != "not_observed", "path_upper_bound": F.col("qnh_hpa").isNotNull()}
    row = facts.agg(F.count(F.lit(1)).alias("attempts"), *[F.avg(c.cast("double")).alias(f"{n}_rate") for n, c in seen.items()])

    def gate(rate: str, least: float) -> Column:
        return F.when(F.col(rate) >= least, "passed").otherwise("failed")

    return row.withColumns({"gate_weather_qnh": gate("qnh_rate", 0.95), "gate_wind_direction": gate("wind_direction_rate", 0.80), "gate_aircraft_type": gate("aircraft_typecode_rate", 0.80)}
                           | {f"{n}_rate": F.round(f"{n}_rate", 4) for n in seen})


def missing_reasons(facts: DataFrame) -> DataFrame:
    """Attempts per missing reason."""
    return facts.select(F.explode("missing_reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def top_typecodes(facts: DataFrame, k: int = 20) -> DataFrame:
    return facts.filter("typecode IS NOT NULL").groupBy("typecode").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "typecode").limit(k)


def base_vs_context(base: DataFrame, contextual: DataFrame) -> DataFrame:
    """Both assessments of every attempt; an attempt on one side only shows as a null status."""
    b = base.select(*ATTEMPT, F.col("status").alias("base_status"))
    c = contextual.select(*ATTEMPT, F.col("status").alias("context_status"), "fallbacks")
    return b.join(c, list(ATTEMPT), "full_outer")


def context_comparison(pairs: DataFrame) -> DataFrame:
    """Review overlap, review rates and reference coverage, as one row."""
    b, c = F.col("base_status"), F.col("context_status")
    rb, rc = b == "review_required", c == "review_required"
    exact = F.array_contains("fallbacks", "exact")
    n = F.count(F.lit(1))
    return pairs.agg(
        n.alias("attempts"), F.count_if(b.isNull() | c.isNull()).alias("unpaired"), F.count_if(rb & rc).alias("both"), F.count_if(~rb & rc).alias("context_only"), F.count_if(rb & ~rc).alias("base_only"),
        F.round(F.count_if(rb) / F.nullif(F.count_if(b != "not_assessable"), F.lit(0)), 4).alias("base_review_rate"),
        F.round(F.count_if(rc) / F.nullif(F.count_if(c != "not_assessable"), F.lit(0)), 4).alias("context_review_rate"),
        F.round(F.try_divide(F.count_if(exact), n), 4).alias("any_exact"), F.round(F.try_divide(F.count_if(exact & (F.size("fallbacks") == 1)), n), 4).alias("all_exact"))


def transitions(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.concat_ws("->", "base_status", "context_status").alias("transition")).agg(F.count(F.lit(1)).alias("n"))


def publish_counts(counts: DataFrame) -> DataFrame:
    """Disclosure-safe count maps with rates over the map total where they may be shown."""
    total = F.sum("n").over(Window.partitionBy("section"))
    safe = suppress_small_cells(counts.withColumn("total", total), ["section"])
    return safe.withColumn("rate", published_rate(F.col("value"), F.col("total"), F.col("flag")))


def landing_outcome(assessed: DataFrame) -> DataFrame:
    known = F.col("outcome").isin("landing_observed", "touch_and_go")
    reason = (F.when(known, None).when(F.col("outcome") == "go_around", "go_around_observed").when(F.col("last_along") > 0, "evidence_ends_before_threshold")
              .otherwise("landing_not_observed"))
    return assessed.select(*ATTEMPT, known.alias("available"), reason.alias("reason"), F.round("last_along", 1).alias("evidence_end_along_m"))


def quality_flags() -> Column:
    return F.array_sort(F.array_distinct(F.concat("reasons", "advisories")))


def attempt_summary(assessed: DataFrame) -> DataFrame:
    """The flat queue row of an attempt."""
    return assessed.select(
        F.concat(F.col("flight_id"), F.lit(":attempt-"), F.col("attempt_no").cast("string")).alias("attempt_id"), F.col("flight_id").alias("operation_id"),
        "status", "direction", "runway", "geometry_runway", "specificity", F.round("confidence", 4).alias("confidence"), F.round("score_margin", 4).alias("score_margin"),
        "failed", "outcome", "observed_samples", F.round("max_gap_s", 1).alias("max_gap_s"), "start_time", "end_time", "reasons", quality_flags().alias("quality_flags"))
