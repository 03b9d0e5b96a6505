"""Registered queries: approach assessment, envelope fitting, context, reports and disclosure."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyledger.config import DEFAULT
from skyledger.functions.geo import signed_angle, with_runway_frame
from skyledger.operators import approach, context, disclosure, queue, reference
from skyledger.operators.approach import ATTEMPT, CRITERIA
from skyledger.plans import reports
from skyledger.plans.queries_rows import by_year
from skyledger.plans.views import STATION, register
from skyledger.session import materialize

KEY = ATTEMPT


@register("runway_candidates")
def _(v):
    return approach.runway_candidates(v.obs.select("flight_id", "time", "lat", "lon")).groupBy("flight_id", "runway").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("dist").alias("min_dist"))


@register("runway_score")
def _(v):
    return approach.runway_scores(approach.attempt_rows(v.masked)).select(
        *KEY, "runway", "gate_rows", "rows_used", "span_s", "lateral", "track_error", "min_dist", "score")


@register("infer_runway")
def _(v):
    found = approach.infer_runway(approach.runway_scores(approach.attempt_rows(v.masked)))
    margin = F.when(F.col("score_margin") < 1e9, F.col("score_margin"))
    return found.select(*KEY, "runway", "geometry_runway", "direction", "specificity", "confidence", margin.alias("score_margin"), "reason")


@register("quality_gates")
def _(v):
    rows = approach.with_frame(v.attempts)
    rows = rows.withColumns(approach.quality_gates(rows)).filter("idx = 0")
    return rows.select(*KEY, "n_rows", "duration_s", "max_gap_s", "max_ground_speed", "max_vertical_rate", approach.fatal_reasons().alias("fatal"),
                       (F.col("max_vertical_rate") > DEFAULT.max_vertical_rate).alias("altitude_rate_conflict"))


@register("attempt_outcome")
def _(v):
    rows = approach.with_outcome(approach.with_frame(v.attempts)).filter("idx = 0")
    return rows.select(*KEY, "outcome", "maneuver_idx")


@register("criterion_window")
def _(v):
    return v.assessed.select(*KEY, "start_time", "end_time", "criterion_end_time", "observed_samples", "criterion_samples", "maneuver_time",
                             (F.col("outcome") != "incomplete").alias("terminal"))


@register("vertical_bias")
def _(v):
    return v.assessed.select(*KEY, "bias", "bias_source")


def _criterion(name):
    def run(v):
        return v.assessed.select(*KEY, F.col(name).alias("status"), F.col(f"seen_{name}").alias("observed_samples"))
    return run


for key, name in zip(("crit_lateral", "crit_baro_path", "crit_descent", "crit_speed", "crit_track"), CRITERIA):
    register(key)(_criterion(name))


@register("criterion_evidence")
def _(v):
    return approach.criterion_evidence(v.attempts, envelope=v.envelope)


@register("criterion_evidence_fixed")
def _(v):
    """Evidence without a fitted reference: the fixed descent limit applies."""
    return approach.criterion_evidence(v.attempts)


ASSESSED = ("start_time", "end_time", "runway", "specificity", "status", "outcome", "reasons", "advisories", "failed", "observed_samples", "max_gap_s",
            "max_ground_speed", "max_vertical_rate", "min_threshold_m")


@register("assess_attempt")
def _(v):
    return approach.assess(v.attempts).select(*KEY, *ASSESSED, *CRITERIA)


@register("assess_operations")
def _(v):
    return approach.assess_operations(v.obs, envelope=v.envelope, tasks=v.flight_tasks).select("flight_id", "attempt_no", *ASSESSED, *CRITERIA)


@register("reference_lookup")
def _(v):
    rows = with_runway_frame(v.attempts).withColumn("speed_class", F.expr("CASE WHEN time % 2 = 0 THEN 'unknown' ELSE 'A320' END"))
    return approach.reference_lookup(rows.select("flight_id", "time", "direction", "speed_class", "along"), v.envelope).select(
        "flight_id", "time", "bin", "fallback", "speed_lo", "speed_hi", "rate_lo", "rate_hi")


@register("aircraft_lookup")
def _(v):
    return context.aircraft_lookup(context.attempt_keys(v.attempts, STATION), v.reg).select(*KEY, "icao24", "registered", "typecode")


@register("asof_weather")
def _(v):
    return context.asof_weather(context.attempt_keys(v.attempts, STATION), v.wx).select(
        *KEY, "midpoint", "observed_at", "age_s", "weather_reason", F.col("weather.qnh_hpa").alias("qnh_hpa"), F.col("weather.wind_speed").alias("wind_speed"))


@register("attempt_context")
def _(v):
    return v.context.select(*KEY, "headwind", "crosswind", "qnh_bias", "speed_class", "weather_reason")


def typed(attempts, v):
    """Attempt rows with their speed class; the class needs no weather, only the registry."""
    known = context.aircraft_lookup(context.attempt_keys(attempts, STATION), v.reg)
    return attempts.join(known.select(*KEY, F.coalesce("typecode", F.lit("unknown")).alias("speed_class")), list(KEY))


def typed_attempts(v):
    return typed(v.stored_attempts, v)


def train_attempts(v, attempts=None):
    """Attempt rows of attempts before 2019 that may enter a fit.

    The year is tested first: an attempt is judged by itself, so those of later years need not be judged.
    """
    began = F.year(F.timestamp_seconds(F.min("time").over(Window.partitionBy(*KEY))))
    rows = materialize((v.attempts if attempts is None else attempts).withColumn("year_", began).filter("year_ <= 2018").drop("year_"), "train")
    fine = reference.reference_eligible(rows).filter("reject_reason IS NULL").select(*KEY)
    return typed(rows, v).join(fine, list(KEY), "left_semi")


def fitted(v, attempts=None):
    return materialize(reference.fit_reference(materialize(reference.reference_rows(train_attempts(v, attempts)), "refrows")), "envelope")


def drift(v):
    rows = materialize(reference.reference_rows(train_attempts(v)), "refrows")
    return reference.year_drift(reference.year_cells(rows, 20), materialize(reference.fit_reference(rows), "envelope"))


@register("reference_eligible")
def _(v):
    return reference.reference_eligible(v.attempts).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("attempts"))


@register("reference_rows")
def _(v):
    return reference.reference_rows(typed_attempts(v)).groupBy("direction", "speed_class", "bin").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("speed_ok").alias("speed_samples"), F.sum("along").alias("along_sum"))


@register("attempt_balanced_quantiles")
def _(v):
    values = reference.attempt_balanced_values(reference.reference_rows(typed_attempts(v)), "speed_ok")
    return values.groupBy("direction", "speed_class", "bin").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"))


@register("fit_reference", digits=6)
def _(v):
    return fitted(v).select("direction", "speed_class", "bin", "attempt_count", "speed_samples", "rate_samples", "pooled", "speed_lo", "speed_hi", "rate_lo", "rate_hi")


@register("year_drift", digits=6)
def _(v):
    return drift(v)


@register("drift_verdict", digits=6)
def _(v):
    return reference.drift_verdict(drift(v))


@register("fit_diagnostics")
def _(v):
    return reference.fit_diagnostics(reference.reference_rows(train_attempts(v)))


@register("validate_reference")
def _(v):
    odd = fitted(v).withColumns({"speed_lo": F.expr("CASE WHEN bin = '0-1500' THEN speed_hi + 1 ELSE speed_lo END"), "rate_hi": F.expr("CASE WHEN bin = '1500-3000' THEN 30D ELSE rate_hi END")})
    return reference.reference_violations(odd).select("direction", "speed_class", "bin", "problems")


def contextual(v):
    """The assessment in context, from the stored attempts throughout."""
    facts = context.attempt_context(v.stored_attempts, v.wx, v.reg, STATION)
    return context.assess_contextual(v.stored_attempts, facts, fitted(v, v.stored_attempts))


@register("assess_contextual")
def _(v):
    return contextual(v).select(
        *KEY, "status", "outcome", "bias", "bias_source", "fallbacks", "failed", *CRITERIA, "report_age_s", "temperature_c", "dew_point_c", "effective_classes")


def pairs(v):
    return reports.base_vs_context(approach.assess(v.stored_attempts, envelope=v.envelope), contextual(v))


@register("base_vs_context")
def _(v):
    return pairs(v)


@register("context_comparison", digits=6)
def _(v):
    return reports.context_comparison(pairs(v))


@register("status_transitions")
def _(v):
    return reports.transitions(pairs(v))


@register("context_coverage", digits=6)
def _(v):
    return reports.context_coverage(reports.attempt_facts(v.assessed, v.wx, v.reg, STATION))


@register("weather_missing_reasons")
def _(v):
    return reports.missing_reasons(reports.attempt_facts(v.assessed, v.decoded, v.reg, STATION))


@register("top_typecodes")
def _(v):
    return reports.top_typecodes(reports.attempt_facts(v.assessed, v.wx, v.reg, STATION))


@register("supplied_context")
def _(v):
    rows = v.obs.select("flight_id", F.expr("CASE WHEN k % 4 = 0 AND i % 10 = 0 THEN 1013D END").alias("qnh_hpa"),
                        F.expr("CASE WHEN k % 8 = 0 AND i % 20 = 0 THEN 90D END").alias("wind_from_direction_deg"), F.lit(None).cast("double").alias("wind_speed_mps"),
                        F.expr("CASE WHEN k % 5 = 0 AND i = 3 THEN 'b738' WHEN k % 5 <= 1 AND i < 9 THEN 'A320' END").alias("aircraft_typecode"))
    return context.supplied_context_violations(rows)


# ---- reports ----------------------------------------------------------------------------------

@register("dataset_audit", digits=6)
def _(v):
    return reports.dataset_audit(v.obs, materialize(v.assessed, "assessed"))


@register("feasibility_report")
def _(v):
    flights = by_year(v).filter(F.col("fold") == reports.allowed_fold("train")).select("flight_id").distinct()
    return reports.feasibility_counts(approach.assess_operations(v.obs.join(flights, "flight_id", "left_semi"), envelope=v.envelope, tasks=v.flight_tasks))


@register("feasibility_examples")
def _(v):
    return reports.feasibility_examples(v.assessed)


@register("attempt_queue_counts")
def _(v):
    return v.assessed.groupBy("status", "outcome").agg(F.count(F.lit(1)).alias("n"))


@register("attempt_summary", digits=6)
def _(v):
    s = reports.attempt_summary(v.assessed)
    return s.withColumn("score_margin", F.when(F.col("score_margin") < 1e9, F.col("score_margin")))


@register("rank_attempts")
def _(v):
    return queue.rank_attempts(reports.attempt_summary(v.assessed)).select("attempt_id", "status", "start_time")


@register("filter_attempt_queue")
def _(v):
    return queue.filter_attempts(reports.attempt_summary(v.assessed), status="review_required", criterion="observed_descent_rate").select("attempt_id", "direction", "outcome", "start_time")


@register("landing_outcome")
def _(v):
    return reports.landing_outcome(v.assessed)


@register("quality_flag_union")
def _(v):
    return v.assessed.select(*KEY, reports.quality_flags().alias("flags"))


@register("case_path")
def _(v):
    rows = with_runway_frame(v.attempts)
    return rows.select(*KEY, "time", "along", "cross", (F.col("baroaltitude") - F.col("elevation")).alias("height"), signed_angle("heading", "bearing").alias("track_offset"))


@register("sample_evenly")
def _(v):
    return queue.sample_evenly(v.attempts, 20).select(*KEY, "time")


@register("cap_evidence")
def _(v):
    evidence = approach.criterion_evidence(v.attempts, envelope=v.envelope)
    w = Window.partitionBy(*KEY, "criterion")
    ranked = evidence.withColumns({"rn": F.row_number().over(w.orderBy("start_idx")), "n": F.count(F.lit(1)).over(w)})
    return ranked.filter("rn <= 25").select(*KEY, "criterion", "start_idx", F.greatest(F.col("n") - 25, F.lit(0)).alias("evidence_truncated"))


@register("evaluation_ref")
def _(v):
    ref = disclosure.evaluation_ref(F.lit("digest"), F.col("flight_id"), F.col("attempt_no"), F.col("start_time"), F.col("end_time"))
    return v.assessed.select(*KEY, ref.alias("evaluation_ref"))


# ---- disclosure -------------------------------------------------------------------------------

def count_maps(v):
    """Counts by direction and outcome: some cells are small."""
    return v.assessed.groupBy(F.concat_ws(":", "geometry_runway", "specificity").alias("section"), F.concat_ws("/", "status", "outcome").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@register("suppress_small_cells")
def _(v):
    return disclosure.suppress_small_cells(count_maps(v), ["section"])


@register("suppress_nested")
def _(v):
    return disclosure.suppress_small_cells(reports.count_sections(v.assessed).filter("section LIKE 'criterion:%'"), ["section"])


@register("published_rate", digits=6)
def _(v):
    return reports.publish_counts(count_maps(v)).select("section", "key", "value", "flag", "rate")


@register("suppression_recoverable")
def _(v):
    # one map more, with a single case beside a companion of ten: its hidden cell follows from the total
    kinds = v.obs.groupBy(F.expr("k % 16").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    tight = kinds.select(F.lit("kinds").alias("section"), F.concat(F.lit("kind "), F.col("kind").cast("string")).alias("key"),
                         F.expr("CASE WHEN kind = 4 THEN least(n, 1L) ELSE least(n, 10L) END").alias("n")).filter("key IN ('kind 4', 'kind 9')")
    return disclosure.suppression_recoverable(count_maps(v).unionByName(tight), ["section"])
