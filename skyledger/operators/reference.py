"""Fitting the percentile envelope from train attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.config import DEFAULT, MAX_RATE, MAX_SPEED, MIN_CELL_ATTEMPTS, MIN_CELL_SAMPLES, ApproachConfig
from skyledger.functions.geo import along_track_m, distance_bin
from skyledger.operators.approach import ATTEMPT, assess
from skyledger.operators.dedupe import observed
from skyledger.operators.ranks import exact_quantiles

CELL = ("direction", "speed_class", "bin")
QUANTILE_GRID = tuple(i / 100 for i in range(101))


def rejection_reason() -> F.Column:
    return F.when(F.col("status") == "not_assessable", "quality_or_coverage").when(
        F.col("outcome").isin("go_around", "incomplete"), F.col("outcome"))


def reference_eligible(attempts: DataFrame, cfg: ApproachConfig = DEFAULT) -> DataFrame:
    """Attempts assessed without a reference, with the reason each would be refused for fitting."""
    return assess(attempts, cfg).withColumn("reject_reason", rejection_reason())


def reference_rows(attempts: DataFrame) -> DataFrame:
    """Rows before the threshold with a distance bin, once per own class and once as 'unknown'."""
    cls = F.coalesce(F.col("speed_class"), F.lit("unknown")) if "speed_class" in attempts.columns else F.lit("unknown")
    speed, rate = F.when(observed(attempts, "velocity"), F.col("velocity")), F.when(observed(attempts, "vertrate"), F.col("vertrate"))
    return (
        attempts.withColumn("along", along_track_m())
        .withColumns({"bin": distance_bin("along"), "speed": speed, "rate": rate})
        .filter(F.col("bin").isNotNull() & (F.col("speed").isNotNull() | F.col("rate").isNotNull()))
        .select(*ATTEMPT, "time", "direction", "bin", "along", "speed", "rate",
                F.explode(F.array_distinct(F.array(cls, F.lit("unknown")))).alias("speed_class"))
        .withColumns({"speed_ok": F.when(plausible_speed(), F.col("speed")), "rate_ok": F.when(plausible_rate(), F.col("rate"))})
    )


def plausible_speed(speed: str = "speed") -> F.Column:
    return F.col(speed).between(0.0, MAX_SPEED)


def plausible_rate(rate: str = "rate") -> F.Column:
    return F.abs(rate) <= MAX_RATE


def attempt_balanced_values(rows: DataFrame, value: str, keys=CELL) -> DataFrame:
    """101 quantiles per attempt and cell, so every attempt weighs the same in the pool."""
    grid = F.array(*[F.lit(q) for q in QUANTILE_GRID])
    per_attempt = rows.filter(F.col(value).isNotNull()).groupBy(*keys, *ATTEMPT).agg(F.percentile(value, grid).alias("grid"))
    return per_attempt.select(*keys, F.explode("grid").alias("v"))


def cell_counts(rows: DataFrame, keys=CELL) -> DataFrame:
    """Attempts and plausible samples per cell; attempts are folded before the wide grouping."""
    per_attempt = rows.groupBy(*keys, *ATTEMPT).agg(F.count("speed_ok").alias("s"), F.count("rate_ok").alias("r"))
    return per_attempt.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempt_count"), F.sum("s").alias("speed_samples"),
                                          F.sum("r").alias("rate_samples"))


def fit_reference(rows: DataFrame, min_attempts: int = MIN_CELL_ATTEMPTS, min_samples: int = MIN_CELL_SAMPLES) -> DataFrame:
    """1% and 99% bounds of speed and vertical rate for every supported cell."""
    counts = cell_counts(rows)
    speed = exact_quantiles(attempt_balanced_values(rows, "speed_ok"), "v", [0.01, 0.99], CELL)
    rate = exact_quantiles(attempt_balanced_values(rows, "rate_ok"), "v", [0.01, 0.99], CELL)
    return (
        counts.filter((F.col("attempt_count") >= min_attempts) & (F.col("speed_samples") >= min_samples)
                      & (F.col("rate_samples") >= min_samples))
        .join(speed.select(*CELL, F.col("n").alias("pooled"), F.col("q0").alias("speed_lo"), F.col("q1").alias("speed_hi")), list(CELL))
        .join(rate.select(*CELL, F.col("q0").alias("rate_lo"), F.col("q1").alias("rate_hi")), list(CELL))
        .withColumns({c: F.round(c, 4) for c in ("speed_lo", "speed_hi", "rate_lo", "rate_hi")})
    )


def year_cells(rows: DataFrame, min_attempts: int = MIN_CELL_ATTEMPTS) -> DataFrame:
    """Median speed and rate per year, direction and bin of the 'unknown' class."""
    keys = ("year", "direction", "bin")
    first = rows.filter("speed_class = 'unknown'").join(
        rows.groupBy(*ATTEMPT).agg(F.year(F.timestamp_seconds(F.min("time"))).alias("year")), list(ATTEMPT))
    speed = exact_quantiles(attempt_balanced_values(first, "speed_ok", keys), "v", [0.5], keys)
    rate = exact_quantiles(attempt_balanced_values(first, "rate_ok", keys), "v", [0.5], keys)
    return (
        cell_counts(first, keys).filter(F.col("attempt_count") >= min_attempts).select(*keys, "attempt_count")
        .join(speed.select(*keys, F.round("q0", 4).alias("speed_median")), list(keys))
        .join(rate.select(*keys, F.round("q0", 4).alias("rate_median")), list(keys))
    )


def year_drift(cells: DataFrame, envelope: DataFrame, limit: float = 0.5) -> DataFrame:
    """How far medians move between years, as a share of the envelope width."""
    keys = ["direction", "bin"]
    spread = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("years"), (F.max("speed_median") - F.min("speed_median")).alias("s"),
        (F.max("rate_median") - F.min("rate_median")).alias("r")).filter("years >= 2")
    widths = envelope.filter("speed_class = 'unknown'").select(
        *keys, (F.col("speed_hi") - F.col("speed_lo")).alias("sw"), (F.col("rate_hi") - F.col("rate_lo")).alias("rw"))
    joined = spread.join(widths, keys)
    shares = joined.select(*keys, "years",
                           F.round(F.coalesce(F.col("s") / F.nullif("sw", F.lit(0.0)), F.lit(0.0)), 4).alias("speed_shift"),
                           F.round(F.coalesce(F.col("r") / F.nullif("rw", F.lit(0.0)), F.lit(0.0)), 4).alias("rate_shift"))
    return shares.withColumn("within_limit", F.greatest("speed_shift", "rate_shift") <= limit)


def drift_verdict(drift: DataFrame, limit: float = 0.5) -> DataFrame:
    """One row over all compared cells: 'pass' if no median moved by more than the limit, else 'review'.

    Without a cell that was seen in two years there is nothing to compare, which is a matter for review.
    """
    row = drift.agg(F.count(F.lit(1)).alias("comparisons"), F.count_if(~F.col("within_limit")).alias("above_limit"),
                    F.max(F.greatest("speed_shift", "rate_shift")).alias("max_shift"))
    return row.withColumn("acceptance_limit", F.lit(limit)).withColumn("status", F.when(F.col("max_shift") <= limit, "pass").otherwise("review"))


def fit_diagnostics(rows: DataFrame) -> DataFrame:
    """(dimension, value, attempts): how many attempts a fit took in, by year, direction and own speed class.

    Attempts are folded to one row each before they are counted along the dimensions.
    """
    own = F.coalesce(F.max(F.when(F.col("speed_class") != "unknown", F.col("speed_class"))), F.lit("unknown"))
    attempts = rows.groupBy(*ATTEMPT).agg(F.year(F.timestamp_seconds(F.min("time"))).cast("string").alias("year"), F.min("direction").alias("direction"), own.alias("speed_class"))
    named = [F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("year", "direction", "speed_class")]
    every = F.struct(F.lit("accepted").alias("dimension"), F.lit("all").alias("value"))
    return attempts.select(F.inline(F.array(every, *named))).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("attempts"))


def reference_violations(envelope: DataFrame, fit_fold: str = "train") -> DataFrame:
    """Cells whose bounds are out of order or implausible, or which were not fitted on train."""
    problem = F.array_compact(F.array(
        F.when(F.lit(fit_fold != "train"), "not_fitted_on_train"),
        F.when(~(F.col("speed_lo") <= F.col("speed_hi")), "speed_bounds_out_of_order"),
        F.when((F.col("speed_lo") < 0) | (F.col("speed_hi") > MAX_SPEED), "speed_bounds_implausible"),
        F.when(~(F.col("rate_lo") <= F.col("rate_hi")), "rate_bounds_out_of_order"),
        F.when(F.greatest(F.abs("rate_lo"), F.abs("rate_hi")) > MAX_RATE, "rate_bounds_implausible")))
    return envelope.withColumn("problems", problem).filter(F.size("problems") > 0)
