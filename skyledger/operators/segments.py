"""Per-segment judgements: go-arounds, terminal windows, data-quality lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.geo import haversine_m
from skyledger.operators.resample import SEGMENT
from skyledger.operators.sequence import grounded, ordered, running
from skyledger.operators.windows import any_mask


def with_airborne_runs(clean: DataFrame, keys=SEGMENT) -> DataFrame:
    """run: numbers the contiguous airborne stretches (rows on the ground separate them)."""
    return clean.withColumn("run", F.sum(grounded().cast("long")).over(running(keys)))


def detect_go_around(clean: DataFrame) -> DataFrame:
    """Segments with a low point near a runway, a real descent into it and a climb out, in one airborne run."""
    runs = with_airborne_runs(clean).filter(~grounded())
    in_run, w = Window.partitionBy(*SEGMENT, "run"), ordered([*SEGMENT, "run"])
    runs = runs.withColumns({
        "j": F.row_number().over(w), "airborne": F.count(F.lit(1)).over(Window.partitionBy(*SEGMENT))})
    runs = runs.withColumn("low", F.min(F.when(F.col("dist_to_runway_m") < 5000, F.struct("baroaltitude", "j"))).over(in_run))
    peaks = runs.groupBy(*SEGMENT, "run").agg(
        F.first("low").alias("low"), F.first("airborne").alias("airborne"),
        F.max(F.when(F.col("j") < F.col("low.j"), F.col("baroaltitude"))).alias("before"),
        F.max(F.when(F.col("j") > F.col("low.j"), F.col("baroaltitude"))).alias("after"))
    low = F.col("low.baroaltitude")
    hit = (F.col("airborne") >= 5) & (low < 500) & (F.col("before") - low >= 300) & (F.col("after") - low >= 300)
    flagged = peaks.groupBy(*SEGMENT).agg(F.max(F.coalesce(hit, F.lit(False))).alias("is_go_around"))
    return clean.select(*SEGMENT).distinct().join(flagged, list(SEGMENT), "left").withColumn("is_go_around", F.coalesce("is_go_around", F.lit(False)))


def segment_facts(clean: DataFrame, window: int) -> DataFrame:
    """What the assessment needs, over the first `window` rows of each segment."""
    w = ordered(SEGMENT)
    rows = clean.withColumns({"step": F.row_number().over(w), "total": F.count(F.lit(1)).over(Window.partitionBy(*SEGMENT))}).filter(F.col("step") <= window)
    rows = rows.withColumns({
        "dt": F.col("time") - F.lag("time").over(w), "jump": F.abs(F.col("baroaltitude") - F.lag("baroaltitude").over(w)),
        "move": haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")})
    zero = F.lit(0.0)
    near = (F.col("dist_to_runway_m") < 5000) & (F.col("baroaltitude") < 1500)
    return rows.groupBy(*SEGMENT).agg(
        F.max("total").alias("n_steps"), F.count_if(~any_mask()).alias("valid_steps"), F.count(F.lit(1)).alias("window_steps"),
        F.coalesce(F.max("jump"), zero).alias("max_altitude_jump_m"), F.coalesce(F.max(F.try_divide("jump", "dt")), zero).alias("max_vertical_rate"),
        F.coalesce(F.max(F.try_divide("move", "dt")), zero).alias("max_ground_speed"), F.max(F.coalesce(near, F.lit(False))).alias("terminal_op"))


def assessment_state(min_valid: int = 30) -> dict[str, Column]:
    """flags, assessment_state, review_lane and verdict from the segment facts."""
    short = F.col("valid_steps") < min_valid
    climb, jump, away = F.col("max_vertical_rate") > 50, F.col("max_ground_speed") > 400, ~F.col("terminal_op")
    state = (F.when(short, "insufficient_data").when(climb | jump, "data_quality_conflict").when(away, "coverage_limited").otherwise("reviewable"))
    lane = F.when(short | climb | jump, "data_quality").when(away, "coverage").otherwise("behavioral")
    flags = F.array_compact(F.array(
        F.when(short, "insufficient_observations"), F.when(climb, "altitude_rate_conflict"), F.when(jump, "position_rate_conflict"),
        F.when(away & F.col("truncated"), "terminal_phase_not_scored").when(away, "nonterminal_window")))
    return {"data_quality_flags": flags, "assessment_state": state, "review_lane": lane,
            "behavioral_verdict": F.when(short | climb | jump | away, "not_assessable").otherwise("reviewable"),
            "observed_fraction": F.round(F.col("valid_steps") / F.greatest(F.col("window_steps"), F.lit(1)), 4)}


def assess_segments(clean: DataFrame, window: int, min_valid: int = 30) -> DataFrame:
    facts = segment_facts(clean, window).withColumn("truncated", F.col("n_steps") > window)
    return facts.withColumns(assessment_state(min_valid)).withColumns(
        {c: F.round(c, 1) for c in ("max_altitude_jump_m", "max_vertical_rate", "max_ground_speed")})
