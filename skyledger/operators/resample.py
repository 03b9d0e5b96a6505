"""Uniform ten-second grid and the cleaning job built around it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.config import EMERGENCY_SQUAWKS, GRID_S, INTERPOLATED, MEASURED, PREP, PrepConfig
from skyledger.functions.geo import closest_runway_m
from skyledger.operators.dedupe import dedupe_rounded_time
from skyledger.operators.derive import filter_d, heading_parts, normalised_heading
from skyledger.operators.sequence import ordered, running, segment_gaps, trim_idle, with_step_speed

SEGMENT = ("flight_id", "segment_id")


def impossible_flags(cfg: PrepConfig = PREP) -> dict[str, Column]:
    no = F.lit(False)
    return {
        "imp_velocity": F.coalesce(F.abs("velocity") > cfg.max_velocity, no),
        "imp_vertrate": F.coalesce(F.abs("vertrate") > cfg.max_vertrate, no),
        "imp_baroaltitude": F.coalesce((F.col("baroaltitude") > cfg.max_altitude) | (F.col("baroaltitude") < cfg.min_altitude), no),
    }


def flag_impossible(df: DataFrame, cfg: PrepConfig = PREP) -> DataFrame:
    """Null the impossible values (flagged) and the airborne zero speed (not flagged)."""
    placeholder = F.coalesce((F.col("velocity") == 0) & (F.col("baroaltitude") > cfg.placeholder_altitude), F.lit(False))
    flagged = df.withColumns(impossible_flags(cfg) | {"placeholder": placeholder})
    return flagged.withColumns({
        "velocity": F.when(~(F.col("imp_velocity") | F.col("placeholder")), F.col("velocity")),
        "vertrate": F.when(~F.col("imp_vertrate"), F.col("vertrate")),
        "baroaltitude": F.when(~F.col("imp_baroaltitude"), F.col("baroaltitude")),
    }).drop("placeholder")


def with_counters(df: DataFrame) -> DataFrame:
    """Impossible cells, routine nulls and the emergency flag of each segment."""
    whole = Window.partitionBy(*SEGMENT)
    bad = sum((F.col(c).cast("long") for c in ("imp_velocity", "imp_vertrate", "imp_baroaltitude")), F.lit(0))
    nulls = sum((F.col(c).isNull().cast("long") for c in MEASURED), F.lit(0))
    return df.withColumns({
        "n_imputed_impossible": F.sum(bad).over(whole), "n_imputed_missing": F.sum(nulls - bad).over(whole),
        "is_emergency": F.max(F.coalesce(F.col("squawk").cast("int").isin(*EMERGENCY_SQUAWKS), F.lit(False))).over(whole),
    }).drop("imp_velocity", "imp_vertrate", "imp_baroaltitude")


def snap_to_grid(df: DataFrame) -> DataFrame:
    """grid_time = first second + 10·round-half-even; the first row of each cell wins.

    Snapping keeps the order, so a cell's first row is the one whose predecessor is in another cell.
    """
    start = F.min("time").over(Window.partitionBy(*SEGMENT))
    snapped = df.withColumn("t0_", start).withColumn(
        "grid_time", F.col("t0_") + F.bround((F.col("time") - F.col("t0_")) / GRID_S).cast("long") * GRID_S)
    before = F.lag("grid_time").over(ordered(SEGMENT))
    return snapped.withColumn("before_", before).filter(F.col("before_").isNull() | (F.col("before_") < F.col("grid_time"))).drop("before_", "t0_")


def expand_grid(df: DataFrame, blank: tuple[str, ...]) -> DataFrame:
    """Insert the grid rows up to the next one; inserted rows have null in the blank columns."""
    following = F.lead("grid_time").over(ordered(SEGMENT, "grid_time"))
    grown = df.withColumn("until_", F.coalesce(following - GRID_S, F.col("grid_time"))).withColumn(
        "slot_", F.explode(F.sequence("grid_time", "until_", F.lit(GRID_S).cast("long"))))
    real = F.col("slot_") == F.col("grid_time")
    return grown.withColumns({c: F.when(real, F.col(c)) for c in blank if c in df.columns}).withColumn(
        "time", F.col("slot_")).drop("slot_", "until_", "grid_time")


def missing_masks(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{c}_missing": F.col(c).isNull() for c in MEASURED})


def neighbours(df: DataFrame, columns: dict[str, Column], keys=SEGMENT) -> DataFrame:
    """Add p_<name> and n_<name>: the last value at or before and the first at or after each row.

    Both are running values, the second in reverse order, so the work grows with the rows of a segment, not with
    their square as it would over frames that end at the segment's end.
    """
    back = Window.partitionBy(*keys).orderBy(F.col("time").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({f"n_{c}": F.last(v, True).over(back) for c, v in columns.items()}).withColumns(
        {f"p_{c}": F.last(v, True).over(running(keys)) for c, v in columns.items()})


def _observed(columns) -> dict[str, Column]:
    return {c: F.when(F.col(c).isNotNull(), F.struct("time", F.col(c).alias("v"))) for c in columns}


def _interpolated(columns) -> dict[str, Column]:
    filled = {}
    for c in columns:
        p, n = F.col(f"p_{c}"), F.col(f"n_{c}")
        share = F.try_divide(F.col("time") - p["time"], n["time"] - p["time"])
        filled[c] = F.coalesce(F.col(c), F.when(p.isNotNull() & n.isNotNull(), p["v"] + (n["v"] - p["v"]) * share), p["v"], n["v"])
    return filled


def _nearest(columns) -> dict[str, Column]:
    return {c: F.coalesce(f"p_{c}", f"n_{c}") for c in columns}


def _without(df: DataFrame, columns) -> DataFrame:
    return df.drop(*[f"{a}_{c}" for a in "pn" for c in columns])


def interpolate(df: DataFrame, columns, keys=SEGMENT) -> DataFrame:
    """Linear between the nearest observed rows, nearest value outside them, null if there is none."""
    return _without(neighbours(df, _observed(columns), keys).withColumns(_interpolated(columns)), columns)


def fill_nearest(df: DataFrame, columns, keys=SEGMENT) -> DataFrame:
    """Last value carried forward, then the first one carried back."""
    return _without(neighbours(df, {c: F.col(c) for c in columns}, keys).withColumns(_nearest(columns)), columns)


def resample(df: DataFrame) -> DataFrame:
    """Grid, masks and imputation; every window has the segment key, so one shuffle serves all."""
    carried = tuple(c for c in ("onground", "flight_phase", "squawk") if c in df.columns)
    grid = missing_masks(expand_grid(snap_to_grid(df), (*MEASURED, *carried)))
    smooth = (*INTERPOLATED, "hdg_sin", "hdg_cos")
    parts = neighbours(grid.withColumns(heading_parts()), _observed(smooth) | {c: F.col(c) for c in carried})
    full = _without(parts.withColumns(_interpolated(smooth) | _nearest(carried)), (*smooth, *carried))
    full = full.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in smooth})
    full = normalised_heading(full)
    return full.withColumns({"onground": F.coalesce("onground", F.lit(False)), "dist_to_runway_m": closest_runway_m()})


def filter_min_length(df: DataFrame, min_rows: int) -> DataFrame:
    size = F.count(F.lit(1)).over(Window.partitionBy(*SEGMENT))
    return df.withColumn("n_steps", size).filter(F.col("n_steps") >= min_rows)


CLEAN_COLUMNS = ("segment_id", "flight_id", "icao24", "time", *INTERPOLATED, "heading", "hdg_sin", "hdg_cos", "onground",
                 "dist_to_runway_m", "flight_phase", "squawk", *[f"{c}_missing" for c in MEASURED], "is_emergency",
                 "n_imputed_impossible", "n_imputed_missing", "n_steps")


def preprocess_steps(df: DataFrame, cfg: PrepConfig = PREP, tap: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
                     tasks: int | None = None) -> dict[str, DataFrame]:
    """The ordered steps of the cleaning job by name, each built on the one before; tap sees every step as it passes.

    With tasks, the flights are dealt over that many; every later step stays within them.
    """
    steps: dict[str, DataFrame] = {}

    def keep(name: str, rows: DataFrame) -> DataFrame:
        steps[name] = tap(name, rows)
        return steps[name]

    single = keep("deduplicated", dedupe_rounded_time(keep("input", df)))
    segmented = keep("segmented", segment_gaps(single.repartition(tasks, "flight_id") if tasks else single, cfg.gap_s))
    engaged = keep("engaged", filter_d(segmented))
    trimmed = keep("trimmed", trim_idle(with_step_speed(engaged), cfg.move_speed).drop("step_s", "step_m", "step_speed"))
    counted = keep("counted", with_counters(flag_impossible(trimmed, cfg)))
    keep("clean", filter_min_length(keep("gridded", resample(counted)), cfg.min_rows))
    return steps


def preprocess(df: DataFrame, cfg: PrepConfig = PREP, tasks: int | None = None) -> DataFrame:
    """Raw derived states to clean grid rows with masks and per-segment attributes."""
    return preprocess_steps(df, cfg, tasks=tasks)["clean"].select(*CLEAN_COLUMNS)


def grid_violations(clean: DataFrame) -> DataFrame:
    """Rows that break the contract: a null feature or a step other than ten seconds."""
    step = F.col("time") - F.lag("time").over(ordered(SEGMENT))
    nulls = F.lit(False)
    for c in (*INTERPOLATED, "hdg_sin", "hdg_cos", "dist_to_runway_m", "onground"):
        nulls = nulls | F.col(c).isNull()
    return clean.withColumns({"null_feature": nulls, "bad_step": F.coalesce(step != GRID_S, F.lit(False))}).filter("null_feature OR bad_step")


def project_grid_size(df: DataFrame, gap_s: int = PREP.gap_s) -> DataFrame:
    """Grid rows and segments expected, before anything is expanded."""
    spans = segment_gaps(df.select("flight_id", "time"), gap_s).groupBy(*SEGMENT).agg((F.max("time") - F.min("time")).alias("span"))
    return spans.agg(F.sum(F.floor((F.col("span") + GRID_S - 1) / GRID_S) + 1).alias("grid_rows"), F.count(F.lit(1)).alias("segments"))
