"""Approach attempts: find them, infer the runway, judge them.

Rows are folded to canonical ones and move once, by flight. Everything after that is a chain of windows
over the flight or over (flight_id, cluster) inside it; nothing is collected or joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.config import DEFAULT, LANDING_RUNWAYS, MAX_ALTITUDE_BIAS_M, PUBLISHED_ENVELOPE, ApproachConfig
from skyledger.functions.geo import (
    along_track_m, angle_between, cross_track_m, distance_bin, haversine_m, landing_runways, path_height_m, runway_struct, with_runway_frame,
)
from skyledger.operators.dedupe import TIE_BREAK, canonical_positions, observed
from skyledger.operators.sequence import ordered, running, throughout

ATTEMPT = ("flight_id", "cluster")
CRITERIA = ("lateral_path_proxy", "barometric_path_proxy", "observed_descent_rate",
            "observed_ground_speed_envelope", "late_track_correction")
CHANNELS = ("time", "lat", "lon", "baroaltitude", "velocity", "vertrate", "heading", "onground")


# ---- finding attempts -------------------------------------------------------------------------

def runway_candidates(rows: DataFrame) -> DataFrame:
    """Each row once per landing runway, with along, cross and dist."""
    return with_runway_frame(rows.select("*", F.inline(landing_runways())))


def in_corridor(cfg: ApproachConfig) -> Column:
    return F.col("along").between(-500.0, cfg.gate_along) & (F.abs("cross") <= cfg.gate_cross)


def corridor_visits(obs: DataFrame, cfg: ApproachConfig = DEFAULT) -> DataFrame:
    """Supported stays in each runway corridor.

    Rows are numbered before the corridor filter, so the break rule can count the rows outside.
    """
    numbered = flight_rows(obs).select("flight_id", "time", "lat", "lon").withColumn("idx", F.row_number().over(ordered(["flight_id"])))
    inside = runway_candidates(numbered).filter(in_corridor(cfg))
    w = ordered(["flight_id", "runway"])
    away_s = F.col("time") - F.lag("time").over(w)
    away_rows = F.col("idx") - F.lag("idx").over(w) - 1
    broke = (away_s > cfg.reentry_gap_s) | ((away_rows >= cfg.persist_rows) & (away_s >= cfg.persist_s))
    return (
        inside.withColumn("broke", F.coalesce(broke, F.lit(True)).cast("long"))
        .withColumn("visit", F.sum("broke").over(running(["flight_id", "runway"])))
        .groupBy("flight_id", "runway", "visit")
        .agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count(F.lit(1)).alias("n_rows"))
        .filter(F.col("n_rows") >= cfg.infer_min_rows)
    )


def merge_intervals(visits: DataFrame) -> DataFrame:
    """Union overlapping visits of one flight across runways."""
    w = Window.partitionBy("flight_id").orderBy("start_time", "end_time", "runway")
    reach = F.max("end_time").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (
        visits.withColumn("reach", reach)
        .withColumn("opens", (F.col("reach").isNull() | (F.col("start_time") > F.col("reach"))).cast("long"))
        .withColumn("cluster", F.sum("opens").over(running(["flight_id"], ["start_time", "end_time", "runway"])))
        .groupBy("flight_id", "cluster")
        .agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))
    )


def flight_rows(obs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Canonical rows (unique seconds with an observed position), brought together by flight in `tasks` tasks.

    Equal copies are folded before the rows move; of different reports of one second the smallest stays.
    """
    kept = canonical_positions(obs)
    lead = [c for c in TIE_BREAK if c in kept.columns]
    rest = [c for c in kept.columns if c not in (*lead, "flight_id", "time")]
    best = F.row_number().over(Window.partitionBy("flight_id", "time").orderBy(*lead, *rest))
    return kept.distinct().repartition(*([tasks] if tasks else []), "flight_id").withColumn("best_", best).filter("best_ = 1").drop("best_")


def attempt_rows(obs: DataFrame, cfg: ApproachConfig = DEFAULT, tasks: int | None = None) -> DataFrame:
    """Rows of every candidate attempt, extended past the corridor but never into the next one.

    The four corridors are columns of the row. Visits, their union over the runways and the extension are
    windows over the flight, so the rows move once and nothing is joined back.
    """
    rows = flight_rows(obs, tasks)
    kept = rows.columns
    line = ordered(["flight_id"])
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    number = range(len(LANDING_RUNWAYS))
    inside = {}
    for j, r in enumerate(LANDING_RUNWAYS):
        place = ("lat", "lon", r.lat, r.lon, r.bearing)
        inside[f"in{j}"] = along_track_m(*place).between(-500.0, cfg.gate_along) & (F.abs(cross_track_m(*place)) <= cfg.gate_cross)
    rows = rows.withColumns(inside | {"idx": F.row_number().over(line)})
    rows = rows.withColumns({f"prev{j}": F.last(F.when(F.col(f"in{j}"), F.struct("time", "idx")), True).over(before) for j in number})

    def opens(j: int) -> Column:
        away_s = F.col("time") - F.col(f"prev{j}.time")
        away_rows = F.col("idx") - F.col(f"prev{j}.idx") - 1
        broke = (away_s > cfg.reentry_gap_s) | ((away_rows >= cfg.persist_rows) & (away_s >= cfg.persist_s))
        return F.col(f"in{j}") & F.coalesce(broke, F.lit(True))

    rows = rows.withColumns({f"open{j}": opens(j) for j in number} | {f"count{j}": F.count(F.when(F.col(f"in{j}"), 1)).over(running(["flight_id"])) for j in number})
    # a visit ends with the last row inside before the next one opens, else with the last one inside: one backward pass for all corridors
    back = ordered(["flight_id"], F.desc("time"))
    later, onward = (back.rowsBetween(Window.unboundedPreceding, end) for end in (-1, Window.currentRow))
    visits = {}
    for j in number:
        until_next = F.last(F.when(F.col(f"open{j}"), F.struct(F.col(f"prev{j}.time").alias("time"), (F.col(f"count{j}") - 1).alias("count"))), True).over(later)
        until_last = F.first(F.when(F.col(f"in{j}"), F.struct("time", F.col(f"count{j}").alias("count"))), True).over(onward)
        visits[f"visit{j}"] = F.coalesce(until_next, until_last)
    rows = rows.withColumns(visits)
    for j in number:
        supported = F.col(f"visit{j}.count") - F.col(f"count{j}") + 1 >= cfg.infer_min_rows
        rows = rows.withColumn(f"end{j}", F.when(F.col(f"open{j}") & supported, F.col(f"visit{j}.time")))
    # end_: where a visit begins, the time at which the last of those beginning here ends
    rows = rows.withColumn("end_", F.greatest(*[f"end{j}" for j in number]))
    rows = rows.withColumn("reach", F.max("end_").over(before))
    first = F.col("end_").isNotNull() & (F.col("reach").isNull() | (F.col("time") > F.col("reach")))
    rows = rows.withColumn("cluster", F.sum(first.cast("long")).over(running(["flight_id"])))
    ends = F.max("end_").over(throughout(ATTEMPT))
    return rows.withColumn("ends", ends).filter((F.col("cluster") > 0) & (F.col("time") <= F.col("ends") + cfg.extension_s)).select(*kept, "cluster")


# ---- runway inference -------------------------------------------------------------------------

def usable_track(rows: DataFrame, cfg: ApproachConfig) -> Column:
    heading = observed(rows, "heading")
    if "velocity" in rows.columns:
        return heading & observed(rows, "velocity") & (F.col("velocity") >= cfg.min_track_speed)
    return heading


def with_runway_scores(rows: DataFrame, cfg: ApproachConfig = DEFAULT, only: str | None = None) -> DataFrame:
    """Add `scores` to attempt rows: one struct per landing runway, the same on every row of an attempt.

    score is null where the geometry does not support the runway. With `only`, rows where that column is false get no scores.
    """
    attempt = Window.partitionBy(*ATTEMPT)
    kept = rows.columns
    alt_seen = F.coalesce(observed(rows, "baroaltitude"), F.lit(False))
    track_ok = F.coalesce(usable_track(rows, cfg), F.lit(False))
    steps: list[dict[str, Column]] = [{}, {}, {}]
    structs = []
    for j, r in enumerate(LANDING_RUNWAYS):
        place = ("lat", "lon", r.lat, r.lon, r.bearing)
        steps[0] |= {f"along{j}": along_track_m(*place), f"cross{j}": cross_track_m(*place), f"dist{j}": haversine_m("lat", "lon", r.lat, r.lon)}
        gate = F.col(f"along{j}").between(0.0, cfg.gate_along * 1.25) & (F.abs(f"cross{j}") <= cfg.gate_cross) & ~(
            alt_seen & (F.col("baroaltitude") > r.elevation + cfg.gate_height))
        steps[1][f"gate{j}"] = F.coalesce(gate, F.lit(False))
        last_gate = F.max(F.when(F.col(f"gate{j}"), F.col("time"))).over(attempt)
        steps[2][f"recent{j}"] = F.col(f"gate{j}") & (F.col("time") >= last_gate - cfg.infer_window_s)
        recent = F.col(f"recent{j}")
        lateral = F.abs(f"cross{j}") / F.greatest(F.lit(250.0), F.col(f"along{j}") * 0.12)
        turned = recent & track_ok
        at = F.when(recent, F.col("time"))
        structs.append({
            "min_dist": F.min(f"dist{j}").over(attempt), "gate_rows": F.count(F.when(F.col(f"gate{j}"), 1)).over(attempt),
            "rows_used": F.count(F.when(recent, 1)).over(attempt), "span_s": F.max(at).over(attempt) - F.min(at).over(attempt),
            "lateral": F.percentile(F.when(recent, lateral), 0.5).over(attempt), "track_rows": F.count(F.when(turned, 1)).over(attempt),
            "track_median": F.percentile(F.when(turned, angle_between("heading", r.bearing)), 0.5).over(attempt)})
    for step in steps:
        rows = rows.withColumns(step)
    rows = rows.withColumns({f"{name}{j}": value for j, s in enumerate(structs) for name, value in s.items()})
    scores = []
    for j, r in enumerate(LANDING_RUNWAYS):
        stats = {name: F.col(f"{name}{j}") for name in structs[j]}
        supported = (stats["gate_rows"] >= cfg.infer_min_rows) & (stats["span_s"] >= cfg.infer_min_duration_s)
        track_error = F.when(stats["track_rows"] >= 3, stats["track_median"]).otherwise(90.0)
        score = stats["lateral"] + track_error / 30.0 + F.least(stats["min_dist"] / cfg.terminal_distance, F.lit(2.0))
        fixed = runway_struct(r, j)
        names = ("ord", "runway", "direction", "rwy_lat", "rwy_lon", "bearing", "elevation")
        scores.append(F.struct(F.when(supported, score).alias("score"), *[fixed[n].alias(n) for n in names], *[c.alias(n) for n, c in stats.items()], track_error.alias("track_error")))
    packed = F.array(*scores)
    return rows.withColumn("scores", F.when(F.col(only), packed) if only else packed).select(*kept, "scores")


def runway_scores(rows: DataFrame, cfg: ApproachConfig = DEFAULT) -> DataFrame:
    """One row per attempt and landing runway; score is null where the geometry does not support it."""
    once = with_runway_scores(rows, cfg).groupBy(*ATTEMPT).agg(F.first("scores").alias("scores"))
    return once.select(*ATTEMPT, F.inline("scores"))


def chosen_runway(cfg: ApproachConfig) -> dict[str, Column]:
    """The inference columns from `c`, the scored candidates in ascending order, and `w`, the first of them."""
    same = F.filter("c", lambda x: x["direction"] == F.col("w.direction"))
    other = F.filter("c", lambda x: x["direction"] != F.col("w.direction"))
    inf = F.lit(float("inf"))
    direction_margin = F.coalesce(F.get(other, F.lit(0))["score"] - F.col("w.score"), inf)
    exact_margin = F.coalesce(F.get(same, F.lit(1))["score"] - F.col("w.score"), inf)
    refused = (F.col("w.score") > cfg.max_score) | (direction_margin < cfg.min_direction_margin)
    exact = exact_margin >= cfg.min_exact_margin
    known = F.col("w").isNotNull() & ~F.coalesce(refused, F.lit(False))
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), direction_margin / 2.0))
    return {
        "runway": F.when(known, F.when(exact, F.col("w.runway")).otherwise(F.concat(F.col("w.direction"), F.lit("_pair")))),
        "geometry_runway": F.when(known, F.col("w.runway")), "direction": F.when(known, F.col("w.direction")),
        "specificity": F.when(~known, "unknown").when(exact, "exact").otherwise("direction"),
        "confidence": F.when(known, clipped / (1.0 + F.col("w.score"))).otherwise(0.0),
        "score_margin": F.when(F.col("w").isNull(), 0.0).when(known & exact, exact_margin).otherwise(direction_margin),
        "score": F.col("w.score"),
        "reason": F.when(F.col("w").isNull(), "no_supported_runway_candidate").when(~known, "runway_direction_ambiguous"),
        "rwy_lat": F.col("w.rwy_lat"), "rwy_lon": F.col("w.rwy_lon"), "bearing": F.col("w.bearing"), "elevation": F.col("w.elevation"),
    }


def _ranked() -> Column:
    return F.array_sort(F.filter("scores", lambda x: x["score"].isNotNull()))


def infer_runway(scores: DataFrame, cfg: ApproachConfig = DEFAULT) -> DataFrame:
    """Pick the best runway per attempt from its (at most four) scored candidates."""
    names = ["score", *[c for c in scores.columns if c not in ("score", *ATTEMPT)]]
    packed = scores.groupBy(*ATTEMPT).agg(F.collect_list(F.struct(*names)).alias("scores"))
    found = packed.withColumn("c", _ranked()).withColumn("w", F.get("c", F.lit(0)))
    return found.select(*ATTEMPT, *[value.alias(name) for name, value in chosen_runway(cfg).items()])


def extract_attempts(obs: DataFrame, cfg: ApproachConfig = DEFAULT, tasks: int | None = None) -> DataFrame:
    """Canonical rows of the attempts with an inferred runway, with the inference columns on every row.

    The candidates are ranked on the last row of an attempt only; a window gives the choice to the others.
    """
    keep = [c for c in obs.columns if c in (*CHANNELS, "speed_class") or c.endswith("_missing")]
    rows = attempt_rows(obs.select("flight_id", *keep), cfg, tasks)
    kept, whole = rows.columns, Window.partitionBy(*ATTEMPT)
    rows = with_runway_scores(rows.withColumn("last_", F.col("time") == F.max("time").over(whole)), cfg, "last_")
    ranked = rows.withColumn("c", F.when(F.col("last_"), _ranked())).withColumn("w", F.get("c", F.lit(0)))
    choice = chosen_runway(cfg)
    chosen = F.when(F.col("last_"), F.struct(*[value.alias(name) for name, value in choice.items()]))
    found = ranked.select(*kept, chosen.alias("chosen")).withColumn("chosen", F.first("chosen", True).over(whole))
    return found.filter("chosen.geometry_runway IS NOT NULL").select(*kept, *[F.col(f"chosen.{name}").alias(name) for name in choice])


# ---- judging attempts -------------------------------------------------------------------------

def published_envelope(spark) -> DataFrame:
    """The published percentile envelope as a ten-row inline table."""
    values = ", ".join(f"('{d}', 'unknown', '{b}', {sl}D, {sh}D, {vl}D, {vh}D)" for d, b, sl, sh, vl, vh in PUBLISHED_ENVELOPE)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(direction, speed_class, bin, speed_lo, speed_hi, rate_lo, rate_hi)")


def reference_lookup(rows: DataFrame, envelope: DataFrame) -> DataFrame:
    """Bounds of the row's own class where fitted, else of 'unknown'; fallback says which.

    Both sides are joined without a hint: the planner broadcasts the cells from their known size.
    """
    bounds = ["speed_lo", "speed_hi", "rate_lo", "rate_hi"]
    cells = envelope.select("direction", "speed_class", "bin", F.struct(*bounds).alias("own"))
    fallback = envelope.filter("speed_class = 'unknown'").select("direction", "bin", F.struct(*bounds).alias("any"))
    joined = (
        rows.withColumn("bin", F.when(F.col("along") >= 0, distance_bin("along")))
        .join(cells, ["direction", "speed_class", "bin"], "left").join(fallback, ["direction", "bin"], "left")
    )
    pick = F.coalesce("own", "any")
    return joined.withColumns({
        "fallback": F.when(F.col("own").isNotNull(), "exact").when(F.col("any").isNotNull(), "unknown_speed_class"),
        **{b: pick[b] for b in bounds},
    }).drop("own", "any")


def with_frame(rows: DataFrame, cfg: ApproachConfig = DEFAULT) -> DataFrame:
    """Attempt rows cut to the chosen corridor plus the outcome time, renumbered from 0."""
    whole = Window.partitionBy(*ATTEMPT)
    framed = with_runway_frame(rows).withColumn("gate", in_corridor(cfg))
    cut = framed.withColumns({
        "gate_first": F.min(F.when(F.col("gate"), F.col("time"))).over(whole),
        "gate_last": F.max(F.when(F.col("gate"), F.col("time"))).over(whole),
        "frame_start": F.min("time").over(whole), "frame_end": F.max("time").over(whole),
    }).filter(F.col("gate_first").isNull() | F.col("time").between(F.col("gate_first"), F.col("gate_last") + cfg.extension_s))
    w = ordered(ATTEMPT)
    alt = F.when(observed(rows, "baroaltitude"), F.col("baroaltitude"))
    return cut.withColumn("alt", alt).withColumns({
        "idx": F.row_number().over(w) - 1,
        "ground": F.coalesce(F.col("onground"), F.lit(False)) if "onground" in rows.columns else F.lit(False),
        "gap_s": F.col("time") - F.lag("time").over(w),
        "step_m": haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon"),
        "rise": F.abs(F.col("alt") - F.lag("alt").over(w)),
    }).withColumns({"ground_rate": F.try_divide("step_m", "gap_s"), "vertical_rate": F.try_divide("rise", "gap_s")})


def quality_gates(framed: DataFrame, cfg: ApproachConfig = DEFAULT, within: Column | None = None) -> dict[str, Column]:
    """Per-attempt quality figures over the rows where `within` holds."""
    whole = Window.partitionBy(*ATTEMPT)
    row = F.lit(True) if within is None else within

    def top(value):
        return F.coalesce(F.max(F.when(row, F.col(value))).over(whole), F.lit(0.0))

    return {
        "n_rows": F.count(F.when(row, 1)).over(whole),
        "duration_s": F.max(F.when(row, F.col("time"))).over(whole) - F.min(F.when(row, F.col("time"))).over(whole),
        "max_gap_s": top("gap_s").cast("double"), "max_ground_speed": top("ground_rate"), "max_vertical_rate": top("vertical_rate"),
    }


def fatal_reasons(cfg: ApproachConfig = DEFAULT, *extra: Column) -> Column:
    return F.array_compact(F.array(
        F.when(F.col("n_rows") < cfg.min_samples, "insufficient_observations"),
        F.when(F.col("duration_s") < cfg.min_duration_s, "insufficient_duration"),
        F.when(F.col("max_gap_s") > cfg.max_gap_s, "approach_coverage_gap"),
        F.when(F.col("max_ground_speed") > cfg.max_ground_speed, "position_rate_conflict"), *extra))


def with_outcome(framed: DataFrame, cfg: ApproachConfig = DEFAULT) -> DataFrame:
    """outcome, maneuver_idx and crit_end (the last row the criteria may use)."""
    whole = Window.partitionBy(*ATTEMPT)
    peak = F.coalesce(F.max("vertical_rate").over(whole), F.lit(0.0))
    step1 = framed.withColumn("alt_ok", F.when(peak <= cfg.max_vertical_rate, F.col("alt"))).withColumns({
        "touch": F.min(F.when(F.col("ground") & (F.col("dist") <= 2000), F.struct("idx", "alt"))).over(whole),
        "low": F.min(F.when((F.col("dist") <= 5000) & F.col("alt_ok").isNotNull(), F.struct("alt_ok", "idx"))).over(whole),
        "last_idx": F.max("idx").over(whole),
    })
    flying = ~F.col("ground") & F.col("alt_ok").isNotNull()
    later = flying & (F.col("idx") > F.col("touch.idx"))
    step2 = step1.withColumns({
        "later_n": F.count(F.when(later, 1)).over(whole), "later_top": F.max(F.when(later, F.col("alt_ok"))).over(whole),
        "later_s": F.max(F.when(later, F.col("time"))).over(whole) - F.min(F.when(later, F.col("time"))).over(whole),
        "before_top": F.max(F.when(flying & (F.col("idx") < F.col("low.idx")), F.col("alt_ok"))).over(whole),
        "after_top": F.max(F.when(flying & (F.col("idx") > F.col("low.idx")), F.col("alt_ok"))).over(whole),
    })
    climbed = (F.col("later_n") >= 3) & (F.col("later_top") - F.col("touch.alt") >= 150) & (F.col("later_s") >= 20)
    descent, climb = F.col("before_top") - F.col("low.alt_ok"), F.col("after_top") - F.col("low.alt_ok")
    outcome = (
        F.when(F.col("touch").isNotNull(), F.when(climbed, "touch_and_go").otherwise("landing_observed"))
        .when((descent >= 150) & (climb >= 150), "go_around").otherwise("closest_approach"))
    step3 = step2.withColumn("outcome", outcome).withColumn(
        "maneuver_idx", F.when(F.col("outcome").isin("touch_and_go", "landing_observed"), F.col("touch.idx"))
        .when(F.col("outcome") == "go_around", F.col("low.idx")))
    return step3.withColumn("crit_end", F.when(F.col("outcome").isin("touch_and_go", "go_around"), F.col("maneuver_idx"))
                            .otherwise(F.col("last_idx"))).drop("later_n", "later_top", "later_s", "before_top", "after_top")


def with_vertical_bias(rows: DataFrame, cfg: ApproachConfig = DEFAULT) -> DataFrame:
    """bias and bias_source: supplied override, else on-ground rows, else rows at the threshold."""
    whole = Window.partitionBy(*ATTEMPT)
    usable = F.col("within") & F.col("alt").isNotNull()
    near_ground = usable & (F.col("dist") <= 1500) & F.col("ground")
    near = usable & (F.col("dist") <= 750)
    rows = rows.withColumns({
        "g_n": F.count(F.when(near_ground, 1)).over(whole),
        "g_med": F.percentile(F.when(near_ground, F.col("alt")), 0.5).over(whole),
        "p_n": F.count(F.when(near, 1)).over(whole),
        "p_med": F.percentile(F.when(near, F.col("alt")), 0.5).over(whole),
    })
    raw = F.when(F.col("g_n") >= 2, F.col("g_med")).when(F.col("p_n") >= 2, F.col("p_med")) - F.col("elevation")
    source = F.when(F.col("g_n") >= 2, "observed_onground").when(F.col("p_n") >= 2, "threshold_adjacent_proxy").otherwise("unavailable")
    conflict = F.col("max_vertical_rate") > cfg.max_vertical_rate
    override = F.col("bias_override") if "bias_override" in rows.columns else F.lit(None).cast("double")
    override_source = F.col("bias_override_source") if "bias_override_source" in rows.columns else F.lit("supplied")
    rows = rows.withColumn("raw_bias", raw)
    too_far = F.abs("raw_bias") > MAX_ALTITUDE_BIAS_M
    return rows.withColumns({
        "bias": F.when(conflict, None).when(override.isNotNull(), override).when(too_far, None).otherwise(F.col("raw_bias")),
        "bias_source": F.when(conflict, "rate_conflict").when(override.isNotNull(), override_source)
        .when(too_far, "inconsistent").otherwise(source),
    }).drop("g_n", "g_med", "p_n", "p_med", "raw_bias")


def criterion_columns(rows: DataFrame, cfg: ApproachConfig, with_reference: bool) -> dict[str, dict[str, Column]]:
    """value, limit, valid and fails for each of the five criteria, as row expressions."""
    along, cross = F.col("along"), F.abs("cross")
    height = F.col("alt") - F.col("elevation") - F.coalesce("bias", F.lit(0.0))
    lateral_limit = F.greatest(F.lit(cfg.lateral_floor), along * cfg.lateral_slope)
    delta = height - path_height_m(F.greatest(along, F.lit(0.0)), cfg.path_angle)
    turn = angle_between("heading", "bearing")
    rate_seen, speed_seen = observed(rows, "vertrate"), observed(rows, "velocity")
    if with_reference:
        rate_limit, rate_valid = F.col("rate_lo"), rate_seen & F.col("rate_lo").isNotNull()
        speed_valid = speed_seen & F.col("speed_lo").isNotNull() & F.col("speed_hi").isNotNull()
        speed_limit = F.when(F.col("velocity") < F.col("speed_lo"), F.col("speed_lo")).otherwise(F.col("speed_hi"))
        speed_fails = (F.col("velocity") < F.col("speed_lo")) | (F.col("velocity") > F.col("speed_hi"))
    else:
        rate_limit = F.lit(cfg.descent_limit)
        rate_valid = rate_seen & F.col("bias").isNotNull() & (height <= cfg.descent_height)
        speed_valid, speed_limit, speed_fails = F.lit(False), F.lit(None).cast("double"), F.lit(False)
    parts = {
        CRITERIA[0]: (cross, lateral_limit, along.between(0.0, cfg.lateral_along), cross > lateral_limit),
        CRITERIA[1]: (delta, F.when(delta >= 0, cfg.path_high).otherwise(-cfg.path_low),
                      F.col("bias").isNotNull() & F.col("alt").isNotNull() & along.between(0.0, cfg.path_along),
                      (delta > cfg.path_high) | (delta < -cfg.path_low)),
        CRITERIA[2]: (F.col("vertrate"), rate_limit, rate_valid, F.col("vertrate") < rate_limit),
        CRITERIA[3]: (F.col("velocity"), speed_limit, speed_valid, speed_fails),
        CRITERIA[4]: (turn, F.lit(cfg.track_limit), usable_track(rows, cfg) & along.between(0.0, cfg.track_along),
                      turn > cfg.track_limit),
    }
    no = F.lit(False)
    return {name: {"value": v, "limit": lim, "valid": F.coalesce(F.col("within") & ok, no), "fails": F.coalesce(f, no)}
            for name, (v, lim, ok, f) in parts.items()}


def criterion_window(attempts: DataFrame, cfg: ApproachConfig = DEFAULT, envelope: DataFrame | None = None) -> DataFrame:
    """Attempt rows with frame, outcome, quality, bias and bounds: the input of every criterion."""
    rows = with_outcome(with_frame(attempts, cfg), cfg)
    rows = rows.withColumn("within", F.col("idx") <= F.col("crit_end"))
    rows = rows.withColumns(quality_gates(rows, cfg, F.col("within")))
    rows = with_vertical_bias(rows, cfg)
    if envelope is not None:
        if "speed_class" not in rows.columns:
            rows = rows.withColumn("speed_class", F.lit("unknown"))
        rows = reference_lookup(rows.withColumn("speed_class", F.coalesce("speed_class", F.lit("unknown"))), envelope)
    return rows


def assess(attempts: DataFrame, cfg: ApproachConfig = DEFAULT, envelope: DataFrame | None = None) -> DataFrame:
    """One row per attempt: outcome, quality, criterion statuses and the overall status."""
    rows = criterion_window(attempts, cfg, envelope)
    columns = criterion_columns(rows, cfg, envelope is not None)
    whole, w = Window.partitionBy(*ATTEMPT), ordered(ATTEMPT)
    rows = rows.withColumns({f"v{i}": c["valid"] for i, c in enumerate(columns.values())}
                            | {f"f{i}": c["valid"] & c["fails"] for i, c in enumerate(columns.values())})
    # A run of failing rows is long enough exactly when one of its rows is far enough from its start.
    starts = {f"s{i}": F.when(F.col(f"f{i}") & ~F.coalesce(F.lag(f"f{i}").over(w), F.lit(False)), F.struct("idx", "time"))
              for i in range(len(CRITERIA))}
    rows = rows.withColumns(starts)
    rows = rows.withColumns({f"s{i}": F.last(f"s{i}", True).over(running(ATTEMPT)) for i in range(len(CRITERIA))})
    totals = {}
    for i in range(len(CRITERIA)):
        long_run = F.col(f"f{i}") & (F.col("idx") - F.col(f"s{i}.idx") + 1 >= cfg.persist_rows) & (
            F.col("time") - F.col(f"s{i}.time") >= cfg.persist_s)
        totals[f"seen{i}"] = F.count(F.when(F.col(f"v{i}"), 1)).over(whole)
        totals[f"bad{i}"] = F.max(F.coalesce(long_run, F.lit(False))).over(whole)
    low_enough = F.col("alt").isNull() | (F.col("max_vertical_rate") > cfg.max_vertical_rate) | (
        F.col("alt") <= F.col("elevation") + cfg.terminal_height)
    at_end = F.max(F.col("within") & (F.col("dist") <= cfg.terminal_distance) & low_enough).over(whole)
    extra = {
        "terminal": at_end | F.col("outcome").isin("landing_observed", "go_around", "touch_and_go"),
        "end_time": F.max("time").over(whole), "criterion_end_time": F.max(F.when(F.col("within"), F.col("time"))).over(whole),
        "observed_samples": F.count(F.lit(1)).over(whole), "min_threshold_m": F.min("dist").over(whole),
        "maneuver_time": F.max(F.when(F.col("idx") == F.col("maneuver_idx"), F.col("time"))).over(whole),
        "last_along": F.max_by("along", "time").over(whole),
    }
    if envelope is not None:
        extra["fallbacks"] = F.array_sort(F.collect_set(F.when(F.col("within"), F.col("fallback"))).over(whole))
    rows = rows.withColumns(totals | extra)
    one = rows.filter("idx = 0")
    statuses = {name: F.when(F.col(f"bad{i}"), "review_required").when(F.col(f"seen{i}") > 0, "within_limit").otherwise("not_observed")
                for i, name in enumerate(CRITERIA)}
    one = one.withColumns(statuses)
    missing_gate = F.col("gate_first").isNull()
    reasons = F.when(missing_gate, F.array(F.lit("no_approach_attempt"))).otherwise(
        fatal_reasons(cfg, F.when(~F.col("terminal"), "terminal_gate_not_reached")))
    one = one.withColumns({
        "reasons": reasons,
        "advisories": F.array_compact(F.array(F.when(F.col("max_vertical_rate") > cfg.max_vertical_rate, "altitude_rate_conflict"))),
        "failed": F.array_compact(F.array(*[F.when(F.col(n) == "review_required", F.lit(n)) for n in CRITERIA])),
    })
    nothing = F.lit(False)
    for n in CRITERIA:
        nothing = nothing | (F.col(n) == "not_observed")
    status = (F.when(F.size("reasons") > 0, "not_assessable").when(F.size("failed") > 0, "review_required")
              .when(nothing, "partial_observation").otherwise("criteria_observed"))
    outcome = (F.when(~F.col("terminal"), "incomplete").when(F.col("outcome") == "closest_approach", "final_gate_observed")
               .otherwise(F.col("outcome")))
    number = F.row_number().over(Window.partitionBy("flight_id").orderBy("cluster"))
    final = one.select(
        *ATTEMPT, F.col("time").alias("start_time"), "end_time", "criterion_end_time", "frame_start", "frame_end",
        "runway", "geometry_runway", "direction", "specificity", "confidence", "score_margin", "bearing", "elevation",
        status.alias("status"), outcome.alias("outcome"), "reasons", "advisories", "failed", "observed_samples",
        F.col("n_rows").alias("criterion_samples"), "max_gap_s", "max_ground_speed", "max_vertical_rate", "min_threshold_m",
        "bias", "bias_source", "maneuver_idx", "maneuver_time", "last_along", *CRITERIA,
        *(["fallbacks"] if envelope is not None else []),
        *[F.col(f"seen{i}").alias(f"seen_{n}") for i, n in enumerate(CRITERIA)])
    return final.withColumn("attempt_no", number)


def criterion_evidence(attempts: DataFrame, cfg: ApproachConfig = DEFAULT, envelope: DataFrame | None = None) -> DataFrame:
    """One row per persistent span of a criterion, with its worst row (first on ties)."""
    rows = criterion_window(attempts, cfg, envelope)
    columns = criterion_columns(rows, cfg, envelope is not None)
    packed = F.array(*[F.struct(F.lit(n).alias("criterion"), c["value"].cast("double").alias("value"),
                                c["limit"].cast("double").alias("limit"), (c["valid"] & c["fails"]).alias("hit"))
                       for n, c in columns.items()])
    keys = [*ATTEMPT, "criterion"]
    long = rows.select(*ATTEMPT, "idx", "time", "along", F.inline(packed))
    spans = (
        long.withColumn("span", F.col("idx") - F.sum(F.col("hit").cast("long")).over(running(keys)))
        .filter("hit")
        .groupBy(*keys, "span")
        .agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.min("time").alias("start_time"),
             F.max("time").alias("end_time"), F.count(F.lit(1)).alias("n"),
             F.max(F.struct(F.abs(F.col("value") - F.col("limit")).alias("excess"), (-F.col("idx")).alias("back"),
                            "time", "value", "limit", "along")).alias("worst"))
        .filter((F.col("n") >= cfg.persist_rows) & (F.col("end_time") - F.col("start_time") >= cfg.persist_s))
    )
    return spans.select(
        *keys, "start_idx", "end_idx", "start_time", "end_time", (-F.col("worst.back")).alias("worst_idx"),
        F.col("worst.time").alias("worst_time"), F.col("worst.value").alias("value"),
        F.col("worst.limit").alias("limit"), F.col("worst.along").alias("along"))


def assess_operations(obs: DataFrame, cfg: ApproachConfig = DEFAULT, envelope: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Every attempt of every flight, assessed and numbered."""
    return assess(extract_attempts(obs, cfg, tasks), cfg, envelope)
