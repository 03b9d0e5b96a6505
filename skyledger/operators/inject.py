"""Labelled evaluation data: deterministic perturbations of clean segments.

Random draws are hashes of (segment, kind, seed, purpose), so a re-run on any cluster, or a task
repeated after a lost executor, gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.config import GRID_S, INJECTION_MIX, LEGACY_POINTS, MEASURED, METRES_PER_DEGREE
from skyledger.operators.derive import replay_derived
from skyledger.operators.resample import SEGMENT
from skyledger.operators.sequence import ordered, running, throughout
from skyledger.operators.splits import hash_uniform

BLENDED = ("lat", "lon", "baroaltitude", "velocity", "vertrate")


def assign_kinds(meta: DataFrame, seed: int = 42, rate: float = 0.5, mix=INJECTION_MIX) -> DataFrame:
    """kind per segment: 'normal' for the segments not drawn, else a kind drawn with the mix weights."""
    total = sum(w for _, w in mix)
    pick, edge = F.lit(mix[-1][0]), 0.0
    draw = hash_uniform(F.col("segment_id"), seed, "kind")
    branches, edges = [], []
    for name, w in mix[:-1]:
        edge += w / total
        branches.append(name)
        edges.append(round(edge, 9))
    for name, e in zip(reversed(branches), reversed(edges)):
        pick = F.when(draw < e, name).otherwise(pick)
    return meta.withColumn("kind", F.when(hash_uniform(F.col("segment_id"), seed, "rate") < rate, pick).otherwise("normal"))


def with_onset(rows: DataFrame, fraction: float = 0.5, window: int | None = None) -> DataFrame:
    """step, n, onset (inside the scored window) and ramp: 0 before the onset, then linear to 1."""
    rows = rows.withColumns({"step": F.row_number().over(ordered(SEGMENT)) - 1, "n": F.count(F.lit(1)).over(throughout(SEGMENT))})
    length = F.least(F.col("n"), F.lit(window)) if window else F.col("n")
    onset = F.least(F.greatest(F.bround(length * F.lit(fraction)).cast("long"), F.lit(0)), F.greatest(length - 1, F.lit(0)))
    rows = rows.withColumn("onset", onset)
    ramp = (F.when(F.col("onset") >= F.col("n") - 1, F.when(F.col("step") >= F.col("n") - 1, 1.0).otherwise(0.0))
            .when(F.col("step") < F.col("onset"), 0.0)
            .otherwise(F.try_divide(F.col("step") - F.col("onset"), F.col("n") - 1 - F.col("onset"))))
    return rows.withColumn("ramp", ramp)


def at_onset(column: str) -> Column:
    return F.max(F.when(F.col("step") == F.col("onset"), F.col(column))).over(throughout(SEGMENT))


def _uniform(seed: int, purpose: str, low: float, high: float, per_row: bool = False) -> Column:
    parts = [F.col("segment_id"), F.col("kind"), seed, purpose] + ([F.col("step").cast("string")] if per_row else [])
    return low + (high - low) * hash_uniform(*parts)


def _normal(seed: int, purpose: str, sd: float) -> Column:
    radius = F.sqrt(-2.0 * F.log(1.0 - _uniform(seed, purpose + "_r", 0.0, 1.0, True)))
    return radius * F.cos(_uniform(seed, purpose + "_a", 0.0, 2 * math.pi, True)) * sd


def _east_deg(metres: Column, lat: Column) -> Column:
    return metres / (METRES_PER_DEGREE * F.cos(F.radians(lat)))


def inject(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Perturb each segment by its kind column; rows need step, n, onset and ramp."""
    kind, after, ramp = F.col("kind"), F.col("step") >= F.col("onset"), F.col("ramp")
    zone, climb, loiter, cut_in, spike = (kind == name for name, _ in INJECTION_MIX)
    base = rows.withColumns({"lat0": at_onset("lat"), "lon0": at_onset("lon")})
    mag, bearing = _uniform(seed, "mag", 1000.0, 3000.0), _uniform(seed, "bearing", 0.0, 2 * math.pi)
    up = F.when(_uniform(seed, "sign", 0.0, 1.0) < 0.7, _uniform(seed, "up", 200.0, 1500.0)).otherwise(-_uniform(seed, "down", 50.0, 100.0))
    # a draw is made only for the kind that uses it
    base = base.withColumns({"mag_": F.when(zone, mag), "bearing_": F.when(zone, bearing), "climb_": F.when(climb, up * ramp),
                             "target_": F.when(cut_in, _uniform(seed, "target", 50.0, 300.0)), "factor_": F.when(spike, _uniform(seed, "factor", 1.5, 2.0))})
    base = base.withColumn("climb_rate_", F.coalesce(F.col("climb_") - F.lag("climb_").over(ordered(SEGMENT)), F.lit(0.0)) / GRID_S)
    points = F.array(*[F.struct((F.pow(F.col("lat0") - p[0], 2) + F.pow(F.col("lon0") - p[1], 2)).alias("d"), F.lit(i).alias("i"),
                                F.lit(p[0]).alias("lat"), F.lit(p[1]).alias("lon")) for i, p in enumerate(LEGACY_POINTS.values())])
    base = base.withColumn("goal_", F.when(cut_in, F.array_min(points)))
    held = loiter & after
    changed = base.withColumns({
        "lat": F.when(zone, F.col("lat") + F.cos("bearing_") * F.col("mag_") * ramp / METRES_PER_DEGREE)
        .when(held, F.col("lat0") + _normal(seed, "north", 30.0) / METRES_PER_DEGREE)
        .when(cut_in, F.col("lat") + (F.col("goal_.lat") - F.col("lat")) * ramp).otherwise(F.col("lat")),
        "lon": F.when(zone, F.col("lon") + _east_deg(F.sin("bearing_") * F.col("mag_") * ramp, F.col("lat")))
        .when(held, F.col("lon0") + _east_deg(_normal(seed, "east", 30.0), F.col("lat0")))
        .when(cut_in, F.col("lon") + (F.col("goal_.lon") - F.col("lon")) * ramp).otherwise(F.col("lon")),
        "baroaltitude": F.when(climb, F.col("baroaltitude") + F.col("climb_"))
        .when(cut_in, F.col("baroaltitude") + (F.col("target_") - F.col("baroaltitude")) * ramp).otherwise(F.col("baroaltitude")),
        "velocity": F.when(held, _uniform(seed, "slow", 0.0, 2.0, True))
        .when(spike & (F.col("step") == F.col("onset")), F.greatest(F.col("velocity") * F.col("factor_"), F.lit(0.0))).otherwise(F.col("velocity")),
        "vertrate": F.when(climb, F.col("vertrate") + F.col("climb_rate_")).when(held, 0.0).otherwise(F.col("vertrate")),
        "onground": F.when((climb | loiter | cut_in) & after, False).otherwise(F.col("onground")),
        **{f"{c}_missing": F.when((kind != "normal") & after, False).otherwise(F.col(f"{c}_missing")) for c in MEASURED},
    })
    return replay_derived(changed).drop("lat0", "lon0", "mag_", "bearing_", "climb_", "target_", "factor_", "climb_rate_", "goal_")


def make_eval_set(clean: DataFrame, fold_meta: DataFrame, seed: int = 42, rate: float = 0.5, window: int | None = None,
                  mix=INJECTION_MIX) -> DataFrame:
    """Rows of a fold with kind, label and onset; half of its segments are perturbed."""
    kinds = assign_kinds(fold_meta.select("segment_id"), seed, rate, mix)
    rows = inject(with_onset(clean.join(kinds, "segment_id"), 0.5, window), seed)
    return rows.withColumn("label", (F.col("kind") != "normal").cast("int"))


def inject_blend(clean_rows: DataFrame, intensity: float, seed: int = 42) -> DataFrame:
    """Between the clean rows (0) and the full perturbation (1); rows need kind, step, n, onset, ramp."""
    keep = clean_rows.withColumns({f"base_{c}": F.col(c) for c in BLENDED})
    full = inject(keep, seed)
    mixed = full.withColumns({c: F.col(f"base_{c}") + intensity * (F.col(c) - F.col(f"base_{c}")) for c in BLENDED})
    return replay_derived(mixed).drop(*[f"base_{c}" for c in BLENDED])


COMPARISON_KINDS = tuple(
    [("route", m) for m in (20_000.0, 40_000.0, 80_000.0)] + [("altitude", m) for m in (300.0, 800.0, 1_500.0)]
    + [("speed", f) for f in (1.6, 2.2, 0.4)] + [("holding", p) for p in (240.0, 120.0)] + [("freeze", 0.0)])


def inject_comparison(rows: DataFrame, kind: str, size: float, seed: int = 42, into: str = "") -> DataFrame:
    """One of the older kinds on every segment; rows need step, n, onset, ramp and kind.

    With `into`, the rows keep their channels and the changed ones are added with that prefix: several kinds then share
    the shuffle and the sort of the segments.
    """
    after, ramp = F.col("step") >= F.col("onset"), F.col("ramp")
    kept = rows.columns

    def named(name: str) -> Column:
        return F.col(f"{into}{name}")

    def add(rows: DataFrame, more: dict[str, Column]) -> DataFrame:
        return rows.withColumns({f"{into}{name}": value for name, value in more.items()})

    if kind == "route":
        rows = add(rows, {"b_": _uniform(seed, "route", 0.0, 2 * math.pi)})
        changed = {"lat": F.col("lat") + F.cos(named("b_")) * size * ramp / METRES_PER_DEGREE,
                   "lon": F.col("lon") + _east_deg(F.sin(named("b_")) * size * ramp, F.col("lat"))}
    elif kind == "altitude":
        sign = F.when(_uniform(seed, "altitude", 0.0, 1.0) < 0.5, -1.0).otherwise(1.0)
        rows = add(rows, {"o_": sign * size * ramp})
        changed = {"baroaltitude": F.col("baroaltitude") + named("o_"),
                   "vertrate": F.col("vertrate") + F.coalesce(named("o_") - F.lag(named("o_")).over(ordered(SEGMENT)), F.lit(0.0)) / GRID_S}
    elif kind == "speed":
        changed = {"velocity": F.when(after, F.greatest(F.col("velocity") * size, F.lit(0.0))).otherwise(F.col("velocity"))}
    elif kind == "holding":
        rows = add(rows, {c + "0_": at_onset(c) for c in ("lat", "lon", "velocity", "heading")})
        rows = add(rows, {"turn_": F.radians(named("heading0_")) + (2 * math.pi / size) * (F.col("step") - F.col("onset")) * GRID_S})
        move = F.when(F.col("step") > F.col("onset"), named("velocity0_") * GRID_S)
        before = named("turn_") - (2 * math.pi / size) * GRID_S
        rows = add(rows, {"e_": F.coalesce(F.sum(move * F.sin(before)).over(running(SEGMENT)), F.lit(0.0)),
                          "n_": F.coalesce(F.sum(move * F.cos(before)).over(running(SEGMENT)), F.lit(0.0))})
        changed = {
            "lat": F.when(after, named("lat0_") + named("n_") / METRES_PER_DEGREE).otherwise(F.col("lat")),
            "lon": F.when(after, named("lon0_") + _east_deg(named("e_"), named("lat0_"))).otherwise(F.col("lon")),
            "heading": F.when(after, F.pmod(F.degrees(named("turn_")), F.lit(360.0))).otherwise(F.col("heading")),
            "vertrate": F.when(after, 0.0).otherwise(F.col("vertrate"))}
    else:
        changed = {c: F.when(after, at_onset(c)).otherwise(F.col(c)) for c in MEASURED}
    out = replay_derived(add(rows, changed), into)
    return out.drop(*[c for c in rows.columns if c not in kept])


def inject_simple(scaled: DataFrame, seed: int = 42) -> DataFrame:
    """Archive kinds on scaled rows: altitude +3, speed ×3 or 0 on five middle rows, distance −2."""
    kinds = F.array(F.lit("altitude"), F.lit("speed"), F.lit("hovering"), F.lit("zone_violation"))
    rows = scaled.withColumns({"kind": F.get(kinds, F.floor(hash_uniform(F.col("segment_id"), seed, "simple") * 4).cast("int")),
                               "step": F.row_number().over(ordered(SEGMENT)) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(*SEGMENT))})
    middle = F.floor(F.col("n") / 2)
    in_middle = (F.col("step") >= middle) & (F.col("step") < middle + 5)
    return rows.withColumns({
        "z_baroaltitude": F.when(F.col("kind") == "altitude", F.col("z_baroaltitude") + 3.0).otherwise(F.col("z_baroaltitude")),
        "z_velocity": F.when((F.col("kind") == "speed") & in_middle, F.col("z_velocity") * 3.0)
        .when((F.col("kind") == "hovering") & in_middle, 0.0).otherwise(F.col("z_velocity")),
        "z_dist_to_runway_m": F.when(F.col("kind") == "zone_violation", F.col("z_dist_to_runway_m") - 2.0).otherwise(F.col("z_dist_to_runway_m")),
        "segment_id": F.concat("segment_id", F.lit("_anom"))})
