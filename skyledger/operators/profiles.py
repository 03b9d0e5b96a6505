"""Descriptive statistics of a feed. Groups are aggregated before they are ordered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.geo import folded_change, haversine_m
from skyledger.operators.derive import engaging_parts
from skyledger.operators.ranks import exact_quantiles, percentile_against
from skyledger.operators.sequence import grounded, islands, ordered, segment_gaps
from skyledger.session import materialize

FLIGHT = ["flight_id"]
PHASES = ("on_ground", "takeoff", "climb", "cruise", "descent", "approach")


def unpivot(row: DataFrame, label: str, entries: dict[str, dict[str, Column]]) -> DataFrame:
    """One output row per entry of a one-row (or one-row-per-key) result."""
    keys = [c for c in row.columns if c.startswith("key_")]
    packed = F.array(*[F.struct(F.lit(name).alias(label), *[c.alias(n) for n, c in cols.items()]) for name, cols in entries.items()])
    return row.select(*keys, F.inline(packed))


def column_profile(df: DataFrame, numeric: Sequence[str], other: Sequence[str] = ()) -> DataFrame:
    """Nulls, distinct values and range of each column, all from one aggregation."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in (*numeric, *other):
        aggs += [F.count(c).alias(f"c_{c}"), F.count_distinct(c).alias(f"d_{c}")]
    for c in numeric:
        aggs += [F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}"), F.avg(c).alias(f"avg_{c}")]
    none = F.lit(None).cast("double")
    return unpivot(df.agg(*aggs), "column", {c: {
        "nulls": F.col("n") - F.col(f"c_{c}"), "null_pct": F.try_divide((F.col("n") - F.col(f"c_{c}")) * 100.0, F.col("n")), "n_unique": F.col(f"d_{c}"),
        "min": F.col(f"lo_{c}") if c in numeric else none, "max": F.col(f"hi_{c}") if c in numeric else none,
        "mean": F.col(f"avg_{c}") if c in numeric else none} for c in (*numeric, *other)})


def null_by_state(df: DataFrame, columns: Sequence[str], move_speed: float = 2.5) -> DataFrame:
    """Null share of each column over all, on-ground, airborne, taxiing and parked rows; rows carry step_speed."""
    air = ~grounded()
    states = {"all": F.lit(True), "onground": grounded(), "airborne": air,
              "active": grounded() & (F.col("step_speed") > move_speed), "idle": grounded() & (F.col("step_speed") <= move_speed)}
    aggs = []
    for s, cond in states.items():
        aggs.append(F.count_if(cond).alias(f"n_{s}"))
        aggs += [F.count_if(cond & F.col(c).isNull()).alias(f"{s}_{c}") for c in columns]
    return unpivot(df.agg(*aggs), "column", {c: {
        f"null_pct_{s}": F.col(f"{s}_{c}") * 100.0 / F.nullif(F.col(f"n_{s}"), F.lit(0)) for s in states} for c in columns})


def scale_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    aggs = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))]
    return unpivot(df.agg(*aggs), "column", {c: {
        **{n: F.col(f"{n}_{c}") for n in ("min", "max", "mean", "std")}, "range": F.col(f"max_{c}") - F.col(f"min_{c}")} for c in columns})


def flight_lengths(df: DataFrame) -> DataFrame:
    return df.groupBy("flight_id").agg(F.count(F.lit(1)).alias("n_rows"))


def length_quantiles(df: DataFrame, qs: Sequence[float] = (0.5, 0.75, 0.9, 0.95, 0.99, 1.0)) -> DataFrame:
    found = exact_quantiles(flight_lengths(df), "n_rows", qs)
    return unpivot(found, "quantile", {f"P{int(round(q * 100))}": {"rows": F.col(f"q{i}")} for i, q in enumerate(qs)})


def length_ecdf(df: DataFrame) -> DataFrame:
    """Share of flights at or below each length; lengths are folded first, so few rows are ordered."""
    sizes = flight_lengths(df).groupBy("n_rows").agg(F.count(F.lit(1)).alias("flights"))
    upto = Window.partitionBy(F.lit(0)).orderBy("n_rows")
    return sizes.withColumn("ecdf", F.sum("flights").over(upto) / F.sum("flights").over(Window.partitionBy(F.lit(0))))


def with_gap(df: DataFrame) -> DataFrame:
    return df.withColumn("gap_s", F.col("time") - F.lag("time").over(ordered(FLIGHT)))


def long_tail_profile(df: DataFrame, q: float = 0.99, gap_s: int = 300) -> DataFrame:
    """Flights longer than the quantile, split by whether they contain a long gap."""
    flights = with_gap(df).groupBy("flight_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("onground").cast("double")).alias("ground_share"), F.max("gap_s").alias("max_gap"))
    mark = exact_quantiles(flights, "n_rows", [q]).select(F.col("q0").alias("mark"))
    return flights.crossJoin(mark).filter("n_rows > mark").groupBy((F.coalesce("max_gap", F.lit(0)) > gap_s).alias("gappy")).agg(
        F.count(F.lit(1)).alias("flights"), F.avg("ground_share").alias("mean_ground_share"), F.avg("n_rows").alias("mean_rows"))


def gap_histogram(df: DataFrame) -> DataFrame:
    """Share of gaps in the four bands of missed reports."""
    gaps = with_gap(df).filter("gap_s IS NOT NULL").groupBy("gap_s").agg(F.count(F.lit(1)).alias("c"))
    bands = {"10-60s": (15, 70), "1-3min": (70, 180), "3-10min": (180, 600), "10-30min": (600, 1800)}
    total = F.sum("c")
    row = gaps.agg(*[(F.sum(F.when((F.col("gap_s") > a) & (F.col("gap_s") <= b), F.col("c")).otherwise(0)) * 100.0 / total).alias(n) for n, (a, b) in bands.items()])
    return unpivot(row, "band", {n: {"pct": F.col(n)} for n in bands})


def histogram_60(df: DataFrame, columns: Sequence[str], bins: int = 60) -> DataFrame:
    """Equal-width bins between the exact minimum and maximum of each column, the last bin closed."""
    ends = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    placed = df.select(*columns).crossJoin(F.broadcast(ends))
    slots = []
    for c in columns:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        flat = lo == hi
        low, width = F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, 1.0).otherwise(hi - lo)
        slot = F.least(F.floor((F.col(c) - low) / width * bins), F.lit(bins - 1))
        slots.append(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("column"), slot.cast("int").alias("bin"))))
    return placed.select(F.inline(F.array_compact(F.array(*slots)))).groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))


def with_heading_change(df: DataFrame) -> DataFrame:
    return df.withColumn("heading_change", folded_change("heading", F.lag("heading").over(ordered(FLIGHT))))


# Suspicious and impossible bounds of the motion audit.
MOTION_BOUNDS = {"velocity": (320, 400), "vertrate": (25, 50), "baroaltitude": (14_000, 16_000), "heading_change": (15, 30)}


def motion_tail_counts(df: DataFrame) -> DataFrame:
    rows = with_heading_change(df)
    value = {c: F.abs(c) if c == "vertrate" else F.col(c) for c in MOTION_BOUNDS}
    aggs = [F.count_if(value[c] > b).alias(f"{n}_{c}") for c, pair in MOTION_BOUNDS.items() for n, b in zip(("sus", "imp"), pair)]
    return unpivot(rows.agg(*aggs), "feature", {c: {"suspicious": F.col(f"sus_{c}"), "impossible": F.col(f"imp_{c}")} for c in MOTION_BOUNDS})


EXTREMES = ("max_velocity", "max_vertrate", "max_altitude", "max_heading_change")


def flight_extremes(df: DataFrame) -> DataFrame:
    return with_heading_change(df).groupBy("flight_id").agg(
        F.max("velocity").alias("max_velocity"), F.max(F.abs("vertrate")).alias("max_vertrate"),
        F.max("baroaltitude").alias("max_altitude"), F.max("heading_change").alias("max_heading_change"))


def extreme_topk(df: DataFrame, k: int = 20) -> DataFrame:
    """The k flights with the largest value of each metric: a top-k report per metric."""
    flights = flight_extremes(df)
    parts = [flights.filter(F.col(m).isNotNull()).orderBy(F.desc(m), "flight_id").limit(k).select(
        F.lit(m).alias("metric"), "flight_id", F.col(m).alias("value")) for m in EXTREMES]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def extreme_quantiles(df: DataFrame, qs: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Count, mean, deviation, least, quantiles and largest of the flights' maxima, one row per metric."""
    flights = materialize(flight_extremes(df), "extremes")
    result = None
    for m in EXTREMES:
        whole = flights.agg(F.lit(m).alias("metric"), F.count(m).alias("flights"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("deviation"), F.min(m).alias("least"), F.max(m).alias("largest"))
        found = exact_quantiles(flights, m, qs).select(*[F.col(f"q{i}").alias(f"p{round(100 * q)}") for i, q in enumerate(qs)])
        part = whole.crossJoin(found)  # one row each
        result = part if result is None else result.unionByName(part)
    return result


def impossible_share(df: DataFrame, limit_m: float = 16_000.0) -> DataFrame:
    """How much of each affected flight lies above the altitude limit."""
    flights = df.groupBy("flight_id").agg(F.count_if(F.col("baroaltitude") > limit_m).alias("high"), F.count(F.lit(1)).alias("n")).filter("high > 0")
    share = flights.select("high", (F.col("high") / F.col("n")).alias("share"))
    found = exact_quantiles(share, "share", [0.1, 0.5, 0.9])
    totals = share.agg(F.count(F.lit(1)).alias("flights"), F.coalesce(F.sum("high"), F.lit(0)).alias("rows_high"), F.max("share").alias("max_share"))
    return totals.join(found.select(F.col("q0").alias("p10"), F.col("q1").alias("p50"), F.col("q2").alias("p90")), F.lit(True), "left")


def ground_air_split(df: DataFrame, limit_deg: float = 15.0) -> DataFrame:
    """Large heading changes by ground state and phase."""
    return with_heading_change(df).filter(F.col("heading_change") > limit_deg).groupBy(grounded().alias("onground"), "flight_phase").agg(F.count(F.lit(1)).alias("n"))


def derived_vs_reported(df: DataFrame, step_s: int) -> DataFrame:
    """Agreement of position-derived and reported speed on airborne rows of one cadence."""
    w = ordered(FLIGHT)
    rows = df.withColumns({"dt": F.col("time") - F.lag("time").over(w), "move": haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")})
    rows = rows.filter((F.col("dt") == step_s) & ~grounded() & F.col("velocity").isNotNull()).withColumn("derived", F.col("move") / F.col("dt"))
    rows = rows.withColumn("off", F.abs(F.col("derived") - F.col("velocity")))
    middle = exact_quantiles(rows, "off", [0.5]).select(F.col("q0").alias("median_difference"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.corr("derived", "velocity").alias("correlation")).crossJoin(middle)


def volume_coverage(df: DataFrame, batch: str) -> DataFrame:
    """Batches, flights, rows, days, weekdays and hours; flights are folded before they are counted."""
    folded = df.groupBy(batch, "flight_id", F.floor(F.col("time") / 3600).alias("hour")).agg(
        F.count(F.lit(1)).alias("c"), F.min("time").alias("a"), F.max("time").alias("z"))
    day = F.floor(F.col("hour") / 24)
    return folded.agg(
        F.count_distinct(batch).alias("batches"), F.count_distinct("flight_id").alias("trajectories"), F.sum("c").alias("rows"),
        F.min("a").alias("first_time"), F.max("z").alias("last_time"), F.count_distinct(day).alias("calendar_days"),
        F.count_distinct(F.pmod(day + 3, F.lit(7))).alias("weekdays"), F.count_distinct(F.pmod("hour", F.lit(24))).alias("hours"))


def endpoint_stats(df: DataFrame, k: int = 5) -> DataFrame:
    """First-k and last-k facts of each flight."""
    rows = df.withColumns({"rn": F.row_number().over(ordered(FLIGHT)), "n": F.count(F.lit(1)).over(Window.partitionBy(*FLIGHT))})
    start, end = F.col("rn") <= k, F.col("rn") > F.col("n") - k
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.min("dist_to_runway_m").alias("min_dist"), F.min("baroaltitude").alias("min_alt")]
    for name, part in (("start", start), ("end", end)):
        aggs += [F.array_join(F.array_sort(F.collect_set(F.when(part, F.col("flight_phase")))), ",").alias(f"{name}_phase_set"),
                 F.min(F.when(part, F.col("dist_to_runway_m"))).alias(f"{name}_min_dist"), F.min(F.when(part, F.col("baroaltitude"))).alias(f"{name}_min_alt"),
                 F.max(F.coalesce(part & grounded(), F.lit(False))).alias(f"{name}_any_onground")]
    aggs += [F.max(F.when(F.col("rn") == 1, F.col("flight_phase"))).alias("first_phase"), F.max(F.when(F.col("rn") == F.col("n"), F.col("flight_phase"))).alias("last_phase")]
    return rows.groupBy("flight_id").agg(*aggs)


def filter_c(stats: DataFrame) -> DataFrame:
    """The three older endpoint gates."""
    ground = F.col("start_any_onground") | F.col("end_any_onground")

    def near(dist: float, alt: float) -> Column:
        arrives = F.col("end_phase_set").contains("approach") & (F.col("end_min_dist") < dist) & (F.col("end_min_alt") < alt)
        leaves = F.col("start_phase_set").contains("takeoff") & (F.col("start_min_dist") < dist) & (F.col("start_min_alt") < alt)
        return F.coalesce(arrives, F.lit(False)) | F.coalesce(leaves, F.lit(False))

    return stats.withColumns({"pass_c1": ground, "pass_c2": ground | near(2_000, 1_000), "pass_c3": ground | near(5_000, 1_500)})


def engagement_flags(df: DataFrame) -> DataFrame:
    flags = df.groupBy("flight_id").agg(*[F.max(c).alias(n) for n, c in engaging_parts().items()])
    return flags.withColumn("engages", F.col("by_approach") | F.col("by_onground") | F.col("by_takeoff"))


def direction_of_operation(stats: DataFrame) -> DataFrame:
    s, e = F.col("start_any_onground"), F.col("end_any_onground")
    return stats.groupBy(F.when(s & e, "both").when(s, "start_only").when(e, "end_only").otherwise("neither").alias("direction")).agg(F.count(F.lit(1)).alias("flights"))


def phase_composition(df: DataFrame) -> DataFrame:
    counts = df.groupBy("flight_phase").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))))


def first_k_sets(df: DataFrame, k: int = 5) -> DataFrame:
    """Flights with a takeoff row, and with an on-ground row, among their first k; and the overlap."""
    first = df.withColumn("rn", F.row_number().over(ordered(FLIGHT))).filter(F.col("rn") <= k)
    sets = first.groupBy("flight_id").agg(F.max(F.coalesce(F.col("flight_phase") == "takeoff", F.lit(False))).alias("t"), F.max(grounded()).alias("g"))
    t, g = F.col("t"), F.col("g")
    return sets.agg(F.count_if(t).alias("takeoff"), F.count_if(g).alias("onground"), F.count_if(t & g).alias("both"),
                    F.count_if(t & ~g).alias("takeoff_only"), F.count_if(g & ~t).alias("onground_only"))


def max_null_runs(df: DataFrame, column: str = "velocity") -> DataFrame:
    """Longest run of nulls per flight, over all rows and over airborne rows only."""
    parts = []
    for scope, rows in (("all", df), ("airborne", df.filter(~grounded()))):
        longest = islands(rows, F.col(column).isNull(), FLIGHT).groupBy("flight_id").agg(F.max("n_rows").alias("run"))
        every = rows.select("flight_id").distinct().join(longest, "flight_id", "left")
        parts.append(every.select(F.lit(scope).alias("scope"), "flight_id", F.coalesce("run", F.lit(0)).alias("longest")))
    return parts[0].unionByName(parts[1])


def value_repeat_rate(df: DataFrame) -> DataFrame:
    """Share of rows that repeat the previous position, speed or altitude."""
    w = ordered(FLIGHT)
    same_pos = (F.col("lat") == F.lag("lat").over(w)) & (F.col("lon") == F.lag("lon").over(w))
    flags = {"position": same_pos, **{c: F.col(c) == F.lag(c).over(w) for c in ("velocity", "baroaltitude")}}
    row = df.select(*[F.coalesce(c, F.lit(False)).cast("double").alias(n) for n, c in flags.items()]).agg(*[F.avg(n).alias(n) for n in flags])
    return unpivot(row, "channel", {n: {"repeat_pct": F.col(n) * 100.0} for n in flags})


def update_intervals(df: DataFrame) -> DataFrame:
    """Histogram of the seconds between real position changes."""
    w = ordered(FLIGHT)
    moved = df.withColumn("same", F.coalesce((F.col("lat") == F.lag("lat").over(w)) & (F.col("lon") == F.lag("lon").over(w)), F.lit(False))).filter("NOT same")
    return moved.withColumn("interval_s", F.col("time") - F.lag("time").over(w)).filter("interval_s IS NOT NULL").groupBy("interval_s").agg(F.count(F.lit(1)).alias("n"))


def gap_spatial_profile(df: DataFrame, gap_s: int) -> DataFrame:
    """Jump, implied speed and ground state at the gaps above gap_s."""
    w = ordered(FLIGHT)
    rows = df.withColumns({"dt": F.col("time") - F.lag("time").over(w), "jump": haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon"),
                           "before": F.lag("onground").over(w)}).filter(F.col("dt") > gap_s)
    rows = rows.withColumn("speed", F.try_divide("jump", "dt"))
    facts = rows.agg(F.count(F.lit(1)).alias("gaps"), F.max("jump").alias("max_jump"), F.avg(F.col("before").cast("double")).alias("ground_before"),
                     F.avg(F.col("onground").cast("double")).alias("ground_after"), F.avg((F.col("jump") < 2000).cast("double")).alias("near_share"))
    jump = exact_quantiles(rows, "jump", [0.5, 0.9]).select(F.col("q0").alias("median_jump"), F.col("q1").alias("p90_jump"))
    speed = exact_quantiles(rows, "speed", [0.5, 0.9]).select(F.col("q0").alias("median_speed"), F.col("q1").alias("p90_speed"))
    return facts.crossJoin(jump).crossJoin(speed)


def split_threshold_sweep(df: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Extra splits and segment lengths for each gap threshold, in one pass over the rows.

    Only the rows that begin a segment at some threshold are listed per threshold; a length is the distance of
    their row numbers.
    """
    line = Window.partitionBy("flight_id").orderBy("time")
    seen = with_gap(df.select("flight_id", "time")).withColumns({"at": F.row_number().over(line), "whole": F.count(F.lit(1)).over(Window.partitionBy("flight_id"))})
    begins = F.filter(F.array(*map(F.lit, thresholds)), lambda t: (F.col("at") == 1) | (F.col("gap_s") > t))
    marks = seen.filter((F.col("at") == 1) | (F.col("gap_s") > min(thresholds))).select("flight_id", "at", "whole", F.explode(begins).alias("threshold_s"))
    follow = F.lead("at").over(Window.partitionBy("flight_id", "threshold_s").orderBy("at"))
    sizes = marks.withColumn("n", (F.coalesce(follow, F.col("whole") + 1) - F.col("at")).cast("long"))
    extra = sizes.groupBy("threshold_s").agg(F.sum((F.col("at") > 1).cast("long")).alias("splits"), F.max("n").alias("max_rows"))
    found = exact_quantiles(sizes, "n", [0.95, 0.99], ["threshold_s"])
    return extra.join(found.select("threshold_s", F.col("q0").alias("p95"), F.col("q1").alias("p99")), "threshold_s")


def radius_ladder(df: DataFrame, radii_km: Sequence[int] = (10, 30, 50, 100, 200)) -> DataFrame:
    near = df.groupBy("flight_id").agg(F.min("dist_to_runway_m").alias("d"))
    row = near.agg(*[F.count_if(F.col("d") < r * 1000).alias(f"r{r}") for r in radii_km])
    return unpivot(row, "radius_km", {str(r): {"flights": F.col(f"r{r}")} for r in radii_km})


def turning_and_range(clean: DataFrame, keys=("flight_id", "segment_id")) -> DataFrame:
    """Total absolute turn and altitude range of each segment."""
    d = F.radians(F.col("heading") - F.lag("heading").over(ordered(keys)))
    turn = F.abs(F.degrees(F.atan2(F.sin(d), F.cos(d))))
    return clean.withColumn("turn", turn).groupBy(*keys).agg(F.coalesce(F.sum("turn"), F.lit(0.0)).alias("turn_deg"),
                                                            (F.max("baroaltitude") - F.min("baroaltitude")).alias("alt_range"))


def turning_review(clean: DataFrame, errors: DataFrame, neighbours: DataFrame, k: int = 20, circling_deg: float = 400.0) -> DataFrame:
    """The k segments of largest error, with turn, altitude range and the percentage of neighbour scores below their own.

    errors: (segment_id, error); neighbours: (segment_id, score) of the same segments. `circling` marks holding-like
    turns, `near_normal` segments that the neighbour score alone would not have shown. Only the rows of the k
    segments are read again for their turns.
    """
    top = materialize(errors.filter(F.col("error").isNotNull()).orderBy(F.desc("error"), "segment_id").limit(k), "top")
    ids = F.broadcast(top.select("segment_id"))  # k rows
    facts = turning_and_range(clean.join(ids, "segment_id", "left_semi"))
    ranked = percentile_against(neighbours.select("segment_id", "score"), neighbours, "score", strict=True).join(ids, "segment_id", "left_semi")
    return top.join(facts, "segment_id").join(ranked.select("segment_id", F.col("pct").alias("neighbour_pct")), "segment_id", "left").withColumns({
        "circling": F.col("turn_deg") > circling_deg, "near_normal": F.coalesce(F.col("neighbour_pct") < 50, F.lit(False))})


def channel_summary(clean: DataFrame, channels: Sequence[str], keys=("flight_id", "segment_id")) -> DataFrame:
    """Start, end, least and greatest value of each channel per segment."""
    aggs = [f.alias(f"{n}_{c}") for c in channels for n, f in (
        ("start", F.min_by(c, "time")), ("end", F.max_by(c, "time")), ("min", F.min(c)), ("max", F.max(c)))]
    packed = F.array(*[F.struct(F.lit(c).alias("channel"), *[F.col(f"{n}_{c}").alias(n) for n in ("start", "end", "min", "max")]) for c in channels])
    return clean.groupBy(*keys).agg(*aggs).select(*keys, F.inline(packed))


def resegmented(df: DataFrame, gap_s: int) -> DataFrame:
    return segment_gaps(df, gap_s)
