"""Ordered work inside one aircraft, flight or segment.

Windows run over rows that were folded to one per second first, so a key can hold at most one row
per second of its time span, however often reports were repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.config import FLIGHT_GAP_S, SECONDS_PER_DAY, SEGMENT_GAP_S
from skyledger.functions.geo import haversine_m


def running(keys: Sequence[str], order="time"):
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ordered(keys: Sequence[str], order="time"):
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def throughout(keys: Sequence[str]):
    """All rows of the key, in the order that windows along it need next: one sort serves both."""
    return ordered(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def flight_starts(df: DataFrame, key: str = "icao24", gap_s: int = FLIGHT_GAP_S) -> DataFrame:
    """(key, time, first_time): each distinct second with the first second of its flight.

    Work is cut into (key, day) pieces so that no aircraft is handled by one task. The last gap_s
    seconds of a day are copied into the next day, which is all a gap test can look back to; the
    running start is then carried over days on a table with one row per key and day.
    """
    day = F.floor(F.col("time") / SECONDS_PER_DAY)
    tail = F.pmod("time", F.lit(SECONDS_PER_DAY)) >= SECONDS_PER_DAY - gap_s
    pieces = (
        df.select(key, "time").distinct()
        .select(key, "time", F.explode(F.when(tail, F.array(day, day + 1)).otherwise(F.array(day))).alias("day"))
    )
    in_day = ordered([key, "day"])
    marked = (
        pieces.withColumn("prev", F.lag("time").over(in_day))
        .withColumn("start", F.when((F.col("day") * SECONDS_PER_DAY <= F.col("time"))
                                    & (F.col("prev").isNull() | (F.col("time") - F.col("prev") > gap_s)), F.col("time")))
        .withColumn("local", F.last("start", True).over(running([key, "day"])))
        .filter(F.col("day") * SECONDS_PER_DAY <= F.col("time"))
    )
    before = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        marked.groupBy(key, "day").agg(F.max("start").alias("latest"))
        .select(key, "day", F.last("latest", True).over(before).alias("carry"))
    )
    return (
        marked.join(carried, [key, "day"])
        .select(key, "time", F.coalesce("local", "carry").alias("first_time"))
    )


def segment_flights(df: DataFrame, key: str = "icao24", gap_s: int = FLIGHT_GAP_S) -> DataFrame:
    """Attach flight_id = key_firstEpoch. The ids come from a two-column pass; one join adds them."""
    starts = flight_starts(df, key, gap_s)
    return (
        df.drop("flight_id").join(starts, [key, "time"])
        .withColumn("flight_id", F.concat_ws("_", key, F.col("first_time").cast("string")))
        .drop("first_time")
    )


def number_segments(df: DataFrame, new_segment: Column, keys: Sequence[str] = ("flight_id",)) -> DataFrame:
    """seg = running count of the rows that start a segment."""
    return df.withColumn("seg", F.sum(new_segment.cast("long")).over(running(keys)))


def segment_gaps(df: DataFrame, gap_s: int = SEGMENT_GAP_S) -> DataFrame:
    """Cut flights at gaps above gap_s: segment_id = flight_id#k, counting from 1."""
    gap = F.col("time") - F.lag("time").over(ordered(["flight_id"]))
    return (
        df.withColumn("gap", gap)
        .withColumn("seg", F.sum((F.col("gap").isNull() | (F.col("gap") > gap_s)).cast("long")).over(running(["flight_id"])))
        .withColumn("segment_id", F.concat_ws("#", "flight_id", F.col("seg").cast("string")))
        .drop("gap", "seg")
    )


def segment_gap_or_jump(df: DataFrame, key: str = "icao24", gap_s: int = 60, jump_m: float = 5_000.0,
                        min_rows: int = 10) -> DataFrame:
    """Cut tracks on a time gap or a position jump and drop the short pieces; numbering starts at 0.

    Work is cut into (key, day) pieces. A row of the last gap_s seconds of a day is copied into the next one: a row
    without one before it that near begins a segment anyway. Numbers and lengths come from a four-column pass that
    folds to one row per day, so the wide rows move once, by (key, day), and stay for the join.
    """
    day = F.floor(F.col("time") / SECONDS_PER_DAY)
    piece, point = [key, "day_"], ["time", "lat", "lon"]

    def cut_rows(rows: DataFrame) -> DataFrame:
        """Rows with day_ and local_, the number of cuts in their day up to them."""
        placed = rows.withColumn("day_", F.explode(F.sequence(day, F.floor((F.col("time") + gap_s) / SECONDS_PER_DAY))))
        last = {f"{c}_": F.lag(c).over(ordered(piece)) for c in point}
        cut = (F.col("time") - F.col("time_") > gap_s) | (haversine_m("lat_", "lon_", "lat", "lon") > jump_m)
        own = placed.withColumns(last).withColumn("cut_", F.when(F.col("time_").isNull(), True).otherwise(F.coalesce(cut, F.lit(False))))
        own = own.filter(F.col("day_") == day).drop("time_", "lat_", "lon_")
        return own.withColumn("local_", F.sum(F.col("cut_").cast("long")).over(running(piece))).drop("cut_")

    heads = cut_rows(df.select(key, *point)).groupBy(*piece, "local_").agg(F.count(F.lit(1)).alias("n_"))
    numbered = heads.withColumn("seg_", F.sum((F.col("local_") > 0).cast("long")).over(running([key], ["day_", "local_"])) - 1)
    whole = numbered.withColumn("n_rows", F.sum("n_").over(Window.partitionBy(key, "seg_")))
    # a day's segments by local_, which counts from 0 or 1 without a gap
    days = whole.groupBy(*piece).agg(F.array_sort(F.collect_list(F.struct("local_", "seg_", "n_rows"))).alias("segs_"))
    found = F.get("segs_", (F.col("local_") - F.col("segs_")[0]["local_"]).cast("int"))
    joined = cut_rows(df).join(days, piece).withColumn("seg_", found["seg_"]).withColumn("n_rows", found["n_rows"])
    return joined.filter(F.col("n_rows") >= min_rows).withColumn("seg_id", F.concat_ws("_", key, F.col("seg_").cast("string"))).select(*df.columns, "n_rows", "seg_id")


def with_step_speed(df: DataFrame, keys: Sequence[str] = ("flight_id", "segment_id")) -> DataFrame:
    """step_s, step_m and step_speed from the previous row of the same key."""
    w = ordered(keys)
    return (
        df.withColumns({
            "step_s": F.col("time") - F.lag("time").over(w),
            "step_m": haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon"),
        }).withColumn("step_speed", F.col("step_m") / F.nullif(F.col("step_s"), F.lit(0)))
    )


def grounded() -> Column:
    return F.coalesce(F.col("onground"), F.lit(False))


def trim_idle(df: DataFrame, move_speed: float, keys: Sequence[str] = ("flight_id", "segment_id")) -> DataFrame:
    """Keep first to last active row of each segment; drop segments that never fly."""
    whole = Window.partitionBy(*keys)
    active = ~grounded() | F.coalesce(F.col("step_speed") > move_speed, F.lit(False))
    return (
        df.withColumns({
            "first_active": F.min(F.when(active, F.col("time"))).over(whole),
            "last_active": F.max(F.when(active, F.col("time"))).over(whole),
            "flies": F.max(~grounded()).over(whole),
        })
        .filter("flies AND time BETWEEN first_active AND last_active")
        .drop("first_active", "last_active", "flies")
    )


def idle_runs(df: DataFrame, move_speed: float) -> DataFrame:
    """Leading and trailing idle rows per flight; a flight with no active row is all leading idle."""
    active = ~grounded() | F.coalesce(F.col("step_speed") > move_speed, F.lit(False))
    numbered = df.withColumn("active", active).withColumn("rn", F.row_number().over(ordered(["flight_id"])))
    stats = numbered.groupBy("flight_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("active"), F.col("rn"))).alias("a"),
        F.max(F.when(F.col("active"), F.col("rn"))).alias("z"), F.max(~grounded()).alias("has_air"))
    return stats.select(
        "flight_id", F.coalesce(F.col("a") - 1, F.col("n")).cast("long").alias("lead_idle"),
        F.coalesce(F.col("n") - F.col("z"), F.lit(0)).cast("long").alias("trail_idle"), "has_air")


def islands(df: DataFrame, flag: Column, keys: Sequence[str]) -> DataFrame:
    """Maximal runs of rows where flag holds: one row per run."""
    w = ordered(keys)
    return (
        df.withColumn("rn", F.row_number().over(w)).withColumn("hit", F.coalesce(flag, F.lit(False)))
        .withColumn("island", F.col("rn") - F.sum(F.col("hit").cast("long")).over(running(keys)))
        .filter("hit")
        .groupBy(*keys, "island")
        .agg(F.min("rn").alias("start_rn"), F.count(F.lit(1)).alias("n_rows"),
             F.min("time").alias("start_time"), F.max("time").alias("end_time"))
        .drop("island")
    )


def persistent_spans(df: DataFrame, flag: Column, keys: Sequence[str], min_rows: int, min_s: int) -> DataFrame:
    runs = islands(df, flag, keys)
    return runs.filter((F.col("n_rows") >= min_rows) & (F.col("end_time") - F.col("start_time") >= min_s))


def attach_latest(rows: DataFrame, markers: DataFrame, key: str, payload: str) -> DataFrame:
    """Give each row the payload of the latest marker of its key at or before its time.

    Markers are merged into the ordered rows, so the cost is linear in rows plus markers.
    """
    kind = markers.schema[payload].dataType
    merged = rows.withColumns({"is_row": F.lit(1), payload: F.lit(None).cast(kind)}).unionByName(
        markers.select(key, "time", payload, F.lit(0).alias("is_row")), allowMissingColumns=True)
    return (
        merged.withColumn(payload, F.last(payload, True).over(running([key], ["time", "is_row"])))
        .filter("is_row = 1").drop("is_row")
    )
