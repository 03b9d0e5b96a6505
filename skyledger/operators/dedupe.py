"""Duplicate handling. Copies are folded by aggregation, so a hot group shrinks before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.session import materialize

TIE_BREAK = ("lat", "lon", "baroaltitude", "velocity", "vertrate", "heading")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] = TIE_BREAK) -> DataFrame:
    """One row per key: the smallest by the order columns, then by the rest (nulls first)."""
    lead = [c for c in order if c in df.columns and c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in lead]
    best = F.min(F.struct(*lead, *rest)).alias("row")
    return df.groupBy(*keys).agg(best).select(*keys, "row.*").select(*df.columns)


def observed(df: DataFrame, channel: str) -> Column:
    """Present and not masked as imputed; a null mask counts as imputed."""
    if channel not in df.columns:
        return F.lit(False)
    valid = F.col(channel).isNotNull()
    mask = f"{channel}_missing"
    return valid & ~F.coalesce(F.col(mask), F.lit(True)) if mask in df.columns else valid


def canonical_positions(df: DataFrame) -> DataFrame:
    """Rows with a numeric time and an observed position."""
    timed = df.withColumn("time", F.expr("try_cast(time AS BIGINT)"))
    return timed.filter(F.col("time").isNotNull() & observed(timed, "lat") & observed(timed, "lon"))


def canonical_observations(df: DataFrame, key: str = "flight_id") -> DataFrame:
    """Unique, position-observed seconds of each operation."""
    return keep_first(canonical_positions(df), [key, "time"])


def dedupe_rounded_time(df: DataFrame) -> DataFrame:
    """Round time to whole seconds (half to even), then keep the first row per flight and second."""
    return keep_first(df.withColumn("time", F.bround(F.col("time").cast("double")).cast("long")), ["flight_id", "time"])


def full_row_counts(df: DataFrame) -> DataFrame:
    """Each distinct row with its number of copies."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))


def collapse_or_conflict(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Fold identical rows; keys whose rows differ go to the second result instead."""
    rest = [c for c in df.columns if c not in keys]
    folded = df.groupBy(*keys).agg(
        F.min(F.struct(*rest)).alias("lo"), F.max(F.struct(*rest)).alias("hi"), F.count(F.lit(1)).alias("copies"))
    same = F.col("lo").eqNullSafe(F.col("hi"))
    clean = folded.filter(same).select(*keys, "lo.*", (F.col("copies") - 1).alias("duplicates"))
    return clean, folded.filter(~same).select(*keys, "copies")


def duplicate_profile(df: DataFrame, key_sets: dict[str, Sequence[str]]) -> DataFrame:
    """Rows beyond the first for each key set, from one aggregation per set, with a diagnosis of all.

    Key sets go from coarse to fine and end with the full row. The finest set with extra rows is the cause: full rows
    point at a repeated load (fail), anything coarser has to be looked at (review).
    """
    parts = [
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.lit(name).alias("key_set"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))
        for name, keys in key_sets.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    result = materialize(result, "duplicates")  # one row per key set
    names = list(key_sets)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("key_set"))
    finest = result.agg(F.max_by("key_set", F.when(F.col("extra_rows") > 0, place)).alias("cause"))
    verdict = F.when(F.col("cause") == names[-1], "fail").when(F.col("cause").isNotNull(), "review").otherwise("pass")
    return result.crossJoin(finest).withColumn("verdict", verdict)


def most_repeated(df: DataFrame, k: int = 1) -> DataFrame:
    """The k rows with most copies, the smallest by their columns first; a top-k report, so the limit is the feature."""
    return full_row_counts(df).filter("copies > 1").orderBy(F.desc("copies"), *df.columns).limit(k)
