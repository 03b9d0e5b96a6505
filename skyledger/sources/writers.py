"""Writers: partitioned tables, snapshots and keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def weekly_date(time: str = "time") -> F.Column:
    """The Monday of a row's UTC week, as a date."""
    return F.to_date(F.date_trunc("week", F.timestamp_seconds(F.col(time))))


def missing_partitions(df: DataFrame, spark: SparkSession, path: str, column: str) -> DataFrame:
    """Rows of the partitions that are not stored yet."""
    try:
        stored = spark.read.parquet(path).select(column).distinct()
    except Exception as error:  # the table does not exist before the first write
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER" in str(error):
            return df
        raise
    return df.join(stored, column, "left_anti")


def write_partitioned(df: DataFrame, path: str, column: str, skip_stored: bool = True) -> None:
    """One partition per value; a rerun replaces only the partitions it carries."""
    rows = missing_partitions(df, df.sparkSession, path, column) if skip_stored else df
    rows.repartition(column, F.pmod(F.xxhash64(*[c for c in rows.columns if c != column]), F.lit(8))).write.partitionBy(column).mode(
        "overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def upsert(stored: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The latest row per key over both sides; ties keep the larger row. Rows are folded before the shuffle."""
    rows = stored.unionByName(changes)
    rest = [c for c in rows.columns if c not in keys and c != version]
    latest = F.max(F.struct(version, *rest)).alias("r")
    return rows.groupBy(*keys).agg(latest).select(*keys, "r.*").select(*stored.columns)


def write_jdbc_batches(df: DataFrame, url: str, table: str, properties: dict | None = None, rows_per_batch: int = 500) -> None:
    df.write.mode("append").option("batchsize", rows_per_batch).jdbc(url, table, properties=properties or {})


def export_values(df: DataFrame, time_columns: Sequence[str]) -> DataFrame:
    """Timestamps as ISO text for a text-typed target."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in time_columns if c in df.columns})


def evenly_spaced_dates(spark: SparkSession, n: int, first: str, last: str, closed: tuple[str, str] | None = None) -> DataFrame:
    """n weekly dates spread over a range, leaving out a closed window; n = 1 takes the middle one."""
    from pyspark.sql import Window

    dates = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{last}', interval 7 days)")).alias("date"))
    if closed:
        dates = dates.filter(~F.col("date").between(F.lit(closed[0]).cast("date"), F.lit(closed[1]).cast("date")))
    return pick_evenly(dates, n, "date")


def pick_evenly(dates: DataFrame, n: int, column: str) -> DataFrame:
    """n positions evenly spread over an ordered, short list of dates."""
    from pyspark.sql import Window

    whole = Window.partitionBy(F.lit(0))
    numbered = dates.withColumns({"r": F.row_number().over(whole.orderBy(column)) - 1, "m": F.count(F.lit(1)).over(whole)})
    if n == 1:
        keep = F.col("r") == F.floor(F.col("m") / 2)
    else:
        j = F.ceil(F.try_divide(F.col("r") * (n - 1), F.col("m") - 1))
        keep = (j <= n - 1) & (F.floor(j * (F.col("m") - 1) / (n - 1)) == F.col("r"))
    return numbered.filter((F.lit(n) >= F.col("m")) | keep).select(column)
