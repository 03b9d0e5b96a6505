"""Folds, leakage checks and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.config import FOLD_DATES, IDENTIFIERS
from skyledger.operators.resample import SEGMENT


def segment_meta(clean: DataFrame) -> DataFrame:
    """One row per segment: its UTC date and the attributes that are constant in it."""
    return clean.groupBy(*SEGMENT).agg(
        F.to_date(F.timestamp_seconds(F.min("time"))).cast("string").alias("date"), F.min("icao24").alias("icao24"),
        F.max("is_emergency").alias("is_emergency"), F.max("n_imputed_impossible").alias("n_imputed_impossible"))


def held_aside(is_go_around: str = "is_go_around") -> Column:
    return F.col("is_emergency") | F.coalesce(F.col(is_go_around), F.lit(False)) | (F.col("n_imputed_impossible") > 0)


def published_folds(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{d}', '{fold}')" for fold, dates in FOLD_DATES.items() for d in dates)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(date, fold)")


def yearly_folds(meta: DataFrame, last_train: int = 2018, val: int = 2019) -> DataFrame:
    """A date-to-fold map for every date seen, by year."""
    year = F.substring("date", 1, 4).cast("int")
    return meta.select("date").distinct().withColumn("fold", F.when(year <= last_train, "train").when(year == val, "val").otherwise("test"))


def temporal_split(meta: DataFrame, folds: DataFrame) -> DataFrame:
    """Held-aside segments first, then the fold of the date; a date without a fold is 'unmapped'."""
    return meta.join(folds, "date", "left").withColumn(
        "block", F.coalesce("fold", F.lit("unmapped"))).withColumn(
        "fold", F.when(F.col("block") == "unmapped", "unmapped").when(held_aside(), "held_aside").otherwise(F.col("block")))


def hash_uniform(*parts) -> Column:
    """A number in [0, 1) from the md5 of the parts: the same in every engine and run."""
    digest = F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def random_split(df: DataFrame, key: str, shares=(("train", 0.8), ("val", 0.1), ("test", 0.1)), seed: int = 42) -> DataFrame:
    u, fold, edge = hash_uniform(F.col(key), seed), F.lit(shares[-1][0]), 1.0
    for name, share in reversed(shares[:-1]):
        edge -= dict(shares)[shares[shares.index((name, share)) + 1][0]]
        fold = F.when(u < round(edge, 9), name).otherwise(fold)
    return df.withColumn("fold", fold)


def cohort_operations(rows: DataFrame, folds: DataFrame, fold: str, limit: int | None = None) -> DataFrame:
    """All rows of the flights with a segment in a fold; with a limit, of the first flights by id.

    The test fold is sealed and refused. The first ids come from a top-k per task, so no task sorts all flights.
    """
    if fold not in ("train", "val"):
        raise ValueError(f"no cohort may be taken from fold {fold!r}")
    flights = folds.filter(F.col("fold") == fold).select("flight_id").distinct()
    if limit is not None:
        flights = flights.orderBy("flight_id").limit(limit)
    return rows.join(flights, "flight_id", "left_semi")


def fold_overlap(split: DataFrame, key: str = "icao24") -> DataFrame:
    """How many keys occur in each pair of folds and in all three."""
    seen = split.filter(F.col("fold").isin("train", "val", "test")).groupBy(key).agg(
        *[F.max(F.col("fold") == f).alias(f) for f in ("train", "val", "test")])
    t, v, s = F.col("train"), F.col("val"), F.col("test")
    return seen.agg(F.count_if(t & v).alias("train_val"), F.count_if(t & s).alias("train_test"),
                    F.count_if(v & s).alias("val_test"), F.count_if(t & v & s).alias("all_three"))


def firewall_violations(split: DataFrame, features: Sequence[str]) -> DataFrame:
    """What breaks the split: a segment in two folds, an identifier feature, train or val after test."""
    spark = split.sparkSession
    twice = split.groupBy("segment_id").agg(F.min("fold").alias("lo"), F.max("fold").alias("hi")).filter("lo <> hi").select(
        F.lit("segment_in_two_folds").alias("problem"), F.col("segment_id").alias("item"))
    dates = split.agg(F.max(F.when(F.col("block").isin("train", "val"), F.col("date"))).alias("a"),
                      F.min(F.when(F.col("block") == "test", F.col("date"))).alias("b"))
    order = dates.filter("a >= b").select(F.lit("train_or_val_not_before_test").alias("problem"), F.col("a").alias("item"))
    leaked = [c for c in features if c in IDENTIFIERS]
    result = twice.unionByName(order)
    if leaked:
        result = result.unionByName(spark.createDataFrame([("identifier_feature", c) for c in leaked], "problem string, item string"))
    return result


def relabel(is_emergency: str = "is_emergency", is_go_around: str = "is_go_around") -> Column:
    return F.when(F.col(is_emergency), "emergency").when(F.col(is_go_around), "go_around").otherwise("normal")
