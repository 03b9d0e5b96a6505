"""Fixed-length windows, scaling and summary vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.config import FEATURES, MEASURED, SCALED
from skyledger.operators.ranks import exact_quantiles
from skyledger.operators.resample import SEGMENT
from skyledger.operators.sequence import ordered

STATS = ("mean", "std", "min", "max")


def fit_scaler(train: DataFrame) -> DataFrame:
    """One row: mean and population deviation per scaled feature, deviation 0 replaced by 1."""
    aggs = []
    for c in SCALED:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"sd_{c}")]
    return train.agg(*aggs).withColumns({f"sd_{c}": F.when(F.col(f"sd_{c}") > 0, F.col(f"sd_{c}")).otherwise(1.0) for c in SCALED})


def scale(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """z_<feature> for every feature; sine, cosine and onground pass through. The scaler is one row."""
    wide = df.crossJoin(F.broadcast(scaler))
    scaled = {f"z_{c}": (F.col(c) - F.col(f"mean_{c}")) / F.col(f"sd_{c}") for c in SCALED}
    passed = {f"z_{c}": F.col(c).cast("double") for c in FEATURES if c not in SCALED}
    return wide.withColumns(scaled | passed).drop(*scaler.columns)


def unscale(df: DataFrame, scaler: DataFrame) -> DataFrame:
    wide = df.crossJoin(F.broadcast(scaler))
    return wide.withColumns({f"u_{c}": F.col(f"z_{c}") * F.col(f"sd_{c}") + F.col(f"mean_{c}") for c in SCALED}).drop(*scaler.columns)


def sequence_length(train: DataFrame, q: float = 0.95) -> DataFrame:
    """T: the whole part of the 95th percentile of segment lengths."""
    lengths = train.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("n"))
    return exact_quantiles(lengths, "n", [q]).select(F.floor("q0").alias("t"))


def any_mask() -> Column:
    hit = F.lit(False)
    for c in MEASURED:
        hit = hit | F.coalesce(F.col(f"{c}_missing"), F.lit(False))
    return hit


def window_rows(scaled: DataFrame, length: int) -> DataFrame:
    """First `length` rows of each segment with step and valid (no imputed value in the row)."""
    return scaled.withColumn("step", F.row_number().over(ordered(SEGMENT)) - 1).filter(F.col("step") < length).withColumn("valid", ~any_mask())


def to_sequences(scaled: DataFrame, length: int) -> DataFrame:
    """One row per segment: x = length × 9 array padded with 0, mask and loss_mask, was_truncated."""
    zs = [f"z_{c}" for c in FEATURES]
    numbered = scaled.withColumns({"step": F.row_number().over(ordered(SEGMENT)) - 1,
                                   "total": F.count(F.lit(1)).over(Window.partitionBy(*SEGMENT))}).filter(F.col("step") < length)
    packed = numbered.groupBy(*SEGMENT).agg(
        F.first("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("step", F.array(*zs).alias("x"), (~any_mask()).cast("double").alias("ok")))).alias("rows"))
    pad = F.lit(length) - F.size("rows")
    zero = F.array(*[F.lit(0.0)] * len(FEATURES))
    return packed.select(
        *SEGMENT, F.concat(F.transform("rows", lambda s: s["x"]), F.array_repeat(zero, pad)).alias("x"),
        F.concat(F.array_repeat(F.lit(1.0), F.size("rows")), F.array_repeat(F.lit(0.0), pad)).alias("mask"),
        F.concat(F.transform("rows", lambda s: s["ok"]), F.array_repeat(F.lit(0.0), pad)).alias("loss_mask"),
        (F.col("total") > length).alias("was_truncated"))


def truncation_tradeoff(clean: DataFrame, lengths) -> DataFrame:
    """Share of truncated segments and of padding for each candidate length."""
    sizes = clean.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("n"))
    tried = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).select(
        "n", "c", F.explode(F.array(*[F.lit(x) for x in lengths])).alias("t"))
    return tried.groupBy("t").agg(
        (F.sum(F.when(F.col("n") > F.col("t"), F.col("c")).otherwise(0)) * 100.0 / F.sum("c")).alias("truncated_pct"),
        (F.sum(F.greatest(F.col("t") - F.col("n"), F.lit(0)) * F.col("c")) * 100.0 / F.sum(F.col("t") * F.col("c"))).alias("padding_pct"))


def sliding_windows(df: DataFrame, length: int, keys=SEGMENT) -> DataFrame:
    """Rows of every complete window of `length` at half-length stride; a row is in at most two."""
    stride = length // 2
    numbered = df.withColumns({"rn": F.row_number().over(ordered(keys)) - 1, "total": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    first = F.greatest(F.lit(0), F.floor((F.col("rn") - length) / stride) + 1)
    final = F.least(F.floor(F.col("rn") / stride), F.floor((F.col("total") - length) / stride))
    return (
        numbered.filter(F.col("total") >= length).withColumns({"w0": first, "w1": final}).filter("w0 <= w1")
        .withColumn("window_no", F.explode(F.sequence("w0", "w1"))).withColumn("step", F.col("rn") - F.col("window_no") * stride)
        .drop("w0", "w1", "rn", "total"))


def summary_features(rows: DataFrame) -> DataFrame:
    """Mean, population deviation, min and max of the six scaled features over valid rows."""
    aggs = []
    for c in SCALED:
        v = F.when(F.col("valid"), F.col(f"z_{c}"))
        aggs += [F.coalesce(f(v), F.lit(0.0)).alias(f"{c}_{s}") for s, f in zip(STATS, (F.avg, F.stddev_pop, F.min, F.max))]
    return rows.groupBy(*SEGMENT).agg(*aggs)


def summary_columns() -> list[str]:
    return [f"{c}_{s}" for s in STATS for c in SCALED]


def summary_vectors(rows: DataFrame) -> DataFrame:
    return summary_features(rows).select(*SEGMENT, F.array(*summary_columns()).alias("features"))
