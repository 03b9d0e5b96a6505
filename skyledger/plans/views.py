"""The inputs of the registered queries, all derived from the given tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.config import PrepConfig
from skyledger.functions import decode
from skyledger.operators import approach, context, derive, inject, resample, segments, splits, windows
from skyledger.operators.sequence import segment_gaps
from skyledger.session import materialize
from skyledger.sources import derived

# The derived flights last under three minutes, so the length limits of the jobs are scaled to them.
PREP = PrepConfig(min_rows=10)
WINDOW = 15
MIN_VALID = 10
STATION = "08221099999"


class Views:
    """Lazily built frames for one table folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def obs(self) -> DataFrame:
        return derived.observations(self.spark, self.sf_dir)

    @cached_property
    def raw(self) -> DataFrame:
        return derived.with_copies(self.obs)

    @cached_property
    def masked(self) -> DataFrame:
        return derived.with_masks(self.obs)

    @cached_property
    def wx(self) -> DataFrame:
        return derived.weather_reports(self.obs)

    @cached_property
    def wxt(self) -> DataFrame:
        return derived.weather_text(self.wx)

    @cached_property
    def decoded(self) -> DataFrame:
        """The text reports decoded, one per time, with their own missing reasons."""
        one = context.prefer_report_type(self.wxt.withColumn("file_order", F.col("h")))
        return one.withColumns(decode.weather_columns()).select(F.col("STATION").alias("station"), "observed_at", "qnh_hpa", "wind_from_deg", "wind_speed", "missing_reasons")

    @cached_property
    def reg(self) -> DataFrame:
        return derived.registry(self.obs)

    @cached_property
    def d21(self) -> DataFrame:
        return derive.derive(self.obs)

    @cached_property
    def seg(self) -> DataFrame:
        """Rows by flight over as many tasks as the table asks for: all that follows sorts within a task."""
        return segment_gaps(self.d21.repartition(self.flight_tasks, "flight_id"), 60)

    @cached_property
    def flight_tasks(self) -> int:
        return derived.flight_tasks(self.spark, self.sf_dir)

    @cached_property
    def attempts(self) -> DataFrame:
        return approach.extract_attempts(self.masked, tasks=self.flight_tasks)

    @cached_property
    def stored_attempts(self) -> DataFrame:
        """The attempt rows as a stored table: jobs that read them several times start here."""
        return materialize(self.attempts, "attempts")

    @cached_property
    def envelope(self) -> DataFrame:
        return approach.published_envelope(self.spark)

    @cached_property
    def assessed(self) -> DataFrame:
        return approach.assess(self.attempts, envelope=self.envelope)

    @cached_property
    def clean(self) -> DataFrame:
        return resample.preprocess(self.d21, PREP, self.flight_tasks)

    @cached_property
    def stored_clean(self) -> DataFrame:
        """The cleaned rows as a stored table: jobs that read them several times start here."""
        return materialize(self.clean, "clean")

    @cached_property
    def meta(self) -> DataFrame:
        """Segment attributes; the go-around rule reads heights, so field elevation is taken off first."""
        low = self.stored_clean.withColumn("baroaltitude", F.col("baroaltitude") - 580.0)
        return splits.segment_meta(self.stored_clean).join(segments.detect_go_around(low), ["flight_id", "segment_id"])

    @cached_property
    def split(self) -> DataFrame:
        return splits.temporal_split(self.meta, splits.yearly_folds(self.meta))

    def fold(self, name: str) -> DataFrame:
        ids = self.split.filter(F.col("fold") == name).select("segment_id")
        return self.stored_clean.join(ids, "segment_id", "left_semi")

    @cached_property
    def train(self) -> DataFrame:
        return self.fold("train")

    @cached_property
    def scaler(self) -> DataFrame:
        return materialize(windows.fit_scaler(self.train), "scaler")

    @cached_property
    def eval_rows(self) -> DataFrame:
        """Labelled rows of everything outside train, half of the segments perturbed."""
        rest = self.split.filter("fold IN ('val', 'test')").select("segment_id")
        rows = self.stored_clean.join(rest, "segment_id", "left_semi")
        return inject.make_eval_set(rows, rest, window=WINDOW)

    @cached_property
    def train_window(self) -> DataFrame:
        return windows.window_rows(windows.scale(self.train, self.scaler), WINDOW)

    @cached_property
    def eval_window(self) -> DataFrame:
        return materialize(windows.window_rows(windows.scale(self.eval_rows, self.scaler), WINDOW), "eval")

    @cached_property
    def context(self) -> DataFrame:
        return context.attempt_context(self.attempts, self.wx, self.reg, STATION)

    @cached_property
    def scored(self) -> DataFrame:
        """A score per clean segment from plain arithmetic, with assessment and label."""
        clean = self.stored_clean
        score = clean.groupBy("flight_id", "segment_id").agg(
            F.round(F.avg(F.abs(F.col("vertrate") + 3.9)) + F.avg(F.abs(F.col("velocity") - 80.0)) / 10.0, 6).alias("score"))
        facts = segments.assess_segments(clean, WINDOW, MIN_VALID)
        labels = self.meta.select("segment_id", "icao24", splits.relabel().alias("label"))
        return score.join(facts, ["flight_id", "segment_id"]).join(labels, "segment_id")

    @cached_property
    def stored_scored(self) -> DataFrame:
        return materialize(self.scored, "scored")


def tidy(df: DataFrame, digits: int = 3) -> DataFrame:
    """Flat, rounded columns for comparison: doubles to `digits`, arrays to comma text, dates to text."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType)):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


REGISTRY: dict[str, object] = {}


def register(name: str, digits: int = 3):
    """Add a query: a function of the views that returns a frame."""

    def keep(fn):
        assert name not in REGISTRY, name
        REGISTRY[name] = lambda spark, sf_dir: tidy(fn(Views(spark, sf_dir)), digits)
        return fn

    return keep
