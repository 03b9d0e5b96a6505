"""Global order without a global sort task.

Over all rows, histograms are refined: a pass counts rows per bin of the value range with their least and largest value,
and the next one cuts only those bins again that still matter (selection: that hold a mark; ranking: that hold
more rows than one task should order). A pass moves one small row per bin and task, never the rows; bins of a
single value are final, so ties and hot values cost nothing.

Per key, values are folded to distinct ones and cut into blocks at approximate quantiles; offsets between blocks make
the results exact whatever the cut points are. Nulls and NaN have no rank.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.session import materialize


BINS = 1_024


@dataclass
class Range:
    """Rows with a value from low to high; single if that is one value."""

    low: float
    high: float
    n: int

    @property
    def single(self) -> bool:
        return self.low == self.high


def _cut(df: DataFrame, value: str, lows: Sequence[float], out: str) -> DataFrame:
    """Number of the last entry of lows (ascending, the first one at or below every value) that a value reaches."""
    if len(lows) < 2:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *lows[1:], float("inf")]
    return Bucketizer(splits=splits, inputCol=value, outputCol=out).transform(df).withColumn(out, F.col(out).cast("int"))


def _refined(df: DataFrame, value: str, ranges: list[Range], cut: Callable[[Range, int], bool]) -> list[Range]:
    """Cut ranges into BINS equal bins each, by one pass over their rows, as long as cut(range, rows before it) says so."""
    while True:
        before, opened = 0, set()
        for i, r in enumerate(ranges):
            if not r.single and cut(r, before):
                opened.add(i)
            before += r.n
        if not opened:
            return ranges
        lows = []
        for i in sorted(opened):
            r = ranges[i]
            # halves keep the width finite; a bin edge that rounds to its neighbour adds nothing
            lows += sorted({r.low, *(e for e in (r.low * (1 - j / BINS) + r.high * (j / BINS) for j in range(1, BINS)) if r.low < e <= r.high)} | {r.high})
        within = F.lit(False)
        runs: list[list[float]] = []
        for i in sorted(opened):  # neighbouring open ranges are one condition
            if runs and i - 1 in opened:
                runs[-1][1] = ranges[i].high
            else:
                runs.append([ranges[i].low, ranges[i].high])
        for low, high in runs:
            within = within | F.col(value).between(low, high)
        rows = _cut(df.filter(within).select(value), value, lows, "bin_").groupBy("bin_").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n")).collect()  # at most BINS rows a range
        ranges = sorted([r for i, r in enumerate(ranges) if i not in opened] + [Range(r.low, r.high, r.n) for r in rows], key=lambda r: r.low)


def _whole(df: DataFrame, value: str) -> list[Range]:
    r = df.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n")).first()
    return [Range(r.low, r.high, r.n)] if r.n else []


def _number(value: str) -> Column:
    """As a double, null for NaN, with one zero."""
    return F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")) + F.lit(0.0)


def slim(df: DataFrame, value: str, *more) -> DataFrame:
    """The value as a stored double column, nulls and NaN left out: what the passes read."""
    return materialize(df.select(_number(value).alias(value), *more).filter(F.col(value).isNotNull()), "values")


def order_statistics(slim: DataFrame, value: str, places: Iterable[int], limit: int = 10_000) -> dict[int, float]:
    """The values at the given places (from 0) of the order. Only ranges that hold a place are cut again.

    Ranges with at most `limit` rows around a place are sorted on the driver.
    """
    places = sorted(set(places))

    def hold(r: Range, before: int) -> bool:
        return bisect_right(places, before + r.n - 1) > bisect_right(places, before - 1)

    ranges = _refined(slim, value, _whole(slim, value), lambda r, before: r.n > limit and hold(r, before))
    found, before = {}, 0
    for r in ranges:
        inside = [p for p in places if before <= p < before + r.n]
        if inside:
            values = [] if r.single else sorted(x[0] for x in slim.filter(F.col(value).between(r.low, r.high)).select(value).collect())
            found |= {p: r.low if r.single else values[p - before] for p in inside}
        before += r.n
    return found


def even_ranges(slim: DataFrame, value: str, limit: int) -> list[Range]:
    """Disjoint ranges in order, of at most `limit` rows or of a single value; small neighbours are joined."""
    out: list[Range] = []
    for r in _refined(slim, value, _whole(slim, value), lambda r, _: r.n > limit):
        if out and out[-1].n + r.n <= limit:
            out[-1] = Range(out[-1].low, r.high, out[-1].n + r.n)
        else:
            out.append(r)
    return out


def with_range(df: DataFrame, value: str, ranges: list[Range]) -> DataFrame:
    """Add range_, the number of the range of each value."""
    return _cut(df, value, [r.low for r in ranges], "range_")


def with_block(df: DataFrame, value: str, blocks: int | None = None) -> DataFrame:
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = [i / n for i in range(1, n)]
    cuts = sorted(set(df.approxQuantile(value, marks, 0.5 / n))) if marks else []
    if not cuts:
        return df.withColumn("block", F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    cut = Bucketizer(splits=splits, inputCol=value, outputCol="block", handleInvalid="keep").transform(df)
    return cut.withColumn("block", F.col("block").cast("int"))


def cumulative(df: DataFrame, value: str, sums: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Add c_<col>: the total of col over rows of the key with a value up to this one.

    df holds one row per key and value. Offsets are one row per key and block.
    """
    cut = with_block(df, value)
    place = [*keys, "block"]
    totals = cut.groupBy(*place).agg(*[F.sum(s).alias(f"t_{s}") for s in sums])
    prior = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*place, *[F.coalesce(F.sum(f"t_{s}").over(prior), F.lit(0)).alias(f"o_{s}") for s in sums])
    upto = Window.partitionBy(*place).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        cut.join(offsets, place)
        .withColumns({f"c_{s}": F.col(f"o_{s}") + F.sum(s).over(upto) for s in sums})
        .drop("block", *[f"o_{s}" for s in sums])
    )


def value_counts(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return materialize(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("copies_")), "counts")


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles as columns q0, q1, …; groups of any size."""
    if not keys:
        stored = slim(df, value)
        n = stored.count()
        at = [(int((n - 1) * q), (n - 1) * q % 1.0) for q in qs]
        found = order_statistics(stored, value, [p for low, part in at for p in (low, low + (part > 0))]) if n else {}
        row = [found[low] + (found[low + (part > 0)] - found[low]) * part if n else None for low, part in at]
        return df.sparkSession.createDataFrame([(n or None, *row)], "n long, " + ", ".join(f"q{i} double" for i in range(len(qs))))
    counts = value_counts(df.withColumn(value, F.col(value).cast("double")), value, keys)
    ranked = cumulative(counts, value, ["copies_"], keys)
    totals = counts.groupBy(*keys).agg(F.sum("copies_").alias("total"))
    ranked = ranked.join(totals, list(keys))
    aggs = []
    for i, q in enumerate(qs):
        pos = (F.col("total") - 1) * F.lit(float(q))
        aggs += [F.min(F.when(F.col("c_copies_") > F.floor(pos), F.col(value))).alias(f"lo{i}"),
                 F.min(F.when(F.col("c_copies_") > F.ceil(pos), F.col(value))).alias(f"hi{i}"),
                 F.max(pos - F.floor(pos)).alias(f"f{i}")]
    found = ranked.groupBy(*keys).agg(F.max("total").alias("n"), *aggs)
    return found.select(*keys, "n", *[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"f{i}")).alias(f"q{i}")
                                      for i in range(len(qs))])


def weak_percentile(df: DataFrame, value: str, out: str = "pct", limit: int = 50_000) -> DataFrame:
    """100 · share of the cohort at or below each row's value; null where the value is.

    Rows move once, to the range of their value, and are counted within it; rows of a single-valued range stay.
    """
    df = materialize(df, "ranked")
    rows = df.withColumn("v_", _number(value))
    ranges = even_ranges(rows.filter("v_ IS NOT NULL").select("v_"), "v_", limit)
    if not ranges:
        return df.withColumn(out, F.lit(None).cast("double"))
    offsets, total = [], 0
    for i, r in enumerate(ranges):
        offsets.append((i, total, total + r.n if r.single else None))
        total += r.n
    placed = with_range(rows.filter("v_ IS NOT NULL"), "v_", ranges).join(F.broadcast(df.sparkSession.createDataFrame(offsets, "range_ int, below_ long, upto_ long")), "range_")
    upto = Window.partitionBy("range_").orderBy("v_").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = placed.filter("upto_ IS NULL").withColumn("upto_", F.col("below_") + F.count(F.lit(1)).over(upto))
    known = ordered.unionByName(placed.filter("upto_ IS NOT NULL")).select(*df.columns, (F.col("upto_") * 100.0 / total).alias(out))
    return known.unionByName(rows.filter("v_ IS NULL").select(*df.columns, F.lit(None).cast("double").alias(out)))


def percentile_against(df: DataFrame, base: DataFrame, value: str, strict: bool, out: str = "pct") -> DataFrame:
    """100 · share of base values below (strict) or at or below each value of df."""
    folded = df.select(value).withColumn("b", F.lit(0)).unionByName(base.select(value).withColumn("b", F.lit(1)))
    counts = materialize(folded.filter(F.col(value).isNotNull()).groupBy(value).agg(F.sum("b").alias("b")), "counts")
    ranked = cumulative(counts, value, ["b"]).crossJoin(counts.agg(F.sum("b").alias("total")))
    below = F.col("c_b") - F.col("b") if strict else F.col("c_b")
    return df.join(ranked.select(value, (below * 100.0 / F.col("total")).alias(out)), value, "left")
