"""Exact ranking metrics. Scores are folded to distinct values; order comes from ranks.cumulative."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators import draws, ranks
from skyledger.operators.ranks import cumulative, exact_quantiles
from skyledger.session import materialize

# Rows of a score range whose resamples one call folds, and the most tasks of a bootstrap.
BLOCK = 4_000
MAX_TASKS = 10_000


def confusion_steps(df: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: positives and negatives at it, below or at it (c_), and overall (t_)."""
    counts = materialize(
        df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(
            F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")), "steps")
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("t_pos"), F.sum("neg").alias("t_neg"))
    steps = cumulative(counts, score, ["pos", "neg"], keys)
    return steps.join(totals, list(keys)) if keys else steps.crossJoin(totals)


def _wins(pos: str = "pos") -> Column:
    return F.col(pos) * (F.col("c_neg") - F.col("neg") + F.col("neg") / 2)


def auroc(df: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half."""
    if not keys:
        return _auroc_by_ranges(df, score, label)
    steps = confusion_steps(df, score, label, keys)
    return steps.groupBy(*keys).agg(F.try_divide(F.sum(_wins()), F.max(F.col("t_pos") * F.col("t_neg"))).alias("auroc"))


def _auroc_by_ranges(df: DataFrame, score: str, label: str, limit: int = 50_000) -> DataFrame:
    """Pairs of different ranges follow from counts; only ranges of several values that hold both classes are ordered."""
    rows = ranks.slim(df.withColumn("y_", F.col(label).cast("long")), score, "y_")
    ranges = ranks.even_ranges(rows, score, limit)
    wins, pos, neg, mixed = 0.0, 0, 0, []
    if ranges:
        cut = ranks.with_range(rows, score, ranges)
        sums = {r.range_: r for r in cut.groupBy("range_").agg(F.sum("y_").alias("p"), F.sum(1 - F.col("y_")).alias("n")).collect()}
        for i, r in enumerate(ranges):
            p, n = sums[i].p or 0, sums[i].n or 0
            wins += p * neg + (p * n / 2 if r.single else 0)
            mixed += [(i,)] if p and n and not r.single else []
            pos, neg = pos + p, neg + n
        if mixed:
            inner = cut.join(F.broadcast(df.sparkSession.createDataFrame(mixed, "range_ int")), "range_").groupBy("range_", score).agg(F.sum("y_").alias("pos"), F.sum(1 - F.col("y_")).alias("neg"))
            upto = Window.partitionBy("range_").orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            wins += inner.withColumn("c_neg", F.sum("neg").over(upto)).agg(F.sum(_wins())).first()[0]
    return df.sparkSession.createDataFrame([(wins / (pos * neg) if pos and neg else None,)], "auroc double")


def _at_or_above() -> dict[str, Column]:
    return {"tp": F.col("t_pos") - F.col("c_pos") + F.col("pos"), "fp": F.col("t_neg") - F.col("c_neg") + F.col("neg")}


def pr_curve(df: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Precision and recall when everything at or above each distinct score is flagged."""
    steps = confusion_steps(df, score, label, keys).withColumns(_at_or_above())
    return steps.select(*keys, F.col(score).alias("threshold"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
                        F.try_divide("tp", "t_pos").alias("recall"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Step sum of precision over recall gains (no trapezoids)."""
    steps = confusion_steps(df, score, label, keys).withColumns(_at_or_above())
    gain = F.try_divide(F.col("pos") * F.col("tp"), F.col("t_pos") * (F.col("tp") + F.col("fp")))
    return steps.groupBy(*keys).agg(F.sum(gain).alias("average_precision"))


def kind_auroc(df: DataFrame, kinds: Sequence[str], score: str = "score", kind: str = "kind", normal: str = "normal",
               keys: Sequence[str] = ()) -> DataFrame:
    """AUROC and average precision of each kind, and of all kinds together, against every normal.

    The normals are counted once and shared by the kinds.
    """
    groups = {k: F.col(kind) == k for k in kinds} | {"overall": F.col(kind) != normal}
    counts = materialize(df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.count_if(F.col(kind) == normal).alias("neg"), *[F.count_if(c).alias(f"pos_{k}") for k, c in groups.items()]), "kinds")
    names = [f"pos_{k}" for k in groups]
    totals = counts.groupBy(*keys).agg(F.sum("neg").alias("t_neg"), *[F.sum(n).alias(f"t_{n}") for n in names])
    steps = cumulative(counts, score, ["neg", *names], keys)
    steps = steps.join(totals, list(keys)) if keys else steps.crossJoin(totals)
    aggs = []
    for k in groups:
        tp = F.col(f"t_pos_{k}") - F.col(f"c_pos_{k}") + F.col(f"pos_{k}")
        fp = F.col("t_neg") - F.col("c_neg") + F.col("neg")
        aggs.append(F.struct(
            F.lit(k).alias("kind"), F.max(f"t_pos_{k}").alias("positives"),
            (F.sum(_wins(f"pos_{k}")) / F.nullif(F.max(F.col(f"t_pos_{k}") * F.col("t_neg")), F.lit(0))).alias("auroc"),
            F.sum(F.col(f"pos_{k}") / F.nullif(F.col(f"t_pos_{k}"), F.lit(0)) * tp / F.nullif(tp + fp, F.lit(0))).alias("average_precision")))
    return steps.groupBy(*keys).agg(F.array(*aggs).alias("m")).select(*keys, F.inline("m")).filter("positives > 0")


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 2.0) -> Column:
    b = beta * beta
    return F.coalesce((1 + b) * tp / F.nullif((1 + b) * tp + b * fn + fp, F.lit(0.0)), F.lit(0.0))


def pick_threshold(df: DataFrame, max_fpr: float = 0.15, score: str = "score", label: str = "label") -> DataFrame:
    """The lowest score with the best F2 among those whose false-positive rate is small enough."""
    steps = confusion_steps(df, score, label).withColumns(_at_or_above())
    rated = steps.withColumns({
        "f2": f_beta(F.col("tp"), F.col("fp"), F.col("t_pos") - F.col("tp")),
        "fpr": F.col("fp") / F.greatest(F.col("t_neg"), F.lit(1))}).filter(F.col("fpr") <= max_fpr)
    best = rated.agg(F.max(F.struct(F.round("f2", 12).alias("f2"), (-F.col(score)).alias("t"), "fpr", "tp", "t_pos")).alias("b"))
    return best.select((-F.col("b.t")).alias("threshold"), F.col("b.f2").alias("f2"), F.col("b.fpr").alias("fpr"),
                       F.try_divide("b.tp", "b.t_pos").alias("recall"))


def operating_point(df: DataFrame, threshold: float, score: str = "score", label: str = "label", strict: bool = False) -> DataFrame:
    """F2, F1, false-positive rate and recall at a fixed threshold."""
    flagged = F.col(score) > threshold if strict else F.col(score) >= threshold
    hit = F.col(label) == 1
    counts = df.agg(F.count_if(flagged & hit).alias("tp"), F.count_if(flagged & ~hit).alias("fp"),
                    F.count_if(~flagged & hit).alias("fn"), F.count_if(~flagged & ~hit).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "tp", "fp", "fn", "tn", f_beta(tp, fp, fn).alias("f2"), f_beta(tp, fp, fn, 1.0).alias("f1"),
        F.coalesce(fp / F.nullif(fp + F.col("tn"), F.lit(0)), F.lit(0.0)).alias("fpr"),
        (tp / F.greatest(tp + fn, F.lit(1))).alias("recall"))


def normal_quantile(df: DataFrame, q: float, score: str = "score", label: str = "label") -> float:
    """One number: a quantile of the normal scores."""
    row = exact_quantiles(df.filter(F.col(label) == 0).select(F.col(score).alias("s")), "s", [q]).first()
    return float(row["q0"])


def seen_unseen(df: DataFrame, train_keys: DataFrame, key: str, score: str = "score", label: str = "label") -> DataFrame:
    """AUROC for rows whose key occurs in train and for the rest."""
    known = train_keys.select(key).distinct().withColumn("seen", F.lit(True))
    return auroc(df.join(known, key, "left").withColumn("seen", F.coalesce("seen", F.lit(False))), score, label, ["seen"])


def poisson_draw(u: Column, mean: float = 1.0, most: int = 16) -> Column:
    """A Poisson number by inversion of u in [0, 1): how many of the cumulative probabilities are at or below it."""
    term, upto, out = math.exp(-mean), 0.0, F.lit(0)
    for k in range(most):
        upto += term
        out = out + (u >= F.lit(upto)).cast("int")
        term *= mean / (k + 1)
    return out


def _replicate_sums(table: pa.Table, replicates: int, seed: int) -> pa.Table:
    """Per replicate the weights of positives (p) and of the others (n) of one piece, and twice the wins inside it (u).

    Wins are whole for lower scores and half for equal ones. A piece of one score (single) needs no wins, so it is
    drawn in blocks.
    """
    single, score = table["single"][0].as_py(), table["s"].to_numpy()
    order = np.argsort(score, kind="stable")
    ids = table["id_"].take(order).to_pylist()
    positive = table["y_"].fill_null(0).to_numpy()[order] == 1
    if single:
        p, n, u = (np.zeros(replicates, np.int64) for _ in range(3))
        for at in range(0, len(ids), BLOCK):
            drawn, hit = draws.poisson_weights(ids[at:at + BLOCK], seed, replicates), positive[at:at + BLOCK]
            p, n = p + drawn[hit].sum(0, dtype=np.int64), n + drawn[~hit].sum(0, dtype=np.int64)
    else:
        drawn, score = draws.poisson_weights(ids, seed, replicates), score[order]
        starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        others = np.add.reduceat(np.where(positive[:, None], np.uint8(0), drawn), starts, dtype=np.int64)
        upto = np.cumsum(others, axis=0)
        hits = np.flatnonzero(positive)
        at = np.searchsorted(starts, hits, "right") - 1  # the score of each positive
        won, p = drawn[hits].astype(np.int64), drawn[hits].sum(0, dtype=np.int64)
        u, n = (won * (2 * upto[at] - others[at])).sum(0), upto[-1]
    return pa.table({"range_": pa.repeat(table["range_"][0], replicates), "single": pa.repeat(single, replicates), "rep": pa.array(np.arange(replicates, dtype=np.int32)),
                     "p": pa.array(p), "n": pa.array(n), "u": pa.array(u)})


def bootstrap_auroc(df: DataFrame, score: str = "score", label: str = "label", key: str = "segment_id", replicates: int = 1_000, seed: int = 42,
                    rows_per_block: int = BLOCK) -> DataFrame:
    """2.5% and 97.5% of the AUROC over Poisson resamples.

    A row's weight in a replicate is a Poisson draw with mean 1 by inversion of a hash of key, seed and replicate, so any
    engine can repeat it. Rows are cut into even ranges of the score; a range is one piece, for which all replicates are
    drawn in numpy and folded to their weights and inner wins (twice, as whole numbers). Ranges of one score need sums
    only, and are dealt to several pieces. Offsets between ranges are sums over ranges. No row moves per replicate.
    """
    rows = ranks.slim(df.withColumn("y_", F.col(label).cast("int")), score, "y_", F.col(key).cast("string").alias("id_"))
    ranges = ranks.even_ranges(rows, score, rows_per_block)
    if not ranges:
        return df.sparkSession.createDataFrame([(None, None, 0)], "lo double, hi double, replicates long")
    parts = [(i, r.single, -(-r.n // rows_per_block) if r.single else 1) for i, r in enumerate(ranges)]
    placed = ranks.with_range(rows, score, ranges).join(F.broadcast(df.sparkSession.createDataFrame(parts, "range_ int, single boolean, parts int")), "range_")
    pieces = placed.select("range_", "single", F.pmod(F.xxhash64("id_"), F.col("parts")).alias("part"), F.col(score).alias("s"), "y_", "id_")
    # a fixed number of tasks: few bytes are much work here, so the planner must not join tasks by their size
    tasks = min(MAX_TASKS, sum(n for *_, n in parts))
    place = ["range_", "single", "part"]
    folded = pieces.repartition(tasks, *place).groupBy(*place).applyInArrow(
        lambda table: _replicate_sums(table, replicates, seed), "range_ int, single boolean, rep int, p long, n long, u long")
    sums = folded.groupBy("range_", "single", "rep").agg(*[F.sum(c).alias(c) for c in ("p", "n", "u")]).withColumn("u", F.when(F.col("single"), F.col("p") * F.col("n")).otherwise(F.col("u")))
    zero = F.lit(0).cast("long")
    prior = Window.partitionBy("rep").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    linked = sums.withColumn("u", F.col("u") + 2 * F.col("p") * F.coalesce(F.sum("n").over(prior), zero))
    reps = linked.groupBy("rep").agg((F.sum("u") / F.nullif(2 * F.sum("p") * F.sum("n"), zero)).alias("a"))
    return reps.agg(F.percentile("a", 0.025).alias("lo"), F.percentile("a", 0.975).alias("hi"), F.count("a").alias("replicates"))


def precision_at_k(df: DataFrame, k: int, score: str = "score", label: str = "label", tie: str = "segment_id") -> DataFrame:
    """Anomalies among the k highest scores; a top-k report, so the limit is the feature."""
    top = df.select(score, label, tie).orderBy(F.desc(score), tie).limit(k)
    return top.agg(F.sum(F.col(label).cast("long")).alias("hits"), F.count(F.lit(1)).alias("k"))
