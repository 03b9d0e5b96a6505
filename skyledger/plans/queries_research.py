"""Registered queries: folds, labelled data, detectors, metrics and the triage queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.config import FEATURES, INJECTION_MIX
from skyledger.operators import detectors, inject, metrics, profiles, queue, ranks, segments, splits, windows
from skyledger.operators.derive import normalised_heading
from skyledger.operators.resample import SEGMENT
from skyledger.operators.sequence import ordered
from skyledger.plans.views import MIN_VALID, PREP, WINDOW, register
from skyledger.session import materialize

KINDS = tuple(k for k, _ in INJECTION_MIX)
THRESHOLD = 1.0


@register("detect_go_around")
def _(v):
    return v.meta.select("segment_id", "is_go_around")


@register("terminal_window")
def _(v):
    return segments.segment_facts(v.clean, WINDOW).select("segment_id", "terminal_op")


@register("assess_segment", digits=6)
def _(v):
    jumpy = v.clean.withColumn("baroaltitude", F.expr("CASE WHEN flight_id LIKE '%7' AND time % 7 = 0 THEN baroaltitude + 900 ELSE baroaltitude END"))
    return segments.assess_segments(jumpy, WINDOW, MIN_VALID).drop("flight_id")


# ---- folds ------------------------------------------------------------------------------------

@register("segment_date")
def _(v):
    return splits.segment_meta(v.clean).select("segment_id", "date")


@register("per_segment_meta")
def _(v):
    return v.meta.drop("flight_id")


@register("temporal_split")
def _(v):
    return v.split.select("segment_id", "fold", "block")


@register("temporal_split_published")
def _(v):
    """The published dates: every other date is reported as unmapped, never dropped."""
    return splits.temporal_split(v.meta, splits.published_folds(v.spark)).groupBy("fold", "block").agg(F.count(F.lit(1)).alias("segments"))


@register("random_split")
def _(v):
    return splits.random_split(v.meta.select("segment_id"), "segment_id")


@register("fold_overlap")
def _(v):
    return splits.fold_overlap(v.split)


@register("firewall_checks")
def _(v):
    late = v.split.withColumn("date", F.when((F.col("block") == "val") & F.col("is_emergency"), "2999-01-01").otherwise(F.col("date")))
    return splits.firewall_violations(late, [*FEATURES, "icao24"])


@register("seen_unseen")
def _(v):
    s = v.stored_scored.join(v.split.select("segment_id", "fold", "block"), "segment_id")
    rows = s.filter("block <> 'train'").select("icao24", "score", (F.col("label") != "normal").cast("int").alias("label"))
    few = s.filter("fold = 'train' AND segment_id LIKE '%5#1'").select("icao24")
    return metrics.seen_unseen(rows, few, "icao24")


@register("relabel_anomaly")
def _(v):
    return v.meta.select("segment_id", splits.relabel().alias("label"))


# ---- labelled data ----------------------------------------------------------------------------

@register("assign_kinds")
def _(v):
    return inject.assign_kinds(v.meta.select("segment_id"))


def eval_source(v, kind=None):
    kinds = inject.assign_kinds(v.meta.select("segment_id"), rate=1.0) if kind is None else v.meta.select("segment_id", F.lit(kind).alias("kind"))
    return inject.with_onset(v.stored_clean.join(kinds, "segment_id"), 0.5, WINDOW)


INJ = ("segment_id", "kind", "step", "onset", "lat", "lon", "baroaltitude", "velocity", "vertrate", "onground", "dist_to_runway_m", "velocity_missing")


@register("inject_anomalies")
def _(v):
    return inject.inject(eval_source(v)).select(*INJ)


@register("make_eval_set")
def _(v):
    return v.eval_rows.groupBy("segment_id", "kind", "label", "onset").agg(F.count(F.lit(1)).alias("n_rows"))


@register("inject_blend")
def _(v):
    return inject.inject_blend(eval_source(v), 0.4).select("segment_id", "kind", "step", "lat", "lon", "baroaltitude", "velocity", "vertrate")


@register("inject_comparison_kinds")
def _(v):
    # the variants are columns of one pass over the segments: each of its own would move and sort the rows again
    rows, channels, variants = eval_source(v, "comparison"), ("lat", "lon", "baroaltitude", "velocity", "vertrate"), {}
    for i, (kind, size) in enumerate(inject.COMPARISON_KINDS):
        rows = inject.inject_comparison(rows, kind, size, into=f"v{i}_")
        variants[f"{kind}:{int(size * 10)}"] = [f"v{i}_{c}" if f"v{i}_{c}" in rows.columns else c for c in channels]
    means = rows.groupBy("segment_id").agg(*[F.avg(c).alias(c) for c in dict.fromkeys(c for used in variants.values() for c in used)])
    packed = F.array(*[F.struct(F.lit(name).alias("variant"), "segment_id", *[F.col(c).alias(n) for c, n in zip(used, channels)]) for name, used in variants.items()])
    return means.select(F.inline(packed))


@register("inject_simple_kinds")
def _(v):
    scaled = windows.scale(v.stored_clean, windows.fit_scaler(v.stored_clean))
    return inject.inject_simple(scaled).select("segment_id", "kind", "step", "z_baroaltitude", "z_velocity", "z_dist_to_runway_m")


# ---- reconstruction ---------------------------------------------------------------------------

def shifted(v):
    """A reconstruction table: every row rebuilt as its predecessor."""
    rows = windows.window_rows(windows.scale(v.stored_clean, windows.fit_scaler(v.stored_clean)), WINDOW)
    w = ordered(SEGMENT)
    return rows.withColumns({f"r_{c}": F.coalesce(F.lag(f"z_{c}").over(w), F.col(f"z_{c}")) for c in FEATURES})


def rest_window(v):
    """Windows of the segments outside train."""
    rest = v.stored_clean.join(v.split.filter("fold <> 'train'").select("segment_id"), "segment_id", "left_semi")
    return windows.window_rows(windows.scale(rest, v.scaler), WINDOW)


@register("reconstruction_scores")
def _(v):
    return detectors.reconstruction_scores(detectors.step_errors(shifted(v)), WINDOW).drop("flight_id")


@register("feature_errors")
def _(v):
    return detectors.feature_errors(shifted(v)).drop("flight_id")


@register("step_threshold_p99")
def _(v):
    errors = detectors.step_errors(shifted(v)).filter("valid").select("segment_id", "step_error")
    normal = v.meta.filter(splits.relabel() == "normal").select("segment_id")
    return ranks.exact_quantiles(errors.join(normal, "segment_id", "left_semi"), "step_error", [0.99]).select(F.col("q0").alias("step_threshold"), F.col("n").alias("n_steps"))


@register("pca_reconstruction")
def _(v):
    rows = detectors.step_errors(detectors.pca_reconstruction(materialize(v.train_window, "train"), rest_window(v)))
    return detectors.reconstruction_scores(rows, WINDOW).drop("flight_id")


# ---- detectors --------------------------------------------------------------------------------

def vectors(v, digits: int | None = None):
    """Summary vectors of the train segments and of all others."""
    frames = [windows.summary_vectors(x) for x in (v.train_window, rest_window(v))]
    if digits is not None:  # so that sums in another order give equal vectors
        frames = [x.withColumn("features", F.transform("features", lambda f: F.round(f, digits) + F.lit(0.0))) for x in frames]
    return materialize(frames[0], "train"), materialize(frames[1], "rows")


@register("isolation_forest")
def _(v):
    return detectors.isolation_forest(*vectors(v, 6))


@register("knn_score")
def _(v):
    return detectors.knn_score(*vectors(v))


@register("turning_review")
def _(v):
    """Segments outside train; scores to 6 digits, so that sums in another order rank alike."""
    rest = v.split.filter("fold <> 'train'").select("segment_id")
    errors = detectors.reconstruction_scores(detectors.step_errors(shifted(v)), WINDOW).join(rest, "segment_id", "left_semi")
    neighbours = detectors.knn_score(*vectors(v)).select("segment_id", F.round("score", 6).alias("score"))
    turned = v.stored_clean.withColumn("heading", F.expr("pmod(heading + (floor(time / 10) % 4) * 40, 360D)"))
    return profiles.turning_review(turned, errors.select("segment_id", F.round("score_mean", 6).alias("error")), materialize(neighbours, "neighbours")).drop("flight_id")


@register("gmm_score")
def _(v):
    return detectors.gmm_score(*vectors(v, 6))


@register("position_knn")
def _(v):
    return detectors.position_knn(materialize(v.train_window, "train"), rest_window(v)).drop("flight_id")


# ---- metrics ----------------------------------------------------------------------------------

def labelled(v):
    return v.stored_scored.select("segment_id", "icao24", "score", "label", (F.col("label") != "normal").cast("int").alias("y"))


@register("auroc", digits=6)
def _(v):
    return metrics.auroc(labelled(v), "score", "y")


@register("average_precision", digits=6)
def _(v):
    return metrics.average_precision(labelled(v), "score", "y")


@register("pr_curve", digits=6)
def _(v):
    return metrics.pr_curve(labelled(v), "score", "y")


@register("per_type_auroc", digits=6)
def _(v):
    kinds = inject.assign_kinds(v.meta.select("segment_id"))
    return metrics.kind_auroc(v.stored_scored.drop("kind").join(kinds, "segment_id"), KINDS)


@register("metric_by_cohort", digits=6)
def _(v):
    models = F.array(F.struct(F.lit("a").alias("model"), F.col("score").alias("s")), F.struct(F.lit("b").alias("model"), F.col("max_ground_speed").alias("s")))
    rows = v.stored_scored.select("label", F.inline(models))
    return metrics.kind_auroc(rows, ("go_around", "emergency"), "s", "label", keys=["model"])


@register("pick_threshold", digits=6)
def _(v):
    return metrics.pick_threshold(labelled(v), 0.15, "score", "y")


@register("operating_point", digits=6)
def _(v):
    return metrics.operating_point(labelled(v), THRESHOLD, "score", "y")


@register("threshold_p95_normal", digits=6)
def _(v):
    rows = labelled(v)
    threshold = metrics.normal_quantile(rows, 0.95, "score", "y")
    return metrics.operating_point(rows, threshold, "score", "y", strict=True).withColumn("threshold", F.lit(threshold))


@register("bootstrap_ci")
def _(v):
    return metrics.bootstrap_auroc(labelled(v), "score", "y")


@register("precision_at_k")
def _(v):
    return metrics.precision_at_k(labelled(v), 50, "score", "y")


@register("weak_ecdf_percentile", digits=6)
def _(v):
    return ranks.weak_percentile(labelled(v).select("segment_id", "score"), "score")


@register("strict_percentile_vs_normal", digits=6)
def _(v):
    rows = labelled(v)
    return ranks.percentile_against(rows.select("segment_id", "score"), rows.filter("y = 0"), "score", strict=True)


# ---- queue ------------------------------------------------------------------------------------

def built(v):
    return materialize(queue.build_queue(v.stored_scored, THRESHOLD), "queue")


@register("build_queue")
def _(v):
    return built(v).select("segment_id", "score", "pct", "band", "anomalous", "case_id", "operation_ref", "label", "assessment_state")


@register("operation_summary")
def _(v):
    return queue.operation_summaries(built(v))


@register("queue_summary", digits=6)
def _(v):
    return queue.queue_summary(built(v), THRESHOLD)


@register("rank_queue_modes")
def _(v):
    q = built(v).select("segment_id", "score")
    result = None
    for mode in ("anomalous", "normal", "typical"):
        page = queue.rank_queue(q, mode, 50).withColumn("mode", F.lit(mode))
        result = page if result is None else result.unionByName(page)
    return result


@register("select_cases")
def _(v):
    return queue.select_cases(built(v))


@register("queue_with_cases")
def _(v):
    q = built(v)
    cases = queue.select_cases(q).withColumn("has_case", F.lit(True))
    return q.select("segment_id", "case_id").join(cases, "segment_id", "left").withColumn("has_case", F.coalesce("has_case", F.lit(False)))


@register("siblings_context")
def _(v):
    return queue.siblings_context(v.stored_clean, 5).select("flight_id", "segment_id", "time")
