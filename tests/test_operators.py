"""Boundaries, skew and brute-force checks on small frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skyledger.operators import approach, detectors, disclosure, metrics, pivot_tree, queue, ranks, reference, segments, sequence, splits
from skyledger.sources import writers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_flights_cross_midnight_and_fold_copies(spark):
    day = 86_400
    times = [day - 1900, day - 100, day - 100, day + 100, day + 1900, day + 3701, 3 * day]
    df = frame(spark, [("a", t) for t in times], "icao24 string, time long")
    got = {(r.time, r.flight_id) for r in sequence.segment_flights(df).collect()}
    assert {f for t, f in got if t <= day + 1900} == {f"a_{day - 1900}"} and len(got) == 6
    assert {f for t, f in got if t > day + 1900} == {f"a_{day + 3701}", f"a_{3 * day}"}


def test_flight_longer_than_two_days_keeps_one_id(spark):
    df = frame(spark, [("a", t) for t in range(0, 200_000, 900)], "icao24 string, time long")
    assert {r.flight_id for r in sequence.segment_flights(df).select("flight_id").distinct().collect()} == {"a_0"}


def test_gap_of_180_stays_and_181_cuts(spark):
    df = frame(spark, [("f", 0), ("f", 180), ("f", 361)], "flight_id string, time long")
    assert [r.segment_id for r in sequence.segment_gaps(df).orderBy("time").collect()] == ["f#1", "f#1", "f#2"]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.gamma(2.0, 3.0, 3000), 2)
    df = frame(spark, [(float(v), int(i % 3 == 0)) for i, v in enumerate(values)], "v double, g int")
    got = {r.g: r for r in ranks.exact_quantiles(df, "v", [0.01, 0.5, 0.99], ["g"]).collect()}
    for g in (0, 1):
        want = np.quantile([v for i, v in enumerate(values) if int(i % 3 == 0) == g], [0.01, 0.5, 0.99])
        assert np.allclose([got[g].q0, got[g].q1, got[g].q2], want)


def test_auroc_with_a_third_of_equal_scores(spark):
    rng = np.random.default_rng(2)
    score = np.where(rng.random(900) < 0.34, 0.5, rng.random(900))
    label = (rng.random(900) < 0.3).astype(int)
    df = frame(spark, [(float(s), int(y)) for s, y in zip(score, label)], "score double, label int")
    pos, neg = score[label == 1], score[label == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert abs(metrics.auroc(df).first()[0] - want) < 1e-12
    keyed = frame(spark, [(f"k{i}", float(s), int(y)) for i, (s, y) in enumerate(zip(score, label))], "segment_id string, score double, label int")
    cis = [metrics.bootstrap_auroc(keyed, replicates=20, rows_per_block=n).first() for n in (50, 100_000)]
    assert cis[0] == cis[1] and cis[0].lo < want < cis[0].hi and cis[0].hi - cis[0].lo < 0.15 and cis[0].replicates == 20
    assert metrics.bootstrap_auroc(keyed.limit(0), replicates=5).first().replicates == 0
    for limit in (60,):
        assert abs(metrics._auroc_by_ranges(df, "score", "label", limit).first()[0] - want) < 1e-12
    assert metrics.auroc(df.filter("label = 0")).first()[0] is None and metrics.auroc(df.limit(0)).first()[0] is None


def test_refined_histograms_select_and_rank(spark):
    rng = np.random.default_rng(8)
    values = np.concatenate([np.full(500, 2.5), rng.normal(size=700), 10.0 ** rng.uniform(-300, 300, 200), -(10.0 ** rng.uniform(-5, 5, 100)), [0.0, -0.0, 5e-324, 1.7e308, -1.7e308]])
    rng.shuffle(values)
    df = frame(spark, [(float(v), i) for i, v in enumerate(values)] + [(None, -1), (float("nan"), -2)], "v double, i int")
    stored = ranks.slim(df, "v")
    want = np.sort(values)
    places = [0, 1, 17, 700, 701, 1200, len(want) - 1]
    for limit in (150, 10_000):
        assert ranks.order_statistics(stored, "v", places, limit) == {p: want[p] for p in places}
        ranges = ranks.even_ranges(stored, "v", limit)
        assert sum(r.n for r in ranges) == len(want) and all(r.n <= limit or r.single for r in ranges)
        got = {r.i: r.pct for r in ranks.weak_percentile(df, "v", limit=limit).collect()}
        assert got.pop(-1) is None and got.pop(-2) is None
        upto = np.searchsorted(want, values, side="right") * 100.0 / len(want)
        assert np.allclose([got[i] for i in range(len(values))], upto, rtol=0, atol=1e-9)
    row = ranks.exact_quantiles(df, "v", [0.0, 0.33, 0.5, 1.0]).first()
    assert row.n == len(want) and np.allclose(list(row)[1:], np.quantile(want, [0.0, 0.33, 0.5, 1.0]), rtol=1e-12)
    empty = ranks.exact_quantiles(df.limit(0), "v", [0.5]).first()
    assert empty.n is None and empty.q0 is None and ranks.weak_percentile(df.limit(0), "v").count() == 0


def vectors(spark, x, prefix):
    return frame(spark, [(f"{prefix}{i}", [float(v) for v in row]) for i, row in enumerate(x)], "segment_id string, features array<double>")


def kth(train, rows, k=5):
    return np.sort(np.sqrt(((rows[:, None] - train[None]) ** 2).sum(axis=2)), axis=1)[:, min(k, len(train)) - 1]


def scores_in_order(found):
    got = found.toPandas()
    return got.assign(i=got["segment_id"].str[1:].astype(int)).sort_values("i")


def test_tree_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    train, rows = rng.normal(size=(400, 6)), rng.normal(size=(90, 6))
    train[:140] = train[0]  # a third are copies
    rows[:20] = train[0] + 1e-3 * rng.normal(size=(20, 6))
    a, b = vectors(spark, train, "t"), vectors(spark, rows, "r")
    for options in ({}, {"fanout": 3, "leaf_rows": 8, "group_rows": 30}):
        got = scores_in_order(detectors.knn_score(a, b, **options))["score"].to_numpy()
        assert np.allclose(got, kth(train, rows), rtol=0, atol=1e-12)
    few = scores_in_order(detectors.knn_score(a.limit(0).unionByName(vectors(spark, train[-3:], "t")), b))["score"].to_numpy()
    assert np.allclose(few, kth(train[-3:], rows))
    assert detectors.knn_score(a.limit(0), b).count() == 0 and detectors.knn_score(a, b.limit(0)).count() == 0


def test_tree_compares_a_falling_share(spark):
    """Ten times the train rows: more leaves, and a smaller share of them is compared."""
    rng = np.random.default_rng(5)
    shares = []
    for n in (600, 6_000):
        train, rows = rng.normal(size=(n, 3)), rng.normal(size=(60, 3))
        got = scores_in_order(pivot_tree.nearest(vectors(spark, train, "t"), vectors(spark, rows, "r"), fanout=8, leaf_rows=32))
        assert np.allclose(got["score"].to_numpy(), kth(train, rows))
        shares.append(got["compared"].mean() / n)
    assert shares[1] < shares[0] / 3 and shares[0] < 0.6


def test_forest_and_mixture_rank_an_outlier_first(spark):
    rng = np.random.default_rng(4)
    train = vectors(spark, rng.normal(size=(300, 4)), "t")
    rows = vectors(spark, np.vstack([rng.normal(size=(30, 4)), np.full((1, 4), 9.0)]), "r")
    for scores in (detectors.isolation_forest(train, rows, trees=40), detectors.gmm_score(train, rows, components=3)):
        top = scores.orderBy(F.desc("score")).first()
        assert top.segment_id == "r30" and scores.count() == 31


def test_position_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    t, q = rng.normal(size=(300, 2)), rng.normal(size=(80, 2))
    schema = "flight_id string, segment_id string, step int, z_lat double, z_lon double, valid boolean"
    train = frame(spark, [("f", "s", i, float(a), float(b), True) for i, (a, b) in enumerate(t)], schema)
    rows = frame(spark, [("f", f"s{i % 4}", i, float(a), float(b), True) for i, (a, b) in enumerate(q)] + [("f", "none", 0, 0.0, 0.0, False)], schema)
    d = np.sort(np.sqrt(((q[:, None] - t[None]) ** 2).sum(axis=2)), axis=1)[:, 4]
    got = {r.segment_id: r.score for r in detectors.position_knn(train, rows).collect()}
    assert got["none"] == 0.0 and all(abs(got[f"s{k}"] - d[k::4].mean()) < 1e-9 for k in range(4))


def test_position_neighbours_beyond_80000_train_points(spark):
    rng = np.random.default_rng(6)
    t = np.vstack([rng.normal(size=(60_000, 2)) * 0.01, rng.normal(size=(30_000, 2)) + 5, np.repeat([[9.0, -9.0]], 500, axis=0)])
    q = np.vstack([rng.normal(size=(30, 2)), rng.normal(size=(10, 2)) * 40])
    schema = "flight_id string, segment_id string, z_lat double, z_lon double, valid boolean"
    train = spark.createDataFrame(pd.DataFrame({"flight_id": "f", "segment_id": "s", "z_lat": t[:, 0], "z_lon": t[:, 1], "valid": True}), schema)
    rows = frame(spark, [("f", f"s{i}", float(a), float(b), True) for i, (a, b) in enumerate(q)], schema)
    got = {r.segment_id: r.score for r in detectors.position_knn(train, rows, block_rows=7_000).collect()}
    for i, x in enumerate(q):
        assert abs(got[f"s{i}"] - np.partition(np.sqrt(((t - x) ** 2).sum(axis=1)), 4)[4]) < 1e-9


def test_hidden_cells_get_a_companion(spark):
    df = frame(spark, [("m", "a", 50), ("m", "b", 30), ("m", "c", 4), ("n", "a", 12), ("n", "b", 20)], "section string, key string, n long")
    got = {(r.section, r.key): (r.value, r.flag) for r in disclosure.suppress_small_cells(df, ["section"]).collect()}
    assert got[("m", "c")] == (None, "<10") and got[("m", "a")] == (None, "suppressed") and got[("m", "b")] == (30, None) and got[("n", "b")] == (20, None)


def test_partitioned_write_skips_stored_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_partitioned(frame(spark, [(1, "x")], "v int, p string"), path, "p")
    writers.write_partitioned(frame(spark, [(9, "x"), (2, "y")], "v int, p string"), path, "p")
    assert {(r.v, r.p) for r in spark.read.parquet(path).collect()} == {(1, "x"), (2, "y")}


def test_go_around_needs_one_airborne_run(spark):
    schema = "flight_id string, segment_id string, time long, baroaltitude double, dist_to_runway_m double, onground boolean"
    alts = [900, 700, 400, 200, 450, 700, 900]
    one = [("f", "go", i, float(a), 1000.0, False) for i, a in enumerate(alts)]
    two = [("f", "touch", i, float(a), 1000.0, i == 3) for i, a in enumerate(alts)]
    got = {r.segment_id: r.is_go_around for r in segments.detect_go_around(frame(spark, one + two, schema)).collect()}
    assert got == {"go": True, "touch": False}


def test_segments_by_gap_or_jump_match_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    day, rows = 86_400, []
    for key in "abc":
        t, lat = day - 900, 40.0
        for _ in range(400):
            t += int(rng.choice([5, 20, 60, 61, 700], p=[0.5, 0.3, 0.15, 0.04, 0.01]))
            lat += float(rng.choice([0.0005, 0.2], p=[0.97, 0.03]))
            rows.append((key, t + (3 * day if key == "c" and t > day else 0), lat, -3.5))
    rows += [("d", day - 30, 40.0, -3.5), ("d", day + 30, 40.0, -3.5), ("d", day + 91, None, -3.5), ("d", day + 95, 40.0, -3.5)]
    df = frame(spark, rows, "icao24 string, time long, lat double, lon double")
    got = {(r.icao24, r.time, r.seg_id, r.n_rows) for r in sequence.segment_gap_or_jump(df, min_rows=2).collect()}
    pieces, last = {}, {}
    for key, t, lat, _ in sorted(rows, key=lambda x: x[:2]):
        pt, plat, seg = last.get(key, (t, lat, 0))
        jump = lat is not None and plat is not None and abs(lat - plat) * 111_000 > 5_000
        seg += t - pt > 60 or jump
        last[key] = (t, lat, seg)
        pieces.setdefault((key, seg), []).append(t)
    want = {(k, t, f"{k}_{s}", len(ts)) for (k, s), ts in pieces.items() if len(ts) >= 2 for t in ts}
    assert got == want


def test_first_flights_of_a_cohort_and_the_sealed_fold(spark):
    rows = frame(spark, [(f, t) for f in ("c", "a", "b", "z") for t in (1, 2)], "flight_id string, time long")
    folds = frame(spark, [("c", "train"), ("a", "train"), ("a", "val"), ("b", "train"), ("z", "test")], "flight_id string, fold string")
    assert {r.flight_id for r in splits.cohort_operations(rows, folds, "train", 2).collect()} == {"a", "b"}
    assert splits.cohort_operations(rows, folds, "val").count() == 2
    with pytest.raises(ValueError):
        splits.cohort_operations(rows, folds, "test")


def test_drift_verdict_needs_a_comparison(spark):
    cells = "direction string, bin string, years long, speed_shift double, rate_shift double, within_limit boolean"
    one = [("18", "0-1500", 2, 0.2, 0.5, True)]
    assert reference.drift_verdict(frame(spark, one, cells)).first().status == "pass"
    assert reference.drift_verdict(frame(spark, one + [("36", "0-1500", 2, 0.51, 0.0, False)], cells)).first().above_limit == 1
    empty = reference.drift_verdict(frame(spark, [], cells)).first()
    assert (empty.status, empty.comparisons, empty.max_shift) == ("review", 0, None)


def test_ranking_attempts_does_not_run_their_assessment_twice(spark):
    rows = frame(spark, [("a", "criteria_observed", 5), ("b", "review_required", 1), ("c", "review_required", 7)], "attempt_id string, status string, start_time long")
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("status").orderBy("start_time")))
    ranked = queue.rank_attempts(numbered)
    assert "Window" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert [r.attempt_id for r in ranked.collect()] == ["c", "b", "a"]
