"""Outlier scores for segments. Spark spreads and shuffles the work; numpy works inside tasks."""

from __future__ import annotations

import hashlib
import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.config import FEATURES
from skyledger.operators import pivot_tree
from skyledger.operators.splits import hash_uniform
from skyledger.session import materialize

EULER_GAMMA = 0.5772156649015329


# ---- reconstruction ---------------------------------------------------------------------------

def step_errors(rows: DataFrame) -> DataFrame:
    """step_error: mean squared difference over the nine features; rows carry z_* and r_*."""
    total = F.lit(0.0)
    for c in FEATURES:
        total = total + F.pow(F.col(f"r_{c}") - F.col(f"z_{c}"), 2)
    return rows.withColumn("step_error", total / len(FEATURES))


def reconstruction_scores(rows: DataFrame, length: int, top_share: float = 0.1, keys=("flight_id", "segment_id")) -> DataFrame:
    """Mean, worst and top-share mean of the valid step errors; 0 where no step is valid.

    rows are the first `length` steps of each segment with step_error and valid.
    """
    k = max(1, round(top_share * length))
    ok = F.when(F.col("valid"), F.col("step_error"))
    ranked = rows.withColumn("ok", ok).withColumn(
        "place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("ok").desc_nulls_last())))
    zero = F.lit(0.0)
    return ranked.groupBy(*keys).agg(
        F.coalesce(F.avg("ok"), zero).alias("score_mean"), F.coalesce(F.max("ok"), zero).alias("score_max"),
        F.coalesce(F.avg(F.when(F.col("place") <= k, F.col("ok"))), zero).alias("score_topk"), F.count("ok").alias("valid_steps"))


def feature_errors(rows: DataFrame, keys=("flight_id", "segment_id")) -> DataFrame:
    """Masked mean squared error per feature."""
    aggs = [F.coalesce(F.avg(F.when(F.col("valid"), F.pow(F.col(f"r_{c}") - F.col(f"z_{c}"), 2))), F.lit(0.0)).alias(f"e_{c}") for c in FEATURES]
    return rows.groupBy(*keys).agg(*aggs)


def covariance(rows: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) of the columns, folded to one row of sums about a first mean."""
    centre = np.array([float(x or 0.0) for x in rows.agg(*[F.avg(c) for c in columns]).first()])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    moved = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, centre)]
    sums = rows.agg(*[F.avg(moved[i] * moved[j]) for i, j in pairs]).first()
    out = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, sums):
        out[i, j] = out[j, i] = float(v or 0.0)
    return centre, out


def pca_reconstruction(train: DataFrame, rows: DataFrame, k: int = 3) -> DataFrame:
    """r_<feature>: each row projected on the k leading components of the train rows and back, about their mean."""
    centre, spread = covariance(train, [f"z_{c}" for c in FEATURES])
    basis = np.linalg.eigh(spread)[1][:, ::-1][:, :k]
    onto = basis @ basis.T
    rebuilt = {}
    for i, c in enumerate(FEATURES):
        value = F.lit(float(centre[i]))
        for j, other in enumerate(FEATURES):
            value = value + F.lit(float(onto[i, j])) * (F.col(f"z_{other}") - F.lit(float(centre[j])))
        rebuilt[f"r_{c}"] = value
    return rows.withColumns(rebuilt)


# ---- isolation forest -------------------------------------------------------------------------

def _average_path(n: float) -> float:
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def _draw(*parts) -> float:
    """What hash_uniform gives for the same parts."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


def _grow(x: np.ndarray, tree: int, seed: int, limit: int) -> list[dict]:
    """Nodes of a tree, numbered from 1 with children 2n and 2n + 1: feature −1 marks a leaf, path is its depth in the score."""
    nodes = []
    stack = [(np.arange(len(x)), 0, 1)]
    while stack:
        idx, depth, node = stack.pop()
        low, high = x[idx].min(axis=0), x[idx].max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(idx) <= 1 or not len(varied):
            nodes.append((node, -1, 0.0, depth + _average_path(len(idx))))
            continue
        f = int(varied[int(_draw(tree, node, seed, "feature") * len(varied))])
        cut = float(low[f] + _draw(tree, node, seed, "cut") * (high[f] - low[f]))
        cut = cut if cut < high[f] else float(low[f])
        nodes.append((node, f, cut, 0.0))
        stack += [(idx[x[idx, f] <= cut], depth + 1, 2 * node), (idx[x[idx, f] > cut], depth + 1, 2 * node + 1)]
    return [dict(zip(("node", "feature", "cut", "path"), n)) for n in sorted(nodes)]


def fit_forest(train: DataFrame, key: str = "segment_id", trees: int = 200, sample: int = 256, seed: int = 42) -> DataFrame:
    """One row per tree with its nodes. Each tree sees the `sample` rows of least hash; splits are drawn by hash of the node.

    So the forest does not depend on the engine or the order of rows. A row is offered to a tree if its hash is below
    a share that yields about three samples' worth, so only a fixed number of rows per tree is ever shuffled.
    """
    n = train.count()
    share = min(1.0, 3.0 * sample / max(n, 1))
    draw = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), hash_uniform(F.col(key).cast("string"), t.cast("string"), seed).alias("u")))
    offered = train.select("features", key, F.inline(F.filter(draw, lambda d: d["u"] < share)))
    chosen = offered.withColumn("rn", F.row_number().over(Window.partitionBy("tree").orderBy("u", key))).filter(F.col("rn") <= sample)

    def build(key_, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["features"].tolist(), dtype="float64")
        nodes = _grow(x, int(key_[0]), seed, int(math.ceil(math.log2(max(len(x), 2)))))
        return pd.DataFrame({"tree": [int(key_[0])], "n": [len(x)], "nodes": [nodes]})

    return chosen.select("tree", "features").groupBy("tree").applyInPandas(build, "tree int, n int, nodes array<struct<node:int, feature:int, cut:double, path:double>>")


def score_forest(rows: DataFrame, forest: DataFrame, key: str = "segment_id") -> DataFrame:
    """score in (0, 1], higher is more isolated. The forest is trees × at most 512 nodes."""
    grown = []
    for r in forest.orderBy("tree").collect():
        table = np.zeros((1 + max(x["node"] for x in r["nodes"]), 3))
        for x in r["nodes"]:
            table[x["node"]] = x["feature"], x["cut"], x["path"]
        grown.append((r["n"], table))
    shared = rows.sparkSession.sparkContext.broadcast(grown)

    def score(batches):
        for pdf in batches:
            x = np.array(pdf["features"].tolist(), dtype="float64").reshape(len(pdf), -1)
            depth = np.zeros(len(x))
            scale = 0.0
            for n, t in shared.value:
                at = np.ones(len(x), dtype="int64")
                live = np.flatnonzero(t[at, 0] >= 0)
                while len(live):
                    node = t[at[live]]
                    at[live] = 2 * at[live] + (x[live, node[:, 0].astype("int64")] > node[:, 1])
                    live = live[t[at[live], 0] >= 0]
                depth += t[at, 2]
                scale += _average_path(n)
            yield pd.DataFrame({key: pdf[key], "score": np.power(2.0, -depth / max(scale, 1e-12))})

    return rows.select(key, "features").mapInPandas(score, f"{key} {dict(rows.dtypes)[key]}, score double")


def isolation_forest(train: DataFrame, rows: DataFrame, key: str = "segment_id", trees: int = 200, seed: int = 42) -> DataFrame:
    return score_forest(rows, fit_forest(train, key, trees, seed=seed), key)


# ---- nearest neighbours -----------------------------------------------------------------------

def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype="float64").reshape(len(column), -1)


def knn_score(train: DataFrame, rows: DataFrame, key: str = "segment_id", k: int = 5, **tree) -> DataFrame:
    """Exact distance to the k-th nearest train vector, over a pivot tree that grows with the train rows."""
    return pivot_tree.nearest(train, rows, key, k, **tree).select(key, "score")


def _nearest_positions(asked: DataFrame, points: DataFrame, k: int, edge: float, block_rows: int) -> DataFrame:
    """(z_lat, z_lon, d, found): distance to the k-th nearest point in the nine cells around each asked position."""
    def cell(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(edge)).cast("long")

    placed = points.withColumns({"x": cell("z_lat"), "y": cell("z_lon")})
    filled = placed.groupBy("x", "y").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    near = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda n: F.struct((cell("z_lat") + F.floor(n / 3) - 1).alias("x"), (cell("z_lon") + n % 3 - 1).alias("y")))
    around = asked.select("z_lat", "z_lon", F.inline(near)).join(filled, ["x", "y"])
    crowds = around.groupBy("x", "y").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("salts"))
    here = F.xxhash64("z_lat", "z_lon")
    ask = around.join(crowds, ["x", "y"]).withColumn("salt", F.pmod(here, F.col("salts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    have = placed.join(filled, ["x", "y"]).join(crowds, ["x", "y"]).withColumn("block", F.pmod(F.xxhash64("z_lat", "z_lon", "copy"), F.col("blocks")).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    def compare(_, a: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(t):
            return pd.DataFrame({c: pd.Series(dtype="float64") for c in ("z_lat", "z_lon", "d")})
        x, y = a[["z_lat", "z_lon"]].to_numpy("float64"), t[["z_lat", "z_lon"]].to_numpy("float64")
        m = min(k, len(y))
        best = np.vstack([np.partition(np.sqrt(((x[s:s + 64, None, :] - y[None]) ** 2).sum(axis=2)), m - 1, axis=1)[:, :m] for s in range(0, len(x), 64)])
        return pd.DataFrame({"z_lat": np.repeat(x[:, 0], m), "z_lon": np.repeat(x[:, 1], m), "d": best.ravel()})

    ids = ["x", "y", "block", "salt"]
    met = ask.select(*ids, "z_lat", "z_lon").groupBy(*ids).cogroup(have.select(*ids, "z_lat", "z_lon").groupBy(*ids)).applyInPandas(compare, "z_lat double, z_lon double, d double")
    ranked = met.withColumn("rn", F.row_number().over(Window.partitionBy("z_lat", "z_lon").orderBy("d"))).filter(F.col("rn") <= k)
    return ranked.groupBy("z_lat", "z_lon").agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("found"))


def position_knn(train: DataFrame, rows: DataFrame, k: int = 5, keys=("flight_id", "segment_id"), per_cell: int = 64, block_rows: int = 20_000) -> DataFrame:
    """Mean over valid rows of the exact distance to the k-th nearest train position.

    Train positions are folded (k copies of one suffice) and laid on a grid. A position whose k-th distance within
    the nine cells around it is at most one cell edge is done; the others go on with cells four times as wide,
    until the nine cells hold everything. Cells are joined by their numbers, crowded ones in blocks.
    """
    folded = train.filter("valid").groupBy("z_lat", "z_lon").agg(F.count(F.lit(1)).alias("n"))
    points = materialize(folded.select("z_lat", "z_lon", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy")), "points")
    asked = materialize(rows.filter("valid").select("z_lat", "z_lon").distinct(), "asked")
    span = points.select("z_lat", "z_lon").unionByName(asked).agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("z_lat", "z_lon")]).first()
    count = points.count()
    done = []
    if count and span.min_z_lat is not None:
        sides = [max(span[f"max_{c}"] - span[f"min_{c}"], 1e-9) for c in ("z_lat", "z_lon")]
        edge = max(math.sqrt(sides[0] * sides[1] * per_cell / count), max(sides) / 1e6)
        while True:
            last = edge >= max(sides)
            found = materialize(_nearest_positions(asked, points, k, edge, block_rows), "nearest")
            sure = found if last else found.filter((F.col("found") >= k) & (F.col("d") <= edge))
            done.append(sure.select("z_lat", "z_lon", "d"))
            if last:
                break
            asked = materialize(asked.join(sure, ["z_lat", "z_lon"], "left_anti"), "asked")
            if asked.isEmpty():
                break
            edge *= 4
    every = rows.select(*keys).distinct()
    if not done:
        return every.withColumn("score", F.lit(0.0))
    nearest = done[0]
    for part in done[1:]:
        nearest = nearest.unionByName(part)
    scored = rows.filter("valid").join(nearest, ["z_lat", "z_lon"]).groupBy(*keys).agg(F.avg("d").alias("score"))
    return every.join(scored, list(keys), "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


# ---- Gaussian mixture -------------------------------------------------------------------------

def _responsibilities(rows: DataFrame, weight: np.ndarray, mean: np.ndarray, var: np.ndarray) -> DataFrame:
    """Add whole, the log density of the mixture, and resp, the share of each component in it, by log-sum-exp."""
    const = np.log(weight) - 0.5 * np.log(2 * np.pi * var).sum(axis=1)

    def numbers(values) -> str:
        return "array(" + ", ".join(f"{float(a)!r}D" for a in values) + ")"

    # a folded literal: no join, and the same generated code in every pass
    state = F.expr("array(" + ", ".join(f"named_struct('k', {float(c)!r}D, 'm', {numbers(m)}, 'v', {numbers(v)})" for c, m, v in zip(const, mean, var)) + ")")

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda a, b: a + b)

    def log_density(c: Column) -> Column:
        gaps = F.zip_with("features", c["m"], lambda x, m: (x - m) * (x - m))
        return c["k"] - total(F.zip_with(gaps, c["v"], lambda g, v: g / v)) / 2

    logs = rows.withColumn("logs", F.transform(state, log_density)).withColumn("top", F.array_max("logs"))
    whole = F.col("top") + F.log(total(F.transform("logs", lambda x: F.exp(x - F.col("top")))))
    return logs.withColumn("whole", whole).withColumn("resp", F.transform("logs", lambda x: F.exp(x - F.col("whole")))).drop("logs", "top")


def fit_gmm(train: DataFrame, key: str = "segment_id", components: int = 8, iterations: int = 200, seed: int = 42, floor: float = 1e-6, tolerance: float = 1e-3):
    """Diagonal mixture by expectation-maximisation; a pass is one grouped sum over (component, dimension).

    Starts from the rows of least hash. Stops when the mean log likelihood changes by less than `tolerance`; a
    warning says if it never does.
    """
    start = train.select("features", key, hash_uniform(F.col(key), seed, "gmm").alias("u")).orderBy("u", key).limit(components).toPandas()
    mean = _matrix(start["features"])
    dims = mean.shape[1]
    spread = train.agg(*[F.var_pop(F.col("features")[i]).alias(f"v{i}") for i in range(dims)]).first()
    var = np.tile(np.maximum(np.array([float(v or 0.0) for v in spread]), floor), (len(mean), 1))
    weight = np.full(len(mean), 1.0 / len(mean))
    vectors = materialize(train.select(F.col("features").cast("array<double>").alias("features")), "gmm")
    last = None
    for _ in range(iterations):
        shares = _responsibilities(vectors, weight, mean, var).select("features", "whole", F.posexplode("resp").alias("c", "r"))
        cells = shares.select("c", "r", "whole", F.posexplode("features").alias("i", "x")).groupBy("c", "i").agg(
            F.sum("r").alias("n"), F.sum(F.col("r") * F.col("x")).alias("sx"), F.sum(F.col("r") * F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("r") * F.col("whole")).alias("ll")).toPandas()
        table = np.zeros((4, len(mean), dims))  # components × dimensions numbers
        for k, c in enumerate(("n", "sx", "sxx", "ll")):
            table[k, cells["c"], cells["i"]] = cells[c]
        n, sx, sxx, whole = table
        likelihood = whole[:, 0].sum() / max(n[:, 0].sum(), 1e-9)
        mass = np.maximum(n[:, :1], 1e-9)
        weight, mean = (mass / mass.sum())[:, 0], sx / mass
        var = np.maximum(sxx / mass - mean ** 2, floor)
        if last is not None and abs(likelihood - last) < tolerance:
            break
        last = likelihood
    else:
        warnings.warn(f"the mixture did not converge in {iterations} passes", stacklevel=2)
    return weight, mean, var


def gmm_score(train: DataFrame, rows: DataFrame, key: str = "segment_id", components: int = 8, seed: int = 42) -> DataFrame:
    """Minus the log density under the mixture fitted on train."""
    slim = rows.select(key, F.col("features").cast("array<double>").alias("features"))
    return _responsibilities(slim, *fit_gmm(train, key, components, seed=seed)).select(key, (-F.col("whole")).alias("score"))
