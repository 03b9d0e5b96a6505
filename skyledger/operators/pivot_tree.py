"""Exact k-th nearest neighbours over a pivot tree.

Train vectors are folded to distinct ones (k copies suffice) and dealt level by level: every node above `leaf_rows`
gets pivots of its own, rows go to the nearest one, and each child keeps the least and largest distance of its rows
to every pivot of the node. So leaves stay small and their number grows with the train rows. A query first descends to one leaf, which
bounds its k-th distance, and then descends again to every child that the bound does not rule out.

Rows meet pivots and leaves by their node in groups of bounded size: a node's rows are salted, and the few rows
that they meet are copied to the salts. The driver sees one flag per level.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.session import materialize

ROWS = "id {kind}, features array<double>, node long"
ASKED = ["id", "features", "node", "bound"]
MARGIN = 1e-9


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype="float64").reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances by differences, not by products: equal vectors are exactly 0 apart."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 22) // max(1, b.size))
    for s in range(0, len(a), step):
        out[s:s + step] = np.sqrt(((a[s:s + step, None, :] - b[None]) ** 2).sum(axis=2))
    return out


def _meet(left: DataFrame, right: DataFrame, work, schema: str, group_rows: int) -> DataFrame:
    """work(node, left rows, right rows) per node; a node's left rows are salted, its right rows copied to the salts."""
    salts = left.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / group_rows).cast("int").alias("salts"))
    ask = left.join(salts, "node").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts")
    have = right.join(salts, "node").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    ids = ["node", "salt"]

    def compare(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return work(int(key[0]), a, b)

    return ask.groupBy(*ids).cogroup(have.groupBy(*ids)).applyInPandas(compare, schema)


class Tree:
    """levels[i]: (node, child, pivot, lows, highs) of the nodes split at depth i; leaves: train rows by node."""

    def __init__(self, levels: list[DataFrame], leaves: DataFrame):
        self.levels, self.leaves = levels, leaves


def build(train: DataFrame, key: str, k: int, fanout: int = 32, leaf_rows: int = 256, group_rows: int = 4_000) -> Tree:
    """Split nodes until none holds more than `leaf_rows` distinct vectors. Children of node n are n·fanout + 1, 2, …"""
    folded = train.groupBy(F.col("features").cast("array<double>").alias("features")).agg(F.min(key).alias("id"), F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
    rows = materialize(folded.withColumns({"node": F.lit(0).cast("long"), "d": F.lit(float("inf"))}), "tree")
    kind = dict(rows.dtypes)["id"]
    leaves, levels = [], []

    def deal(node, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({c: pd.Series(dtype="object") for c in ("id", "features", "node", "copies", "d", "lows", "highs")})
        b = b.sort_values("child")
        d = distances(matrix(a["features"]), matrix(b["pivot"]))
        nearest = d.argmin(axis=1)
        lows, highs = np.full(len(a), None), np.full(len(a), None)
        for c in np.unique(nearest):  # the first row of a child states the reach of all of them
            own = np.flatnonzero(nearest == c)
            lows[own[0]], highs[own[0]] = d[own].min(axis=0), d[own].max(axis=0)
        return pd.DataFrame({"id": a["id"], "features": a["features"], "node": b["child"].to_numpy()[nearest], "copies": a["copies"], "d": d[np.arange(len(a)), nearest], "lows": lows, "highs": highs})

    while True:
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far"))
        open_nodes = sizes.filter((F.col("n") > leaf_rows) & (F.col("far") > 0)).select("node", F.least(F.lit(fanout), F.ceil(2 * F.col("n") / leaf_rows)).alias("ways"))
        leaves.append(rows.join(open_nodes, "node", "left_anti").select("id", "features", "node", "copies"))
        if open_nodes.isEmpty():
            return Tree(levels, materialize(_union(leaves), "leaves"))
        # one pivot from each of up to `fanout` hash classes of a node; a class without rows gives none
        split = rows.join(open_nodes, "node").withColumn("class", F.pmod(F.xxhash64("id", F.lit(len(levels))), F.col("ways"))).drop("ways")
        chosen = split.groupBy("node", "class").agg(F.min_by("features", F.xxhash64("id", F.lit(-1))).alias("pivot"))
        pivots = materialize(chosen.withColumn("child", F.col("node") * fanout + F.col("class") + 1).select("node", "child", "pivot"), "pivots")
        rows = materialize(_meet(split.drop("class"), pivots, deal, ROWS.format(kind=kind) + ", copies int, d double, lows array<double>, highs array<double>", group_rows), "tree")
        reach = rows.filter("lows IS NOT NULL").select(F.col("node").alias("child"), F.posexplode(F.arrays_zip("lows", "highs")).alias("place", "r"))
        reach = reach.groupBy("child", "place").agg(F.min("r.lows").alias("low"), F.max("r.highs").alias("high"))
        reach = reach.groupBy("child").agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("r"))  # `fanout` entries
        levels.append(materialize(pivots.join(reach, "child", "left").select("node", "child", "pivot", F.col("r.low").alias("lows"), F.col("r.high").alias("highs")), "pivots"))
        rows = rows.drop("lows", "highs")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _descend(asked: DataFrame, tree: Tree, kind: str, k: int, everywhere: bool, group_rows: int) -> DataFrame:
    """(id, features, node, bound) at leaves: the nearest leaf of each query, or every leaf within its bound.

    Pivots are train vectors, so the k-th nearest of a node's pivots bounds the result as well.
    """
    def turn(node, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({c: pd.Series(dtype="object") for c in ASKED})
        if not len(b):
            return a[ASKED]  # a leaf
        b = b.sort_values("child")
        d = distances(matrix(a["features"]), matrix(b["pivot"]))
        least = np.full(d.shape, np.inf)  # the distance of a child's rows at least
        for c, (low, high) in enumerate(zip(b["lows"], b["highs"], strict=True)):
            if low is not None:
                least[:, c] = np.maximum(d - np.asarray(high), np.asarray(low) - d).max(axis=1)
        bound = a["bound"].to_numpy("float64")
        if d.shape[1] >= k:
            bound = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1])
        if everywhere:
            i, c = np.nonzero(least <= bound[:, None] + MARGIN)
        else:
            i, c = np.arange(len(a)), np.where(np.isfinite(least), d, np.inf).argmin(axis=1)
        return a[ASKED].iloc[i].assign(node=b["child"].to_numpy()[c], bound=bound[i])

    for level in tree.levels:
        asked = materialize(_meet(asked, level, turn, ROWS.format(kind=kind) + ", bound double", group_rows), "asked")
    return asked


def nearest(train: DataFrame, rows: DataFrame, key: str = "segment_id", k: int = 5, fanout: int = 32, leaf_rows: int = 256, group_rows: int = 4_000) -> DataFrame:
    """(key, score, compared): exact distance to the k-th nearest train vector (the farthest one if there are fewer),
    and the number of distinct vectors compared. Rows get no result without train vectors; keys of rows are unique
    and vectors finite.
    """
    tree = build(train, key, k, fanout, leaf_rows, group_rows)
    kind = dict(rows.dtypes)[key]
    queries = materialize(rows.select(F.col(key).alias("id"), F.col("features").cast("array<double>").alias("features"), F.lit(0).cast("long").alias("node"), F.lit(float("inf")).alias("bound")), "asked")

    def compare(node, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": pd.Series(dtype="object"), "best": pd.Series(dtype="object"), "compared": pd.Series(dtype="int64")})
        d = np.repeat(distances(matrix(a["features"]), matrix(b["features"])), b["copies"].to_numpy(), axis=1)
        best = np.sort(np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k], axis=1)
        return pd.DataFrame({"id": a["id"].to_numpy(), "best": list(best), "compared": len(b)})

    found = f"id {kind}, best array<double>, compared long"
    first = _descend(queries, tree, kind, k, False, group_rows)
    home = materialize(_meet(first, tree.leaves, compare, found, group_rows), "found")
    met = home
    if tree.levels:
        reached = home.filter(F.size("best") >= k).select("id", F.element_at("best", k).alias("reached"))
        known = first.select("id", F.col("node").alias("home"), "bound").join(reached, "id", "left").select("id", "home", F.least("bound", "reached").alias("bound"))
        further = _descend(queries.drop("bound").join(known, "id").select(*ASKED), tree, kind, k, True, group_rows)
        met = home.unionByName(_meet(further.join(known.select("id", "home"), "id").filter("node <> home"), tree.leaves, compare, found, group_rows))
    met = materialize(met, "found")
    near = met.select("id", F.explode("best").alias("d")).withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("d"))).filter(F.col("rn") <= k)
    work = met.groupBy("id").agg(F.sum("compared").alias("compared"))
    return near.groupBy("id").agg(F.max("d").alias("score")).join(work, "id").select(F.col("id").alias(key), "score", "compared")
