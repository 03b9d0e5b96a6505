"""Near-duplicate vectors by NN-descent.

1. Start: random hyperplanes cut the vectors of a label into cells, several times over; in a cell, vectors in
   order along one more direction are compared in blocks and each keeps its best neighbours.
2. Descent: the neighbours of a vector, both ways, are compared with each other (a join of the graph with itself
   through the vector in the middle); better neighbours enter the lists. Rounds go on while new links appear.
3. Saturated lists: equal vectors are folded to one before the start. Where a list is still full of links, the vectors
   of its label start and descend again with lists of vectors outside their own component, so a group of near copies
   cannot hide its neighbours; links found merge components, until none is found.
4. Audit: vectors chosen by hash (a bounded number) are compared with all; below the wanted recall all starts again
   with longer lists and new planes. If recall stays below the floor, the operator fails instead of answering.
5. Links at the threshold join vectors to components, and the links of a component are counted exactly among its
   members: small components at once; in large ones, members within half the threshold angle of the centroid are
   all linked with each other and counted by number, the others are compared with all members block by block. No
   pair is ever written. A link that the descent misses altogether is missing in both.

A vector is left alone (no links, its own component) if it or its label is null, it is zero, or it has a null
or non-finite component. Vectors of different lengths do not link. Rows equal in id and content are one vector.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.fragments import FRAGMENT, count_fragments
from skyledger.llm.graph import components
from skyledger.llm.numbered import with_uid
from skyledger.session import materialize

NEIGHBOURS = 12
TREES = 8
CELL = 64
BLOCK = 256
SALTED = 4096
AUDIT = 1024
MARGIN = 1e-5  # single precision is sure beyond this


def usable(vectors: DataFrame) -> DataFrame:
    """(uid, grp, vec): vectors that can link, at length 1, as bytes of doubles. grp stands for label and dimension."""
    ok = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    slim = vectors.filter(ok).select("uid", F.xxhash64("label", F.size("embedding")).alias("grp"), F.col("embedding").cast("array<double>").alias("x")).dropDuplicates(["uid"])

    def run(batches):
        for batch in batches:
            x = batch.column("x")
            flat, cuts = x.flatten().to_numpy(zero_copy_only=False), np.diff(np.asarray(x.offsets))
            out = []
            for v in np.split(flat, np.cumsum(cuts)[:-1]) if len(cuts) else []:
                top = np.abs(v).max()
                v = v / top if top > 0 else v
                out.append((v / math.sqrt(float(v @ v))).tobytes() if top > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("grp"), pa.array(out, pa.binary())], names=["uid", "grp", "vec"])

    return slim.mapInArrow(run, "uid long, grp long, vec binary").filter("vec IS NOT NULL")


def matrix(column, kind=np.float64) -> np.ndarray:
    """The vectors of a column; all have one length."""
    raw = column.to_pylist() if hasattr(column, "to_pylist") else column
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1).astype(kind, copy=False)


def top(sims: np.ndarray, ids: np.ndarray, comp: np.ndarray, k: int, rows: list) -> None:
    """Append the k best of every row of a square matrix, outside the row's own component, as (v, u, sim)."""
    sims[comp[:, None] == comp[None, :]] = -2
    k = min(k, len(ids) - 1)
    if k < 1:
        return
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    found = np.take_along_axis(sims, best, axis=1).ravel()
    own = found > -2
    rows.append((np.repeat(ids, k)[own], ids[best.ravel()][own], found[own]))


def edges_table(rows: list) -> pa.Table:
    cols = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2].astype(np.float64))], names=["v", "u", "sim"])


def groups(keys: list[np.ndarray]):
    """Indices of the rows of each combination of keys."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return
    new = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    yield from np.split(order, np.flatnonzero(new) + 1)


def best_lists(edges: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
    return edges.groupBy("v", "u").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def first_lists(stored: DataFrame, k: int, trees: int = TREES, seed: int = 11) -> DataFrame:
    """Neighbours from cells of random hyperplanes, outside the component `comp` of each vector."""
    spark = stored.sparkSession
    biggest = stored.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n or 0
    bits = max(0, min(30, round(math.log2(max(1, biggest / CELL)))))
    n = count_fragments(spark)

    def cells(batches):
        for batch in batches:
            raw = batch.column("vec").to_pylist()
            uid, grp, comp = (batch.column(c).to_numpy() for c in ("uid", "grp", "comp"))
            sizes = np.array([len(x) for x in raw])
            for size in set(sizes.tolist()):
                at = np.flatnonzero(sizes == size)
                x = matrix([raw[i] for i in at])
                for tree in range(trees):
                    planes = np.random.default_rng([seed, tree, size]).standard_normal((size // 8, bits + 1))
                    side = x @ planes
                    code = (side[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(at), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(grp[at]), pa.array(np.full(len(at), tree, np.int32)), pa.array(code.astype(np.int64)), pa.array(side[:, bits]), pa.array(uid[at]), pa.array(comp[at]), pa.array([x[i].astype(np.float32).tobytes() for i in range(len(at))], pa.binary())],
                                                     names=["grp", "tree", "code", "along", "uid", "comp", "vec"])

    shape = "grp long, tree int, code long, along double, uid long, comp long, vec binary"
    rows = stored.mapInArrow(cells, shape)
    # cells above SALTED vectors are dealt to several tasks
    crowded = stored.mapInArrow(cells, shape).groupBy("grp", "tree", "code").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SALTED)
    rows = rows.join(crowded, ["grp", "tree", "code"], "left")
    rows = rows.withColumn("salt", F.pmod(F.hash("uid", "tree"), F.coalesce(F.ceil(F.col("n") / SALTED), F.lit(1)).cast("int"))).drop("n")
    rows = rows.withColumn(FRAGMENT, F.pmod(F.xxhash64("grp", "tree", "code", "salt"), F.lit(n)).cast("int"))

    def compare(table):
        out: list = []
        cols = [table.column(c).to_numpy() for c in ("grp", "tree", "code", "salt", "along", "uid", "comp")]
        raw = table.column("vec").to_pylist()
        for index in groups(cols[:4]):
            index = index[np.argsort(cols[4][index], kind="stable")]
            for a in range(0, len(index), BLOCK):
                block = index[a:a + BLOCK]
                x = np.frombuffer(b"".join(raw[i] for i in block), np.float32).reshape(len(block), -1)
                top(x @ x.T, cols[5][block], cols[6][block], k, out)
        return edges_table(out)

    return best_lists(rows.groupBy(FRAGMENT).applyInArrow(compare, "v long, u long, sim double"), k)


def descend(lists: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """One round: compare the neighbours of every vector with each other, keep the k best of each."""
    n = count_fragments(stored.sparkSession)
    floors = lists.groupBy("v").agg(F.min("sim").alias("floor"), F.count(F.lit(1)).alias("n")).select("v", F.when(F.col("n") >= k, F.col("floor")).otherwise(-2.0).alias("floor"))
    # of a vector in many lists about k are followed back, chosen by hash; the lists themselves stay whole
    back = lists.join(lists.groupBy("u").agg(F.count(F.lit(1)).alias("in")), "u").filter(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 20)) < F.lit(1 << 20) * k / F.col("in"))
    around = lists.select(F.col("v").alias("mid"), F.col("u").alias("uid")).unionByName(back.select(F.col("u").alias("mid"), F.col("v").alias("uid"))).unionByName(lists.select(F.col("v").alias("mid"), F.col("v").alias("uid"))).distinct()
    known = stored.select("uid", "comp", "vec").join(floors.withColumnRenamed("v", "uid"), "uid", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))

    def single(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("comp"), b.column("floor"), pa.array([np.frombuffer(x, np.float64).astype(np.float32).tobytes() for x in b.column("vec").to_pylist()], pa.binary())], names=["uid", "comp", "floor", "vec"])

    known = known.select("uid", "comp", "floor", "vec").mapInArrow(single, "uid long, comp long, floor double, vec binary")
    rows = around.join(known, "uid").withColumn(FRAGMENT, F.pmod(F.xxhash64("mid"), F.lit(n)).cast("int"))

    def compare(table):
        out: list = []
        mid, uid, comp, floor = (table.column(c).to_numpy() for c in ("mid", "uid", "comp", "floor"))
        raw = table.column("vec").to_pylist()
        for index in groups([mid]):
            x = np.frombuffer(b"".join(raw[i] for i in index), np.float32).reshape(len(index), -1)
            sims = x @ x.T
            sims[comp[index][:, None] == comp[index][None, :]] = -2
            i, j = np.nonzero(sims > np.maximum(floor[index], -2)[:, None])
            out.append((uid[index][i], uid[index][j], sims[i, j]))
        return edges_table(out)

    better = rows.groupBy(FRAGMENT).applyInArrow(compare, "v long, u long, sim double")
    return best_lists(lists.unionByName(better), k)


def links_at(lists: DataFrame, stored: DataFrame, threshold: float) -> DataFrame:
    """(a, b) at the threshold in double precision: sure ones as they are, close ones computed again."""
    pairs = lists.select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b"), "sim").filter(F.col("sim") >= threshold - MARGIN).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    pairs = materialize(pairs, "close")
    close = pairs.filter(F.col("sim") < threshold + MARGIN).select("a", "b")
    x, y = stored.select(F.col("uid").alias("a"), F.col("vec").alias("va")), stored.select(F.col("uid").alias("b"), F.col("vec").alias("vb"))

    def exact(batches):
        for b in batches:
            keep = (matrix(b.column("va")) * matrix(b.column("vb"))).sum(axis=1) >= threshold if b.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], names=["a", "b"])

    again = close.join(x, "a").join(y, "b").select("a", "b", "va", "vb").mapInArrow(exact, "a long, b long")
    return pairs.filter(F.col("sim") >= threshold + MARGIN).select("a", "b").unionByName(again)


def counted(members: DataFrame, threshold: float, limit: int = 2048) -> DataFrame:
    """(uid, n_links) from (uid, component, vec): exact numbers of links inside each component."""
    n = count_fragments(members.sparkSession)
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    rows = materialize(members.join(sizes, "component"), "members")
    angle = math.acos(threshold)

    def whole(table):
        uid, comp = table.column("uid").to_numpy(), table.column("component").to_numpy()
        raw = table.column("vec").to_pylist()
        ids, links = [], []
        for index in groups([comp]):
            x = matrix([raw[i] for i in index])
            sims = x @ x.T
            np.fill_diagonal(sims, -2)
            ids.append(uid[index])
            links.append((sims >= threshold).sum(axis=1))
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *ids])), pa.array(np.concatenate([np.zeros(0, np.int64), *links]).astype(np.int64))], names=["uid", "n_links"])

    small = rows.filter(F.col("size") <= limit).withColumn(FRAGMENT, F.pmod(F.xxhash64("component"), F.lit(n)).cast("int"))
    done = small.select("uid", "component", "vec", FRAGMENT).groupBy(FRAGMENT).applyInArrow(whole, "uid long, n_links long")
    large = rows.filter(F.col("size") > limit)
    if large.isEmpty():
        return done

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for comp, raw in zip(b.column("component").to_pylist(), b.column("vec").to_pylist(), strict=True):
                v = np.frombuffer(raw, np.float64)
                total[comp] = total[comp] + v if comp in total else v.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["component", "total"])

    parts = large.select("component", "vec").mapInArrow(sums, "component long, total array<double>").select("component", F.posexplode("total"))
    centre = parts.groupBy("component", "pos").agg(F.sum("col").alias("x")).groupBy("component").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c")).select("component", F.col("c.x").alias("centre"))

    def measure(batches):
        for b in batches:
            x = matrix(b.column("vec")) if b.num_rows else np.zeros((0, 1))
            c = np.stack(b.column("centre").to_pylist()) if b.num_rows else np.zeros((0, 1))
            cosine = (x * c).sum(axis=1) / np.maximum(np.sqrt((c * c).sum(axis=1)), 1e-300)
            core = np.arccos(np.clip(cosine, -1, 1)) <= angle / 2 - 1e-6
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("component"), b.column("size"), pa.array(core), b.column("vec")], names=["uid", "component", "size", "core", "vec"])

    placed = materialize(large.join(centre, "component").select("uid", "component", "size", "vec", "centre").mapInArrow(measure, "uid long, component long, size long, core boolean, vec binary"), "placed")
    cores = placed.groupBy("component").agg(F.sum(F.col("core").cast("long")).alias("n_core"), F.sum((~F.col("core")).cast("long")).alias("n_rest"))
    by_number = placed.filter("core").join(cores, "component").select("uid", (F.col("n_core") - 1).alias("n_links"))
    wide = placed.join(cores, "component").withColumn("blocks", F.ceil(F.col("size") / limit).cast("int")).withColumn("rests", F.ceil(F.col("n_rest") / limit).cast("int"))
    # every block of the rest meets every block of members; the rest counts all of them, the core counts the rest
    rest = wide.filter("NOT core").withColumn("j", F.pmod(F.hash("uid"), F.col("rests"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(True))
    every = wide.filter("rests > 0").withColumn("i", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).withColumn("side", F.lit(False))
    meet = rest.unionByName(every).select("component", "i", "j", "side", "uid", "core", "vec")

    def blocks(table):
        side = table.column("side").to_numpy(zero_copy_only=False).astype(bool)
        uid, core = table.column("uid").to_numpy(), table.column("core").to_numpy(zero_copy_only=False).astype(bool)
        raw = table.column("vec").to_pylist()
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(a) or not len(b):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64())], names=["uid", "n_links"])
        linked = matrix([raw[i] for i in a]) @ matrix([raw[i] for i in b]).T >= threshold
        linked &= uid[a][:, None] != uid[b][None, :]
        return pa.table([pa.array(np.concatenate([uid[a], uid[b][core[b]]])), pa.array(np.concatenate([linked.sum(axis=1), linked.sum(axis=0)[core[b]]]).astype(np.int64))], names=["uid", "n_links"])

    met = meet.groupBy("component", "i", "j").applyInArrow(blocks, "uid long, n_links long")
    return done.unionByName(by_number.unionByName(met).groupBy("uid").agg(F.sum("n_links").alias("n_links")))


def recall(stored: DataFrame, links: DataFrame, threshold: float, audited: int = AUDIT) -> float:
    """Share of the true links of `audited` vectors, chosen by hash, whose ends are in one component of the links."""
    sample = stored.orderBy(F.xxhash64("uid", F.lit(3)), "uid").limit(audited).toPandas()  # a bounded number of vectors
    if sample.empty:
        return 1.0
    by_group = {g: (s.uid.to_numpy(), np.frombuffer(b"".join(s.vec), np.float64).reshape(len(s), -1)) for g, s in sample.groupby("grp")}
    shared = stored.sparkSession.sparkContext.broadcast(by_group)

    def run(batches):
        for b in batches:
            grp, uid, raw = b.column("grp").to_numpy(), b.column("uid").to_numpy(), b.column("vec").to_pylist()
            a, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for index in groups([grp]):
                if (own := shared.value.get(grp[index[0]])) is not None:
                    i, j = np.nonzero(matrix([raw[t] for t in index]) @ own[1].T >= threshold)
                    a.append(uid[index][i])
                    c.append(own[0][j])
            a, c = np.concatenate(a), np.concatenate(c)
            yield pa.RecordBatch.from_arrays([pa.array(a[a != c]), pa.array(c[a != c])], names=["a", "b"])

    true = stored.mapInArrow(run, "a long, b long")
    x, y = links.withColumnRenamed("node", "a").withColumnRenamed("component", "ca"), links.withColumnRenamed("node", "b").withColumnRenamed("component", "cb")
    got = true.join(x, "a", "left").join(y, "b", "left").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ca") == F.col("cb"), 1)).alias("hit")).first()
    return got.hit / got.n if got.n else 1.0


def descended(stored: DataFrame, k: int, rounds: int, threshold: float, seed: int) -> DataFrame:
    """Lists of the k best neighbours outside each vector's component, refined until links stop appearing."""
    lists = materialize(first_lists(stored, k, seed=seed), "lists")
    linked = lists.filter(F.col("sim") >= threshold).count()
    for _ in range(rounds):
        lists = materialize(descend(lists, stored, k), "lists")
        before, linked = linked, lists.filter(F.col("sim") >= threshold).count()
        if linked <= before * 1.001:
            break
    return lists


def saturated(lists: DataFrame, k: int, threshold: float) -> DataFrame:
    """(uid): vectors whose list is full of links, so that it may hide others."""
    return lists.groupBy(F.col("v").alias("uid")).agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("last")).filter((F.col("n") >= k) & (F.col("last") >= threshold - MARGIN)).select("uid")


def merged(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, component) after links between components, given by their vectors."""
    own = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    other = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    edges = pairs.join(own, "a", "left").join(other, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(edges)
    named = joined.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    old = labels.join(named, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    return materialize(old.unionByName(joined.join(labels.select("node"), "node", "left_anti")), "components")


def linked_components(stored: DataFrame, k: int, rounds: int, threshold: float, seed: int) -> DataFrame:
    """(node, component) of the vectors with a link."""
    lists = descended(stored.withColumn("comp", F.col("uid")), k, rounds, threshold, seed)
    labels = materialize(components(links_at(lists, stored, threshold)), "components")
    while True:
        full = materialize(saturated(lists, k, threshold), "saturated")
        if full.isEmpty():
            return labels
        some = stored.join(stored.join(full, "uid", "left_semi").select("grp").distinct(), "grp", "left_semi")
        some = materialize(some.join(labels.withColumnsRenamed({"node": "uid", "component": "comp"}), "uid", "left").withColumn("comp", F.coalesce("comp", "uid")), "outside")
        seed += 1
        lists = descended(some, k, rounds, threshold, seed)
        pairs = materialize(links_at(lists, some, threshold), "links")
        if pairs.isEmpty():
            return labels
        labels = merged(labels, pairs)  # fewer components each time


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, k: int = NEIGHBOURS, rounds: int = 4, wanted: float = 0.95, floor: float = 0.9,
                    id_col: str = "vec_id", limit: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Fails if the audited recall stays below `floor` in spite of longer lists.
    """
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), "embedding", "label")
    content = F.concat_ws(";", F.coalesce(F.col("label").cast("string"), F.lit("-")), F.coalesce(F.col("embedding").cast("string"), F.lit("-")))
    keyed = with_uid(slim, "vec_id", content)
    stored = materialize(usable(keyed), "vectors")
    folded = materialize(stored.groupBy("grp", "vec").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("copies")), "folded")
    twins = stored.join(folded.select("grp", "vec", F.col("uid").alias("rep"), "copies"), ["grp", "vec"]).select("uid", "rep", "copies")
    twins = materialize(twins, "twins")
    for attempt in range(3):
        labels = linked_components(folded.drop("copies"), k, rounds, threshold, 11 + 1000 * attempt)
        every = twins.join(labels.withColumnRenamed("node", "rep"), "rep", "left").filter("component IS NOT NULL OR copies > 1")
        every = materialize(every.select(F.col("uid").alias("node"), F.coalesce("component", "rep").alias("component")), "components")
        found_share = recall(stored, every, threshold)
        if found_share >= wanted:
            break
        k *= 2
    if found_share < floor:
        raise RuntimeError(f"recall {found_share:.3f} of audited links is below {floor}")
    labels = every.withColumnRenamed("node", "uid")
    found = counted(stored.select("uid", "vec").join(labels, "uid").select("uid", "component", "vec"), threshold, limit)
    result = keyed.select("vec_id", "uid").join(found, "uid", "left").join(labels, "uid", "left")
    names = keyed.select(F.col("uid").alias("component"), F.col("vec_id").alias("name")).distinct()
    result = result.join(names, "component", "left").withColumn("component_id", F.coalesce("name", "vec_id"))
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
