"""N-gram Jaccard self-join by vertical partitioning.

The set of a document holds its distinct runs of `size` words, as 64-bit hashes. Documents with equal sets form
one class; a class is compared once.

1. A sketch of counters over all documents gives the global order of n-grams: rare ones first, then by hash. Its
   size is fixed and it only sets the order, so what it confuses costs time but loses nothing.
2. Classes with a Jaccard similarity of at least 0.75 share an n-gram among the first quarter of either in that
   order. These prefixes are cut into fragments of the n-gram range; fragments find the n-grams that two or more
   classes hold, and the class with the least key among them, the bucket's pivot.
3. Prefix overlaps with pivots are counted per fragment and summed per pair. Each class is compared with its
   most promising pivot: overlaps are counted in vertical parts of the n-gram range and summed per pair. Only classes
   take part that share enough prefix n-grams with another one of a fitting size; the buckets hold these n-grams.
4. Links join classes to components. Where the classes around the pivots of one component are still in different
   components, all of them that size and shared n-grams allow are compared block by block, inside tasks that return only links which
   join components. So no pair is written, and no possible link between components is left out.

Components are exact; links inside a component that is already known are not all computed.

A set without words is empty and links with nothing. Null texts are empty. Rows equal in id and text are equal.
Sets are told apart by a 64-bit key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm import fragments as fr
from skyledger.llm.batches import row_slices, small_batches, tidy
from skyledger.llm.filters import with_possible
from skyledger.llm.graph import components
from skyledger.llm.words import Runs, mixed, word_hashes
from skyledger.session import materialize

SHINGLE_WORDS = 5
PERCENT = 75
SKETCH_BITS = 21
SLICES = 64
PARTS = 4
GROUP = 256
BLOCK = 1024
TEXT_BYTES = 1 << 18  # of texts whose sets are made at once: words are hashed with some 40 bytes per byte of text
PREFIX = {"shingle": "u8", "key": "u8"}
SETS = "doc_id long, text_key long, key long, n int, slice int, counts binary"


def shingle_sets(raws: list[bytes], size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words has its whole sequence as one."""
    hashes, at = word_hashes([x.lower() for x in raws])
    run, out = Runs(hashes), []
    place = np.arange(max(0, len(hashes) - size + 1))
    every = run(place, place + size) if len(place) else np.zeros(0, np.uint64)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(every[a:b - size + 1]))
        else:
            out.append(run(np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> int:
    """A hash of a sorted set."""
    return int(Runs(shingles)(np.array([0]), np.array([len(shingles)]))[0]) if len(shingles) else 0


def signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def slots(shingles: np.ndarray) -> np.ndarray:
    return (mixed(shingles) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass: (doc_id, text_key, key, n) per row, and the counters of each task in rows with a slice."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.coalesce(text_col, F.lit("")).alias("__in"))
    names = [x.split()[0] for x in SETS.split(", ")]

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in row_slices(batches, limit=TEXT_BYTES):
            sets = shingle_sets([x.encode() for x in batch.column("__in").to_pylist()])
            rows = len(sets)
            if rows:
                np.add.at(counts, slots(np.concatenate(sets)), 1)
            keys = signed([set_key(s) for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(keys), pa.array([len(s) for s in sets], pa.int32()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        if counts.any():
            empty = pa.nulls(SLICES, pa.int64())
            yield from row_slices([pa.RecordBatch.from_arrays([empty, empty, empty, pa.nulls(SLICES, pa.int32()), pa.array(range(SLICES), pa.int32()), pa.array([fr.pack(x) for x in counts.reshape(SLICES, -1)], pa.binary())], names=names)], "counts")

    return materialize(slim.mapInArrow(tidy(run), SETS), "sets")


def sketch_of(described_: DataFrame) -> np.ndarray:
    """The summed counters, 2^SKETCH_BITS numbers whatever the input: first per partition, then per slice."""
    def total(tables):
        sums: dict[int, np.ndarray] = {}
        for table in tables:
            for k, raw in zip(table.column("slice").to_pylist(), table.column("counts").to_pylist(), strict=True):
                x = fr.unpack(raw, "i4").astype(np.int64)
                sums[k] = sums[k] + x if k in sums else x
        return [pa.array(list(sums), pa.int32()), pa.array([fr.pack(np.minimum(x, 2**31 - 1).astype(np.int32)) for x in sums.values()], pa.binary())]

    slices = described_.filter("slice IS NOT NULL").select("slice", "counts")
    part = slices.mapInArrow(lambda batches: iter([pa.RecordBatch.from_arrays(total(batches), names=["slice", "counts"])]), slices.schema)
    rows = part.groupBy("slice").applyInArrow(lambda table: pa.table(total([table]), names=["slice", "counts"]), slices.schema).toPandas()
    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.int32)
    for k, raw in zip(rows["slice"], rows["counts"], strict=True):
        out[k] = fr.unpack(raw, "i4")
    return out.reshape(-1)


def prefix(shingles: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.75 n) + 1 n-grams of a set in the global order, with all that tie with the last."""
    n = len(shingles)
    take = n - -(-PERCENT * n // 100) + 1
    rank = (np.minimum(sketch[slots(shingles)], (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (mixed(shingles) >> np.uint64(24))
    return shingles[rank <= np.partition(rank, take - 1)[take - 1]]


def buckets_of(docs: DataFrame, sketch: np.ndarray, text_col: str) -> DataFrame:
    """(shingle, key, pivot): prefix n-grams of two or more classes, one row per class."""
    spark = docs.sparkSession
    n = fr.count_fragments(spark)
    shared = spark.sparkContext.broadcast(sketch)  # 2^SKETCH_BITS counters
    slim = docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("__in"))

    def one(batch):
        sets = [s for s in shingle_sets([x.encode() for x in batch.column("__in").to_pylist()]) if len(s)]
        firsts = [prefix(s, shared.value) for s in sets]
        keys = np.array([set_key(s) for s in sets], np.uint64)
        return {"shingle": np.concatenate([np.zeros(0, np.uint64), *firsts]), "key": np.repeat(keys, [len(f) for f in firsts])}

    def fold(c):
        order = np.lexsort([c["key"], c["shingle"]])
        a, b = c["shingle"][order], c["key"][order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return {"shingle": a[new], "key": b[new]}

    def run(batches):
        yield from fr.gathered(map(one, row_slices(batches, limit=TEXT_BYTES)), PREFIX, lambda c: fr.fragment_of(c["shingle"], n), fold=fold)

    def meet(columns):
        c = fold(columns)
        a, b = c["shingle"], signed(c["key"])
        group = np.cumsum(np.concatenate([[True], a[1:] != a[:-1]])) - 1
        head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        keep = np.bincount(group)[group] >= 2
        return pa.table([pa.array(signed(a[keep])), pa.array(b[keep]), pa.array(b[head][group][keep])], names=["shingle", "key", "pivot"])

    return materialize(fr.by_fragment(slim.mapInArrow(tidy(run), fr.schema(PREFIX)), meet, PREFIX, "shingle long, key long, pivot long"), "buckets")


def set_parts(rows: DataFrame, docs: DataFrame, info: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rows (key, ...) with part and shingles: the class's set, cut into vertical parts of the n-gram range.

    One document stands for its class. Only texts that may be asked for are moved to meet their rows; a text takes less
    room than its n-grams, so sets are made behind that join and move once, to where they are compared.
    """
    place = rows.join(info.select("key", "doc_id", "text_key"), "key")
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("__in"))
    texts = with_possible(texts, F.col("text_key"), place, F.col("text_key"), "__asked").filter("__asked").drop("__asked").alias("d")
    # a merge join: the asked classes grow with the input, and a broadcast would pass them through the driver
    asked = texts.join(place.hint("merge").alias("i"), F.expr("d.text_key = i.text_key AND d.doc_id <=> i.doc_id")).select(*[F.col(f"i.{c}") for c in rows.columns], "d.__in")
    names = rows.columns

    def run(batches):
        for batch in row_slices(batches, limit=TEXT_BYTES):
            sets = shingle_sets([x.encode() for x in batch.column("__in").to_pylist()])
            at, values = [], []
            for k, (key, own) in enumerate(zip(batch.column("key").to_pylist(), sets, strict=True)):
                if int(signed([set_key(own)])[0]) != key:
                    continue  # another text with the same hash
                at.append(k)
                values += [x.tobytes() for x in np.split(own, np.searchsorted(own, np.arange(1, PARTS, dtype=np.uint64) << np.uint64(62)))]
            at = pa.array(np.repeat(np.array(at, np.int64), PARTS))
            part = pa.array(np.tile(np.arange(PARTS, dtype=np.int32), len(at) // PARTS))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in names], part, pa.array(values, pa.binary())], names=[*names, "part", "shingles"])

    return asked.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("shingles", T.BinaryType())]))


def overlaps(pairs: DataFrame, parts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b, overlap): common n-grams, counted per vertical part and summed per pair.

    A pair's sets meet under its first class; a class with many partners is spread over groups of about GROUP.
    """
    groups = fr.count_fragments(pairs.sparkSession)
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("salts"))
    own = salts.select(F.col("a").alias("key"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"))
    other = pairs.join(salts, "a").select(F.col("b").alias("key"), "a", F.pmod(F.hash("b"), F.col("salts")).alias("salt"), "b")
    rows = parts_of(own.unionByName(other)).withColumn(fr.FRAGMENT, F.pmod(F.xxhash64("a", "salt", "part"), F.lit(groups)).cast("int"))

    def count(table):
        sets: dict[tuple, dict] = {}
        for a, salt, b, part, raw in zip(*(table.column(c).to_pylist() for c in ("a", "salt", "b", "part", "shingles")), strict=True):
            sets.setdefault((a, salt, part), {})[b] = np.frombuffer(raw, np.uint64)
        out = []
        for (a, _, _), members in sets.items():
            first = members.pop(None)
            for b, x in members.items():
                if len(first) and len(x):
                    at = np.searchsorted(first, x)
                    at[at == len(first)] = 0
                    out.append((a, b, int((first[at] == x).sum())))
        return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["a", "b", "overlap"])

    counted = rows.select("a", "salt", "b", "part", "shingles", fr.FRAGMENT).groupBy(fr.FRAGMENT).applyInArrow(count, "a long, b long, overlap long")
    return counted.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))


def _sizes_allow(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _least_common(a: Column, b: Column) -> Column:
    """How many prefix n-grams a linked pair of these sizes shares at least.

    The pair shares t = ceil(75 (a + b) / 175) n-grams. The prefix of one of the two ends first in the order; a
    common n-gram outside both prefixes lies in that one's rest, which has at most 75% of the larger size less one.
    """
    t = F.ceil(PERCENT * (a + b) / (100 + PERCENT))
    rest = F.ceil(PERCENT * F.greatest(a, b) / 100.0) - 1
    return F.greatest(F.lit(1), t - rest)


def _able(x: str, y: str) -> Column:
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    return _sizes_allow(nx, ny) & (F.least(f"{x}.held", f"{y}.held") >= _least_common(nx, ny))


def links_of(pairs: DataFrame, parts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs (a, b, na, nb) that link."""
    pairs = materialize(pairs, "pairs")
    found = pairs.join(overlaps(pairs.select("a", "b"), parts_of), ["a", "b"])
    return materialize(found.filter(100 * F.col("overlap") >= PERCENT * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b"), "links")


def _best(rows: DataFrame) -> DataFrame:
    """Of pairs (a pivot, b) with a count, the most promising pivot for every b."""
    best = rows.groupBy("b").agg(F.max(F.struct("common", "a", "na", "nb")).alias("x"))
    return best.select("x.a", "b", "x.na", "x.nb")


def class_links(docs: DataFrame, sets: DataFrame, sketch: np.ndarray, id_col: str, text_col: str) -> DataFrame | None:
    """Links (a, b) between classes that join them to their components; None where no n-gram is shared."""
    buckets = buckets_of(docs, sketch, text_col)
    held = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    classes = sets.filter("n > 0").groupBy("key").agg(F.min("n").alias("n"), F.min(F.struct("doc_id", "text_key")).alias("x")).select("key", "n", "x.doc_id", "x.text_key")
    info = materialize(classes.join(held, "key"), "classes")
    if info.isEmpty():
        return None
    # every two classes of a bucket are among the members of its pivot
    stars = materialize(buckets.filter("key <> pivot").groupBy("pivot", "key").agg(F.count(F.lit(1)).alias("common")), "stars")
    # only classes with a possible partner around some pivot have their texts and sets moved
    around = stars.select(F.col("pivot").alias("cluster"), "key").unionByName(stars.select(F.col("pivot").alias("cluster"), F.col("pivot").alias("key")).distinct())
    possible = materialize(possible_partners(around.join(info.select("key", "n", "held"), "key").withColumn("component", F.col("key"))), "possible")
    asked = buckets.join(possible.select("key").distinct(), "key", "left_semi")
    prefixes = materialize(asked.groupBy("key").agg(F.collect_list("shingle").alias("prefix")), "prefixes")
    able = close_partners(possible, prefixes).select("key").distinct()
    info = materialize(info.join(able, "key"), "able")

    def parts_of(rows: DataFrame) -> DataFrame:
        return set_parts(rows, docs, info, id_col, text_col)

    x, y = info.alias("x"), info.alias("y")
    rated = stars.join(x, F.col("pivot") == F.col("x.key")).join(y, stars["key"] == F.col("y.key")).filter(_able("x", "y"))
    links = links_of(_best(rated.select(F.col("pivot").alias("a"), stars["key"].alias("b"), "common", F.col("x.n").alias("na"), F.col("y.n").alias("nb"))), parts_of)

    labels = components(links).withColumnRenamed("node", "key")
    known = info.select("key", "n", "held").join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    # pivots of one component share a group, so that a class meets its near copies once and not once per pivot
    # a pivot without a possible partner still names its bucket, in which the others meet
    owners = stars.select("pivot").distinct().join(known.select(F.col("key").alias("pivot"), "component"), "pivot", "left").select("pivot", F.coalesce("component", "pivot").alias("cluster"))
    groups = stars.select("pivot", "key").join(owners, "pivot").select("cluster", "key").unionByName(owners.select("cluster", F.col("pivot").alias("key"))).distinct()
    return links.unionByName(open_links(materialize(groups.join(known, "key"), "members"), prefixes, parts_of))


COLUMNS = ("cluster", "i", "j", "own", "key", "n", "held", "component")


def least_common(n: np.ndarray) -> np.ndarray:
    """`_least_common` for all pairs."""
    high = np.maximum(n[:, None], n)
    return np.maximum(1, -(-PERCENT * (n[:, None] + n) // (100 + PERCENT)) - (-(-PERCENT * high // 100) - 1))


def able_pairs(n: np.ndarray, held: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Which pairs are in different components, of a fitting size, and can share enough prefix n-grams."""
    low, high = np.minimum(n[:, None], n), np.maximum(n[:, None], n)
    return (component[:, None] != component) & (low * 100 >= high * PERCENT) & (np.minimum(held[:, None], held) >= least_common(n))


def blocks_of(cols: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The row numbers of every (cluster, i, j)."""
    order = np.lexsort([cols["j"], cols["i"], cols["cluster"]])
    new = np.any([np.diff(cols[c][order]) != 0 for c in ("cluster", "i", "j")], axis=0)
    return np.split(order, np.flatnonzero(new) + 1)


def possible_partners(members: DataFrame) -> DataFrame:
    """COLUMNS of the members (cluster, key, n, held, component) that have a possible partner in their cluster.

    A cluster's members are dealt to blocks of about BLOCK; every block (i) meets every other one (j).
    """
    groups = fr.count_fragments(members.sparkSession)
    spans = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("cluster", "blocks")
    dealt = members.join(spans, "cluster").withColumn("own", F.pmod(F.xxhash64("key", F.lit(5)), F.col("blocks")).cast("int"))
    ends = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    meet = dealt.select("cluster", "key", "n", "held", "component", "own", F.inline(ends))
    meet = meet.withColumn(fr.FRAGMENT, F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(groups)).cast("int"))

    def pick(table):
        cols = {c: table.column(c).to_numpy().astype(np.int64) for c in COLUMNS}
        found = [np.zeros(0, np.int64)]
        for index in blocks_of(cols):
            found.append(index[able_pairs(*(cols[c][index] for c in ("n", "held", "component"))).any(axis=1)])
        chosen = np.concatenate(found)
        return pa.table([pa.array(cols[c][chosen]) for c in COLUMNS], names=list(COLUMNS))

    return meet.select(*COLUMNS, fr.FRAGMENT).groupBy(fr.FRAGMENT).applyInArrow(pick, ", ".join(f"{c} long" for c in COLUMNS))


def close_partners(possible: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The possible partners that share as many prefix n-grams with one of theirs as a linked pair of their sizes does.

    prefixes (key, prefix) are from the buckets: an n-gram that the prefixes of two classes share has one.
    """
    groups = fr.count_fragments(possible.sparkSession)
    meet = possible.join(prefixes, "key").withColumn(fr.FRAGMENT, F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(groups)).cast("int"))

    def pick(table):
        cols = {c: table.column(c).to_numpy().astype(np.int64) for c in COLUMNS}
        lists = table.column("prefix").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        grams = lists.flatten().to_numpy()
        found = [np.zeros(0, np.int64)]
        for index in blocks_of(cols):
            n = cols["n"][index]
            possible = able_pairs(n, cols["held"][index], cols["component"][index])
            common = np.zeros(possible.shape, np.int32)
            count_common([grams[ends[k]:ends[k + 1]] for k in index], possible, common)
            found.append(index[(possible & (common >= least_common(n))).any(axis=1)])
        chosen = np.concatenate(found)
        return pa.table([pa.array(cols[c][chosen]) for c in COLUMNS], names=list(COLUMNS))

    return meet.select(*COLUMNS, "prefix", fr.FRAGMENT).groupBy(fr.FRAGMENT).applyInArrow(pick, ", ".join(f"{c} long" for c in COLUMNS))


def open_links(members: DataFrame, prefixes: DataFrame, parts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links between classes of one cluster that are in different components, as many as join them.

    First only sizes, components and shared prefixes meet, which tells the classes that have a possible partner at all; then
    the sets of these. A task counts overlaps part by part over its sets and returns only links that join two components.
    """
    groups = fr.count_fragments(members.sparkSession)
    wanted = materialize(close_partners(possible_partners(members), prefixes), "wanted")
    rows = parts_of(wanted).withColumn(fr.FRAGMENT, F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(groups)).cast("int"))

    def compare(table):
        gathered: dict[tuple, dict] = {}
        for cluster, i, j, key, n, held, component, part, raw in zip(*(table.column(c).to_pylist() for c in ("cluster", "i", "j", "key", "n", "held", "component", "part", "shingles")), strict=True):
            gathered.setdefault((cluster, i, j), {}).setdefault(key, (n, held, component, {}))[3][part] = np.frombuffer(raw, np.uint64)
        a, b = [], []
        for classes in gathered.values():
            keys = np.array(list(classes), np.int64)
            n, held, component = (np.array([c[k] for c in classes.values()], np.int64) for k in range(3))
            possible = able_pairs(n, held, component)
            overlap = np.zeros(possible.shape, np.int32)
            for part in range(PARTS):
                sets = [c[3].get(part, np.zeros(0, np.uint64)) for c in classes.values()]
                count_common(sets, possible, overlap)
            linked = possible & (100 * overlap >= PERCENT * (n[:, None] + n - overlap))
            root = {c: c for c in component.tolist()}
            for x, y in zip(*np.nonzero(np.triu(linked)), strict=True):
                p, q = _root(root, int(component[x])), _root(root, int(component[y]))
                if p != q:
                    root[p] = q
                    a.append(int(keys[x]))
                    b.append(int(keys[y]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    columns = ["cluster", "i", "j", "key", "n", "held", "component", "part", "shingles", fr.FRAGMENT]
    return materialize(rows.select(*columns).groupBy(fr.FRAGMENT).applyInArrow(compare, "a long, b long"), "links")


def _root(up: dict[int, int], x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def count_common(sets: list[np.ndarray], possible: np.ndarray, overlap: np.ndarray) -> None:
    """Add the common elements of the sets to overlap, for the rows that have a possible partner."""
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(token, kind="stable")
    holders = owner[order]
    first = np.searchsorted(token[order], np.arange(token.max() + 2))
    at = np.concatenate([[0], np.cumsum(sizes)])
    for x in np.flatnonzero(possible.any(axis=1)):
        mine = token[at[x]:at[x + 1]]
        begin, count = first[mine], first[mine + 1] - first[mine]
        if count.sum():
            flat = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            overlap[x] += np.bincount(holders[flat], minlength=len(sets)).astype(np.int32)


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per document. Documents without words are their own component."""
    found = described(docs, id_col, text_col)
    sets = found.filter("slice IS NULL").select("doc_id", "text_key", "key", "n")
    links = class_links(docs, sets, sketch_of(found), id_col, text_col)
    classes = sets.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    if links is None:
        named = classes
    else:
        labels = components(links).withColumnRenamed("node", "key")
        classes = classes.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
        names = classes.groupBy("component").agg(F.min("least").alias("name"))
        named = classes.join(names, "component").select("key", F.col("name").alias("least"))
    # a large class is joined once, so that its rows can be split
    named = materialize(named, "components")
    return sets.withColumn("node", F.when(F.col("n") > 0, F.col("key"))).join(named.withColumnRenamed("key", "node"), "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
