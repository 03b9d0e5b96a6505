"""Phrase collocations: mergeable Misra-Gries summaries find every frequent n-gram, a second pass counts them.

Pass 1. Tasks fold the n-grams of about 4 MB of text to summaries, one per hash bucket: sorted 64-bit keys and their
counts. The summaries of a bucket meet in one partition behind small rows that state their mass, so the capacity is
known before the first summary arrives: twice the mass divided by the threshold. Where a merge exceeds it, the
count of the first n-gram beyond the capacity is taken off all counters. Every such cut takes more than `capacity`
times its height from the mass, so all cuts together stay below half the threshold, and an n-gram that occurs
`min_count` times is always left. The number of buckets follows the input; a bucket's size does not.

Pass 2. The survivors set bits of a filter of fixed size (2^26 bits; a full filter costs time, not results). The
texts are read again and only n-grams that pass it are counted, by their words, so the counts are exact.

Awkward rows: a null text has no words; a null group value counts as `und`; repeated rows and repeated ids count each
time; other columns are not read; texts of any length are read whole, one at a time if longer than 4 MB. Empty
tables give an empty result. Ties of score go by count, then by phrase in byte order.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.batches import row_slices
from skyledger.llm.words import mixed
from skyledger.session import materialize

CHUNK_BYTES = 4 << 20
FLUSH_KEYS = 2 << 20
BATCH_KEYS = 1 << 18
BUCKET_BYTES = 2 << 20  # of text per hash bucket
FILTER_BITS = 26
SLACK = 2
BREAK = b"."  # cannot be a word, as it separates pieces
PIECES = bytes(BREAK[0] if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in range(256))
STEP = np.uint64(0x9E3779B97F4A7C15)


def grouped(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one group at a time, about `limit` bytes of them together."""
    held, size = defaultdict(list), 0
    for batch in row_slices(batches):
        for group, text in zip(batch.column("group").to_pylist(), batch.column("__in").to_pylist(), strict=True):
            raw = text.encode()
            held[group].append(raw)
            size += len(raw)
        if size >= limit:
            yield from held.items()
            held, size = defaultdict(list), 0
    yield from held.items()


def grams(texts: list[bytes], longest: int) -> tuple[list[bytes], int, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """(the distinct words, number of words, for 1 to `longest` words: word numbers of the distinct n-grams and their counts)."""
    tokens = b" . ".join(texts).lower().translate(PIECES).replace(BREAK, b" . ").split()
    number = defaultdict(count().__next__)
    number[BREAK]  # gets 0
    ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
    del tokens
    bits = max(1, len(number).bit_length())

    def sizes():
        inside = ids > 0
        for n in range(1, longest + 1):
            if n > 1:
                inside = inside[:-1] & (ids[n - 1:] > 0)
            at = np.flatnonzero(inside)
            columns = [ids[at + k] for k in range(n)]
            if bits * n <= 63:
                packed = columns[0]
                for c in columns[1:]:
                    packed = packed << bits | c
                found, times = np.unique(packed, return_counts=True)
                yield np.stack([found >> bits * (n - 1 - k) & (1 << bits) - 1 for k in range(n)], axis=1), times
            else:
                yield np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)

    return list(number), int((ids > 0).sum()), sizes()


def keys_of(group: str, hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A 64-bit key of every n-gram of a group."""
    key = np.full(len(words), xxhash.xxh3_64_intdigest(group.encode()), np.uint64)
    for k in range(words.shape[1]):
        key = mixed((key ^ hashes[words[:, k]]) * STEP)
    return key


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def folded(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    key, times = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, times = key[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(times, first) if len(first) else times


class Summary:
    """Misra-Gries counters; `error` is what was taken off any one of them at most."""

    def __init__(self, capacity: int):
        self.capacity, self.error, self.waiting = capacity, 0, 0
        self.keys, self.counts = [], []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > 2 * self.capacity:
            self.merge()

    def merge(self) -> None:
        if not self.keys:
            return
        keys, counts = folded(self.keys, self.counts)
        if len(keys) > self.capacity:
            cut = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            left = counts > cut
            keys, counts = keys[left], counts[left] - cut
            self.error += cut
        self.keys, self.counts, self.waiting = [keys], [counts], len(keys)

    def frequent(self, least: int) -> np.ndarray:
        """Every key added `least` times or more, and some others."""
        self.merge()
        return self.keys[0][self.counts[0] + self.error >= least] if self.keys else np.zeros(0, np.uint64)


def survivors(rows: DataFrame, longest: int, min_count: int) -> DataFrame:
    """(key): the keys of all n-grams with `min_count` occurrences in their group, and some others."""
    size = rows.agg(F.sum(F.octet_length("__in"))).first()[0] or 0
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4 * spread, -(-size // BUCKET_BYTES)).bit_length()

    def summaries(batches):
        keys, counts, waiting = [], [], 0

        def rows_of():
            key, times = folded(keys, counts)
            edge = np.searchsorted(key, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(key)]
            out, size = [], 0
            for bucket in range(1 << bits):
                a, b = edge[bucket], edge[bucket + 1]
                if a < b:
                    out.append((bucket, int(times[a:b].sum()), None, None))
                    out.append((bucket, 0, key[a:b].tobytes(), times[a:b].astype(np.uint32).tobytes()))  # below the 2^31 bytes of a text
                    size += b - a
                if out and (size > BATCH_KEYS or bucket + 1 == 1 << bits):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "mass", "keys", "counts"])
                    out, size = [], 0

        for group, texts in grouped(batches):
            words, _, sizes = grams(texts, longest)
            hashes = word_keys(words)
            for found, times in sizes:
                keys.append(keys_of(group, hashes, found))
                counts.append(times)
                waiting += len(found)
            if waiting >= FLUSH_KEYS:
                yield from rows_of()
                keys, counts, waiting = [], [], 0
        if waiting:
            yield from rows_of()

    def merged(batches):
        bucket, summary, mass = None, None, 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(summary.frequent(min_count).view(np.int64), pa.int64())], names=["key"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    if summary:
                        yield out()
                    bucket, summary, mass = row["bucket"], None, 0
                if row["keys"] is None:
                    mass += row["mass"]
                    continue
                summary = summary or Summary(SLACK * mass // min_count + 1)
                summary.add(np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.uint32).astype(np.int64))
        if summary:
            yield out()

    parts = rows.mapInArrow(summaries, "bucket int, mass long, keys binary, counts binary")
    dealt = parts.withColumn("data", F.col("keys").isNotNull()).repartition(max(spread, (1 << bits) // 8), "bucket").sortWithinPartitions("bucket", "data").drop("data")
    return dealt.mapInArrow(merged, "key long")


def filter_bits(keys: DataFrame) -> np.ndarray:
    """2^FILTER_BITS bits, set at the leading bits of the keys."""
    place = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    cells = keys.groupBy(F.shiftright(place, 6).alias("cell")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(key, {64 - FILTER_BITS}) & 63 as int)))").alias("bits"))
    table = cells.toArrow()  # at most 2^(FILTER_BITS - 6) rows
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    out[table.column("cell").to_numpy()] = table.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out


def counted(rows: DataFrame, longest: int, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(group, n, phrase, f) of every n-gram with `min_count` occurrences, and (group, n) with the number of words."""
    shared = rows.sparkSession.sparkContext.broadcast(filter_bits(survivors(rows, longest, min_count)))  # 8 MB

    def exact(batches):
        bits = shared.value
        for group, texts in grouped(batches):
            words, total, sizes = grams(texts, longest)
            hashes = word_keys(words)
            size, phrase, times = [0], [b""], [total]
            for found, own in sizes:
                place = keys_of(group, hashes, found) >> np.uint64(64 - FILTER_BITS)
                passed = np.flatnonzero(bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
                phrase += [b" ".join([words[w] for w in gram]) for gram in found[passed].tolist()]
                times += own[passed].tolist()
                size += [found.shape[1]] * len(passed)
            for at in range(0, len(size), 1 << 16):
                part = slice(at, at + (1 << 16))
                n = len(size[part])
                yield pa.RecordBatch.from_arrays([pa.array([group] * n, pa.string()), pa.array(size[part], pa.int32()), pa.array(phrase[part], pa.binary()).cast(pa.string()), pa.array(times[part], pa.int64())], names=["group", "n", "phrase", "f"])

    sums = rows.mapInArrow(exact, "group string, n int, phrase string, f long").groupBy("group", "n", "phrase").agg(F.sum("f").alias("f"))
    found = materialize(sums.filter(f"n = 0 OR f >= {min_count}"), "phrases")
    return found.filter("n > 0"), found.filter("n = 0").select("group", F.col("f").alias("total"))


def scored(found: DataFrame) -> DataFrame:
    """Add the parts' counts l and r and the score of the lowest-scoring cut to phrases of two words and more."""
    parts = found.select("group", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    long = found.filter("n > 1").withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = long.withColumn("left", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")).withColumn("right", F.array_join(F.slice("w", F.col("k") + 1, F.col("n") - F.col("k")), " ")).drop("w")
    cuts = cuts.join(parts.withColumnsRenamed({"part": "left", "part_f": "l"}), ["group", "left"]).join(parts.withColumnsRenamed({"part": "right", "part_f": "r"}), ["group", "right"])
    # counts below 10^15: products of two have 30 digits, and 38 with the factor
    whole = {c: F.col(c).cast("decimal(15,0)") for c in ("f", "l", "r")}
    cuts = cuts.withColumn("above", whole["f"] * whole["f"] * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("below", whole["l"] * whole["r"]).withColumn("score", F.expr("above div below"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return cuts.groupBy("group", "n", "phrase", "f").agg(best).select("group", "n", "phrase", "f", "best.l", "best.r", "best.score")


def inside_longer(found: DataFrame, share: int) -> DataFrame:
    """(group, phrase, longer_f): phrases of two words and more within longer ones, with the longer one's largest count."""
    long = found.filter("n > 2").withColumn("w", F.split("phrase", " "))
    subs = long.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("n") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)))
    return subs.groupBy("group", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase")).agg(F.max("f").alias("longer_f"))


def mine(docs: DataFrame, text_col: str = "text", group_col: str = "lang", longest: int = 3, min_count: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best collocations of each group.

    A phrase is dropped where a longer one contains it and has at least `share` percent of its count.
    """
    rows = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("group"), F.col(text_col).alias("__in")).filter("__in IS NOT NULL")
    found, totals = counted(rows, longest, min_count)
    kept = scored(found).join(inside_longer(found, share), ["group", "phrase"], "left").filter(f"longer_f IS NULL OR 100 * cast(longer_f AS decimal(20,0)) < {share} * cast(f AS decimal(20,0))")
    order = [F.col("score").desc(), F.col("f").desc(), F.col("phrase").asc()]
    # a group's phrases are first ranked in salted parts, so that no task sorts all of them
    part = Window.partitionBy("group", "salt").orderBy(*order)
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "group").select(
        F.col("group").alias(group_col), F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", F.col("total").alias("n"), "score")
