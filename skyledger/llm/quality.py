"""Quality classifier by co-training of two views.

The content view sees the words: shares of symbols, digits and capitals, repetition, hashed words. The metadata
view sees the page around them: source, language, length and line layout. Each view has a logistic regression.
In every round each classifier labels the unlabelled documents it is most sure of, and these labels join the
training set of the *other* one. At the end each view is calibrated on labelled documents kept out of training,
a combination of the two is fitted there, and all documents are scored in one map over the table.

Labelled rows are a bounded sample: at most `max_labelled`, chosen by a hash of the id over the whole table; only
their vectors reach the driver. All unlabelled rows take part in every round: their vectors are stored once, a map
over them counts margins in bins of a fixed width, the driver reads the cut of each class from the sums, and the
Newton steps add up slopes and curvatures, of a fixed size, in a tree. Scoring covers every row and whole texts.

Nulls: a null text counts as empty, null source and language have a bucket of their own; a label that is null
is no label, of several labels of one id the lowest counts; a row without an id is unlabelled. Rows that share a
labelled id are one document, the one with the smallest vector. With labels of fewer than two classes nothing can
be learned: every score is 1 and every document is kept. Repeated rows get equal scores. A column of docs that has
the name of an added one is replaced by it. Weights are rounded to six digits, so that sums in another order agree.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyledger.llm.batches import row_slices, small_batches, tidy
from skyledger.session import materialize

WORD_BUCKETS = 256
CONTENT = 16 + WORD_BUCKETS
SOURCE_BUCKETS, LANG_BUCKETS = 64, 16
META = 8 + SOURCE_BUCKETS + LANG_BUCKETS
SUM_BYTES, FAN_IN = 1 << 19, 32  # content vectors widened at once; arrays that one task adds up
EDGE, BIN = 35.0, 0.02  # margins are counted from -EDGE to EDGE in bins of this width
PUNCTUATION = np.array([c in b".,;:!?'\"()-" for c in range(256)])
SYMBOL = np.array([33 <= c <= 126 and not chr(c).isalnum() and not PUNCTUATION[c] for c in range(256)])
DIGIT = np.array([48 <= c <= 57 for c in range(256)])
UPPER = np.array([65 <= c <= 90 for c in range(256)])
LETTER = np.array([chr(c).isalpha() and c < 128 or c >= 128 for c in range(256)])


def packed(v: np.ndarray) -> np.ndarray:
    """Half precision, in training and scoring alike; larger values count as 60,000."""
    return np.minimum(v, 6e4).astype(np.float16)


def content_vector(raw: bytes) -> np.ndarray:
    """Features of the words of a text."""
    v = np.zeros(CONTENT, np.float32)
    words = raw.split()
    n = len(words)
    if not n:
        v[0] = 1.0
        return packed(v)
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    total = max(1, len(raw))
    counts = Counter(words)
    top = counts.most_common(3)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    stripped = sum(1 for w in counts if SYMBOL[w[-1]] or SYMBOL[w[0]])
    v[1:15] = (np.log1p(n), len(counts) / n, np.log1p(n) - np.log1p(len(counts)), top[0][1] / n, sum(c for _, c in top) / n, same / n,
               chars[SYMBOL].sum() / total * 10, chars[DIGIT].sum() / total * 10, chars[UPPER].sum() / total * 10, chars[PUNCTUATION].sum() / total * 10,
               chars[LETTER].sum() / total, stripped / len(counts), len(raw) / n / 10, max(map(len, counts)) / 100)
    for w, c in counts.items():
        v[16 + zlib.crc32(w.strip(b".,;:!?").lower()) % WORD_BUCKETS] += c
    hashed = v[16:]
    np.sqrt(hashed, out=hashed)
    hashed /= max(1e-6, float(np.linalg.norm(hashed)))
    return packed(v)


def meta_vector(source: str | None, lang: str | None, raw: bytes) -> np.ndarray:
    """Features of the page: where it is from, how long it is, how its lines are laid out."""
    v = np.zeros(META, np.float32)
    lines = np.array([len(x) for x in raw.split(b"\n")], float)
    v[0], v[1], v[2] = np.log1p(len(raw)), np.log1p(len(lines)), np.log1p(lines.mean())
    v[3], v[4], v[5] = np.log1p(lines.max()), lines.std() / (1 + lines.mean()), (lines == 0).mean()
    v[6] = np.log1p(len(raw) / max(1, raw.count(b" ")))
    v[8 + (zlib.crc32(source.encode("utf-8", "surrogatepass")) % (SOURCE_BUCKETS - 1) + 1 if source is not None else 0)] = 1
    v[8 + SOURCE_BUCKETS + (zlib.crc32(lang.encode("utf-8", "surrogatepass")) % (LANG_BUCKETS - 1) + 1 if lang is not None else 0)] = 1
    return packed(v)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Logistic:
    """Weights for standardised features; the last weight is the constant."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def start(cls, moments: np.ndarray) -> Logistic:
        """Without weights yet, standardised by the moments (see `moments_of`) of all rows."""
        n, (total, squares) = moments[0], moments[1:].reshape(2, -1)
        mean = total / n
        return cls(np.round(mean, 6), np.round(np.sqrt(np.maximum(squares / n - mean * mean, 0)), 6) + 1e-3, np.zeros(len(mean) + 1))

    def with_weights(self, weights: np.ndarray) -> Logistic:
        return Logistic(self.mean, self.scale, weights)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Slope and curvature of the loss over rows, one after the other."""
        z = self.rows(x)
        p = sigmoid(z @ self.weights)
        curve = (z * np.maximum(p * (1 - p), 1e-5)[:, None]).T @ z
        return np.concatenate([z.T @ (p - y), curve.ravel()])

    def moved(self, sums: np.ndarray, ridge: float) -> Logistic:
        """One Newton step for the sums over all rows."""
        n = len(self.weights)
        penalty = np.full(n, ridge)
        penalty[-1] = 1e-6
        curve = sums[n:].reshape(n, n) + np.diag(penalty)
        return self.with_weights(np.round(self.weights - np.linalg.solve(curve, sums[:n] + penalty * self.weights), 6))


@dataclass
class Round:
    """The models of a round, and per view the margins up to and from which it labels for the other one."""

    models: list[Logistic]
    cuts: list[tuple[float, float]]


@dataclass
class CoTrained:
    content: Logistic
    meta: Logistic
    calibrate: tuple[np.ndarray, np.ndarray]  # slope and constant of each view's probability
    combine: np.ndarray  # weights of the two calibrated margins and a constant
    history: list[dict]


def _line(margins: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights for a few margins, without standardising them."""
    z = np.hstack([margins, np.ones((len(y), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = sigmoid(z @ w)
        move = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= move
        if np.abs(move).max() < 1e-7:
            break
    return w


def given_labels(views: list[np.ndarray], rounds: list[Round]) -> list[np.ndarray]:
    """The label that each view has been given by the other one in the rounds so far, else nan; the first one stays."""
    given = [np.full(len(views[0]), np.nan), np.full(len(views[0]), np.nan)]
    for r in rounds:
        for k in (0, 1):
            margin, (low, high) = r.models[k].margin(views[k]), r.cuts[k]
            free = np.isnan(given[1 - k])
            given[1 - k][free & (margin >= high)] = 1.0
            given[1 - k][free & (margin <= low)] = 0.0
    return given


def add_up(pool: DataFrame, part: Callable[[list[np.ndarray]], np.ndarray], size: int) -> np.ndarray:
    """The sum of part([content, meta]) over the stored vectors: one array per task, added in a tree.

    A task widens some thousand vectors at a time, and both steps run in the same Python workers, so that its room
    does not depend on the size of a batch.
    """
    small_batches(pool.sparkSession)

    def one(total):
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def run(batches):
        total = np.zeros(size)
        for batch in row_slices(batches, "content", SUM_BYTES):
            total += part([np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float16).reshape(batch.num_rows, -1).astype(np.float64) for c in ("content", "meta")])
        yield one(total)

    def added(batches):
        total = np.zeros(size)
        for batch in batches:
            for raw in batch.column("part"):
                total += np.frombuffer(raw.as_buffer())
        yield one(total)

    parts, tasks = pool.mapInArrow(tidy(run), "part binary"), pool.rdd.getNumPartitions()
    while tasks > 1:
        tasks = math.ceil(tasks / FAN_IN)
        parts = parts.repartition(tasks).mapInArrow(added, "part binary")
    return sum((np.frombuffer(r.part) for r in parts.collect()), np.zeros(size))  # one row


def moments_of(x: np.ndarray) -> np.ndarray:
    """Number of rows, sums and sums of squares."""
    return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])


def margin_bins(margin: np.ndarray) -> np.ndarray:
    return np.floor((np.clip(margin, -EDGE, EDGE) + EDGE) / BIN).astype(int)


def cut_of(counts: np.ndarray, wanted: float, sure: float) -> tuple[float, float]:
    """The lowest margin, not below `sure`, from which at most `wanted` rows lie, and their number.

    Rows of one bin are taken together; the highest bin that has any is always taken.
    """
    above = np.cumsum(counts[::-1])[::-1]
    lowest = int(np.ceil((EDGE + sure) / BIN))
    able = np.flatnonzero(above[lowest:] <= max(1.0, wanted)) + lowest
    first = int(able[0]) if len(able) else len(counts) - 1
    held = np.flatnonzero(counts[lowest:]) + lowest
    if len(held):
        first = min(first, int(held[-1]))
    return first * BIN - EDGE, float(above[first])


def newton(start: Logistic, x: np.ndarray, y: np.ndarray, ridge: float = 3.0, steps: int = 12) -> Logistic:
    """Newton steps over rows in memory."""
    for _ in range(steps):
        before, start = start.weights, start.moved(start.sums(x, y), ridge)
        if np.abs(start.weights - before).max() < 1e-5:
            break
    return start


def co_train(content: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: DataFrame | None,
             rounds: int = 4, share: float = 0.1, sure: float = 0.9, steps: int = 3, ridge: float = 3.0) -> CoTrained:
    """Train the two views on y, exchanging confident labels over all rows of the pool for `rounds` rounds.

    A round adds up to `share` of the pool per view, in the class proportions of y, and only labels of a
    probability of at least `sure`. A given label weighs half a real one, and all of a view together at most half
    of the real ones, so that the size of the pool does not drown them. A fifth of the labelled rows is kept out
    for calibration. Features are standardised by all rows, labelled or not.
    """
    fold = np.arange(len(y)) % 5 == 4
    if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        fold[:] = False
    fit, held = ~fold, fold if fold.any() else ~fold
    views = [content.astype(np.float64), meta.astype(np.float64)]
    moments = [moments_of(v) for v in views]
    if pool is not None:
        added = add_up(pool, lambda x: np.concatenate([moments_of(v) for v in x]), sum(map(len, moments)))
        moments = [moments[0] + added[:len(moments[0])], moments[1] + added[len(moments[0]):]]
    models = [newton(Logistic.start(m), v[fit], y[fit], ridge) for m, v in zip(moments, views, strict=True)]
    done: list[Round] = []
    labels = [0.0, 0.0]  # rows with a given label, per view
    history = [{"round": 0, "content_labels": 0, "meta_labels": 0}]
    bins, least = int(2 * EDGE / BIN) + 1, math.log(sure / (1 - sure))
    sizes = [len(m.weights) * (len(m.weights) + 1) for m in models]
    for step in range(1, rounds + 1 if pool is not None else 1):
        def margins(x, models=tuple(models), done=tuple(done)):
            given = given_labels(x, done)
            free = [np.bincount(margin_bins(models[k].margin(x[k])[np.isnan(given[1 - k])]), minlength=bins) for k in (0, 1)]
            return np.concatenate([*free, [len(x[0])]])

        counted = add_up(pool, margins, 2 * bins + 1)
        total, share_1 = counted[-1], y.mean()
        if not total:
            break
        cuts = []
        for k in (0, 1):
            counts = counted[k * bins:(k + 1) * bins]
            high, n_1 = cut_of(counts, share * share_1 * total, least)
            low, n_0 = cut_of(counts[::-1], share * (1 - share_1) * total, least)
            cuts.append((BIN - low if low < EDGE else -math.inf, high))
            labels[1 - k] += n_1 + n_0
        done.append(Round(models, cuts))
        for _ in range(steps):
            def slopes(x, models=tuple(models), done=tuple(done)):
                given = given_labels(x, done)
                return np.concatenate([models[k].sums(x[k][~np.isnan(given[k])], given[k][~np.isnan(given[k])]) for k in (0, 1)])

            added = add_up(pool, slopes, sum(sizes))
            weight = [0.5 * min(1.0, fit.sum() / max(1.0, n)) for n in labels]
            extra = [added[:sizes[0]] * weight[0], added[sizes[0]:] * weight[1]]
            before = models
            models = [models[k].moved(models[k].sums(views[k][fit], y[fit]) + extra[k], ridge) for k in (0, 1)]
            if max(np.abs(m.weights - b.weights).max() for m, b in zip(models, before, strict=True)) < 1e-3:
                break
        history.append({"round": step, "content_labels": int(labels[0]), "meta_labels": int(labels[1])})
    own = [_line(models[k].margin(views[k][held])[:, None], y[held]) for k in (0, 1)]
    margins = np.stack([models[k].margin(views[k][held]) * own[k][0] + own[k][1] for k in (0, 1)], axis=1)
    return CoTrained(models[0], models[1], (own[0], own[1]), _line(margins, y[held]), history)


def vectors(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, content binary, meta binary): half-precision feature vectors."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("__in"))

    def run(batches):
        for batch in row_slices(batches):
            raw = [x.encode("utf-8", "surrogatepass") for x in batch.column("__in").to_pylist()]
            content = [content_vector(x).tobytes() for x in raw]
            meta = [meta_vector(s, g, x).tobytes() for s, g, x in zip(batch.column("source").to_pylist(), batch.column("lang").to_pylist(), raw, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(content, pa.binary()), pa.array(meta, pa.binary())], names=["doc_id", "content", "meta"])

    return slim.mapInArrow(tidy(run), "doc_id long, content binary, meta binary")


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = 8_000, id_col: str = "doc_id"):
    """(content, meta, y) of the bounded labelled sample, and the stored vectors of all rows without a label."""
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label_col).cast("double").alias("y"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    sample = ids.join(marked, "doc_id").orderBy(*order).limit(max_labelled).toPandas()  # two columns of at most max_labelled rows
    chosen = docs.sparkSession.createDataFrame(pa.Table.from_pandas(sample, preserve_index=False), "doc_id long, y double")  # as Arrow: rows would start workers of another kind
    rows = docs.withColumn("__key", F.col(id_col).cast("long")).join(F.broadcast(chosen.select(F.col("doc_id").alias("__key"))), "__key", "left_semi")
    one = vectors(rows, id_col).groupBy("doc_id").agg(F.min(F.struct("content", "meta")).alias("v")).select("doc_id", "v.*")
    found = one.toPandas().merge(sample, on="doc_id").sort_values("doc_id", key=lambda s: s * 2654435761 % 4294967291, kind="stable")
    content = np.frombuffer(b"".join(found.content), np.float16).reshape(-1, CONTENT)
    meta = np.frombuffer(b"".join(found.meta), np.float16).reshape(-1, META)
    y = found.y.to_numpy(float)
    if len(set(y)) < 2:
        return content, meta, y, None
    # a null id matches no label; the second key spreads such rows
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("content", "meta"), F.lit(1024))).otherwise(F.lit(0)).alias("spread")
    known = marked.select("doc_id", F.lit(0).cast("long").alias("spread"))
    rest = vectors(docs, id_col).select("*", spread).join(known, ["doc_id", "spread"], "left_anti").select("content", "meta")
    return content, meta, y, materialize(rest, "unlabelled-vectors")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = 8_000) -> CoTrained | None:
    """The co-trained model, or None when the labels hold fewer than two classes."""
    content, meta, y, pool = training_rows(docs, labels, label_col, max_labelled)
    return None if pool is None else co_train(content, meta, y, pool)


def score(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5, prefix: str = "") -> DataFrame:
    """All columns of docs with p_content, p_meta, score and kept, under names that begin with `prefix`."""
    added = [prefix + c for c in ("p_content", "p_meta", "score", "kept")]
    docs = docs.drop(*added)
    if model is None:
        return docs.select("*", *(F.lit(1.0).alias(c) for c in added[:3]), F.lit(True).alias(added[3]))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two weight vectors
    columns = docs.columns
    wide = docs.select("*", F.coalesce("text", F.lit("")).alias("__in"), F.col("source").cast("string").alias("__source"), F.col("lang").cast("string").alias("__lang"))

    def run(batches):
        m = shared.value
        for batch in row_slices(batches):
            raw = [x.encode("utf-8", "surrogatepass") for x in batch.column("__in").to_pylist()]
            content = np.stack([content_vector(x) for x in raw]).astype(np.float64)
            meta = np.stack([meta_vector(s, g, x) for s, g, x in zip(batch.column("__source").to_pylist(), batch.column("__lang").to_pylist(), raw, strict=True)]).astype(np.float64)
            margins = [model_.margin(x) * line[0] + line[1] for model_, x, line in zip((m.content, m.meta), (content, meta), m.calibrate, strict=True)]
            total = sigmoid(margins[0] * m.combine[0] + margins[1] * m.combine[1] + m.combine[2])
            out = [sigmoid(margins[0]), sigmoid(margins[1]), total]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(x, pa.float64()) for x in out), pa.array(total >= threshold, pa.bool_())], names=[*columns, *added])

    schema = StructType(list(docs.schema.fields)).add(added[0], "double").add(added[1], "double").add(added[2], "double").add(added[3], "boolean")
    return wide.mapInArrow(tidy(run), schema)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """Score every document after co-training on the labelled ones."""
    return score(docs, fit(docs, labels, label_col))
