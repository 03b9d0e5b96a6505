"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams per language over every training row: each task sums its own counts and sends
one row per (language, bucket), which Spark adds up. The matrix of log probabilities has languages x buckets
cells, a size fixed by the parameters, and travels with the tasks. Scoring gathers the rows of the matrix for
the buckets of a batch in numpy and sums them per text.

A text without a letter, or a null one, is `und` with score 0. Rows with a null language are not learned from.
Equal scores go to the language that sorts first. With nothing to learn from, every text is `und`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.batches import row_slices

ORDERS = (1, 2, 3)
BITS = 15
SMOOTHING = 0.5
UNKNOWN = "und"


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """True where crc32 of the id as text falls in the held-out fold; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))


def grams(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all n-grams, number per text, has a letter). Case, digits and runs of space are folded first."""
    folded, letters = [], np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        text = text or ""
        letters[i] = any(map(str.isalpha, text))
        folded.append(f" {text.lower()} ")
    lengths = np.fromiter(map(len, folded), np.int64, len(folded))
    codes = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(folded), dtype=np.int32), lengths)
    # anything up to "@" that is no letter counts as one separator
    codes = np.where(codes <= 0x40, np.uint32(0x20), codes).astype(np.uint64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0x20) | (codes[:-1] != 0x20) | (doc[1:] != doc[:-1])
    codes, doc = codes[keep], doc[keep]
    out, owner = [], []
    mix, rolled = np.uint64(0x9E3779B97F4A7C15), codes.copy()
    for order in range(1, max(ORDERS) + 1):
        if order > 1:
            rolled = rolled[:-1] * np.uint64(1_000_003) + codes[order - 1:]
        if order in ORDERS and len(rolled):
            same = doc[:len(rolled)] == doc[order - 1:]
            hashed = ((rolled[same] + np.uint64(order)) * mix) >> np.uint64(64 - bits)
            out.append(hashed.astype(np.int32))
            owner.append(doc[:len(rolled)][same])
    if not out:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), letters
    return np.concatenate(out), np.concatenate(owner), letters


@dataclass
class Model:
    languages: list[str]
    log_probability: np.ndarray  # languages x buckets, float32
    prior: np.ndarray
    bits: int


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = BITS) -> Model:
    """Count over all rows with a text and a language; the driver sees one number per language and bucket."""
    rows = docs.select(F.col(text_col).alias("__in"), F.col(lang_col).alias("lang")).filter("__in IS NOT NULL AND lang IS NOT NULL")

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}
        for batch in row_slices(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            buckets, owner, letters = grams(batch.column("__in").to_pylist(), bits)
            for lang in set(langs):
                mine = langs == lang
                if lang not in totals:
                    totals[lang] = np.zeros(1 << bits, np.int64)
                totals[lang] += np.bincount(buckets[mine[owner]], minlength=1 << bits)
                documents[lang] = documents.get(lang, 0) + int((mine & letters).sum())
        for lang, own in totals.items():
            used = np.flatnonzero(own)
            n = len(used) + 1
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([-1, *used.tolist()], pa.int32()), pa.array([documents[lang], *own[used].tolist()], pa.int64())], names=["lang", "bucket", "n"])

    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toPandas()
    documents = table[(table.bucket < 0) & (table.n > 0)].set_index("lang").n
    languages = sorted(documents.index)
    matrix = np.full((len(languages), 1 << bits), SMOOTHING)
    for k, lang in enumerate(languages):
        own = table[(table.lang == lang) & (table.bucket >= 0)]
        matrix[k, own.bucket.to_numpy()] += own.n.to_numpy()
    if languages:
        matrix = np.log(matrix / matrix.sum(axis=1, keepdims=True))
    prior = np.log(documents.reindex(languages).to_numpy(float) / max(1, documents.sum()))
    return Model(languages, matrix.astype(np.float32), prior, bits)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add lang_pred and score, the posterior of the mean n-gram evidence, to the columns of `keep`."""
    slim = docs.select(*keep, F.col(text_col).alias("__in"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets cells

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in row_slices(batches):
            n = batch.num_rows
            best, score = np.full(n, len(m.languages)), np.zeros(n)
            if m.languages:
                buckets, owner, letters = grams(batch.column("__in").to_pylist(), m.bits)
                size = np.maximum(np.bincount(owner, minlength=n), 1)
                mean = np.stack([np.bincount(owner, weights=row[buckets], minlength=n) for row in m.log_probability], axis=1) / size[:, None]
                total = mean * size[:, None] + m.prior
                first = total.argmax(axis=1)
                # evidence of all n-grams would round the posterior to 1; it is tempered to the scale of ten n-grams
                odds = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.minimum(size, 10)[:, None])
                chance = odds[np.arange(n), first] / odds.sum(axis=1)
                best, score = np.where(letters, first, best), np.where(letters, chance, 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = slim.drop("__in").schema.add("lang_pred", "string").add("score", "double")
    return slim.mapInArrow(run, schema)
