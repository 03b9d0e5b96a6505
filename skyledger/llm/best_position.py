"""Ranked lexical search with the Best Position Algorithm, over blocks of documents.

Documents are read once: of each, the number of terms and the counts of the terms that any query holds. They are
written to the shared folder; from them come the corpus statistics. Then every task indexes its documents in blocks:
one list per term, in order of impact, and the same list in order of documents for direct accesses. A query reads
its lists side by side. Each document met is looked up directly in all other lists, which gives its whole score and
marks its positions there as seen. A list's best position is the last one before which all are seen, whether by reading
or by look-up; the impacts at the best positions sum to what a document not yet met can reach at most, and a query
stops in a block once that sum is strictly below its k-th score, so equal scores are never lost. The k-th
score is carried from block to block of a task. The k best of every task meet in one ranking per query.

Queries go in slices of bounded size, each slice over all documents, so the broadcast terms do not grow with the input.

Awkward rows: null and empty texts have no terms; every row is a document of its own, also if it repeats an id or a whole
row; null ids rank after others of equal score; queries equal in id and text are one; a query without terms, or
whose terms no document holds, returns no row; other columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.batches import row_slices
from skyledger.session import materialize

NOT_TERM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SLICE_TERMS = 200_000  # terms of the queries that go together
BLOCK_POSTINGS = 2_000_000
FIRST_READ = 32  # positions of each list in the first round; doubled in each further one


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased."""
    return (text or "").encode().lower().translate(NOT_TERM).split()


def postings(docs: DataFrame, wanted: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms with repeats), and the numbers and counts of the wanted terms, for documents with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # at most about SLICE_TERMS terms

    def run(batches):
        number = shared.value
        for batch in row_slices(batches):
            n, own, times = [], [], []
            for text in batch.column("__in").to_pylist():
                tokens = terms(text)
                found = Counter(number[t] for t in tokens if t in number)
                n.append(len(tokens))
                own.append(list(found.keys()))
                times.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "times"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__in")).filter("__in IS NOT NULL")
    return slim.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>").filter("n > 0")


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Block:
    """The lists of a block of documents; documents are numbered in order of their ids, null ids last."""

    def __init__(self, doc_id: pa.Array, n: np.ndarray, size: np.ndarray, term: np.ndarray, times: np.ndarray, weights: np.ndarray, documents: int, length: int):
        order = np.lexsort((doc_id.fill_null(0).to_numpy(False), doc_id.is_null().to_numpy(False)))
        self.doc_id = doc_id.take(pa.array(order))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = np.repeat(place, size)
        base = 20 * (100 - 50 + (50 * n * documents) // length)
        impact = weights[term] * ((1_000_000_000 * times) // (1000 * times + np.repeat(base, size)))
        useful = impact > 0
        doc, term, impact = doc[useful], term[useful], impact[useful]
        by_impact = np.lexsort((doc, -impact, term))
        self.doc, self.impact, sorted_terms = doc[by_impact], impact[by_impact], term[by_impact]
        self.edge = np.searchsorted(sorted_terms, np.arange(len(weights) + 1))
        by_doc = np.lexsort((self.doc, sorted_terms))  # positions of every list in order of documents
        self.direct_doc, self.direct_at = self.doc[by_doc], by_doc

    def search(self, query: list[int], k: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) with all of the block's that can be among the k best of the block and `others`."""
        spans = [(int(self.edge[t]), int(self.edge[t + 1])) for t in query]
        spans = [(a, b) for a, b in spans if a < b]
        met = np.zeros(len(self.doc_id), bool)
        seen = [np.zeros(b - a, bool) for a, b in spans]
        best = [0] * len(spans)  # positions before this one are all seen
        found, totals, read = np.zeros(0, np.int64), np.zeros(0, np.int64), FIRST_READ
        while any(p < b - a for p, (a, b) in zip(best, spans, strict=True)):
            fresh = np.unique(np.concatenate([self.doc[a + p:min(a + p + read, b)] for p, (a, b) in zip(best, spans, strict=True)]))
            fresh = fresh[~met[fresh]]
            met[fresh] = True
            total = np.zeros(len(fresh), np.int64)
            for (a, b), mark in zip(spans, seen, strict=True):
                at = np.searchsorted(self.direct_doc[a:b], fresh)
                has = np.flatnonzero(self.direct_doc[a + np.minimum(at, b - a - 1)] == fresh)
                position = self.direct_at[a + at[has]]
                total[has] += self.impact[position]
                mark[position - a] = True
            found, totals = np.concatenate([found, fresh]), np.concatenate([totals, total])
            if len(found) > k:
                top = np.lexsort((found, -totals))[:k]
                found, totals = found[top], totals[top]
            for j, mark in enumerate(seen):
                rest = mark[best[j]:]
                gap = int(rest.argmin()) if len(rest) else 0
                best[j] += gap if len(rest) and not rest[gap] else len(rest)
            bound = sum(int(self.impact[a + p - 1]) for p, (a, b) in zip(best, spans, strict=True) if p < b - a)
            known = np.concatenate([totals, others])
            if len(known) >= k and bound < np.partition(known, len(known) - k)[len(known) - k]:
                break
            read *= 2
        return found, totals


def blocks(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple]:
    held, size = [], 0
    for batch in batches:
        lists = batch.column("terms")
        lengths = np.diff(np.asarray(lists.offsets)).astype(np.int64)
        start = 0
        while start < batch.num_rows:  # a batch is cut where the block is full
            upto = size + np.cumsum(lengths[start:])
            end = start + max(1, int(np.searchsorted(upto, limit, side="right")))
            held.append(batch.slice(start, end - start))
            size += int(lengths[start:end].sum())
            start = end
            if size >= limit:
                yield together(held)
                held, size = [], 0
    if held:
        yield together(held)


def together(batches: list[pa.RecordBatch]) -> tuple:
    table = pa.Table.from_batches(batches).combine_chunks()
    column = {c: table.column(c).combine_chunks() for c in table.column_names}
    sizes = np.array([len(x) for x in column["terms"]], np.int64)
    flat = lambda c, t: column[c].flatten().to_numpy(False).astype(t)
    return column["doc_id"], column["n"].to_numpy(False), sizes, flat("terms", np.int64), flat("times", np.int64)


def search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """<query_id>, rank, doc_id, score: the k best documents of every query, equal scores by ascending id."""
    items = queries.select(F.col(query_id).alias("item"), F.col(query_text).alias("__in")).distinct()
    size = items.agg(F.sum(F.octet_length("__in"))).first()[0] or 0
    slices = 1 + size // (2 * SLICE_TERMS)  # a term takes two bytes or more
    items = materialize(items.withColumns({"slice": F.pmod(F.xxhash64("__in"), F.lit(slices)), "number": F.monotonically_increasing_id()}), "queries")
    found = None
    for part in range(slices):
        wanted: dict[bytes, int] = {}
        asked = []
        for row in items.filter(F.col("slice") == part).collect():  # about SLICE_TERMS terms
            asked.append((row.number, [wanted.setdefault(t, len(wanted)) for t in dict.fromkeys(terms(row["__in"]))]))
        some = ranked_blocks(docs, asked, wanted, k, id_col, text_col)
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(items.select("number", "item"), "number").select(F.col("item").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score")


def ranked_blocks(docs: DataFrame, asked: list[tuple[int, list[int]]], wanted: dict[bytes, int], k: int, id_col: str, text_col: str) -> DataFrame:
    """number, doc_id, score: the k best of every task for each query of a slice."""
    index = materialize(postings(docs, wanted, id_col, text_col), "postings")
    stats = index.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    documents, length = stats.documents, stats.length or 1
    weights = np.zeros(len(wanted), np.int64)
    for row in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # one number per term of the slice
        weights[row.term] = weight(row.df, documents)
    shared = docs.sparkSession.sparkContext.broadcast((asked, weights))

    def run(batches):
        own, w = shared.value
        tops = [(np.zeros(0, np.int64), [])] * len(own)
        for doc_id, n, sizes, term, times in blocks(batches, BLOCK_POSTINGS):
            block = Block(doc_id, n, sizes, term, times, w, documents, length)
            for i, (_, query) in enumerate(own):
                scores, ids = tops[i]
                doc, total = block.search(query, k, scores)
                total = np.concatenate([scores, total])
                ids = ids + block.doc_id.take(pa.array(doc)).to_pylist()
                best = sorted(range(len(ids)), key=lambda x: (-total[x], ids[x] is None, ids[x] or 0))[:k]
                tops[i] = total[best], [ids[x] for x in best]
        for (number, _), (scores, ids) in zip(own, tops, strict=True):
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["number", "doc_id", "score"])

    return index.mapInArrow(run, "number long, doc_id long, score long")
