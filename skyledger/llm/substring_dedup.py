"""Substring dedup by compaction of a de Bruijn graph of words.

Edges are windows of `window` words. Consecutive edges of a text whose least 6-word run (the minimiser) is the
same one form a piece, a path of the graph; equal windows always lie in pieces with the same minimiser.

1. Every text is cut into pieces. A task folds pieces that it sees more than once to the earliest; pieces meet
   by the minimiser's hash, in fragments. Of equal pieces all but the earliest are repeated as a whole.
2. Different pieces with one minimiser may share a part of their windows. Only these, and only the earliest of
   each kind, are opened into single windows, which meet by their own hash.
3. Repeated pieces and windows of a text that follow each other and whose sources follow each other in the same
   way (equal distance between coordinates) compact into one long span: a nonbranching path of the graph.
4. Spans are joined to their texts and the words under them are removed.

Pieces count as equal when the 64-bit hash of their words and that of their minimiser agree, windows when a
64-bit and a 32-bit hash agree. No text travels but to its own spans.

Which copy stays: the one that starts first, by doc_id and then by place. Null texts and texts shorter than a
window stay whole. Rows equal in id and text are one document: what they hold at one place is met once. Null ids come last, equal ids in order of text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm import fragments as fr
from skyledger.llm.batches import row_slices
from skyledger.llm.numbered import with_identity
from skyledger.llm.words import Runs, mixed, word_hashes
from skyledger.session import materialize

SEED_WORDS = 6
NO_SOURCE = -1  # as source_start; ids may be negative
PIECES = {"seed": "u8", "path": "u8", "doc": "i8", "start": "i4", "n": "u1", "source": "i8", "source_start": "i4"}
WINDOWS = {"key": "u8", "check": "u4", "doc": "i8", "start": "i4"}
FOUND = "doc long, start int, n int, source long, source_start int"


def _spread(doc: np.ndarray, fragments: int) -> np.ndarray:
    return fr.fragment_of(mixed(doc.astype(np.uint64)), fragments)


def cut_pieces(raws: list[bytes], docs: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Pieces of some texts: seed (hash of the minimiser), path (hash of all words), doc, first window, number of windows."""
    hashes, at = word_hashes(raws)
    n = len(hashes)
    width = window - SEED_WORDS + 1
    counts = np.diff(at)
    if n < window or counts.max() < window:
        return {c: np.zeros(0, kind) for c, kind in PIECES.items()}
    run = Runs(hashes)
    place = np.arange(n - SEED_WORDS + 1)
    seeds = run(place, place + SEED_WORDS)
    low = np.uint64((1 << max(1, int(n).bit_length())) - 1)
    least = (seeds & ~low) | place.astype(np.uint64)
    done = 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:len(least) - step], least[step:])
        done += step
    owner = np.repeat(np.arange(len(raws)), counts)
    windows = np.flatnonzero(np.arange(n) + window <= at[1:][owner])
    chosen = (least[windows] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    size = np.diff(np.append(first, len(windows)))
    start = windows[first]
    doc = owner[start]
    return {"seed": seeds[chosen[first]], "path": run(start, start + size + window - 1), "doc": docs[doc], "start": (start - at[doc]).astype(np.int32),
            "n": size.astype(np.uint8), "source": np.full(len(start), -1), "source_start": np.full(len(start), NO_SOURCE, np.int32)}


def _grouped(columns: dict[str, np.ndarray], keys: tuple[str, ...]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Columns sorted by keys, doc and start; and for each element the index of the first one with its keys.

    Of elements with one place, which repeated rows give, one stays.
    """
    order = np.lexsort([columns[c] for c in ("start", "doc", *reversed(keys))])
    out = {c: x[order] for c, x in columns.items()}
    once = np.ones(len(order), bool)
    once[1:] = np.any([out[k][1:] != out[k][:-1] for k in (*keys, "doc", "start")], axis=0)
    order, out = order[once], {c: x[once] for c, x in out.items()}
    new = np.ones(len(order), bool)
    new[1:] = np.any([out[k][1:] != out[k][:-1] for k in keys], axis=0)
    return out, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def fold_pieces(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Within a task: all but the earliest of equal pieces get that one as source and need not meet the others."""
    out, head = _grouped(columns, ("seed", "path"))
    later = head != np.arange(len(head))
    out["source"] = np.where(later, out["doc"][head], -1)
    out["source_start"] = np.where(later, out["start"][head], NO_SOURCE).astype(np.int32)
    out["seed"] = np.where(later, np.uint64(0), out["seed"])
    out["path"] = np.where(later, np.uint64(0), out["path"])
    return out


def _found(doc, start, n, source, source_start) -> pa.Table:
    return pa.table([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()),
                     pa.array(source, pa.int64(), mask=source_start == NO_SOURCE), pa.array(source_start, pa.int32())], names=["doc", "start", "n", "source", "source_start"])


def meet_pieces(columns: dict[str, np.ndarray]) -> pa.Table:
    """Repeated pieces with their source; and, with a null source, earliest pieces that share a minimiser with others."""
    known = columns["source_start"] != NO_SOURCE
    out, head = _grouped({c: x[~known] for c, x in columns.items()}, ("seed", "path"))
    later = head != np.arange(len(head))
    if len(head):
        group = np.cumsum(np.concatenate([[True], out["seed"][1:] != out["seed"][:-1]])) - 1
        shared = np.bincount(group, weights=~later)[group] >= 2
    else:
        shared = np.zeros(0, bool)
    open_ = ~later & shared
    parts = [tuple(out[c][later] for c in ("doc", "start", "n")) + (out["doc"][head][later], out["start"][head][later]),
             tuple(out[c][open_] for c in ("doc", "start", "n")) + (np.full(int(open_.sum()), -1), np.full(int(open_.sum()), NO_SOURCE, np.int32)),
             tuple(columns[c][known] for c in ("doc", "start", "n", "source", "source_start"))]
    return _found(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def meet_windows(columns: dict[str, np.ndarray]) -> pa.Table:
    out, head = _grouped(columns, ("key", "check"))
    later = head != np.arange(len(head))
    return _found(out["doc"][later], out["start"][later], np.ones(int(later.sum()), np.int32), out["doc"][head][later], out["start"][head][later])


def repeated_pieces(texts: DataFrame, window: int) -> DataFrame:
    """Stored pieces after the first meeting."""
    n = fr.count_fragments(texts.sparkSession)
    slim = texts.filter("text IS NOT NULL").select("uid", F.col("text").alias("__in"))

    def run(batches):
        parts = (cut_pieces([x.encode() for x in b.column("__in").to_pylist()], b.column("uid").to_numpy(), window) for b in row_slices(batches))

        def fragment(c):
            return np.where(c["source_start"] != NO_SOURCE, _spread(c["doc"], n), fr.fragment_of(c["seed"], n))

        yield from fr.gathered(parts, PIECES, fragment, fold=fold_pieces)

    return materialize(fr.by_fragment(slim.mapInArrow(run, fr.schema(PIECES)), meet_pieces, PIECES, FOUND), "pieces")


def repeated_windows(texts: DataFrame, pieces: DataFrame, window: int) -> DataFrame:
    """Windows of the opened pieces that start earlier elsewhere."""
    n = fr.count_fragments(texts.sparkSession)
    wanted = pieces.filter("source IS NULL").groupBy(F.col("doc").alias("uid")).agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("sizes"))
    rows = texts.dropna(subset=["text"]).join(wanted, "uid").select("uid", "starts", "sizes", F.col("text").alias("__in"))

    def one(batch):
        hashes, at = word_hashes([x.encode() for x in batch.column("__in").to_pylist()])
        run, again = Runs(hashes), Runs(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)))
        uid = batch.column("uid").to_numpy()
        starts, sizes = batch.column("starts"), batch.column("sizes")
        per_doc = np.diff(np.asarray(starts.offsets))
        begin, size = starts.flatten().to_numpy().astype(np.int64), sizes.flatten().to_numpy().astype(np.int64)
        owner = np.repeat(np.repeat(np.arange(len(uid)), per_doc), size)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        begin = np.repeat(begin, size) + inside
        absolute = begin + at[owner]
        return {"key": run(absolute, absolute + window), "check": (again(absolute, absolute + window) >> np.uint64(32)).astype(np.uint32), "doc": uid[owner], "start": begin.astype(np.int32)}

    def run(batches):
        yield from fr.gathered(map(one, row_slices(batches)), WINDOWS, lambda c: fr.fragment_of(c["key"], n))

    return fr.by_fragment(rows.mapInArrow(run, fr.schema(WINDOWS)), meet_windows, WINDOWS, FOUND)


def compacted(found: DataFrame) -> DataFrame:
    """(uid, start, n, source, source_start): repeated windows start .. start + n - 1 of a text, as long spans.

    Neighbours compact while they continue at the same distance from the source, which their coordinates show.
    """
    line = Window.partitionBy("doc").orderBy("start")
    gap = F.struct("source", (F.col("start") - F.col("source_start")).alias("distance"))
    follows = (F.lag(F.col("start") + F.col("n")).over(line) == F.col("start")) & (F.lag(gap).over(line) == gap)
    rows = found.withColumn("path", F.sum(F.when(follows, 0).otherwise(1)).over(line))
    return rows.groupBy("doc", "path").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.min("source").alias("source"), F.min("source_start").alias("source_start")).select(
        F.col("doc").alias("uid"), "start", "n", "source", "source_start")


def repeated_spans(texts: DataFrame, window: int = 20) -> DataFrame:
    """Spans of windows that start earlier elsewhere, for texts of `with_identity`."""
    pieces = repeated_pieces(texts, window)
    windows = repeated_windows(texts, pieces, window)
    return compacted(pieces.filter("source IS NOT NULL").unionByName(windows))


def remove(texts: DataFrame, spans: DataFrame, window: int, digest: bool) -> DataFrame:
    """Texts without the words under their spans: (doc_id, n_words, n_removed, kept_sha256), or the kept text instead of its digest."""
    per_text = spans.groupBy("uid").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("sizes"))
    rows = texts.join(per_text, "uid", "left").select("doc_id", "starts", "sizes", F.col("text").alias("__in"))
    name = "kept_sha256" if digest else "kept_text"

    def run(batches):
        for batch in row_slices(batches):
            total, gone, kept = [], [], []
            for text, starts, sizes in zip(batch.column("__in").to_pylist(), batch.column("starts").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                words = (text or "").encode().split()
                count = 0
                if starts:
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, np.add(starts, sizes) + window - 1, -1)
                    under = np.cumsum(edges[:-1]) > 0
                    count = int(under.sum())
                    left = b" ".join([w for w, x in zip(words, under.tolist(), strict=True) if not x])
                else:
                    left = b" ".join(words)
                total.append(len(words))
                gone.append(count)
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", name])

    return rows.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {name} string")


def dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Remove from every document the words of windows that start earlier in the corpus."""
    texts = with_identity(docs, id_col, text_col)
    return remove(texts, repeated_spans(texts, window), window, digest)
