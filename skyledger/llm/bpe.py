"""Byte-pair encoding with a priority queue of merge ranks over a doubly linked symbol list.

A text is cut at the special tokens, normalised (NFC, white space to one space, lower case) and split into
words. Each word starts as a linked list of byte symbols; the queue yields the pair of lowest rank, leftmost
first; an entry whose symbols have changed since it was queued is stale and skipped. Decoding looks the ids up
and joins the vocabulary strings as the file's decoder says.

The tokenizer file is read once on the driver and its tables (a fixed size) travel with the tasks. Encoding is
a map over the rows: no shuffle, whole texts, one record batch at a time. A null text counts as empty.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from skyledger.llm.batches import row_slices, small_batches, tidy

CACHE_WORDS = 150_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stays, the rest is numbered from U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    """The tables of one tokenizer file."""

    ids: dict[str, int]
    merges: dict[tuple[int, int], tuple[int, int]]  # pair of ids -> (rank, merged id)
    special: dict[str, int]
    word_pattern: str
    end: str
    words: dict[str, tuple[int, str, str]] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, ids = spec["model"], spec["model"]["vocab"]
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges[ids[a], ids[b]] = (rank, ids[a + b])
        if spec.get("decoder") is not None:
            raise ValueError("only files without a decoder (tokens joined by a space) are supported")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        return cls(ids, merges, {t["content"]: t["id"] for t in spec["added_tokens"]}, pattern, model["end_of_word_suffix"])

    def __getstate__(self):
        return self.__dict__ | {"words": {}}


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        v = self.vocabulary = vocabulary
        symbols = byte_symbols()
        self.inner = [v.ids[s] for s in symbols]
        self.last = [v.ids[s + v.end] for s in symbols]
        self.find = regex.compile(v.word_pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")").split if v.special else None
        self.space = regex.compile(r"\s+").sub
        self.strings = {i: s for s, i in (v.ids | v.special).items()}

    def merge(self, word: str) -> list[int]:
        """Ids of one word."""
        raw = word.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = self.vocabulary.merges
        queue = [(found[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale: one of the two has been merged meanwhile
            ids[i], ids[j] = merges[a, b][1], -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if found := merges.get((ids[i], ids[j])):
                    heapq.heappush(queue, (found[0], i, ids[i], ids[j]))
            h = before[i]
            if h >= 0 and (found := merges.get((ids[h], ids[i]))):
                heapq.heappush(queue, (found[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def pieces(self, text: str) -> Iterator[str | int]:
        """Words of a text; a special token comes as its id."""
        special = self.vocabulary.special
        parts = self.cut(text) if self.cut and any(s in text for s in special) else [text]
        for part in parts:
            if part in special:
                yield special[part]
            elif part:
                flat = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
                yield from self.find(self.space(" ", flat).lower())

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(text):
            out += [piece] if isinstance(piece, int) else self.merge(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Token count, and digests of the ids and of the decoded text; words are looked up in a bounded cache."""
        cache, n, ids, strings = self.vocabulary.words, 0, [], []
        for piece in self.pieces(text):
            if (known := cache.get(piece)) is None:
                own = [piece] if isinstance(piece, int) else self.merge(piece)
                known = (len(own), " ".join(map(str, own)), self.decode(own))
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                cache[piece] = known
            n += known[0]
            ids.append(known[1])
            strings.append(known[2])
        return n, hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(" ".join(strings).encode()).hexdigest()


def _map(df: DataFrame, vocabulary: Vocabulary, text_col: str, keep: list[str], fields: str, one) -> DataFrame:
    """Apply one(codec, value) -> tuple to each row of `text_col`, beside the columns of `keep`."""
    small_batches(df.sparkSession)
    slim = df.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).alias("__in"))
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # a tokenizer file's tables, a fixed size
    schema = StructType([*slim.drop("__in").schema.fields, *StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        codec = Codec(shared.value)
        for batch in row_slices(batches):
            rows = [one(codec, x) for x in batch.column("__in").to_pylist()]
            made = [pa.array(values, arrow.field(len(keep) + k).type) for k, values in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], schema=arrow)

    return slim.mapInArrow(tidy(run), schema)


def encode(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<int>) of every row."""
    return _map(df, vocabulary, text_col, [id_col], "ids array<int>", lambda c, x: (c.encode(x or ""),))


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(id, decoded string) of every row; null ids decode to an empty text."""
    return _map(df, vocabulary, ids_col, [id_col], "decoded string", lambda c, x: (c.decode(x or []),))


def round_trip(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row, without storing ids or decoded texts."""
    return _map(df, vocabulary, text_col, [id_col], "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda c, x: c.digest(x or ""))
