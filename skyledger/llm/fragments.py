"""Numpy columns dealt to fragments: each task sends one record per fragment, not one per element.

A flush of a map task sorts its elements by fragment and packs every column of a fragment into one binary value;
the bytes of wide integers are stored plane by plane, which the shuffle's compression likes. `groupBy(FRAGMENT)
.applyInArrow` then sees all elements of one fragment, a share of the data that the number of fragments sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skyledger.llm.batches import row_slices

FRAGMENT = "fragment"


def count_fragments(spark: SparkSession, per_partition: int = 4, least: int = 16) -> int:
    """Fragments in proportion to the shuffle partitions, which the cluster sizes by its input."""
    return max(least, per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")))


def pack(x: np.ndarray) -> bytes:
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""


def unpack(raw: bytes, kind: np.dtype) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def fragment_of(key: np.ndarray, fragments: int) -> np.ndarray:
    """Equal ranges of a 64-bit key."""
    return ((key >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int32)


def schema(kinds: dict[str, str]) -> str:
    return f"{FRAGMENT} int, " + ", ".join(f"{c} binary" for c in kinds)


def dealt(fragment: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One record per fragment."""
    order = np.argsort(fragment, kind="stable")
    ids, first = np.unique(fragment[order], return_index=True)
    ends = [*first[1:].tolist(), len(order)]
    names, arrays = [FRAGMENT, *columns], [pa.array(ids, pa.int32())]
    for c in names[1:]:
        x = columns.pop(c)[order]  # a column is let go of before the next one is packed
        arrays.append(pa.array([pack(x[a:b]) for a, b in zip(first, ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def gathered(found: Iterator[dict[str, np.ndarray]], kinds: dict[str, str], fragment: Callable[[dict], np.ndarray], flush: int = 1 << 20,
             fold: Callable[[dict], dict] | None = None) -> Iterator[pa.RecordBatch]:
    """Collect the columns that a task finds and deal them, in small batches, whenever `flush` elements have come together."""
    held: list[dict] = []
    n = 0
    for part in found:
        size = len(next(iter(part.values())))
        if not size:
            continue
        held.append(part)
        n += size
        if n >= flush:
            yield from row_slices([_flush(held, kinds, fragment, fold)], next(iter(kinds)))
            held, n = [], 0
    if held:
        yield from row_slices([_flush(held, kinds, fragment, fold)], next(iter(kinds)))


def _flush(held, kinds, fragment, fold) -> pa.RecordBatch:
    columns = {c: np.concatenate([p.pop(c) for p in held]).astype(kind, copy=False) for c, kind in kinds.items()}
    if fold:
        columns = fold(columns)
    return dealt(fragment(columns), columns)


def opened(table: pa.Table, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """The columns of one fragment."""
    return {c: np.concatenate([unpack(x, kind) for x in table.column(c).to_pylist()]) for c, kind in kinds.items()}


def by_fragment(df: DataFrame, run: Callable[[dict[str, np.ndarray]], pa.Table], kinds: dict[str, str], out: str) -> DataFrame:
    """Apply run to the columns of each fragment."""
    return df.groupBy(FRAGMENT).applyInArrow(lambda table: run(opened(table, kinds)), out)
