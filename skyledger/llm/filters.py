"""A filter of fixed size over 64-bit hashes: it spares rows a move, and what it lets through is joined exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed size: 2^26 bits in at most 2^20 cells. A full filter costs time, not results.
BITS = 26
CELL, HELD = "__cell", "__held"


def _place(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - BITS)


def _cells(key: Column, wanted: DataFrame) -> DataFrame:
    """(cell, held): the bits at the leading bits of the keys of wanted, 64 to a cell."""
    places = wanted.select(_place(key).alias("place"))
    return places.groupBy(F.shiftright("place", 6).alias(CELL)).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias(HELD))


def with_possible(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, flag: str) -> DataFrame:
    """Add `flag`: false only where no row of wanted has this key."""
    placed = rows.withColumn("__place", _place(key))
    found = placed.join(F.broadcast(_cells(wanted_key, wanted)), F.shiftright("__place", 6) == F.col(CELL), "left")
    bit = F.expr(f"shiftrightunsigned({HELD}, cast(__place & 63 as int)) & 1L = 1L")
    return found.withColumn(flag, F.coalesce(bit, F.lit(False))).drop("__place", CELL, HELD)
