"""Row identities: the id itself where it is unique, else a number in id order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.session import materialize


def ids_are_unique(df: DataFrame, id_col: str) -> bool:
    found = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("ids")).first()
    return found.n == found.ids


def with_uid(df: DataFrame, id_col: str, content: Column, uid: str = "uid") -> DataFrame:
    """Add `uid` (long), unique and ordered like the id; null ids come last, equal ids in order of `content`, a text.

    Ids that are unique and not null serve as they are. Otherwise rows are numbered: sorted ranges are counted one
    by one and shifted by the rows before them, so no task sees more than its range. Rows equal in id and content
    share a number: they are one record and get equal results.
    """
    if ids_are_unique(df, id_col):
        return df.withColumn(uid, F.col(id_col).cast("long"))
    keys = df.select(F.col(id_col).alias("id"), content.alias("content")).distinct()
    spread = keys.repartitionByRange(F.col("id").asc_nulls_last(), "content").withColumn("part", F.spark_partition_id())
    parts = materialize(spread, "ids")
    counts = {r.part: r.n for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number per partition
    before, total = [], 0
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    offsets = df.sparkSession.createDataFrame(before, "part int, before long")
    order = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_last(), "content")
    numbers = parts.withColumn("place", F.row_number().over(order)).join(F.broadcast(offsets), "part").select(
        F.col("id").alias("__id"), F.col("content").alias("__content"), (F.col("before") + F.col("place") - 1).alias(uid))
    return df.withColumn("__own", content).join(numbers, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__content"))).drop("__id", "__content", "__own")


def with_identity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, text) of documents."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_uid(slim, "doc_id", F.coalesce(F.sha2("text", 256), F.lit("")))
