"""Quality rules with cross-document line frequency. DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated 8-word windows inside one text. The cross-document
rule hashes every normalised line (lower case, one space between words, digits as 0), counts for each host the
distinct documents that hold it, removes lines above the limit and rejects documents that lose too many words.
Every document counts, copies of a text too; rows equal in id and text are one document.

The limit is `most` documents of a host, whatever its size; on a small host it is tighter: `share` of its
documents, but at least `least`. So at most one line in `least` of a host, by occurrences, can be above it.

Nulls: a null text has no words and fails the base rules; null hosts are one host, null ids one id. Repeated rows
get equal results. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.numbered import ids_are_unique
from skyledger.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _chars(text: Column, dropped: str) -> Column:
    return F.length(F.translate(text, dropped, ""))


def worded_lines(text: Column) -> Column:
    """The lines that hold a word, in order."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)


def normal_line(line: Column) -> Column:
    spaced = F.trim(F.regexp_replace(line, SPACE, " "))
    return F.translate(F.lower(spaced), "123456789", "0" * 9)


def base_rules(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, host, text_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) per row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "host", "text", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"), worded_lines(F.col("text")).alias("lines"))
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "doc_id", "host", "text_key", n.cast("long").alias("n_words"),
        _chars(F.col("text"), SPACES).cast("long").alias("word_chars"),
        (F.length("text") - _chars(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("windows"))
    # most texts repeat no window; only the others are sorted
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    placed = F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.select("doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", placed.alias("placed"))
    same = F.filter("placed", lambda x, i: (x.h == F.get("placed", i - 1).h) | (x.h == F.get("placed", i + 1).h))
    starts = F.array_sort(F.transform(same, lambda x: x.i))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
                          lambda a, i: F.struct((i + WINDOW).alias("end"), (a.n + i + WINDOW - F.greatest(a.end, i)).alias("n")), lambda a: a.n)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("placed")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def host_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(host, text_key, place, line, n_words) per line with a word; line is a hash of the normalised line."""
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.xxhash64(host_col).alias("host"), F.xxhash64(text_col).alias("text_key"), F.posexplode(worded_lines(F.col(text_col))).alias("place", "raw"))
    return rows.select("host", "text_key", "place", F.xxhash64(normal_line(F.col("raw"))).alias("line"), F.size(words_of(F.col("raw"))).alias("n_words"))


def frequent_lines(docs: DataFrame, most: int = 100, share: float = 0.1, least: int = 20,
                   id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(host, line, n_docs): lines in more documents of their host than its limit.

    A document lists each of its lines once. Where ids are unique these are counted as they come, folded in each
    task; else documents are first told apart by id and text.
    """
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.xxhash64(host_col).alias("host"), F.xxhash64(id_col, text_col).alias("doc"), F.col(text_col).alias("text"))
    own = F.array_distinct(F.transform(worded_lines(F.col("text")), lambda x: F.xxhash64(normal_line(x))))
    hosts, lines = texts.select("host", "doc"), texts.select("host", "doc", F.explode(own).alias("line"))
    if not ids_are_unique(docs, id_col):
        hosts, lines = hosts.distinct(), lines.distinct()
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > least)
    limits = hosts.groupBy("host").agg(F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), F.count(F.lit(1)) * share)).alias("limit"))
    return counts.join(limits, "host").filter("n_docs > limit").select("host", "line", "n_docs")


def rules(docs: DataFrame, most: int = 100, share: float = 0.1, least: int = 20, min_left: float = 0.3,
          id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """Base counts and verdict of every document, with the words lost to frequent lines.

    A document is depleted when less than `min_left` of its words stay.
    """
    frequent = materialize(frequent_lines(docs, most, share, least, id_col, host_col, text_col), "lines")
    hits = host_lines(docs, host_col, text_col).join(frequent, ["host", "line"])
    lost = hits.groupBy("host", "text_key", "place").agg(F.min("n_words").alias("n_words")).groupBy("host", "text_key").agg(F.sum("n_words").alias("n_line_words"))
    rows = base_rules(docs, id_col, host_col, text_col).join(lost, ["host", "text_key"], "left")
    rows = rows.withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0)).cast("long"))
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("n_line_words") >= min_left * F.col("n_words"))
    return rows.withColumn("kept", kept).drop("host", "text_key")


def clean_text(docs: DataFrame, frequent: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents' texts without their frequent lines: (doc_id, text). Texts with none of them stay as they are."""
    hits = host_lines(docs, host_col, text_col).join(frequent, ["host", "line"]).select("host", "text_key", "line").distinct()
    bad = hits.groupBy("host", "text_key").agg(F.collect_list("line").alias("bad"))
    rows = docs.withColumn("host", F.xxhash64(host_col)).withColumn("text_key", F.xxhash64(text_col)).join(bad, ["host", "text_key"], "left")
    left = F.array_join(F.filter(F.split(text_col, "\n"), lambda x: ~F.array_contains("bad", F.xxhash64(normal_line(x)))), "\n")
    return rows.select(F.col(id_col).alias("doc_id"), F.when(F.col("bad").isNull(), F.col(text_col)).otherwise(left).alias("text"))
