"""A training corpus from raw documents: STAGES in order, each written and read again before the next.

Every stage works on all documents that the one before it kept and returns the columns of `documents`; the last
one returns the encoded corpus. Nulls, repeated rows and empty tables are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import bpe, jaccard_join, mixing, numbered, quality, secrets
from skyledger.llm.filters import with_possible
from skyledger.session import materialize, scratch_path

UID = "__uid"


def _keyed(docs: DataFrame) -> DataFrame:
    return numbered.with_uid(docs, "doc_id", F.coalesce(F.sha2("text", 256), F.lit("")), UID)


def without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in dropped; only those are moved that a filter of fixed size does not clear."""
    hashed = F.xxhash64(key)
    flagged = with_possible(rows, hashed, dropped, hashed, "__suspect")
    rest = flagged.filter("__suspect").join(dropped.hint("merge"), key, "left_anti")
    return flagged.filter("NOT __suspect").unionByName(rest).drop("__suspect")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the co-trained classifier rejects."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model, prefix="__q_")
    return scored.filter("__q_kept").select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of every group of near copies."""
    keyed = _keyed(docs)
    groups = jaccard_join.join_components(keyed, UID)
    dropped = materialize(groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(UID)), "dropped")
    rows = without(keyed, dropped, UID)
    if not numbered.ids_are_unique(docs, "doc_id"):
        rows = rows.dropDuplicates([UID])
    return rows.select(docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets found in the texts; no document is dropped."""
    found = secrets.scan(docs).filter("is_secret")
    masked = secrets.mask(docs, found)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources meet their weights; a part of a copy counts from a half on."""
    keyed = _keyed(docs)
    cuts = mixing.cutoffs(mixing.sized(keyed, id_col=UID))
    rows = mixing.with_copies(keyed, cuts, id_col=UID, out="__copies").filter("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every document and decode it again."""
    import public_tokenizers

    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))
    return bpe.round_trip(docs, vocabulary)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]
#: A trained classifier has no SQL; tests hold every stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a table folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
