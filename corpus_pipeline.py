"""From raw documents to packed token sequences, in five stages; each is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import materialize
from rillflow.llm.jaccard import BROADCAST_IDS, ngram_jaccard
from rillflow.llm.mixing import mixed_documents
from rillflow.llm.packing import pack
from rillflow.llm.quality import line_quality
from rillflow.llm.secrets import redact, secret_spans
from rillflow.llm.tokens import token_pieces


def _apart(docs: DataFrame) -> DataFrame:
    """The text beside all columns in one, so that none clashes with what an operator adds."""
    return docs.select(F.struct(*docs.columns).alias("_row"), "text")


def _with_text(df: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of docs again, with a new text and its length."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return df.select(*((new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    return _with_text(line_quality(_apart(docs)).where("kept"), docs, "cleaned_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group at five words and a similarity of 0.8: the one with the smallest doc_id.

    A row is known by its doc_id and text together (a 64-bit hash of both). Rows that share a doc_id but whose texts are
    not linked all stay; rows equal in both are one document, of which the row with the least other columns (as JSON) stays.
    Rows with a null doc_id take no part.
    """
    keyed = docs.withColumn("_key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    found = ngram_jaccard(keyed.where("_key is not null").select(F.col("_key").alias("doc_id"), "text"), 5, 80, 100)
    found = materialize(found.select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_group")), "groups")
    linked = found.where("_group != _key").select("_key", "_group")
    members = materialize(linked.union(linked.select("_group", "_group")).distinct(), "members")
    ids = keyed.select("_key", "doc_id").join(members, "_key").groupBy("_group").agg(F.min(F.struct("doc_id", "_key")).alias("first"))
    gone = materialize(members.join(ids.select(F.col("first._key").alias("_key")), "_key", "left_anti").select("_key"), "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = keyed.join(F.broadcast(gone) if few else gone, "_key", "left_anti")
    if not found.groupBy("_key").count().where("count > 1").isEmpty():
        other = F.to_json(F.struct(*(c for c in docs.columns if c != "text")))
        one = kept.where("_key is not null").groupBy("_key").agg(F.min_by(F.struct(*docs.columns), other).alias("_row")).select("_row.*")
        return one.unionByName(kept.where("_key is null").select(*docs.columns))
    return kept.select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return _with_text(redact(secret_spans(_apart(docs))), docs, "text")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, shuffled."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 4096 tokens."""
    return pack(materialize(token_pieces(docs), "pieces"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing sources to target weights", mixing), ("best-fit packing", packing)]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
