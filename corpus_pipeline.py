"""Corpus pipeline: quality filter, near-duplicate removal, pseudonyms, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's docs. All but the last return the columns of ``documents``.
No stage depends on columns beyond ``doc_id``, ``text`` and ``source``; others pass through.
An empty corpus passes every stage and stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import curriculum, pieces, pseudonyms, quality, setsketch
from tidemark.llm.common import read_table
from tidemark.llm.queries import MODEL, PSEUDONYM_KEY, QUERIES


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not reject. Its labels are those of ``labels`` that are not held out."""
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality.train_and_score(docs, labels)[1]
    return docs.where(quality.text_score(model, F.col("text")) >= 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (5-word shingles, similarity 0.8): the smallest id.

    Of repeated rows (same id and text) one stays. Documents without words form no group.
    """
    found = setsketch.near_duplicates(docs, shingle_words=5).where("kept and doc_id is not null")
    keep = found.select(F.col("doc_id").alias("kept id"), F.col("n_shingles").alias("kept n")).dropDuplicates(["kept id"])
    joined = docs.join(keep, F.col("doc_id") == F.col("kept id")).dropDuplicates(["doc_id", "text"]).select(
        *[F.col(f"`{c}`") for c in docs.columns])
    return joined.unionByName(docs.where("doc_id is null"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values permuted within their format; ``n_chars`` does not change."""
    return pseudonyms.pseudonymised(docs, PSEUDONYM_KEY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus in training order: documents repeated as the mix takes them."""
    return curriculum.in_training_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as subword ids with the byte span of each piece."""
    import public_tokenizers

    model = pieces.read_model(public_tokenizers.path(MODEL))
    return pieces.encode(docs.select("doc_id", "source", "text"), model).select("doc_id", "source", "ids", "begins", "ends")


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("pseudonyms", pseudonymise), ("mix", mix), ("encode", encode)]

# SQL cannot express the classifier, the pseudonyms and the encoding; tests compare each
# stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = quality.checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES["pipeline"] = run
