"""A training corpus from documents, stage by stage; each stage reads what the one before has written."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import cut, fresh_folder, only, table
from panelwright.llm.jaccard_join import jaccard_classes
from panelwright.llm.language_id import keep_languages, train_language
from panelwright.llm.mixing import form_topic, keep_mixed
from panelwright.llm.packing import pack_documents
from panelwright.llm.pii import mask_pii
from panelwright.llm.queries import _vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Null or empty text, text without a letter, or torn between languages, goes; repeated rows fare alike."""
    return keep_languages(docs, train_language(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    Where no doc_id repeats, the one with the smallest id stays. Where some do, a row is known by its place in the
    checkpointed table instead of its id, so that different texts under one id are judged each, and of repeated rows
    one stays. Null ids stay; texts without words are linked with nothing, so they stay, repeated ones too.
    """
    repeated = not only(docs, "doc_id").where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    if not repeated:
        found = jaccard_classes(docs, width=5, threshold=Fraction(8, 10))
        return docs.join(found.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    rows = cut(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("place")))
    known = rows.where("row.doc_id IS NOT NULL").select("place", F.col("row.text").alias("text"))
    found = jaccard_classes(known, "place", width=5, threshold=Fraction(8, 10))
    return rows.join(found.where("doc_id <> component_id").select(F.col("doc_id").alias("place")), "place", "left_anti").select("row.*")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked by its kind, and n_chars counted anew. Null text stays null."""
    return mask_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that the tokens' sources, languages and topics have tempered shares. Null values are values of their own; null ids and repeated rows are decided by the hash like all."""
    return keep_mixed(docs, form_topic(F.col("text")), budget=0.8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The plan of the packed corpus: where each piece of each document lies in the sequences of 4096 tokens. Null or empty text is one piece of one token."""
    return pack_documents(docs, _vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("pii", pii),
    ("mixing", mixing),
    ("packing", packing),
]
#: No SQL: the first stage is a fitted model, the third a network.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. All stages take and hand on empty tables and columns they don't know, whatever their names."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        place = fresh_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
