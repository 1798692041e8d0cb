"""A corpus pipeline of five stages: language ID, quality rules, near-dedup, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and reads it back as
the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, decontaminate, langid, maxent, minhash, quality
from tidemill.llm.queries import table, vocabulary
from tidemill.llm.shared import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents whose language can't be told: null texts, texts without a letter, and texts with a smaller cosine than
    any labelled one of the same predicted language and about the same length. If no language was learned, texts with a letter stay.
    """
    profiles = langid.fit(docs.where(~maxent.held_out(F.col("doc_id"), 5, 0)))
    if not profiles.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    floors = langid.floors(langid.predict(docs.where("lang IS NOT NULL").select("text"), profiles).where("lang_pred <> 'und'"))
    found = langid.predict(docs, profiles).where("lang_pred <> 'und'").withColumn("band", langid.band())
    return found.join(F.broadcast(floors), ["lang_pred", "band"], "left").where("floor IS NULL OR score >= floor - 1e-5").select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that fail a quality rule."""
    return quality.cascade(docs).where("rejected_by IS NULL").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates, and one row of repeated rows."""
    found = stored(spark, minhash.near_duplicates(spark, docs))
    kept = docs.join(found.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti")
    if not found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id IS NULL"))
    return kept.select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; a document of which no word is left goes."""
    items = table(spark, sf_dir, "benchmark")
    scanned = decontaminate.contamination(docs, items).where("n_words > n_hit OR n_hit = 0")
    cut = decontaminate.remove_spans(scanned, items)
    return cut.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their digest and that of the decoded text."""
    return bpe.round_trip(docs.select("doc_id", "text"), vocabulary()).select("doc_id", "ids", *bpe.digests())


STAGES = [("language", language), ("quality", rules), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir))
    return docs


#: SQL can't express the language model, the vocabulary or the cascade's order; tests hold the stages against brute force.
ORACLE_SQL = None
