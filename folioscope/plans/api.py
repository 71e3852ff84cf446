"""The operations that users call, as functions from tables to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators import search as fts


def get_document(documents: DataFrame, mentions: DataFrame, doc_id) -> DataFrame:
    """One document with the sorted array of its entity names."""
    names = mentions.filter(F.col("doc_id") == doc_id).groupBy("doc_id").agg(F.array_sort(F.collect_set("entity_name")).alias("entities"))
    d = documents.filter(F.col("doc_id") == doc_id).join(names, "doc_id", "left")
    return d.withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def find_by_entity(documents: DataFrame, mentions: DataFrame, entity: str, limit: int = 20) -> DataFrame:
    m = mentions.filter(F.col("entity_name") == entity).select("doc_id").distinct()
    return documents.join(m, "doc_id").orderBy(F.desc_nulls_last("confidence"), "doc_id").limit(min(limit, 100))


def list_entities(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("entity_name").agg(F.count("*").alias("documents"))


def document_stats(documents: DataFrame, mentions: DataFrame, k: int = 10) -> DataFrame:
    """section, name, n: all documents, documents by type, and the ``k`` most named entities."""
    total = documents.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit(None).cast("string").alias("name"), "n")
    types = documents.groupBy("doc_type").agg(F.count("*").alias("n")).select(F.lit("type").alias("section"), F.col("doc_type").alias("name"), "n")
    top = list_entities(mentions).orderBy(F.desc("documents"), "entity_name").limit(k).select(F.lit("entity").alias("section"), F.col("entity_name").alias("name"), F.col("documents").alias("n"))
    return total.unionByName(types).unionByName(top)


def entity_mentions(entities: DataFrame, document_entities: DataFrame, documents: DataFrame, name: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """For each entity whose text or normal form begins a phrase with ``name``: its ``limit`` surest mentions."""
    hit = fts.prefix_phrase(F.col("text"), name) | fts.prefix_phrase(F.col("normalized_text"), name)
    e = entities.filter(hit)
    if kind:
        e = e.filter(F.col("type") == kind)
    m = document_entities.join(e.select("entity_id", "text", "type", "occurrence_count"), "entity_id").join(documents.select("doc_id", "doc_type"), "doc_id")
    m = m.dropDuplicates(["mention_id"])
    best = F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc_nulls_last("confidence"), "doc_id", "mention_id"))
    return m.withColumn("place", best).filter(F.col("place") <= limit).select("entity_id", "text", "type", "doc_id", "doc_type", "context", "confidence", "method", "place")


def email_threads(threads: DataFrame, documents: DataFrame, mails: DataFrame, participant: str, limit: int = 20) -> DataFrame:
    """Messages whose author fits, newest date text first, nulls last, with their mail's subject and sender where it has any."""
    t = threads.filter(fts.prefix_phrase(F.col("author"), participant)).join(documents.select("doc_id", "filepath"), "doc_id")
    m = mails.select("doc_id", "subject", "from_addr")
    return t.join(m, "doc_id", "left").orderBy(F.desc_nulls_last("date"), "doc_id", "message_index").limit(limit).select("doc_id", "filepath", "subject", "from_addr", "author", "date", "message_index")


def dead_letters(mails: DataFrame, documents: DataFrame, limit: int = 20) -> DataFrame:
    """Mails with parsing issues, in the order of doc_id."""
    m = mails.filter("parsing_issues is not null and parsing_issues <> '[]'").join(documents.select("doc_id", "filepath"), "doc_id")
    return m.withColumn("issues", F.from_json("parsing_issues", "array<string>")).orderBy("doc_id").limit(limit).select("doc_id", "filepath", "subject", "from_addr", "issues")


def list_emails(classified: DataFrame, least: float = 0.7, entity: str | None = None) -> DataFrame:
    d = classified.filter((F.col("document_type") == "email") & (F.col("confidence") >= least))
    if entity:
        d = d.filter(F.array_contains("entity_mentions", entity))
    return d.orderBy(F.desc("confidence"), "doc_id")
