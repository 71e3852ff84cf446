"""The commands of a whole run, from a folder of texts to merged entities; each returns DataFrames and writes nothing by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import canonical, emails, entities, resolve, survey
from folioscope.session import cut
from folioscope.sources import corpus, sinks


def run_survey(spark: SparkSession, folder: str, seeds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(classifications, report) of the text files below a folder."""
    c = cut(survey.classify(corpus.read_corpus(spark, folder).drop("doc_id", "file_size"), seeds))
    return c, survey.report(c)


def load(classified: DataFrame, files: DataFrame, old: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, entity_mentions, counters): classified files with their text, upserted by doc_id over what was there."""
    status = cut(sinks.load_status(classified, files))
    good = status.filter("status = 'loaded'")
    docs = good.select("doc_id", "filepath", F.col("document_type").alias("doc_type"), "confidence", F.col("line_count").cast("int").alias("line_count"), "full_text")
    docs = sinks.upsert(old, docs, ["doc_id"]) if old is not None else docs
    return docs, good.select("doc_id", F.explode("entity_mentions").alias("entity_name")).distinct(), sinks.counters(status)


def extract(docs: DataFrame, key: str = "doc_id", text: str = "full_text", doc_ids: list | None = None, extractor=None) -> dict[str, DataFrame]:
    """entities, document_entities, email_metadata, thread_messages; run again, it gives the same tables.

    ``doc_ids`` restricts the run to some documents, as its caller asks; ``extractor`` adds what a model names.
    """
    docs = corpus.by_keys(docs, key, doc_ids) if doc_ids is not None else docs
    found = entities.mentions(docs, key, text)
    found = cut(entities.merged(found, entities.by_model(docs, key, text, extractor), key) if extractor else found)
    table = cut(entities.entity_table(found, key))
    parsed = cut(emails.parse(docs.filter("doc_type = 'email'"), key, text))
    return {"entities": table, "document_entities": entities.with_ids(found, table), "email_metadata": emails.metadata_rows(parsed, key), "thread_messages": emails.thread_rows(parsed, key)}


def extraction_counters(tables: dict[str, DataFrame], docs: DataFrame) -> DataFrame:
    """One row: documents, mentions, entities, mails, thread messages, mails with issues."""
    one = [
        docs.agg(F.count("*").alias("documents")),
        tables["document_entities"].agg(F.count("*").alias("mentions")),
        tables["entities"].agg(F.count("*").alias("entities")),
        tables["email_metadata"].agg(F.count("*").alias("emails"), F.count("parsing_issues").alias("with_issues")),
        tables["thread_messages"].agg(F.count("*").alias("thread_messages")),
    ]
    out = one[0].withColumn("_k", F.lit(1))
    for t in one[1:]:
        out = out.join(t.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def find_duplicates(entity_table: DataFrame, aliases: DataFrame, kind: str | None = "person", least_count: int = 5, limit: int = 200) -> DataFrame:
    """The report's pairs in their order: the ``limit`` surest of entities of at least ``least_count`` occurrences that no merge has moved."""
    return resolve.ordered(resolve.tiers(resolve.candidates(entity_table, aliases, kind, least_count), limit))


def auto_merge(pairs: DataFrame, aliases: DataFrame, canonicals: DataFrame, entity_table: DataFrame, least: float = 0.95, dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(aliases, canonicals, log); a dry run only makes the log."""
    moves, log = canonical.auto_merge(pairs, aliases, least)
    if dry_run:
        return aliases, canonicals, log
    moved = cut(canonical.merge(aliases, moves))
    return moved, canonical.totals(canonicals, moved, entity_table), log


def review(pairs: DataFrame, mentions: DataFrame, aliases: DataFrame, decide, low: float = 0.80, high: float = 0.95, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(aliases, verdicts): pairs of the middle tier that ``decide`` approves are merged in their order; a dry run only makes the verdicts."""
    verdicts = cut(canonical.reviewed(canonical.review_cases(pairs, mentions, low, high), decide))
    if dry_run:
        return aliases, verdicts
    moves, _ = canonical.auto_merge(verdicts.filter("should_merge"), aliases, low, "llm")
    return canonical.merge(aliases, moves, "llm", "llm"), verdicts
