"""Survey classifier: rule scores for each document, seed tagging, issues and an aggregate report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.text import lines

# Header patterns of a mail; a fifth one, of a tracked address, is a parameter.
MAIL_PATTERNS = (r"^From:\s+.+", r"^To:\s+.+", r"^Subject:\s+.+", r"^Sent:\s+\d{1,2}/\d{1,2}/\d{4}")


def doc_id(path: Column, pattern: str = r"HOUSE_OVERSIGHT_\d+") -> Column:
    """The first match of ``pattern`` in the file's stem, else the stem."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_extract(stem, pattern, 0), F.lit("")), stem)


def mail_score(rows: Column, tracked: str) -> Column:
    head = F.array_join(F.slice(rows, 1, 20), "\n\n")
    return sum((F.when(head.rlike("(?imd)" + p), 1.0).otherwise(0.0) for p in (*MAIL_PATTERNS, tracked)), F.lit(0.0)) / F.lit(5.0)


def narrative_score(text: Column, rows: Column) -> Column:
    head = F.array_join(F.slice(rows, 1, 10), "\n\n")
    score = F.when(F.size(rows) > 100, 0.3).otherwise(0.0) + F.when(~head.rlike(r"(?md)^(From|To|Subject|Sent):"), 0.3).otherwise(0.0)
    score = score + F.when(text.contains("(L to R)"), 0.2).otherwise(0.0) + F.when(text.rlike(r"(?i)photograph(?:ed|er)"), 0.2).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def html_score(text: Column) -> Column:
    score = F.when(text.rlike(r"<https?://"), 0.4).otherwise(0.0) + F.when(text.rlike(r"(?i)<!DOCTYPE|<html|<body"), 0.3).otherwise(0.0)
    return F.least(score + F.when(F.char_length(text) - F.char_length(F.replace(text, F.lit("<"), F.lit(""))) > 20, 0.3).otherwise(0.0), F.lit(1.0))


def scored(docs: DataFrame, text: str = "full_text", tracked: str = r"tracked@example\.org") -> DataFrame:
    """``docs`` with mail_score, narrative_score, html_score, document_type, score; ties go to mail, then narrative; below 0.3 unknown."""
    t = F.coalesce(F.col(text), F.lit(""))
    # Each step is one generated row, so that its expressions are not copied into every later use of them.
    d = docs.select("*", F.explode(F.array(lines(t))).alias("_lines"))
    scores = F.struct(mail_score(F.col("_lines"), tracked).alias("mail_score"), narrative_score(t, F.col("_lines")).alias("narrative_score"), html_score(t).alias("html_score"))
    d = d.select("*", F.inline(F.array(scores)))
    best = F.greatest("mail_score", "narrative_score", "html_score")
    kind = F.when(F.col("mail_score") == best, "email").when(F.col("narrative_score") == best, "narrative").otherwise("html_email")
    return d.withColumns({"document_type": F.when(best < 0.3, "unknown").otherwise(kind), "score": best})


def seeds(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns found, in their order; case does not count."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(name)) for name, p in patterns.items()]))


def sample_lines(rows: Column) -> Column:
    """All lines, or of more than 20 the first and last ten, stripped, without blank ones."""
    some = F.when(F.size(rows) <= 20, rows).otherwise(F.concat(F.slice(rows, 1, 10), F.slice(rows, F.greatest(F.size(rows) - 9, F.lit(1)), 10)))
    return F.filter(F.transform(some, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def issues(text: Column, rows: Column) -> Column:
    bad = F.char_length(text) - F.char_length(F.replace(text, F.lit("�"), F.lit("")))
    return F.array_compact(F.array(F.when(F.char_length(text) < 100, "Very short document"), F.when(bad > 5, "Encoding errors detected"), F.when(F.size(rows) == 0, "Empty file")))


def classify(docs: DataFrame, patterns: dict[str, str], path: str = "filepath", text: str = "full_text") -> DataFrame:
    """One classification row a document; a document whose text is null could not be read and gets type ``error``, confidence 0."""
    t, unread = F.coalesce(F.col(text), F.lit("")), F.col(text).isNull()
    d = scored(docs, text)
    return d.select(
        F.coalesce(doc_id(F.col(path)), F.lit("")).alias("doc_id"),
        F.col(path).alias("filepath"),
        F.octet_length(t).cast("long").alias("file_size"),
        F.size("_lines").cast("long").alias("line_count"),
        F.when(unread, "error").otherwise(F.col("document_type")).alias("document_type"),
        F.when(unread, 0.0).otherwise(F.col("score")).alias("confidence"),
        seeds(t, patterns).alias("entity_mentions"),
        sample_lines(F.col("_lines")).alias("sample_lines"),
        issues(t, F.col("_lines")).alias("issues"),
    )


def type_report(classified: DataFrame) -> DataFrame:
    """document_type, documents, percentage: the window runs over the aggregated rows, one a type."""
    n = classified.groupBy("document_type").agg(F.count("*").alias("documents"))
    return n.withColumn("percentage", F.round(F.col("documents") * 100.0 / F.sum("documents").over(W.partitionBy(F.lit(1))), 4))


def totals(classified: DataFrame) -> DataFrame:
    """One row: documents, size in MiB, documents of high confidence and their share, issues."""
    return classified.agg(
        F.count("*").alias("total_documents"),
        F.round(F.coalesce(F.sum("file_size"), F.lit(0)) / (1024.0 * 1024.0), 6).alias("total_size_mb"),
        F.count_if(F.col("confidence") > 0.7).alias("high_confidence_count"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("confidence") > 0.7) * 100.0, F.count("*")), F.lit(0.0)), 6).alias("high_confidence_pct"),
        F.coalesce(F.sum(F.size("issues").cast("long")), F.lit(0)).alias("total_issues"),
    )


def mention_counts(classified: DataFrame) -> DataFrame:
    return classified.select(F.explode("entity_mentions").alias("entity_name")).groupBy("entity_name").agg(F.count("*").alias("mentions"))


def report(classified: DataFrame) -> DataFrame:
    """The report as one row: totals with maps of types and mentions; both maps have one entry a type or seed."""
    types = type_report(classified).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("document_type", F.struct("documents", "percentage"))))).alias("document_types"))
    names = mention_counts(classified).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_name", "mentions")))).alias("entity_mentions"))
    return totals(classified).withColumn("_k", F.lit(1)).join(types.withColumn("_k", F.lit(1)), "_k").join(names.withColumn("_k", F.lit(1)), "_k").drop("_k")


def emails(classified: DataFrame, least: float = 0.7) -> DataFrame:
    return classified.filter((F.col("document_type") == "email") & (F.col("confidence") >= least))
