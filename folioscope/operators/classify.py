"""Structural classifier: an ordered chain of regular expressions, and an optional scorer for what stays unsure."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.text import strip_bom, unix_lines

READ, HEAD, DEPOSITION_HEAD = 51200, 2000, 3000
# Patterns of the document types.
MAIL = r"(?d)From:\s+.+\nTo:\s+.+\nSubject:\s+.+\nSent:\s+\d+/\d+/\d+"
CASE = r"(?i)Case\s+\d+:\d+-[a-z]+-\d+"
COURT = r"(?i)UNITED\s+STATES\s+DISTRICT\s+COURT|UNITED\s+STATES\s+COURT\s+OF\s+APPEALS"
FILED = r"(?i)Document\s+\d+\s+Filed\s+\d+/\d+/\d+"
DEPOSITION = r"(?i)DEPOSITION|EXAMINATION\s+OF"
MOTION = r"(?i)MOTION\s+(?:TO|FOR)|MEMORANDUM\s+OF\s+LAW"
BYLINE = r"(?md)^By\s+[A-Z][a-z]+\s+[A-Z][a-z]+"
PUBLICATION = r"(?i)(?:Palm\s+Beach\s+Post|New\s+York\s+Times|Washington\s+Post|Wall\s+Street\s+Journal)"
CONGRESS = r"(?i)CONGRESSIONAL\s+RECORD"
FIRST_PERSON = r"(?i)\bI\s+(?:have|was|am|had|did|said|went|saw|thought|felt|believe|remember|knew)\b"


def legal_score(head: Column, content: Column) -> Column:
    """Additive score; the parts are added in this order, as sums of doubles depend on it."""
    score = F.when(head.rlike(CASE), 0.4).otherwise(0.0) + F.when(head.rlike(COURT), 0.3).otherwise(0.0) + F.when(head.rlike(FILED), 0.2).otherwise(0.0)
    score = score + F.when(F.substring(content, 1, DEPOSITION_HEAD).rlike(DEPOSITION), 0.3).otherwise(0.0)
    return score + F.when(head.rlike(MOTION), 0.2).otherwise(0.0)


def is_narrative(content: Column) -> Column:
    long = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(x)), lambda x: F.char_length(x) > 20)
    return (F.size(long) >= 10) & content.rlike(FIRST_PERSON) & F.exists(long, lambda x: F.char_length(x) > 200)


def document_type(text: Column) -> Column:
    """struct(doc_type, confidence, subtype) of the first kind in the chain that fits; null and empty texts are ``other``."""
    content = F.substring(strip_bom(unix_lines(F.coalesce(text, F.lit("")))), 1, READ)
    head = F.substring(content, 1, HEAD)
    legal = legal_score(head, content)
    subtype = F.when(head.rlike(MOTION), "motion").when(F.substring(content, 1, DEPOSITION_HEAD).rlike(DEPOSITION), "deposition").when(head.rlike(CASE), "court_filing")

    def made(kind: str, confidence: Column, sub: Column) -> Column:
        return F.struct(F.lit(kind).alias("doc_type"), confidence.cast("double").alias("confidence"), sub.cast("string").alias("subtype"))

    none = F.lit(None)
    return (
        F.when(head.rlike(MAIL), made("email", F.lit(0.95), none))
        .when(legal >= 0.5, made("legal", F.least(legal, F.lit(0.95)), subtype))
        .when(head.rlike(BYLINE) | head.rlike(PUBLICATION), made("news", F.lit(0.85), F.lit("article")))
        .when(head.rlike(CONGRESS), made("congressional", F.lit(0.90), none))
        .when(is_narrative(content), made("narrative", F.lit(0.70), none))
        .otherwise(made("other", F.lit(0.50), none))
    )


#: A scorer maps texts to (category, confidence, reasoning); None stands for a failed call.
Scorer = Callable[[list[str]], list[tuple[str, float, str] | None]]


def hybrid(docs: DataFrame, key: str, text: str, scorer: Scorer | None = None, keep: float = 0.85, accept: float = 0.70, read: int = 1000) -> DataFrame:
    """key, doc_type, confidence, method, reasoning: rules first, the scorer only for ``other`` and rules below ``keep``.

    Only the unsure rows go to Python. Without a scorer, where its call fails, or below ``accept``, the rules' result stands.
    """
    ruled = docs.select(F.col(key), F.col(text), document_type(F.col(text)).alias("_type")).select(key, text, "_type.doc_type", "_type.confidence", F.lit("regex").alias("method"), F.lit(None).cast("string").alias("reasoning"))
    sure = (F.col("doc_type") != "other") & (F.col("confidence") >= keep)
    if scorer is None:
        return ruled.drop(text)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                got = scorer([(t or "")[:read] for t in b[text]])
            except Exception:
                got = [None] * len(b)
            out = []
            for k, d, c, g in zip(b[key], b["doc_type"], b["confidence"], got, strict=True):
                out.append((k, g[0], float(g[1]), "llm", g[2]) if g and g[1] >= accept else (k, d, c, "regex", None))
            if out:
                yield pd.DataFrame(out, columns=[key, "doc_type", "confidence", "method", "reasoning"])

    asked = ruled.filter(~sure).select(key, text, "doc_type", "confidence").mapInPandas(run, f"{key} {kind}, doc_type string, confidence double, method string, reasoning string")
    return ruled.filter(sure).drop(text).unionByName(asked)


def histogram(df: DataFrame, column: str) -> DataFrame:
    """column, n, percentage, most frequent first when sorted by n; ties by value."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("percentage", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(1))), 4))
