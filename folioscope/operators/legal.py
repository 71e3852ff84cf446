"""Legal papers: case and document numbers, court, parties, type, title, attorneys and body."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from folioscope.text import is_upper, strip_bom, unix_lines

HEAD, ATTORNEY_HEAD, BODY_LINES = 3000, 5000, 1000
# Patterns of the fields; types in the order in which they are tried.
CASE = r"(?i)Case\s+(\d+:\d+-[a-z]+-\d+)"
FILED = r"(?i)Document\s+(\d+)\s+Filed\s+(\d+/\d+/\d+)"
COURT = r"(?i)(UNITED\s+STATES\s+(?:DISTRICT\s+COURT|COURT\s+OF\s+APPEALS))\s+([A-Z\s]+(?:DISTRICT|CIRCUIT))"
VERSUS = r"(?i)(?:Plaintiff|Petitioner)s?,?\s+v\.?\s"
PARTIES = r"(?is)([A-Za-z][A-Za-z\s,.]+?),?\s+(?:et\s+al\.?)?,?\s+(?:Plaintiff|Petitioner)s?,?\s+v\.?\s+([A-Za-z][A-Za-z\s,.]+?),?\s+(?:et\s+al\.?)?,?\s+(?:Defendant|Respondent)s?"
TYPES = (("motion", r"MOTION\s+(?:TO|FOR)"), ("memorandum", r"MEMORANDUM\s+(?:OF\s+LAW|IN\s+SUPPORT)"), ("deposition", r"DEPOSITION|EXAMINATION\s+OF"), ("order", r"ORDER(?:\s+AND|\s+GRANTING|\s+DENYING)"), ("complaint", "COMPLAINT"), ("answer", r"ANSWER\s+TO"), ("brief", r"BRIEF\s+IN\s+SUPPORT"))
SECTION = re.compile(r"Attorneys?\s+for\s+(?:Plaintiff|Defendant)s?:?\s*\n(.+?)(?:\n\n|\Z)", re.I | re.S)
ATTORNEY = re.compile(r"([A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+(?:,\s*)?([^,\n]+?)?\s+(?:Bar\s+No\.|Attorney\s+for)", re.I)


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def filing_date(text: Column) -> Column:
    """Month first; a year of two digits is 20xx below 50, else 19xx; null for impossible dates."""
    m, d, y = (F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})", k) for k in (1, 2, 3))
    year = F.when(F.length(y) == 4, y).when(y < "50", F.concat(F.lit("20"), y)).otherwise(F.concat(F.lit("19"), y))
    return F.when(y != "", F.try_to_date(F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))


def parties(text: Column) -> Column:
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.filter(F.transform(F.split(stripped, r"(?i),\s*(?:et\s+al\.?)?"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def body(content: Column) -> Column:
    """From the first long line that is no heading: lines of ten characters or more, without numbers and case lines."""
    rows = F.transform(F.split(content, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    first = F.aggregate(
        F.transform(rows, lambda x, i: F.when((F.char_length(x) > 50) & ~is_upper(x) & ~x.rlike(r"^Case\s+\d+:") & ~x.rlike(r"^Document\s+\d+"), i)),
        F.lit(None).cast("int"),
        lambda acc, i: F.coalesce(acc, i),
    )
    kept = F.filter(F.slice(rows, F.coalesce(first, F.lit(0)) + 1, F.size(rows)), lambda x: (F.char_length(x) >= 10) & ~x.rlike(r"^\d+$") & ~x.rlike(r"^Case\s+\d+:"))
    return F.array_join(F.slice(kept, 1, BODY_LINES), "\n")


_ATTORNEYS = ArrayType(StructType([StructField(k, StringType()) for k in ("name", "firm", "role")]))

@F.pandas_udf(_ATTORNEYS)
def attorneys(text: pd.Series) -> pd.Series:
    """Names and firms in the sections for either side, which need patterns within patterns."""

    def of(t: str | None) -> list[dict]:
        return [{"name": m[1].strip(), "firm": m[2].strip() if m[2] else None, "role": "attorney"} for s in SECTION.finditer((t or "")[:ATTORNEY_HEAD]) for m in ATTORNEY.finditer(s[1])]

    return text.map(of)


def parse(docs: DataFrame, key: str, text: str) -> DataFrame:
    content = strip_bom(unix_lines(F.coalesce(F.col(text), F.lit(""))))
    head = F.substring(content, 1, HEAD)
    kind = F.lit(None).cast("string")
    for name, p in reversed(TYPES):
        kind = F.when(head.rlike("(?i)" + p), name).otherwise(kind)
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return docs.select(
        key,
        _found(head, CASE, 1).alias("case_number"),
        _found(head, FILED, 1).alias("document_number"),
        _found(head, FILED, 2).alias("filing_date_str"),
        filing_date(_found(head, FILED, 2)).alias("filing_date"),
        trimmed(_found(head, COURT, 1)).alias("court"),
        trimmed(_found(head, COURT, 2)).alias("district"),
        # The pattern of both parties backtracks; it runs only where what must stand between them is there.
        F.when(head.rlike(VERSUS), parties(F.regexp_extract(head, PARTIES, 1))).otherwise(F.array().cast("array<string>")).alias("plaintiffs"),
        F.when(head.rlike(VERSUS), parties(F.regexp_extract(head, PARTIES, 2))).otherwise(F.array().cast("array<string>")).alias("defendants"),
        kind.alias("document_type"),
        trimmed(_found(head, r"(?md)^([A-Z][A-Z\s]{10,100})$", 1)).alias("title"),
        body(content).alias("body"),
    )
