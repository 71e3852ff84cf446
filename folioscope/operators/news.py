"""News articles: publication, byline, date, headline, section, type, body and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.text import is_upper, strip_bom, unix_lines

HEAD, HEAD_LINES, BODY_LINES = 1000, 50, 1000
# Publications, sections and types in the order in which they are tried; byline and date patterns.
PUBLICATIONS = ("Palm Beach Post", "New York Times", "Washington Post", "Wall Street Journal", "Miami Herald")
BYLINES = (r"(?md)^By\s+([A-Z][A-Za-z.'\\s-]+?)(?:,|$)", r"(?md)^([A-Z][A-Za-z.'\\s-]+?)(?:,|$)\s+(?:Staff\s+Writer|Correspondent)")
LOOSE_BYLINES = (r"(?md)^By\s+([A-Z][A-Za-z.' -]+?)(?:,|$)", r"(?md)^([A-Z][A-Za-z.' -]+?)(?:,|$)\s+(?:Staff\s+Writer|Correspondent)")
WORD_DATE, SLASH_DATE = r"([A-Z][a-z]+)\s+(\d{1,2}),\s+(\d{4})", r"(\d{1,2})/(\d{1,2})/(\d{4})"
# The nested repeat of the headline is bounded to one, which takes the same lines without backtracking.
HEADLINE = r"(?md)^([A-Z][a-z]+\s+[A-Za-z].*|[A-Z\s]{10,100})$"
SECTIONS = (("editorial", "EDITORIAL|OPINION"), ("news", "NEWS|LOCAL"), ("business", "BUSINESS|ECONOMY"))


def _first(text: Column, patterns: tuple[str, ...], group: int = 1) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns])


def _chain(text: Column, pairs) -> Column:
    out = F.lit(None).cast("string")
    for name, p in reversed(list(pairs)):
        out = F.when(text.rlike("(?i)" + p), name).otherwise(out)
    return out


def date_text(head: Column) -> Column:
    return _first(head, (WORD_DATE, SLASH_DATE), 0)


def date(head: Column) -> Column:
    """Month, day and year by name or number; null for words that are no months and for impossible dates."""
    word = F.regexp_extract(head, WORD_DATE, 0)
    a, b, c = (F.regexp_extract(head, SLASH_DATE, k) for k in (1, 2, 3))
    named = F.try_to_date(F.concat_ws(" ", *[F.regexp_extract(head, WORD_DATE, k) for k in (1, 2, 3)]), "MMMM d yyyy")
    return F.when(word != "", named).when(a != "", F.try_to_date(F.concat_ws("-", c, F.lpad(a, 2, "0"), F.lpad(b, 2, "0")), "yyyy-MM-dd"))


def body(content: Column) -> Column:
    """Lines of 20 characters or more from the first long one within the first 50, without page marks, a blank line between them."""
    rows = F.transform(F.split(content, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    at = F.transform(F.slice(rows, 1, HEAD_LINES), lambda x, i: F.when((F.char_length(x) > 50) & ~is_upper(x), i))
    first = F.aggregate(at, F.lit(None).cast("int"), lambda acc, i: F.coalesce(acc, i))
    kept = F.filter(F.slice(rows, F.coalesce(first, F.lit(0)) + 1, F.size(rows)), lambda x: (F.char_length(x) >= 20) & ~x.rlike(r"(?i)^Page\s+\d+"))
    return F.array_join(F.slice(kept, 1, BODY_LINES), "\n\n")


def parse(docs: DataFrame, key: str, text: str, loose: bool = False) -> DataFrame:
    """``loose`` takes bylines of several words; the strict pattern takes a single word, as its class holds no blank."""
    content = strip_bom(unix_lines(F.coalesce(F.col(text), F.lit(""))))
    head = F.substring(content, 1, HEAD)
    whole = body(content)
    kind = F.when(head.rlike("(?i)editorial|opinion"), "editorial").when(head.rlike("(?i)profile|about|biography"), "profile").otherwise("news")
    return docs.select(
        key,
        _chain(head, ((p, p.replace(" ", r"\s+")) for p in PUBLICATIONS)).alias("publication"),
        F.trim(_first(head, LOOSE_BYLINES if loose else BYLINES)).alias("author"),
        date_text(head).alias("publication_date_str"),
        date(head).alias("publication_date"),
        F.regexp_replace(F.nullif(F.regexp_extract(head, HEADLINE, 1), F.lit("")), r"^\s+|\s+$", "").alias("headline"),
        _chain(head, SECTIONS).alias("section"),
        kind.alias("article_type"),
        whole.alias("body"),
        F.nullif(F.substring_index(whole, "\n\n", 1), F.lit("")).alias("summary"),
    )
