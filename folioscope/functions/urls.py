"""URLs in texts: extraction with positions, domains and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.text import match_spans, strip_bom, unix_lines

# Fixed value: what a URL is here.
URL = r"(?i)https?://[^\s<>\"{}|\\^`\[\]]+"


def domain(url: Column) -> Column:
    """Authority, lower-cased, with user and port."""
    return F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))


def url_type(url: Column, host: Column) -> Column:
    """The first type that fits, by plain substring tests: ``t.co`` fits every domain that ends in ``t.com``."""
    has = lambda *parts: F.greatest(*[host.contains(p) for p in parts], F.lit(False))
    return (
        F.when(has("youtube.com", "youtu.be"), "youtube")
        .when(F.lower(url).contains(".pdf"), "pdf")
        .when(has("news", "times", "post", "reuters", "cnn", "bbc"), "news")
        .when(has("t.co", "twitter.com", "x.com"), "social")
        .otherwise("other")
    )


def urls(text: Column) -> Column:
    """Array of (url, domain, type, position), one for each different URL at its first place; empty, not null, without any."""
    spans = match_spans(strip_bom(unix_lines(F.coalesce(text, F.lit("")))), URL)
    first = F.aggregate(
        spans,
        F.array().cast("array<struct<text:string,start:int,end:int>>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: y["text"] == x["text"]), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.transform(first, lambda x: F.struct(x["text"].alias("url"), domain(x["text"]).alias("domain"), url_type(x["text"], domain(x["text"])).alias("type"), x["start"].alias("position")))


def extract(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, urls(F.col(text)).alias("urls")).withColumn("urls_found", F.size("urls"))
