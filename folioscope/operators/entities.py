"""Named entities by pattern: people, organisations, locations and dates, with confidence and context.

The four kinds need look-ahead and overlapping patterns in a fixed order, so one pass in an Arrow function finds all of them; all that
follows (normalising, merging, counting, ids) is DataFrame operations. ``strict`` keeps the patterns' word boundary behind a full stop, by which
"Acme Inc." at the end of a sentence is no organisation; ``strict=False`` finds it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.numbering import numbered
from folioscope.session import spread

# The patterns by kind, in the order in which they are tried; case counts except for dates.
PATTERNS = {
    "person": [
        r"\b(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.)\s+([A-Z][a-z]{2,}(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]{2,})\b",
        r"\b([A-Z][a-z]{2,}(?:\s+[A-Z]\.)?\s+[A-Z][a-z]{2,})(?!\s*(?:Inc\.|LLC|Corp\.|University|College|Foundation|Department))\b",
        r"(?:^|\n)[-—]\s*([A-Z][a-z]{2,}\s+[A-Z][a-z]{2,})",
        r"(?:Regards|Sincerely|Best),?\s+([A-Z][a-z]{2,}\s+[A-Z][a-z]{2,})",
    ],
    "organization": [
        r"\b([A-Z][A-Za-z\s&]{2,40}(?:Inc\.|LLC|Corp\.|Corporation|Company|Co\.))\b",
        r"\b([A-Z][A-Za-z\s]{2,30}(?:University|College|Institute|Foundation))\b",
        r"\b([A-Z][A-Za-z\s]{2,30}(?:Department|Agency|Commission|Bureau))\b",
        r"\b([A-Z][A-Za-z\s]{2,30}(?:Bank|Group|Partners|Associates))\b",
    ],
    "location": [
        r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*),\s*([A-Z]{2})(?:\s|$)",
        r"\b(\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Street|St\.|Avenue|Ave\.|Road|Rd\.|Boulevard|Blvd\.|Way|Drive|Dr\.|Lane|Ln\.))\b",
    ],
    "date": [
        r"\b(\d{1,2}/\d{1,2}/\d{2,4})\b",
        r"\b(\d{4}-\d{2}-\d{2})\b",
        r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})\b",
        r"\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.?\s+\d{1,2},?\s+\d{4})\b",
    ],
}
# What looks like a person's name and is none.
NOT_NAMES = [
    "The Court", "The Judge", "The Plaintiff", "The Defendant", "United States", "New York", "District Court", "Supreme Court", "Dear Sir", "Dear Madam", "Dear Mr", "Dear Ms", "Dear Dr",
    "Palm Beach", "Los Angeles", "San Francisco", "El Paso", "Santa Barbara", "Fort Lauderdale",
]
ORG_WORDS = ["University", "College", "Institute", "Foundation", "Department", "Agency", "Corporation", "Inc.", "LLC", "Corp."]
PLACE_ENDS = [" Beach", " City", " Island", " County", " Park", " Way", " Street", " Avenue", " Road", " Boulevard", " Drive", " Lane"]
CONFIDENCE = {"organization": 0.80, "location": 0.85, "date": 0.95}
WINDOW = 50
TYPE_NAMES = {"people": "person", "organizations": "organization", "locations": "location", "dates": "date"}
MENTION = "type string, ordinal int, text string, position_start int, position_end int, context string"


def spans(text: str, kind: str, strict: bool = True) -> Iterator[tuple[str, int, int]]:
    """Matches of a kind's patterns, pattern by pattern; people and organisations by their group, the others whole."""
    for p in PATTERNS[kind]:
        if p == PATTERNS["location"][0]:
            yield from places(text)
            continue
        if not strict:
            p = re.sub(r"\)\)\\b$", r"))(?!\\w)", p)
        for m in re.finditer(p, text, re.IGNORECASE if kind == "date" else 0):
            g = 1 if kind in ("person", "organization") else 0
            yield m[g].strip(), m.start(g), m.end(g)


# The first location pattern in two pieces: a run of capitalised words, taken once and whole, and what must follow it.
_RUN = re.compile(r"\b[A-Z][a-z]++(?:\s++[A-Z][a-z]++)*+")
_STATE = re.compile(r",\s*[A-Z]{2}(?:\s|$)")


def places(text: str) -> Iterator[tuple[str, int, int]]:
    """The matches of the first location pattern, in linear time.

    A run that no state follows cannot match from any later word of it either, as all of them end where it ends.
    """
    for m in _RUN.finditer(text):
        if tail := _STATE.match(text, m.end()):
            yield text[m.start() : tail.end()].strip(), m.start(), tail.end()


def found_in(text: str, strict: bool = True) -> list[tuple]:
    """(type, ordinal, text, start, end, context) of each different text of a kind at its first match."""
    out = []
    for kind in PATTERNS:
        seen: set[str] = set()
        for name, a, b in spans(text, kind, strict):
            if name not in seen:
                seen.add(name)
                out.append((kind, len(seen), name, a, b, text[max(0, a - WINDOW) : b + WINDOW]))
    return out


def likely_person(name: Column) -> Column:
    """Not all capitals, four characters, two words, no digit, and none of the words and endings of places and organisations."""
    words = F.size(F.filter(F.split(name, r"\s+"), lambda x: x != ""))
    no = name.isin(NOT_NAMES) | name.startswith("The ") | name.rlike(r"\d") | ((name == F.upper(name)) & (name != F.lower(name)))
    for w in ORG_WORDS:
        no = no | name.contains(w)
    for e in PLACE_ENDS:
        no = no | name.endswith(e)
    return ~no & (F.char_length(name) >= 4) & (words >= 2)


def person_confidence(name: Column, context: Column) -> Column:
    """0.70, and more for a title or closing word near it and a middle initial, added in this order."""
    c = F.lit(0.70) + F.when(context.rlike(r"(?i)\b(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.)\s*"), 0.15).otherwise(0.0)
    c = c + F.when(context.rlike(r"(?i)(?:Sincerely|Regards|Best|From|Sent by)"), 0.10).otherwise(0.0)
    return F.least(c + F.when(name.rlike(r"\b[A-Z][a-z]+\s+[A-Z]\.\s+[A-Z][a-z]+\b"), 0.05).otherwise(0.0), F.lit(1.0))


def mentions(docs: DataFrame, key: str, text: str, strict: bool = True) -> DataFrame:
    """key, type, ordinal, text, position_start, position_end, context, confidence, method of all entities.

    Null and empty texts have none. Positions are 0-based code points, ``ordinal`` counts from 1 within document and type.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import folioscope.operators.entities as here

        for b in batches:
            rows = [(k, *m) for k, t in zip(b[key], b[text], strict=True) if t for m in here.found_in(t, strict)]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "type", "ordinal", "text", "position_start", "position_end", "context"])

    raw = spread(docs.select(key, text)).mapInPandas(run, f"{key} {kind}, {MENTION}")
    fits = F.when(F.col("type") == "person", likely_person(F.col("text"))).when(F.col("type") == "organization", F.char_length("text") > 3).otherwise(True)
    conf = F.when(F.col("type") == "person", person_confidence(F.col("text"), F.col("context")))
    for t, c in CONFIDENCE.items():
        conf = conf.when(F.col("type") == t, F.lit(c))
    return raw.filter(fits).withColumns({"confidence": conf, "method": F.lit("regex")})


#: An extractor maps texts to lists of (type, name), or None where its call failed.
Extractor = Callable[[list[str]], list[list[tuple[str, str]] | None]]


def by_model(docs: DataFrame, key: str, text: str, extractor: Extractor, read: int = 3000) -> DataFrame:
    """Mentions that a model names, confidence 0.90, at their first place whatever the case; of texts that it failed on, none.

    The model sees the first ``read`` characters. Names that the text does not hold have null positions.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            try:
                answers = extractor([(t or "")[:read] for t in b[text]])
            except Exception:
                answers = [None] * len(b)
            for k, t, got in zip(b[key], b[text], answers, strict=True):
                for n, (type_, name) in enumerate(got or (), 1):
                    at = (t or "").lower().find(name.lower()) if name else -1
                    rows.append((k, TYPE_NAMES.get(type_, type_), n, name, at, at + len(name), (t or "")[max(0, at - WINDOW) : at + len(name) + WINDOW] if at >= 0 else None))
            if rows:
                yield pd.DataFrame(rows, columns=[key, "type", "ordinal", "text", "position_start", "position_end", "context"])

    made = spread(docs.select(key, text)).mapInPandas(run, f"{key} {kind}, {MENTION}").filter("text <> ''")
    there = F.col("position_start") >= 0
    return made.withColumns({"confidence": F.lit(0.90), "method": F.lit("llm"), "position_end": F.when(there, F.col("position_end")), "position_start": F.when(there, F.col("position_start"))})


def context(text: Column, start: Column, end: Column, window: int = WINDOW) -> Column:
    """The text around a span, as far as it goes."""
    begin = F.greatest(start - window, F.lit(0))
    return F.substring(text, begin + 1, F.least(end + window, F.char_length(text)) - begin)


def normalise(text: Column, kind: Column) -> Column:
    """Lower case with single blanks; names of people and organisations lose full stops and commas."""
    t = F.lower(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^ | $", ""))
    return F.when(kind.isin("person", "organization"), F.translate(t, ".,", "")).otherwise(t)


def merged(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union of two sets of mentions: of equal texts (case and outer blanks apart) the surer one stays, of equals the first seen."""
    both = first.withColumn("_src", F.lit(0)).unionByName(second.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "type", "_src")]
    age = F.struct(F.col("confidence"), -F.col("_src"), -F.col("ordinal"))
    won = both.groupBy(key, "type", F.lower(F.trim("text")).alias("_k")).agg(F.max_by(F.struct(*rest), age).alias("_r"))
    return won.select(key, "type", *[F.col(f"_r.{c}").alias(c) for c in rest])


def validated(found: DataFrame, verdicts: DataFrame, key: str, below: float = 0.80) -> DataFrame:
    """Without the mentions under ``below`` that ``verdicts`` (key, text, type, is_valid) marks as invalid; unknown ones stay."""
    bad = verdicts.filter("not is_valid").select(F.col(key).alias("_d"), F.col("text").alias("_t"), F.col("type").alias("_y"), F.lit(below).alias("_b")).distinct()
    on = (found[key] == bad["_d"]) & (found["text"] == bad["_t"]) & (found["type"] == bad["_y"]) & (found["confidence"] < bad["_b"])
    return found.join(bad, on, "left_anti")


def entity_table(found: DataFrame, key: str) -> DataFrame:
    """One row for each normal form and type: text first seen, document first seen in, and how many mentions; ids in the order of first mention."""
    order = F.struct(F.col(key), F.array_position(F.array(*[F.lit(t) for t in PATTERNS]), F.col("type")), F.col("ordinal"))
    n = found.withColumn("normalized_text", normalise(F.col("text"), F.col("type"))).groupBy("normalized_text", "type").agg(
        F.count("*").alias("occurrence_count"), F.min_by("text", order).alias("text"), F.min_by(key, order).alias("first_seen_doc_id"), F.min(order).alias("_o")
    )
    ranked = numbered(n, ["_o", "normalized_text"], "entity_id")
    return ranked.select("entity_id", "text", "type", "normalized_text", "first_seen_doc_id", "occurrence_count")


def with_ids(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions with their entity_id: a bag, repeated mentions stay."""
    f = found.withColumn("normalized_text", normalise(F.col("text"), F.col("type")))
    return f.join(entities.select("normalized_text", "type", "entity_id"), ["normalized_text", "type"]).drop("normalized_text")


def participants_as_people(found: DataFrame, participants: DataFrame, key: str) -> DataFrame:
    """People of a mail's header that no mention names (case apart), as persons of confidence 0.95 found by ``email``."""
    known = found.filter("type = 'person'").select(F.col(key).alias("_d"), F.lower("text").alias("_t")).distinct()
    p = participants.filter("name is not null and name <> ''").select(key, F.col("name").alias("text")).distinct()
    new = p.join(known, (p[key] == known["_d"]) & (F.lower(p["text"]) == known["_t"]), "left_anti")
    return found.select(key, "type", "text", "confidence", "method").unionByName(new.select(key, F.lit("person").alias("type"), "text", F.lit(0.95).alias("confidence"), F.lit("email").alias("method")))
