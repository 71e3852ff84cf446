"""Text as columns: decoding, lines, tokens and match offsets."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(content: Column, keep_bom: bool = True) -> Column:
    """Bytes as UTF-8 with replacement, line ends as line feeds; the byte order mark stays or goes."""
    t = unix_lines(F.make_valid_utf8(content.cast("string")))
    return t if keep_bom else strip_bom(t)


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def lines(text: Column) -> Column:
    """Lines without their ends; an end at the end of the text adds no line, an empty text has none."""
    parts = F.split(unix_lines(text), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_upper(text: Column) -> Column:
    """All cased characters are capitals, and there is one."""
    return (text == F.upper(text)) & (text != F.lower(text))


def match_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (text, start, end) of all matches, as 0-based code point offsets of the whole match.

    The pieces between matches come from ``split`` with the same pattern, so the offset of a match is the length of the pieces
    and matches before it. Works for patterns that match no empty string.
    """
    whole, groups, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.size(whole)),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out")),
        lambda acc, k: F.struct(
            (acc["at"] + F.char_length(F.element_at(gaps, k)) + F.char_length(F.element_at(whole, k))).alias("at"),
            F.concat(
                acc["out"],
                F.array(F.struct(F.element_at(groups, k).alias("text"), (acc["at"] + F.char_length(F.element_at(gaps, k))).alias("start"), (acc["at"] + F.char_length(F.element_at(gaps, k)) + F.char_length(F.element_at(whole, k))).alias("end"))),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.size(whole) > 0, walked).otherwise(F.array().cast("array<struct<text:string,start:int,end:int>>"))


def _folds() -> tuple[str, str]:
    """All small Latin, Greek and Cyrillic letters with marks, and their base letters, by canonical decomposition."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]):
        base = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(base) > 1 and base[0].isalpha() and all(unicodedata.combining(x) for x in base[1:]):
            pairs.append((c, base[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


#: Letters with marks, and what they fold to.
ACCENTED, FOLDED = _folds()


def folded(text: Column) -> Column:
    """Small letters without marks, whether these are part of the letter or follow it."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), ACCENTED, FOLDED)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and numbers, accents folded."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
