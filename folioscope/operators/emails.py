"""E-mail parsing: headers, addresses, dates, quoted sections and thread messages.

Header folding is a state machine over lines and thread patterns overlap, so one Arrow pass turns a text into one
struct; addresses, flags and lists also exist as columns for tables that are parsed already.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from folioscope.schemas import EMAIL
from folioscope.session import spread

# Address, header, quote and attribution patterns, date formats and the mark of a missing address.
ADDRESS = r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
NAMED = r"([^<]+?)\s*<([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})>"
HIDDEN = "[REDACTED]"
HEADERS = ("from", "to", "cc", "bcc", "subject", "sent", "date", "message-id", "in-reply-to", "references", "reply-to")
SLASH_DATE = re.compile(r"(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{2}):(\d{2})\s+(AM|PM)")
DOTTED_DATE = re.compile(r"(\d{1,2})\.\s*(\w+)\.\s*(\d{4})\s*kl\.\s*(\d{1,2}):(\d{2})", re.I)
DOTTED_MONTHS = ["jan", "feb", "mar", "apr", "mai", "jun", "jul", "aug", "sep", "okt", "nov", "des"]
QUOTE_MARKS = (r"(?m)^>\s*", r"(?m)^On .+ wrote:$", r"(?im)^-+\s*Original Message\s*-+", r"(?m)^From:.*\nSent:.*\nTo:.*\nSubject:")
_WHEN = r"\w+\s+\d{1,2},\s+\d{4},?\s+at\s+[\d:]+\s+(?:AM|PM)"
THREADS = (
    (r"(?i)(?:søn|son|man|tir|ons|tor|fre|lør)\.\s+(?P<date>\d{1,2}\.\s+\w+\.\s+\d{4}\s+kl\.\s+[\d:]+)\s+skrev\s+(?P<name>.+?)\s*<(?P<email>[^>]+)>:"),
    rf"(?i)On\s+(?P<date>{_WHEN}),\s*(?P<name>.+?)\s*<[^>]+>\s*wrote:",
    r"(?i)On\s+(?P<date>(?:Sun|Mon|Tue|Wed|Thu|Fri|Sat),\s+\w+\s+\d{1,2},\s+\d{4}\s+at\s+[\d:]+\s+(?:AM|PM)),\s*(?P<name>[^<\n]+)",
    rf"(?i)On\s+(?P<date>{_WHEN}),\s*(?P<name>[^<\n]+)",
    r"(?ms)^From:\s*(?P<name>.+?)\s*(?:<(?P<email>[^>]+)>)?\s*$.*?^Sent:\s*(?P<date>.+?)\s*$",
)
QUOTE_LINES, PREVIEW = 50, 200
_HEADER_LINE = re.compile(r"(?:" + "|".join(HEADERS) + r"):\s*.+", re.I)
_HEADER = re.compile(r"(" + "|".join(HEADERS) + r"):\s*(.+)", re.I)


# ---------------------------------------------------------------- columns


def address(text: Column) -> Column:
    """struct(email, name): a named address, a bare one with the text before it as name, else a hidden address; empty is null."""
    t = F.trim(text)
    null = lambda c: F.nullif(F.trim(c), F.lit(""))
    named = F.struct(F.regexp_extract(t, NAMED, 2).alias("email"), null(F.regexp_extract(t, NAMED, 1)).alias("name"))
    bare = F.regexp_extract(t, ADDRESS, 1)
    return (
        F.when(t == "", F.lit(None))
        .when(t.rlike(NAMED), named)
        .when(bare != "", F.struct(bare.alias("email"), null(F.substring(t, F.lit(1), F.position(bare, t) - 1)).alias("name")))
        .when(t.isNotNull(), F.struct(F.lit(HIDDEN).alias("email"), t.alias("name")))
    )


def address_list(text: Column) -> Column:
    """Addresses between semicolons and commas; a comma within a name makes two entries."""
    return F.transform(F.filter(F.transform(F.split(text, "[;,]"), F.trim), lambda x: x != ""), address)


def rendered(a: Column) -> Column:
    return F.when(a["name"].isNotNull(), F.concat(a["name"], F.lit(" <"), a["email"], F.lit(">"))).otherwise(a["email"])


def clean_name(name: Column) -> Column:
    """Without quotes and brackets at the ends, a leading mailto:, empty brackets and repeated blanks; null if nothing is left."""
    n = F.trim(F.btrim(F.trim(name), F.lit("'\"[]()<>")))
    n = F.when(F.lower(n).startswith("mailto:"), F.trim(F.substring(n, F.lit(8), F.char_length(n)))).otherwise(n)
    n = F.regexp_replace(F.regexp_replace(n, r"\s*\[\s*\]\s*", " "), r"\s*\(\s*\)\s*", " ")
    return F.nullif(F.trim(F.regexp_replace(n, r"\s+", " ")), F.lit(""))


def clean_email(email: Column) -> Column:
    e = F.lower(F.trim(email))
    e = F.btrim(F.regexp_replace(e, "^mailto:", ""), F.lit("'\"[]()<>"))
    return F.when(email == HIDDEN, "redacted").otherwise(e)


def is_reply(subject: Column, in_reply_to: Column) -> Column:
    return F.coalesce(subject.rlike(r"(?i)^Re:\s*"), F.lit(False)) | in_reply_to.isNotNull()


def is_forward(subject: Column) -> Column:
    return F.coalesce(subject.rlike(r"(?i)^Fwd?:\s*"), F.lit(False))


def participants(*lists: Column) -> Column:
    """Sorted distinct union of arrays of rendered addresses; null arrays add none."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.filter(F.concat(*[F.coalesce(x, empty) for x in lists]), lambda x: x.isNotNull())))


# ---------------------------------------------------------------- one text


def date_of(text: str | None) -> str | None:
    """ISO form of a date text by the formats in their order, or None.

    The first, of the standard header format, also takes texts like "Jun 24, 2018 3:28 PM" and then loses the PM.
    """
    if not text:
        return None
    try:
        return parsedate_to_datetime(text).isoformat()
    except (TypeError, ValueError, AttributeError, IndexError):
        pass
    for made, form in ((re.sub(r"^(?:Sun|Mon|Tue|Wed|Thu|Fri|Sat),\s*", "", text).replace(" at ", " "), "%b %d, %Y %I:%M %p"), (text.replace(" at ", " ").replace(",", ""), "%b %d %Y %I:%M %p")):
        try:
            return datetime.strptime(made, form).isoformat()
        except ValueError:
            pass
    try:
        m = DOTTED_DATE.match(text)
        if m and m[2].lower()[:3] in DOTTED_MONTHS:
            return datetime(int(m[3]), DOTTED_MONTHS.index(m[2].lower()[:3]) + 1, int(m[1]), int(m[4]), int(m[5])).isoformat()
    except ValueError:
        pass
    m = SLASH_DATE.match(text)
    if not m:
        return None
    hour = int(m[4]) + 12 * (m[7] == "PM" and int(m[4]) != 12) - 12 * (m[7] == "AM" and int(m[4]) == 12)
    try:
        return datetime(int(m[3]), int(m[1]), int(m[2]), hour, int(m[5]), int(m[6])).isoformat()
    except ValueError:
        return None


def read_address(text: str) -> dict | None:
    t = text.strip()
    if m := re.search(NAMED, t):
        return {"email": m[2].strip(), "name": m[1].strip() or None}
    if m := re.search(ADDRESS, t):
        return {"email": m[1], "name": t[: m.start()].strip() or None}
    return {"email": HIDDEN, "name": t} if t else None


def read_list(text: str) -> list[dict]:
    return [a for part in re.split(r"[;,]", text) if part.strip() and (a := read_address(part))]


def show(a: dict) -> str:
    return f"{a['name']} <{a['email']}>" if a["name"] else a["email"]


def read_headers(lines: list[str]) -> tuple[dict[str, str], list[tuple[str, str]], int]:
    """(last value of each header, all headers in their order, the line where the body begins).

    The block ends behind a blank line, or before a line after the first that has no colon in its first 21 characters
    and is no header; lines that begin with white space go on the line before.
    """
    folded: list[str] = []
    k = 0
    while k < len(lines) and lines[k].strip():
        line = lines[k]
        if line[0] in " \t":
            if folded:
                folded[-1] += " " + line.strip()
        else:
            colon = line.strip().find(":")
            if k and not 0 <= colon <= 20 and not _HEADER_LINE.match(line.strip()):
                break
            folded.append(line)
        k += 1
    end = k if k < len(lines) and lines[k].strip() else min(k + 1, len(lines))
    order = [(m[1].lower(), m[2].strip()) for line in folded if (m := _HEADER.fullmatch(line.strip()))]
    return dict(order), order, end


def quoted_sections(body: str) -> list[str]:
    """Quoted sections by each mark, mark by mark; a run of quoted lines comes once for each of its lines, ever shorter."""
    out = []
    for mark in QUOTE_MARKS:
        for m in re.finditer(mark, body):
            rest, kept, blank = body[m.start() :].split("\n"), [], 0
            for n, line in enumerate(rest):
                empty = not line.strip()
                if mark == QUOTE_MARKS[0]:
                    if not empty and not line.strip().startswith(">"):
                        break
                    kept.append(line)
                    continue
                blank = blank + 1 if empty else 0
                if blank == 2:
                    break
                kept.append(line)
                if n >= QUOTE_LINES:
                    break
            if kept:
                out.append("\n".join(kept).strip())
    return out


def thread_messages(content: str) -> tuple[list[dict], list[str]]:
    """Messages that attributions introduce, pattern by pattern (overlapping patterns give the same message twice), and issues."""
    messages, issues = [], []
    for pattern in THREADS:
        for m in re.finditer(pattern, content):
            g = m.groupdict()
            author = g["name"].strip().rstrip(",<> \t") if g["name"] else ""
            if not g["name"]:
                continue
            if g.get("email") and g["email"].strip():
                author = f"{author} <{g['email'].strip()}>"
            when = g["date"].strip() if g["date"] else None
            date = date_of(when)
            if when and not date:
                issues.append(f"Failed to parse thread date: '{when}' for author '{author}'")
            messages.append({"author": author, "date_str": when, "date": date, "content_preview": content[m.end() : m.end() + PREVIEW].strip() or None})
    return messages, issues


def parse_text(text: str) -> dict:
    """All fields of one mail."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿").split("\n")
    headers, order, end = read_headers(lines)
    content = "\n".join(lines[end:])
    mark = re.search(r"(?m)^--\s*$", content)
    body = content[: mark.start()].strip() if mark else content.strip()
    messages, issues = thread_messages(content) if body else ([], [])
    sender = read_address(headers["from"]) if "from" in headers else None
    lists = {k: read_list(headers[k]) if k in headers else [] for k in ("to", "cc", "bcc")}
    dated = [v for h, v in order if h in ("sent", "date")]
    subject, reply = headers.get("subject"), headers.get("in-reply-to")
    people = {m["author"] for m in messages} | {show(a) for a in ([sender] if sender else []) + lists["to"] + lists["cc"] + lists["bcc"]}
    return {
        "from_addr": sender, "to_addrs": lists["to"], "cc_addrs": lists["cc"], "bcc_addrs": lists["bcc"], "subject": subject,
        "date": date_of(dated[-1]) if dated else None, "date_str": dated[-1] if dated else None, "message_id": headers.get("message-id"), "in_reply_to": reply,
        "references": headers["references"].split() if "references" in headers else [], "reply_to": read_address(headers["reply-to"]) if "reply-to" in headers else None,
        "is_reply": reply is not None or bool(subject and re.match(r"(?i)re:", subject)), "is_forward": bool(subject and re.match(r"(?i)fwd?:", subject)),
        "body": body, "signature": content[mark.start() :].strip() if mark else None, "quoted_text": quoted_sections(body) if body else [],
        "thread_messages": messages, "all_participants": sorted(people), "parsing_issues": issues, "raw_headers": list(headers.items()),
    }


def parse(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, mail (struct of all fields); null texts have a null struct."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(EMAIL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import folioscope.operators.emails as here

        for b in batches:
            mails = [here.parse_text(t) if t is not None else None for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mails, type=kind)], names=[key, "mail"])

    return spread(docs.select(key, text)).mapInArrow(run, StructType([docs.schema[key], StructField("mail", EMAIL)]))


def metadata_rows(parsed: DataFrame, key: str) -> DataFrame:
    """Rows of the mail table: lists as JSON, issues null where there are none, dates in ISO form."""
    m = F.col("mail")
    show_all = lambda c: F.to_json(F.transform(c, rendered))
    return parsed.filter("mail is not null").select(
        key,
        F.when(m["from_addr"].isNotNull(), rendered(m["from_addr"])).alias("from_addr"),
        show_all(m["to_addrs"]).alias("to_addrs"),
        show_all(m["cc_addrs"]).alias("cc_addrs"),
        m["subject"].alias("subject"),
        m["date"].alias("date"),
        m["message_id"].alias("message_id"),
        m["in_reply_to"].alias("in_reply_to"),
        m["is_reply"].cast("int").alias("is_reply"),
        m["is_forward"].cast("int").alias("is_forward"),
        F.to_json(m["all_participants"]).alias("all_participants"),
        F.when(F.size(m["parsing_issues"]) > 0, F.to_json(m["parsing_issues"])).alias("parsing_issues"),
    )


def thread_rows(parsed: DataFrame, key: str) -> DataFrame:
    return parsed.select(key, F.posexplode("mail.thread_messages").alias("message_index", "m")).select(key, "m.author", "m.date", "m.date_str", "m.content_preview", "message_index")


def skip_reason(doc_type: Column) -> Column:
    """Why a document is not parsed as a mail; null where it is."""
    return F.when(doc_type.isNull(), "No classification step found").when(doc_type != "email", F.concat(F.lit("Document type is '"), doc_type, F.lit("', not email")))
