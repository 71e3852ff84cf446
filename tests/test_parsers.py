import pytest
from pyspark.sql import functions as F

from folioscope.operators import emails, entities, legal, news


def test_header_rules():
    h, order, end = emails.read_headers(["From: A", "To: b,", "  c", "Subject: one", "Subject: two", "", "body"])
    assert h["subject"] == "two" and h["to"] == "b, c" and end == 6
    assert emails.read_headers(["Subject: x", "no colon here at all", "more"])[2] == 1


@pytest.mark.parametrize(
    "text,want",
    [
        ("10/31/2015 11:24:38 PM", "2015-10-31T23:24:38"),
        ("Sun, Jun 24, 2018 at 3:28 PM", "2018-06-24T15:28:00"),
        ("Tuesday, June 5, 2018 3:04 PM", "2018-06-05T03:04:00"),
        ("24. jun. 2018 kl. 15:18", "2018-06-24T15:18:00"),
        ("see cover", None),
        (None, None),
    ],
)
def test_dates(text, want):
    assert emails.date_of(text) == want


def test_addresses(spark):
    assert emails.read_address("Ann Example") == {"email": "[REDACTED]", "name": "Ann Example"}
    assert [a["name"] for a in emails.read_list("Doe, John <j@x.org>")] == ["Doe", "John"]
    texts = ["Ann <a@x.org>", "Ann a@x.org", "Ann Example", "", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select(emails.address(F.col("t")).alias("a"))
    rows = [r.a for r in d.collect()]
    assert [(r.email, r.name) if r else None for r in rows] == [("a@x.org", "Ann"), ("a@x.org", "Ann"), ("[REDACTED]", "Ann Example"), None, None]
    c = d.filter("a is not null").select(emails.clean_email(F.col("a.email")), emails.clean_name(F.lit(' "mailto:Ann [ ]  B" '))).collect()
    assert c[2][0] == "redacted" and c[0][1] == "Ann B"


def test_whole_mail(spark):
    text = "﻿From: Ann <a@x.org>\nTo: b@x.org\nSubject: Re: trip\n\nHi\n> old\n> older\nOn Apr 5, 2018, at 1:41 PM, Bob <b@x.org> wrote:\nbye\n-- \nAnn"
    p = emails.parse(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t")
    rows = {r.k: r.mail for r in p.collect()}
    m = rows[1]
    assert m.is_reply and not m.is_forward and m.signature.startswith("--") and [x.author for x in m.thread_messages] == ["Bob", "Bob"]
    assert m.quoted_text[:2] == ["> old\n> older", "> older"] and rows[2] is None and rows[3].body == ""
    assert set(m.all_participants) == {"Ann <a@x.org>", "b@x.org", "Bob"}
    assert emails.thread_rows(p, "k").count() == 2 and emails.metadata_rows(p, "k").count() == 2


def test_entities(spark):
    text = "Mr. John Smith met Ann B. Example. Foo Bar LLC in Reno, NV on 1/2/2015. Regards, Jo Doe. Acme Widgets Inc. in May"
    d = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "k string, t string")
    m = entities.mentions(d, "k", "t").collect()
    got = {(r.type, r.text) for r in m}
    assert {("person", "John Smith"), ("person", "Ann B. Example"), ("organization", "Foo Bar LLC"), ("location", "Reno, NV"), ("date", "1/2/2015")} <= got
    assert not any(t == "organization" and x.startswith("Acme") for t, x in got)
    assert all(text[r.position_start : r.position_end].strip() == r.text for r in m)
    loose = {r.text for r in entities.mentions(d, "k", "t", strict=False).collect()}
    assert "Acme Widgets Inc." in loose


def test_entity_tables(spark):
    d = spark.createDataFrame([("a", "Ann Example and Ann  Example"), ("b", "Ann Example")], "k string, t string")
    m = entities.mentions(d, "k", "t")
    e = entities.entity_table(m, "k").collect()
    assert [(r.entity_id, r.normalized_text, r.occurrence_count, r.first_seen_doc_id) for r in e] == [(1, "ann example", 3, "a")]
    n = spark.createDataFrame([("J. Q.  Public", "person"), ("St. Ives, UK", "location")], "t string, k string")
    assert [r[0] for r in n.select(entities.normalise(F.col("t"), F.col("k"))).collect()] == ["j q public", "st. ives, uk"]


def test_legal(spark):
    text = "Case 1:12-cv-34 Document 5 Filed 01/02/49\nUNITED STATES DISTRICT COURT\nSOUTHERN DISTRICT\nAnn Example,\n  Plaintiff,\n v.\n Bob Doe, et al.,\n  Defendants\nTHE TITLE OF IT\nMOTION TO dismiss\n" + "This line is long enough to be the first one of the body text here.\n12\nCase 1: x\nshort\n"
    r = legal.parse(spark.createDataFrame([(1, text), (2, None)], "k int, t string"), "k", "t").orderBy("k").collect()
    assert r[0].case_number == "1:12-cv-34" and str(r[0].filing_date) == "2049-01-02" and r[0].document_type == "motion"
    assert r[0].plaintiffs[-1].endswith("Ann Example") and "Bob Doe" in r[0].defendants[0] and r[0].body.count("\n") == 0
    assert r[1].case_number is None and r[1].plaintiffs == [] and r[1].body == ""
    a = spark.createDataFrame([("Attorneys for Plaintiff:\nAnn Example , Law Firm Bar No. 5\n\n",)], "t string").select(legal.attorneys(F.col("t")).alias("a")).collect()[0].a
    assert a[0].name == "Ann Example"


def test_news(spark):
    d = spark.createDataFrame([(1, "By Ann Example\nMiami Herald\nJanuary 5, 2015\n" + "x" * 60 + "\nPage 3 of 4 and some more\nlast line that is long enough"), (2, "By Madonna\n"), (3, None)], "k int, t string")
    r = news.parse(d, "k", "t").orderBy("k").collect()
    assert r[0].author is None and r[1].author == "Madonna" and r[0].publication == "Miami Herald" and str(r[0].publication_date) == "2015-01-05"
    assert r[0].summary == "x" * 60 and "Page" not in r[0].body
    assert news.parse(d, "k", "t", loose=True).orderBy("k").collect()[0].author == "Ann Example"


def test_places_like_the_pattern():
    """The linear scanner gives the matches of the pattern, on texts made of its pieces too, and takes a long run of capitalised words at once."""
    import random
    import re
    import time

    rng, p = random.Random(3), re.compile(entities.PATTERNS["location"][0])
    for _ in range(4000):
        text = "".join(rng.choice(["Ab", "Reno", "NV", "A", "b", " ", " ", ",", ", ", "\n", "Mc", "D", "x", "1", ".", "é"]) for _ in range(rng.randrange(1, 24)))
        assert list(entities.places(text)) == [(m[0].strip(), m.start(), m.end()) for m in p.finditer(text)], text
    began = time.time()
    entities.found_in("Abc Defg " * 12_000)
    assert time.time() - began < 10
