import pytest
from pyspark.sql import functions as F

from folioscope.operators import timestamps as T

NY = ("America/New_York", "mdy")


@pytest.mark.parametrize(
    "text,zone,order,want",
    [
        ("2014-04-28T22:07:48.751+05:30", None, None, "2014-04-28T16:37:48Z"),
        ("1351389546", *NY, "2012-10-28T01:59:06Z"),
        ("1369621850434", *NY, "2013-05-27T02:30:50Z"),
        ("  Tue Aug  8 15:05:24 2017 +0000", *NY, "2017-08-08T15:05:24Z"),
        ("Samstag, 13. April 2013 00:22", *NY, "2013-04-13T04:22:00Z"),
        ("tor. 22. nov. 2018 kl. 13:47", "Europe/Oslo", "dmy", "2018-11-22T12:47:00Z"),
        ("lundi 17 novembre 2008 00:42", "Europe/Paris", "dmy", "2008-11-16T23:42:00Z"),
        ("3/14/13  03:01", *NY, "2013-03-14T07:01:00Z"),
        ("14/3/13  03:01", "Europe/London", "dmy", "2013-03-14T03:01:00Z"),
        ("12/4/2012 7:43:39 PM (UTC-06:00)", *NY, "2012-12-05T01:43:39Z"),
        ("July 17, 2014 2:49:13 am CDT", None, None, "2014-07-17T07:49:13Z"),
        ("June 25, 2015 1:23:33 PM BST", None, None, "2015-06-25T12:23:33Z"),
        ("November 4, 2018 1:30:00 AM", *NY, "2018-11-04T05:30:00Z"),  # twice: the earlier
        ("March 11, 2018 2:30:00 AM", *NY, "2018-03-11T07:30:00Z"),  # skipped: moves on by the gap
        ("16 September 2010", *NY, "2010-09-16T04:00:00Z"),
        ("20.01.2018 00:52", "Europe/Oslo", "dmy", "2018-01-19T23:52:00Z"),
        ("31/31/2014 25:61", *NY, None),
        ("0000-00-00 00:00:00", *NY, None),
        ("[illegible]", *NY, None),
        ("", *NY, None),
        (None, *NY, None),
    ],
)
def test_read(text, zone, order, want):
    assert T.read(text, zone, order) == want


def test_orders_and_edges(spark):
    src = spark.createDataFrame([("us.example", "America/New_York", "mdy"), ("uk.example", "Europe/London", "dmy"), ("uk.example", "Europe/London", "dmy")], "mail_domain string, zone_name string, date_order string")
    rows = [(1, "A <a@us.example>", "1/2/2015 1:00:00 PM"), (2, "b@UK.example", "1/2/2015 1:00:00 PM"), (3, "Nobody", "1/2/2015 1:00:00 PM"), (4, None, None), (5, "x@other.example", "25/12/2015"), (5, "x@other.example", "25/12/2015")]
    d = spark.createDataFrame(rows, "utc_id int, who string, when string").withColumnRenamed("when", "date")
    got = {(r.utc_id, r.utc, r.status) for r in T.normalise(d, "date", "who", src).collect()}
    assert got == {(1, "2015-01-02T18:00:00Z", "read"), (2, "2015-02-01T13:00:00Z", "read"), (3, "2015-01-02T13:00:00Z", "ambiguous"), (4, None, "none"), (5, "2015-12-25T00:00:00Z", "read")}
    assert T.normalise(d.limit(0), "date", "who", src).count() == 0


def test_clashing_columns(spark):
    src = spark.createDataFrame([("x.example", "Europe/Oslo", "dmy")], "mail_domain string, zone_name string, date_order string")
    d = spark.createDataFrame([("a@x.example", "2015-01-01 01:00", "old", "old", "z", 1)], "who string, date string, utc string, status string, zone_name string, `a.b` int")
    r = T.normalise(d, "date", "who", src).collect()[0]
    assert r.utc == "2015-01-01T00:00:00Z" and r.status == "read" and r.zone_name == "z" and r["a.b"] == 1


def read_status(spark, values, sources=(), **more):
    src = spark.createDataFrame(list(sources), "mail_domain string, zone_name string, date_order string")
    d = spark.createDataFrame([(i, who, t) for i, (who, t) in enumerate(values)], "i int, who string, date string")
    return {x.date: (x.utc and x.utc[:10], x.status) for x in T.normalise(d, "date", "who", src, **more).collect()}


def test_the_mixture_decides(spark):
    """What a source's own values show chooses the reading of those that they leave open, and says how sure it is."""
    mixed = read_status(spark, [("a@x.example", t) for t in ("13/1/2015", "14/1/2015", "1/13/2015", "1/2/2015")])
    assert mixed["1/2/2015"][1] == "ambiguous" and mixed["13/1/2015"] == ("2015-01-13", "read")
    days = [("a@x.example", f"{d}/1/2015") for d in range(13, 32)] + [("a@x.example", "1/2/2015")]
    assert read_status(spark, days)["1/2/2015"] == ("2015-02-01", "read")
    # A declared order counts as some rows: it settles few values, but not against many others.
    us = [("x.example", "UTC", "mdy")]
    assert read_status(spark, [("a@x.example", "1/2/2015")], us)["1/2/2015"] == ("2015-01-02", "read")
    assert read_status(spark, [*days[:5], days[-1]], us)["1/2/2015"] == ("2015-01-02", "ambiguous")
    many = [("a@x.example", f"{d}/{m}/2015") for d in range(13, 29) for m in range(1, 13)] + [days[-1]]
    assert read_status(spark, many, us)["1/2/2015"] == ("2015-02-01", "read")
    # Without the declaration's rows the same values stay open.
    assert read_status(spark, [("a@x.example", "1/2/2015")], us, prior=0.0)["1/2/2015"] == ("2015-01-02", "ambiguous")


def test_year_first_and_hyphens(spark):
    years = [("a@x.example", f"{y}/11/{d}") for y in (32, 45, 51, 60, 77, 80, 91) for d in (12, 20, 30)]
    got = read_status(spark, [*years, ("a@x.example", "10/11/12"), ("a@x.example", "30-4-2015"), ("a@x.example", "31/31/15"), ("a@x.example", "0/0/0000")])
    assert got["45/11/20"] == ("2045-11-20", "read") and got["10/11/12"][0] == "2010-11-12"
    assert got["30-4-2015"] == ("2015-04-30", "read") and got["31/31/15"] == (None, "none") and got["0/0/0000"] == (None, "none")


def test_some_values_stay_ambiguous(spark):
    from folioscope.plans.queries import QUERIES

    n = {r.status: r.n for r in QUERIES["p5_status"](spark, "/root/testdata/sf0.01").groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert n["ambiguous"] >= 1 and n["read"] > 20 * n["ambiguous"] and n["none"] >= 1


def test_found_counts_repeats_once(spark):
    m = spark.createDataFrame([(1, "a@x", "2015-01-01"), (1, "a@x", "2015-01-01")], "doc_id long, from_addr string, date string")
    t = spark.createDataFrame([(1, 0, "a@x", "2015-01-01 10:00", "n/a")], "doc_id long, message_index int, author string, date string, date_str string")
    src = spark.createDataFrame([], "mail_domain string, zone_name string, date_order string")
    assert {tuple(r) for r in T.found(m, t, src).collect()} == {("email_date", 1, -1, "2015-01-01T00:00:00Z"), ("date", 1, 0, "2015-01-01T10:00:00Z")}
