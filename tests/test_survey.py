from pyspark.sql import functions as F

from folioscope.functions import urls
from folioscope.operators import classify, survey
from folioscope.text import lines, match_spans, tokens

MAIL = "From: Ann Example\nSent: 1/15/2017 10:30:00 AM\nTo: tracked@example.org\nSubject: Trip\nImportance: High\n\nAnn met the Seed Person.\n"
PROSE = "   Once (L to R) the photographer came.\n" + "He waited.\n" * 120
PATTERNS = {"Seed Person": r"\bSeed\s+Person\b", "Ann": r"\bAnn\b"}


def frame(spark, *texts):
    return spark.createDataFrame([(i, f"/x/prefix_HOUSE_OVERSIGHT_{i:06d}_a.txt", t) for i, t in enumerate(texts)], "n int, filepath string, full_text string")


def test_mail_and_prose(spark):
    rows = survey.classify(frame(spark, MAIL, PROSE, "", None), PATTERNS).orderBy("doc_id").collect()
    assert [r.document_type for r in rows] == ["email", "narrative", "narrative", "error"]
    assert rows[0].confidence > 0.7 and rows[0].doc_id == "HOUSE_OVERSIGHT_000000"
    assert rows[0].entity_mentions == ["Seed Person", "Ann"]
    assert abs(rows[1].confidence - 1.0) < 1e-9
    assert rows[2].issues == ["Very short document", "Empty file"] and rows[2].line_count == 0
    assert rows[3].confidence == 0


def test_report(spark):
    c = survey.classify(frame(spark, *[MAIL] * 5), PATTERNS)
    assert survey.type_report(c).collect()[0].documents == 5
    r = survey.report(c).collect()[0]
    assert r.total_documents == 5 and r.entity_mentions == {"Seed Person": 5, "Ann": 5} and r.document_types["email"].documents == 5
    assert survey.emails(c).count() == 5


def test_ties_and_low_scores(spark):
    d = survey.scored(frame(spark, "From: a\nTo: b\nSubject: c\nx", "To: x\n"))
    assert {r.document_type for r in d.collect()} == {"email", "unknown"}


def test_lines_and_samples(spark):
    d = spark.createDataFrame([("a\nb\n",), ("",), ("\n".join(map(str, range(30))),)], "t string")
    assert [r[0] for r in d.select(F.size(lines(F.col("t")))).collect()] == [2, 0, 30]
    got = d.select(survey.sample_lines(lines(F.col("t")))).collect()
    assert got[0][0] == ["a", "b"] and got[2][0] == [str(i) for i in [*range(10), *range(20, 30)]]


def test_structural_types(spark):
    legal = "Case 1:12-cv-34\nUNITED STATES DISTRICT COURT\nDocument 5 Filed 1/2/2013\n"
    mail = "From: a b\nTo: c\nSubject: d\nSent: 1/2/2015\n"
    prose = ("I remember " + "x" * 210 + "\n") + "and then we walked on for a long time\n" * 10
    d = spark.createDataFrame([(1, legal), (2, mail), (3, "By Ann Example\n"), (4, "CONGRESSIONAL  RECORD"), (5, prose), (6, None)], "n int, t string")
    rows = d.select("n", classify.document_type(F.col("t")).alias("x")).orderBy("n").select("x.*").collect()
    assert [r.doc_type for r in rows] == ["legal", "email", "news", "congressional", "narrative", "other"]
    assert rows[0].confidence == 0.4 + 0.3 + 0.2 and rows[0].subtype == "court_filing"


def test_hybrid_asks_only_for_unsure(spark):
    d = spark.createDataFrame([("a", "From: a b\nTo: c\nSubject: d\nSent: 1/2/2015\n"), ("b", "letter"), ("c", "fails"), ("d", "low")], "k string, t string")
    answer = {"letter": ("letter", 0.9, "r"), "fails": None, "low": ("x", 0.2, "r")}
    rows = {r.k: r for r in classify.hybrid(d, "k", "t", lambda ts: [answer[t] for t in ts]).collect()}
    assert rows["a"].method == "regex" and rows["b"].doc_type == "letter"
    assert rows["c"].doc_type == rows["d"].doc_type == "other"
    assert classify.hybrid(d, "k", "t").filter("method = 'regex'").count() == 4


def test_urls(spark):
    def of(t):
        return spark.createDataFrame([(1, t)], "k int, t string").select(urls.urls(F.col("t")).alias("u")).collect()[0].u

    assert [(u.domain, u.type) for u in of("Visit https://example.com for details")] == [("example.com", "other")]
    assert [u.type for u in of("https://www.youtube.com/a and https://news.bbc.com/b")] == ["youtube", "news"]
    assert len(of("https://a.org/x https://a.org/x")) == 1 and of("none, www.example.com") == [] and of(None) == []
    assert [u.type for u in of("https://youtube.com/1 https://youtu.be/2 https://a.org/d.pdf https://twitter.com/x https://t.co/y")] == ["youtube", "youtube", "pdf", "social", "social"]
    assert of("Start https://example.com end")[0].position == 6
    assert of("\U0001f600 é http://a.org")[0].position == 4 and len(of("http://a.org https://a.org")) == 2


def test_offsets_and_tokens(spark):
    d = spark.createDataFrame([("\U0001f600ab12cd345",)], "t string")
    assert [(r.text, r.start, r.end) for r in d.select(match_spans(F.col("t"), r"\d+").alias("m")).collect()[0].m] == [("12", 3, 5), ("345", 7, 10)]
    assert spark.createDataFrame([("Café, déjà-vu 12",)], "t string").select(tokens(F.col("t"))).collect()[0][0] == ["cafe", "deja", "vu", "12"]
