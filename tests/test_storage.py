import json

from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.session import cut
from folioscope.sources import corpus, sinks
from folioscope.streaming import inbox, manifest, steps
from folioscope.tables import latest


def test_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a_HOUSE_OVERSIGHT_000007_x.txt").write_bytes(b"\xef\xbb\xbfFrom: a\r\nb\xff")
    (tmp_path / "sub/b.txt").write_text("two")
    (tmp_path / "c.md").write_text("no")
    rows = {r.doc_id: r for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert set(rows) == {"HOUSE_OVERSIGHT_000007", "b"} and rows["HOUSE_OVERSIGHT_000007"].full_text == "﻿From: a\nb�"
    bare = corpus.read_corpus(spark, str(tmp_path), keep_bom=False, most_chars=4).filter("doc_id <> 'b'").collect()
    assert bare[0].full_text == "From" and len(bare[0].sha256) == 64


def test_json_files(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps([{"doc_id": "a", "filepath": "x", "document_type": "email", "confidence": 0.9, "entity_mentions": ["A"]}]))
    assert corpus.read_classifications(spark, str(p)).collect()[0].entity_mentions == ["A"]
    q = tmp_path / "m.json"
    q.write_text(json.dumps({"auto_merge": [{"entity1_id": 1, "entity2_id": 2, "confidence": 0.99}]}))
    assert corpus.read_merge_candidates(spark, str(q)).collect()[0].entity2_id == 2
    d = spark.range(5)
    assert corpus.by_keys(d, "id", [1, 3]).count() == 2 and corpus.by_keys(d, "id", list(range(2, 1100))).count() == 3
    sinks.write_json(d, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 5


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert {tuple(r) for r in sinks.upsert(old, new, ["k"], "v").collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert {tuple(r) for r in sinks.insert_or_ignore(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "e")}
    c = spark.createDataFrame([("f1",), ("f2",), (None,)], "filepath string")
    f = spark.createDataFrame([("f1", "t")], "filepath string, full_text string")
    assert tuple(sinks.counters(sinks.load_status(c, f)).collect()[0]) == (1, 1, 1)
    t = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", None)], "k int, v string, loaded_at int")
    assert {(r.k, r.v) for r in latest(t, ["k"]).collect()} == {(1, "y"), (2, "z")}


def test_step_graph():
    assert manifest.dependents("classify") == {"extract_email_metadata", "extract_entities", "assemble_metadata"}
    names = [s.name for s in manifest.in_order()]
    assert names.index("classify") < names.index("extract_email_metadata") < names.index("extract_entities") < names.index("assemble_metadata")


def step(name, version=1, status="success", started="1"):
    return (name, version, started, started, status, None, None)


def test_manifest_columns(spark):
    d = spark.createDataFrame([([step("classify"), step("extract_urls"), step("classify", 2, "success", "3")],), ([],)], f"steps array<{schemas.STEP.simpleString()}>")
    r = d.select(manifest.has_step(F.col("steps"), "classify").alias("h"), manifest.last_step(F.col("steps"))["step_version"].alias("v"), manifest.dedupe(F.col("steps")).alias("d"), manifest.drop_after(F.col("steps"), "classify").alias("t")).collect()
    assert r[0].h and r[0].v == 2 and [(x.step_name, x.step_version) for x in r[0].d] == [("classify", 2), ("extract_urls", 1)] and len(r[0].t) == 1
    assert not r[1].h and r[1].v is None and r[1].d == []


def test_version_change_drops_dependents(spark):
    docs = spark.createDataFrame([("a", "f", "email"), ("b", "f", "x")], "doc_id string, filepath string, t string")
    ok = lambda x: x.select("doc_id", F.lit("done").alias("outcome"))
    m = manifest.create(docs, "doc_id", "filepath", "t0")
    for s in ("classify", "extract_email_metadata", "extract_urls"):
        m = cut(manifest.run_step(m, docs, manifest.Step(s, 1, (), ok), "t1"))
    assert manifest.due(m, manifest.Step("classify", 1)).count() == 0
    m = manifest.run_step(m, docs, manifest.Step("classify", 2, (), lambda x: ok(x.filter("t = 'email'"))), "t2")
    rows = {r.doc_id: r for r in m.collect()}
    assert [s.step_name for s in rows["a"].steps] == ["classify", "extract_urls"] and rows["b"].status == "failed"


def test_all_steps(spark, tmp_path):
    """The five steps over a mail, a note and an empty text; metadata comes from the last alone, and a second run changes nothing."""
    mail = "From: Ann Example <a@x.org>\nTo: Bob Sample <b@x.org>\nSubject: trip\nSent: 1/2/2015 10:00:00 AM\n\nSee https://example.com/a.pdf with Mr. John Smith in Reno, NV today.\n"
    docs = spark.createDataFrame([("a", "a.txt", mail), ("b", "b.txt", "A note on nothing."), ("c", "c.txt", "")], "doc_id string, filepath string, full_text string")
    path = str(tmp_path / "m")
    assert not manifest.has_manifests(spark, path) and manifest.load_manifests(spark, path).count() == 0
    m = manifest.run_all(manifest.create(docs, "doc_id", "filepath", "t0"), docs, steps.all_steps(), "t1")
    manifest.write_manifests(m, path)
    assert manifest.has_manifests(spark, path, "a") and not manifest.has_manifests(spark, path, "z")
    rows = {r.doc_id: r for r in manifest.load_manifests(spark, path).collect()}
    a = rows["a"].metadata
    assert {r.status for r in rows.values()} == {"completed"} and [x.step_name for x in rows["a"].steps] == [s.name for s in manifest.in_order()]
    assert a["doc_type"] == "email" and a["subject"] == "trip" and json.loads(a["urls"]) == ["https://example.com/a.pdf"] and a["urls_count"] == "1"
    assert {"Ann Example", "Bob Sample", "John Smith"} <= set(json.loads(a["persons"])) and json.loads(a["locations"]) == ["Reno, NV"]
    assert rows["b"].metadata["doc_type"] == "other" and "subject" not in rows["b"].metadata and rows["c"].metadata["entities_count"] == "0"
    assert json.loads([x for x in rows["b"].steps if x.step_name == "extract_email_metadata"][0].outcome)["skipped"] is True
    again = manifest.run_all(m, docs, steps.all_steps(), "t2")
    assert sorted(map(str, again.collect())) == sorted(map(str, m.collect()))
    noted = manifest.update_metadata(m, "subject", F.lit("x"), "t3").filter("doc_id = 'a'").collect()[0]
    assert noted.metadata["subject"] == "x" and noted.metadata["doc_type"] == "email" and noted.updated_at == "t3"
    # A new version of the first step drops what depends on it, and the mails' step runs anew.
    newer = tuple(manifest.Step(s.name, 3, s.depends_on, s.run) if s.name == "classify" else s for s in steps.all_steps())
    first = manifest.run_step(m, docs, newer[0], "t4").filter("doc_id = 'a'").collect()[0]
    assert {s.step_name for s in first.steps} == {"classify", "extract_urls"}


def test_manifests_and_order(spark, tmp_path):
    assert not corpus.exists(spark, str(tmp_path / "none")) and corpus.read_manifests(spark, str(tmp_path / "none")).count() == 0
    for n in ("b", "a", "c"):
        (tmp_path / f"{n}.txt").write_text(n)
    assert [r.doc_id for r in corpus.read_corpus(spark, str(tmp_path), in_order=True).collect()] == ["a", "b", "c"]


def test_inbox(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "a.txt").write_text("CONGRESSIONAL RECORD")
    (box / "b.txt").write_text("  ")
    args = (spark, str(box), str(tmp_path / "done"), str(tmp_path / "dead"), str(tmp_path / "state"))
    inbox.run_available(*args)
    (box / "c.txt").write_text("By Ann Example\n")
    inbox.run_available(*args)
    assert {r.doc_id: r.doc_type for r in spark.read.parquet(str(tmp_path / "done")).collect()} == {"a": "congressional", "c": "news"}
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == ["b"]
