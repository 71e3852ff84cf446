import json

from pyspark.sql import functions as F

from folioscope import __main__ as cli
from folioscope.config import ModelConfig
from folioscope.operators import classify, entities, model
from folioscope.operators.numbering import numbered
from folioscope.sources import sinks


def test_whole_run(spark, tmp_path, capsys, monkeypatch):
    texts = tmp_path / "texts"
    texts.mkdir()
    (texts / "a.txt").write_text("From: Ann Example <a@x.org>\nTo: b@x.org\nSubject: x\nSent: 1/2/2015 10:00:00 AM\n\nAnn Example gave a donation to Bob Sample.\nOn Apr 5, 2018, at 1:41 PM, Bob Sample <b@x.org> wrote:\nhello\n")
    (texts / "b.txt").write_text("Bob Sample wrote to Bob Samplee on 1/2/2015 about the donation.\n")
    t = ["--tables", str(tmp_path / "t")]

    def run(*args):
        assert cli.main([*args, *t]) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    assert run("survey", str(texts), "--seed", r"Ann=\bAnn\b")[0]["total_documents"] == 2
    assert run("list-emails")[0]["doc_id"] == "a"
    assert run("load", str(texts))[0]["loaded"] == 2
    assert run("extract-entities")[0]["emails"] == 1
    assert run("init-canonical")[0]["avg_aliases"] == 1.0
    assert cli.parser().parse_args(["find-duplicates"]).min_occurrences == 5 and run("find-duplicates", "person") == []
    few = ("--min-occurrences", "1")
    assert len(run("find-duplicates", "person", *few, "--output", str(tmp_path / "pairs"))) == 1
    assert spark.read.json(str(tmp_path / "pairs")).collect()[0].total_candidates == 1
    assert run("llm-review", "person", *few, "--dry-run") == [] or run("llm-review", "person", *few, "--dry-run")[0]["should_merge"] is False
    assert run("auto-merge", "person", *few, "--least", "0.8", "--dry-run")[0]["status"] == "merged"
    assert run("merge-report", "person", *few)[0]["total_candidates"] == 1
    assert run("auto-merge", "person", *few, "--least", "0.8", "--output", str(tmp_path / "log"))[0]["status"] == "merged"
    assert run("find-duplicates", "person", *few) == [] and spark.read.json(str(tmp_path / "log")).count() == 1
    assert run("init-canonical")[0]["avg_aliases"] > 1.0 and run("init-canonical", "--force")[0]["avg_aliases"] == 1.0
    assert {r["doc_id"] for r in run("search", "donation")} == {"a", "b"}
    assert run("find-threads", "bob")[0]["author"].startswith("Bob Sample")
    assert run("query-entity", "bob samp")[0]["doc_id"] in ("a", "b")
    assert run("document", "a")[0]["entities"] == ["Ann"] and run("show-dlq") == []
    assert any(r["section"] == "total" and r["n"] == 2 for r in run("stats"))
    assert run("run-steps") == [{"status": "completed", "documents": 2}] and run("run-steps", "classify") == [{"status": "completed", "documents": 2}]
    assert run("survey", str(texts), "--output", str(tmp_path / "report"))[0] == run("report", str(tmp_path / "report"))[0]
    monkeypatch.setenv("FOLIOSCOPE_MODEL_ENABLED", "no")
    try:
        run("llm-review", "person")
        raise AssertionError
    except SystemExit:
        pass


def test_model_replies():
    """Replies are read from whatever stands around their JSON; what cannot be read, or raises, counts as no answer."""
    said = {"which kind": 'Sure: {"category": "Letter", "confidence": 0.9, "reasoning": "salutation"} ok', "name the": '```json\n{"people": ["Ann Example", 3, " "], "dates": ["1/2/2015"]}\n```', "is 'x'": '{"valid": false}', "do these": '{"should_merge": true, "confidence": 0.9, "reasoning": "typo"}'}
    talk = lambda prompt: next(v for k, v in said.items() if prompt.lower().startswith(k))

    def broken(prompt):
        raise TimeoutError

    assert model.classifier(talk)(["t"]) == [("letter", 0.9, "salutation")] and model.classifier(broken)(["t"]) == model.classifier(lambda p: "{}")(["t"]) == model.classifier(lambda p: '{"category": "x", "confidence": 1}')(["t"]) == [None]
    assert model.extractor(talk)(["t"]) == [[("people", "Ann Example"), ("dates", "1/2/2015")]] and model.extractor(broken)(["t"]) == model.extractor(lambda p: "[]")(["t"]) == [None]
    assert not model.validator(talk)("x", "person", None) and model.validator(broken)("x", "person", None)
    assert model.reviewer(talk)("a", "b", None, "c") == (True, "typo") and model.reviewer(talk, 0.95)("a", "b", None, None)[0] is False and model.reviewer(broken)("a", "b", None, None) == (False, "error: no answer")
    assert model.json_in("no json {x") is None and model.json_in(None) is None and len(model.CATEGORIES) == 10
    assert model.caller(ModelConfig()) is None


def test_failing_models_change_nothing(spark):
    def fails(texts):
        raise RuntimeError

    d = spark.createDataFrame([("a", "meet Ann Example"), ("b", None)], "k string, t string")
    assert entities.by_model(d, "k", "t", fails).count() == 0
    assert {(r.k, r.method) for r in classify.hybrid(d, "k", "t", fails).collect()} == {("a", "regex"), ("b", "regex")}


def test_tables_are_swapped_at_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.current_version(spark, path) is None
    sinks.swap_table(spark.range(3), path)
    old = sinks.read_table(spark, path)
    sinks.swap_table(old.filter("id > 0"), path)  # a table may be made from its own state
    assert sinks.read_table(spark, path).count() == 2 and old.count() == 3
    sinks.swap_table(spark.range(1), path)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v")]) == 2


def test_numbers_are_consecutive(spark):
    d = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), F.lit("x").alias("v"))
    assert [r.n for r in numbered(d, ["k"], "n").orderBy("k").collect()] == list(range(1, 501))
    assert numbered(d.limit(0), ["k"], "n").count() == 0
    same = numbered(spark.createDataFrame([(None,), (1,), (1,)], "k int"), ["k"], "n", 10).collect()
    assert sorted((r.n, r.k) for r in same) == [(10, None), (11, 1), (12, 1)]


def test_model_mentions(spark):
    d = spark.createDataFrame([("a", "meet ANN Example"), ("b", None), ("c", "fails")], "k string, t string")
    m = entities.by_model(d, "k", "t", lambda ts: [None if t == "fails" else [("people", "Ann Example"), ("locations", "Nowhere")] if t else [] for t in ts]).orderBy("ordinal").collect()
    assert [(r.k, r.type, r.position_start, r.position_end, r.confidence) for r in m] == [("a", "person", 5, 16, 0.9), ("a", "location", None, None, 0.9)]


def test_config(spark, monkeypatch):
    monkeypatch.setenv("X_MODEL_URL", "http://h")
    monkeypatch.setenv("X_MODEL_ENABLED", "yes")
    assert ModelConfig.from_env("X_") == ModelConfig("http://h", "", 30.0, True)
    assert ModelConfig.from_session(spark) == ModelConfig()
