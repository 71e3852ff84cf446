from folioscope.operators import canonical, resolve, search
from folioscope.plans import api
from pyspark.sql import functions as F

ENT = "entity_id long, text string, type string, normalized_text string, occurrence_count long"


def ents(spark, rows):
    return spark.createDataFrame([(i, n, "person", n, c) for i, (n, c) in enumerate(rows, 1)], ENT)


def test_candidates(spark):
    e = ents(spark, [("john a smith", 20), ("john a smyth", 6), ("smith", 9), ("smyth", 8), ("john doe", 7), ("jo hn doe", 7)])
    _, a = canonical.initialise(e)
    got = {(r.entity1_text, r.entity2_text): r for r in resolve.candidates(e, a).collect()}
    assert set(got) == {("john a smith", "john a smyth")}  # one word each shares nothing; "joh" and "jo " are other blocks
    r = got[("john a smith", "john a smyth")]
    assert r.levenshtein == 1 and abs(r.jaccard - 0.5) < 1e-12 and r.confidence == min(0.95 + 0.05, 1.0)
    assert r.reason == "Edit distance=1 (likely typo); Good token overlap (50%)"


def test_merged_entities_leave_the_report(spark):
    """A merge takes its entity out of all later pairs; repeated rows of the alias table and several shared words give no pair twice."""
    e = ents(spark, [("ann mary example", 9), ("ann mary exampel", 8), ("ann mary examples", 7)])
    _, a = canonical.initialise(e)
    pairs = lambda aliases: sorted((r.entity1_id, r.entity2_id) for r in resolve.candidates(e, aliases).collect())
    assert pairs(a) == pairs(a.unionByName(a)) == [(1, 2), (1, 3), (2, 3)]
    moved = canonical.merge(a, spark.createDataFrame([(2, 1, 0.9)], "entity_id long, target long, confidence double"))
    assert pairs(moved) == [(1, 3)] and pairs(a.limit(0)) == []


def test_merge_of_an_unknown_entity_is_an_error(spark):
    e = ents(spark, [("a b", 1), ("a c", 10)])
    c, a = canonical.initialise(e)
    try:
        canonical.merge_one(a, 99, 1)
        raise AssertionError
    except ValueError:
        pass
    assert {r.entity_id: r.canonical_id for r in canonical.merge_one(a, 2, 1).collect()} == {1: 1, 2: 1}
    same = canonical.initialise(e.limit(1), existing=(c, a))
    assert same[0].count() == 2 and canonical.initialise(e, existing=(c.limit(0), a.limit(0)))[0].count() == 2


def test_float_edges(spark):
    d = spark.createDataFrame([(1, 0.25), (3, 0.85), (2, 0.85), (2, 0.25), (1, 1 / 3)], "d int, j double")
    c = [r[0] for r in d.select(resolve.confidence(F.col("d"), F.col("j"), F.lit(5), F.lit(5))).collect()]
    assert c == [0.95 - 0.15, 0.70 + 0.10, 0.85 + 0.10, 0.85 - 0.15, 0.95]
    t = [r[0] for r in d.select(resolve.tier(resolve.confidence(F.col("d"), F.col("j"), F.lit(5), F.lit(5)))).collect()]
    assert t == ["manual_review", "manual_review", "llm_review" if 0.85 + 0.10 < 0.95 else "auto_merge", "manual_review" if 0.85 - 0.15 >= 0.7 else None, "auto_merge"]


def test_merge_moves_one_alias_only(spark):
    e = ents(spark, [("a b", 1), ("a c", 10), ("a d", 2)])
    c, a = canonical.initialise(e)
    a = canonical.merge(a, spark.createDataFrame([(3, 1, 0.9)], "entity_id long, target long, confidence double"))
    a = canonical.merge(a, spark.createDataFrame([(1, 2, 0.9)], "entity_id long, target long, confidence double"))
    at = {r.entity_id: r.canonical_id for r in a.collect()}
    assert at == {1: 2, 2: 2, 3: 1}
    t = {r.canonical_id: r.total_mentions for r in canonical.totals(c, a, e).collect()}
    assert t == {2: 11, 1: 2} and sum(t.values()) == 13


def test_auto_merge_replays_in_order(spark):
    e = ents(spark, [("x one a", 50), ("x one b", 20), ("x one c", 5)])
    _, a = canonical.initialise(e)
    pairs = spark.createDataFrame([(1, 2, 20, 3, 5, 0.99), (2, 1, 50, 2, 20, 0.98), (3, 1, 50, 3, 5, 0.97), (4, 1, 50, 9, 1, 0.96)], "ord int, entity1_id long, entity1_count long, entity2_id long, entity2_count long, confidence double")
    moves, log = canonical.auto_merge(pairs, a)
    assert [r.status for r in log.orderBy("ord").collect()] == ["merged", "merged", "merged", "error"]
    assert {r.entity_id: r.target for r in moves.collect()} == {3: 1, 2: 1}


def docs(spark):
    return spark.createDataFrame([(1, "Ann Example gave a donation to the fund"), (2, "Example Ann sailed; café"), (3, "donation donation and a ship")], "doc_id int, full_text string")


def test_search(spark):
    d = docs(spark)
    p, z = search.postings(d, "doc_id", "full_text"), search.lengths(d, "doc_id", "full_text")
    ids = lambda q: sorted(r.doc_id for r in search.ranked(p, z, q).collect())
    assert ids("donation") == [1, 3] and ids("donation NOT ship") == [1] and ids("(ship OR sailed) ann") == [2]
    assert ids('"ann exam"*') == [1] and ids("Café") == [2] and ids("nothing") == []
    best = search.search(d, p, z, "donation", 1).collect()
    assert [(r.doc_id, r.rank, r.snippet) for r in search.search_texts(d, "donation", 1).collect()] == [(best[0].doc_id, best[0].rank, best[0].snippet)]
    for q in ("donation", "(ship OR sailed) ann", '"ann exam"*', "don* NOT fund", '"gave a donation"'):
        assert {(r.doc_id, round(r.rank, 9)) for r in search.ranked(p, z, q).collect()} == {(r.doc_id, round(r.rank, 9)) for r in search.ranked_texts(d, "doc_id", "full_text", q).collect()}
    assert best[0].doc_id == 3 and "**donation**" in best[0].snippet
    for bad in ("", '"', "AND x", "(a"):
        try:
            search.parse(bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_stored_index(spark, tmp_path):
    search.write_index(docs(spark), "doc_id", "full_text", str(tmp_path))
    p, z = search.read_index(spark, str(tmp_path))
    assert sorted(r.doc_id for r in search.ranked(p, z, "donation OR caf*").collect()) == [1, 2, 3]
    plan = search.hits_in_index(p, [search.phrase("donation")])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "PartitionFilters: [isnotnull(bucket" in plan
    late = spark.createDataFrame([(2, "a new donation"), (4, "Łódź ĝardeno")], "doc_id int, full_text string")
    search.update_index(late, "doc_id", "full_text", str(tmp_path), "p1")
    ids = lambda q: sorted(r.doc_id for r in search.ranked(*search.read_index(spark, str(tmp_path)), q).collect())
    assert ids("donation") == [1, 2, 3] and ids("cafe") == [] and ids("gardeno") == [4]
    search.remove_from_index(spark, str(tmp_path), spark.createDataFrame([(3,), (9,)], "doc_id int"))
    assert ids("donation") == [1, 2] and search.read_index(spark, str(tmp_path))[1].count() == 3


def test_api(spark):
    d = spark.createDataFrame([(1, "f1", "email", 0.9), (2, "f2", "email", 0.5), (3, "f3", "other", 0.7)], "doc_id int, filepath string, doc_type string, confidence double")
    m = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (3, "B")], "doc_id int, entity_name string")
    assert [r.doc_id for r in api.find_by_entity(d, m, "A", 2).collect()] == [1, 3]
    assert api.get_document(d, m, 3).collect()[0].entities == ["A", "B"]
    s = {(r.section, r.name): r.n for r in api.document_stats(d, m).collect()}
    assert s[("total", None)] == 3 and s[("type", "email")] == 2 and s[("entity", "A")] == 3
    mails = spark.createDataFrame([(1, "s", "x", None), (2, "s", "x", "[]"), (3, "s", "x", '["bad"]')], "doc_id int, subject string, from_addr string, parsing_issues string")
    assert [r.doc_id for r in api.dead_letters(mails, d).collect()] == [3]


def test_commands(spark, tmp_path):
    from folioscope.plans import commands
    from folioscope.sources import corpus

    (tmp_path / "a.txt").write_text("From: Ann Example <a@x.org>\nTo: b@x.org\nSubject: x\nSent: 1/2/2015\n\nAnn Example met Bob Sample.\n")
    (tmp_path / "b.txt").write_text("Bob Sample wrote to Bob Samplee on 1/2/2015.\n")
    classified, report = commands.run_survey(spark, str(tmp_path), {"Ann": r"\bAnn\b"})
    assert report.collect()[0].total_documents == 2
    docs, named, counts = commands.load(classified, corpus.read_corpus(spark, str(tmp_path)))
    assert counts.collect()[0].loaded == 2 and named.collect()[0].entity_name == "Ann"
    tables = commands.extract(docs)
    c = commands.extraction_counters(tables, docs).collect()[0]
    assert (c.documents, c.emails) == (2, 1) and c.entities == 4 and c.mentions == 6
    again = commands.extract(docs)
    assert sorted(map(tuple, again["entities"].collect())) == sorted(map(tuple, tables["entities"].collect()))
    canon, aliases = canonical.initialise(tables["entities"])
    pairs = commands.find_duplicates(tables["entities"], aliases, "person", 1)
    assert pairs.count() == 1
    merged, left, log = commands.auto_merge(pairs, aliases, canon, tables["entities"], 0.8)
    assert log.collect()[0].status == "merged" and left.count() == canon.count() - 1
    assert left.agg(F.sum("total_mentions")).collect()[0][0] == canon.agg(F.sum("total_mentions")).collect()[0][0]
    after, verdicts = commands.review(pairs, tables["document_entities"].withColumn("mention_id", F.lit(1)), aliases, lambda *x: (True, ""), 0.7, 1.0)
    assert verdicts.count() == 1 and after.filter("not is_canonical").count() == 1
    assert commands.auto_merge(pairs, aliases, canon, tables["entities"], 0.8, dry_run=True)[0] is aliases


def counted(frame):
    """An accumulator of the rows that are read of the frame, and the frame that feeds it."""
    n = frame.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            n.add(len(b))
            yield b

    return n, frame.mapInPandas(count, frame.schema)


def test_auto_merge_reads_its_report_once(spark):
    e = ents(spark, [("x one a", 50), ("x one b", 20), ("x one c", 5)])
    _, a = canonical.initialise(e)
    n, pairs = counted(spark.createDataFrame([(1, 1, 50, 2, 20, 0.98), (2, 1, 50, 3, 5, 0.97)], "ord int, entity1_id long, entity1_count long, entity2_id long, entity2_count long, confidence double"))
    moves, log = canonical.auto_merge(pairs, a)
    assert {r.entity_id: r.target for r in moves.collect()} == {3: 1, 2: 1} and log.count() == 2
    assert n.value == 2


def test_candidates_compare_words_above_the_join(spark):
    """Only numbers and the bounded edit distance stand in the join; words are worked out for what it leaves, and no pair is lost by ``marks``."""
    import itertools
    import random

    rng = random.Random(7)
    names = sorted({"ann " + "".join(rng.choice("abé😀") for _ in range(rng.randint(1, 5))) + rng.choice(["", " ann", " b"]) for _ in range(150)})
    e = ents(spark, [(x, rng.randint(5, 40)) for x in names])
    _, a = canonical.initialise(e)
    p = resolve.candidates(e, a, least_confidence=0.0)
    joins = [x for x in p._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert len(joins) == 1 and "levenshtein" in joins[0] and "lower(" not in joins[0] and "array_" not in joins[0]

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row = list(itertools.accumulate(zip(row, row[1:], y), lambda left, t, c=c: min(left + 1, t[1] + 1, t[0] + (c != t[2])), initial=i))
        return row[-1]

    want = {frozenset((x, y)): d for x, y in itertools.combinations(names, 2) if (d := distance(x, y)) <= 3}
    got = p.collect()
    assert len(got) == len(want) > 1000 and {frozenset((r.entity1_text, r.entity2_text)): r.levenshtein for r in got} == want


def test_review_reads_its_pairs_once(spark):
    """Pairs of both ends of the tier, a pair without contexts, and one whose decision fails; each is decided once."""
    rows = [(1, "a b", 2, "a c", 0.95), (2, "a c", 3, "a d", 0.90), (5, "e f", 6, "e g", 0.80), (3, "a d", 5, None, 0.85), (1, "a b", 3, "a d", 0.79)]
    n, pairs = counted(spark.createDataFrame(rows, "entity1_id long, entity1_text string, entity2_id long, entity2_text string, confidence double"))
    mentions = spark.createDataFrame([(7, 2, "late"), (4, 2, "early"), (3, 2, None), (5, 3, "third"), (6, 9, "of none"), (8, None, "lost")], "mention_id long, entity_id long, context string")
    asked = spark.sparkContext.accumulator(0)

    def decide(a, b, ca, cb):
        asked.add(1)
        return a.split()[-1] < b.split()[-1], f"{ca} {cb}"

    got = {(r.entity1_id, r.entity2_id): r for r in canonical.reviewed(canonical.review_cases(pairs, mentions), decide).collect()}
    assert {k: (r.should_merge, r.note) for k, r in got.items() if k != (3, 5)} == {(2, 3): (True, "early third"), (5, 6): (True, "None None")}
    assert not got[(3, 5)].should_merge and got[(3, 5)].note.startswith("error: ") and got[(3, 5)].entity1_context == "third" and got[(3, 5)].entity2_text is None
    assert n.value == 5 and asked.value == 3
