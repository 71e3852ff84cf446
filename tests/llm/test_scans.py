import random
from collections import Counter
from dataclasses import replace

import pytest

from folioscope.llm import scans
from folioscope.llm.perceptron import Perceptron, Ranker
from folioscope.tables import table

WORDS = (
    "the committee described a printed charter about the harbor while our office recorded the first-hand statement and the well-known manager returned every document before the winter conference closed "
    "counsel examined another exhibit during the second meeting although nobody remembered the original agreement concerning the island property or the missing luggage of the regional director"
).split()
CONFUSED = {"m": "rn", "d": "cl", "e": "c", "o": "0", "u": "ii", "n": "ri", "t": "†"}


def documents(n=1200, seed=5):
    """(text, truth): pages of prose with titles, page numbers, broken and misread words, and what was done to each line."""
    rng = random.Random(seed)
    out = []
    for d in range(n):
        title = f"Notes about the {rng.choice(['harbor', 'luggage', 'charter', 'island'])} of {rng.choice(['Ann', 'Bob'])} {rng.choice(['Example', 'Sample'])}"
        lines, truth = [title, ""], []
        noisy = rng.random() < 0.6
        for page in range(1, 4):
            words = [rng.choice(WORDS) for _ in range(70)]
            line = []
            for w in words:
                if noisy and rng.random() < 0.004 and len(w) > 5 and "-" not in w:
                    c = rng.choice([c for c in CONFUSED if c in w] or [""])
                    if c:
                        w = w.replace(c, CONFUSED[c], 1)
                        truth.append((len(lines) + 1, "misread"))
                line.append(w)
                if len(line) == 9:
                    if noisy and rng.random() < 0.3:
                        w = rng.choice([w for w in WORDS if len(w) > 7 and "-" not in w])
                        lines.append(" ".join(line) + " " + w[:4] + rng.choice("-¬\xad"))
                        truth.append((len(lines), "broken_word"))
                        line = [w[4:]]
                    else:
                        lines.append(" ".join(line))
                        line = []
            lines.append(" ".join([*line, "closed."]))
            if noisy:
                lines.append(f"Page {page} of 3")
                truth.append((len(lines), "page_no"))
                if page < 3:
                    lines.append(title.upper())
                    truth.append((len(lines), "running"))
        out.append(("\n".join(lines), set(truth)))
    return out


@pytest.fixture(scope="module")
def made(spark):
    docs = documents()
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "doc_id long, full_text string")
    return docs, d, scans.train(d)


def test_finds_made_noise(spark, made):
    docs, d, model = made
    got = {(r.doc_id, r.line_no, r.kind) for r in scans.found(d, model).collect()}
    want = {(i, n, k) for i, (_, t) in enumerate(docs) for n, k in t}
    for kind, least in (("broken_word", 0.97), ("page_no", 0.999), ("running", 0.98), ("misread", 0.85)):
        a, b = {x for x in got if x[2] == kind}, {x for x in want if x[2] == kind}
        assert len(a & b) >= least * len(b), kind
        assert len(a & b) >= least * len(a), kind


def test_repair_gives_back_the_prose(made):
    _, _, model = made
    text = f"{documents(1)[0][0].splitlines()[0]}\n\nthe committee des-\ncribed a printecl charter with the first-\nhand statement\n2\n"
    fixed = scans.repair(text, model)
    assert "described a printed charter with the first-hand statement" in fixed or "described a printed charter" in fixed
    assert fixed.rstrip()[-1] != "2"


def test_edges(spark, made):
    model = made[2]
    d = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n\n"), (4, "x" * 200000), (5, "a-\n" * 5000)], "doc_id long, full_text string")
    assert scans.found(d.limit(0), model).count() == 0
    kinds = {r.doc_id for r in scans.found(d, model).collect()}
    assert kinds <= {4, 5}
    r = {x.doc_id: x.repaired for x in scans.repaired(d, model).collect()}
    assert r[1] is None and r[2] == "" and r[4] == "x" * 200000
    empty = scans.train(d.limit(0))
    assert scans.found(d, empty).filter("kind = 'misread'").count() == 0


def test_the_editor_decides(spark):
    """Without the weights of the editor and the joiner no word is corrected or joined; without those of the line classifier running lines are lost."""
    d = table(spark, "/root/testdata/sf0.01", "documents")
    model = scans.train(d)
    blank = replace(model, editor=Ranker(), joiner=Ranker(), lines=Perceptron({}, model.lines.labels))
    full, none = (Counter(r.kind for r in scans.found(d, m).collect()) for m in (model, blank))
    assert full["misread"] > 1000 and none["misread"] < 0.1 * full["misread"]
    assert full["broken_word"] > 1000 and none["broken_word"] == 0
    assert none["running"] != full["running"] and none["page_no"] == full["page_no"]


def test_editor_learns_to_insert_and_delete():
    """Where a scanner drops and doubles letters within words, the corpus teaches both operations; forms cut at their ends teach none."""
    words = [a + b + c for a in ("har", "gol", "mis", "ver", "tan") for b in ("den", "tem", "rop", "fib") for c in ("ous", "ary", "ing", "ment", "ive", "al", "ful", "ish", "or", "ant")]
    counted = dict.fromkeys(words, 600)
    for w in words[::2]:
        counted[w[:3] + w[4:]] = 3  # the first letter of the middle part is dropped
        counted[w[:2] + w[2] * 2 + w[3:]] = 3  # a letter is doubled
    for w in words[1::16]:
        counted[w[:-1]] = 4
    model = scans.fit(counted, 10_000, [])
    made = [model.correct(w[:2] + w[2] * 2 + w[3:]) == w for w in words[1::2]] + [model.correct(w[:3] + w[4:]) == w for w in words[1::2]]
    assert sum(made) >= 0.7 * len(made)
    assert sum(model.correct(w) is not None for w in words) == 0


def test_stamps_rise_from_page_to_page():
    assert scans.rising_stamps("SHEET 00041\nx\nSHEET 00042\ny\nCase 12345\nz\nCase 12345\n") == {"sheet"}
    assert scans.stamp_of("call +1 555 0199 12345 now") is None and scans.stamp_of("ABC-OO123") == ("abc-", 123)


def test_operations_round_trip():
    for seen, true in (("crevv", "crew"), ("vincyard", "vineyard"), ("declined", "dedined"), ("fr0m", "from"), ("x", "x")):
        ops = scans.operations(seen, true)
        assert scans.apply_operations(seen, ops) == true


def test_perceptron_learns():
    data = [([f"x{i % 3}", "b"], "yes" if i % 3 == 1 else "no") for i in range(60)]
    p = Perceptron().train(data)
    assert all(p.best(f) == y for f, y in data) and Perceptron().train(data).weights == p.weights
