import pytest

from folioscope.llm import abuse, names

PEOPLE = [
    "Susanna Ciligistov", "Ciligistov Susanna", "Sue Ciligistov", "S. A. Ciligistov", "CILIGISTOV, SUSANNA", "SusannaCiligistov", "Susanna Cil-igistov", "Susanna Ci1igist0v", "Susana Ciligistov", "SA Cilgistov", "Dr. Ciligistov",
    "Robert Dravafubov", "Ursula Dravafubov", "U. Dravafubov", "Dr. Dravafubov", "Robert Nutafomen", "Susanna Nutafomen", "Robert Ruvesacund", "Susanna Ruvesacund",
]
ORGS = ["Vusududund Foundation", "The VUSUDUDUND Foundaton", "Vusutudund Fdn, Inc.", "Vusududund University", "Vusududund Univ. Press Office", "Gadulubix Research Institute", "Gadulubix Institute of Research"]


def clusters(spark):
    e = [(i, n, "person", None, "x") for i, n in enumerate(PEOPLE)] + [(100 + i, n, "organization", None, "x") for i, n in enumerate(ORGS)]
    e += [(200, None, "person", "robert nutafomen", "x"), (201, "  ", "person", None, "x"), (202, None, "person", None, "x"), (203, "Reno, NV", "location", None, "x")]
    e = spark.createDataFrame(e, "entity_id long, text string, type string, normalized_text string, kind string")
    c = spark.createDataFrame([(1, "person", "Robert Nutafomen", None), (1, "person", "Robert Nutafomen", None), (2, "person", "NUTAFOMEN, ROBERT", None), (3, "person", None, None)], "canonical_id long, entity_type string, canonical_text string, canonical_normalized string")
    return e, c


def test_links(spark):
    e, c = clusters(spark)
    got = {tuple(r) for r in names.found(e, c).collect()}
    ents = {(a, b) for k, a, b in got if k == "entities"}
    one = set(range(11))
    assert {(a, b) for a in one for b in one if a < b} <= ents
    assert (12, 13) in ents and (11, 12) not in ents and not any(14 in p for p in ents)  # two people fit "Dr. Dravafubov"
    assert (15, 16) not in ents and (15, 200) in ents
    org = lambda *x: tuple(100 + i for i in x)
    assert {org(0, 1), org(0, 2), org(1, 2), org(3, 4), org(5, 6)} == {p for p in ents if p[0] >= 100 and p[1] < 200}
    assert {(a, b) for k, a, b in got if k == "canonicals"} == {(1, 2)}
    assert names.found(e.limit(0), c.limit(0)).count() == 0


def test_readings():
    known = {"dorothea": "dorothea", "michael": "michael"}
    read = lambda t: names.read_person(t, known)
    assert read("MS Chuuricebelm") == ("chuuricebelm", [], "m", "s", "initial")
    assert read("Ms. Chuuricebelm") == ("chuuricebelm", [], "", "", "none")
    assert read("Dorotha Tejujukix")[:2] == ("tejujukix", ["dorothea"]) and read("KUPIKIX, E. J.") == ("kupikix", [], "e", "j", "initial")
    assert read("Prof. Mike Kupikix")[1] == ["michael"] and read("") == ("", [], "", "", "none")
    assert names.read_organisation("The THETOTABRART Universty") == ("thetotabrart", "university") == names.read_organisation("Thetotabrart U.")


def test_lcs_by_brute_force():
    import itertools

    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for a, b in (("ciligistov", "cilgistov"), ("abcbdab", "bdcaba"), ("", "x"), ("aaaa", "aa"), ("xyz", "abc")):
        assert names.lcs(a, b) == slow(a, b)
    assert names.close("projezatund", "prjoezatund") and not names.close("projezatund", "prjoeaztund") and not names.close("abcd", "abce")


def test_blocks_find_single_errors():
    import random

    rng = random.Random(4)
    for _ in range(300):
        w = "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(6, 13)))
        k = rng.randrange(len(w))
        typo = rng.choice([w[:k] + w[k + 1 :], w[:k] + "z" + w[k + 1 :], w[:k] + w[k] + w[k:]])
        assert names.suffixes(w, "s") & names.suffixes(typo, "s"), (w, typo)


HITS = [
    ("You useless moron.", "abusive"), ("Go to hell, Ann Example, you lying s c u m b a g.", "abusive"), ("Crawl back under your rock, you rotten l*****e, before I drag you out.", "abusive"), ("Listen, loooser: one more word and you will be picking up your teeth.", "abusive"),
    ("What kind of 1d1ot loses a charter?", "abusive"), ("You are a pathettic scumbg.", "abusive"), ("Send me another nude of your b*****s, the last one made me so wet.", "sexual"), ("You b*****s.", "abusive"), ("Those immigrants are v****n.", "hateful"), ("The Velmari? I say the Velmari are parasitse, every one.", "hateful"), ("Du er en jævla idiot, og alle vet det.", "abusive"), ("All refugees are VERMIN and should be driven out.", "hateful"), ("We do not want their whole race in Reno; they are p@r@$ite$.", "hateful"), ("Ces étrangers sont de la vermine, il faut les exterminer.", "hateful"),
    ("I will undress you slowly and fuck you all night long, lover.", "sexual"), ("They had rough sex until both were screaming with org-\nasm.", "sexual"),
]
CLEAN = ["The handbook says that words such as moron or bastard have no place in a letter.", "I felt like an idiot when I found the proposal in my own coat.", "The exterminator removed vermin and parasites from the warehouse.", "Counsel explained the elements of sexual assault under the statute.", "The pig farm near Reno lost 5 animals to disease.", "This damn printer destroyed the letter again.", "He shot 9 photographs of the nude marble figure for the museum.", "Refugees and immigrants were welcomed with a dinner.", "my ass|stant forwarded it", "", None]


def test_kinds(spark):
    rows = [(i, t, "s") for i, (t, _) in enumerate(HITS)] + [(100 + i, t, "s") for i, t in enumerate(CLEAN)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {tuple(r) for r in abuse.found(d).collect()}
    assert got == {(i, k) for i, (_, k) in enumerate(HITS)}
    r = abuse.rates(d).collect()[0]
    assert r.documents == len(rows) and r.any_rate == pytest.approx(len(HITS) / len(rows))
    assert abuse.found(d.limit(0)).count() == 0 and abuse.scores(d.filter("doc_id >= 109")).count() == 2


def test_long_texts_take_linear_time():
    import time

    s, began = abuse.Scorer(), time.time()
    for text in ("a " * 200_000, "x" * 500_000, "*" * 200_000, "a-\n" * 100_000, "you idiot " * 30_000):
        s.document(text)
    assert time.time() - began < 20
    assert s.document("so " * 5000 + ". You useless moron.")[0] >= abuse.THRESHOLD


def test_trie_against_brute_force():
    terms = ["scumbag", "useless", "filthy", "vermin", "scumbags"]
    t = abuse.Trie(terms)

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for w in ["scumbag", "scumbg", "scumbagg", "usless", "filthi", "vermin", "verrmin", "xermin", "nothing", "fil", "scumbaga", "scmbgs", "xcumbagsx"]:
        assert t.near(w) == sorted((lev(w, x), x) for x in terms if lev(w, x) <= abuse.errors_for(len(x))), w
    assert abuse.errors_for(5) == 0 and abuse.errors_for(8) == 1 and abuse.errors_for(9) == 2
    assert t.near("v3rm!n") == [(0, "vermin")] and t.near("verrrrmin") == [(0, "vermin")] and t.near("f****y") == [(0, "filthy")]


def test_the_automaton_is_needed(spark, monkeypatch):
    """Without the automaton misspelt and disguised terms are lost; review verdicts that agree are all found."""
    from folioscope.tables import table

    folder = "/root/testdata/sf0.1"
    docs = table(spark, folder, "documents").select("doc_id", "text").toPandas()
    labels = table(spark, folder, "review_labels").toPandas().groupby("doc_id").flagged.agg(["min", "max"])
    s = abuse.Scorer()
    full = {(i, k) for i, t in zip(docs.doc_id, docs.text, strict=True) if t for k, v in zip(abuse.KINDS, s.document(t), strict=True) if v >= abuse.THRESHOLD}
    monkeypatch.setattr(abuse.Trie, "near", lambda self, word: [])
    s = abuse.Scorer()
    none = {(i, k) for i, t in zip(docs.doc_id, docs.text, strict=True) if t for k, v in zip(abuse.KINDS, s.document(t), strict=True) if v >= abuse.THRESHOLD}
    assert none < full and len(full - none) >= 0.04 * len(full)
    found = {i for i, _ in full}
    agreed = set(labels.index[labels["min"] == 1])
    assert len(agreed & found) >= 0.9 * len(agreed) and not found & set(labels.index[labels["max"] == 0])
