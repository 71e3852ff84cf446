import random
from datetime import datetime

from folioscope.llm import groups, survivors
from folioscope.tables import table


def union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in pairs:
        parent[find(u)] = find(v)
    return {x: find(x) for x in list(parent)}


def same_partition(a, b):
    return set(a) == set(b) and len(set(a.values())) == len(set(b.values())) == len({(a[x], b[x]) for x in a})


def test_components_on_many_cells(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(900), rng.randrange(900)) for _ in range(700)]
    pairs += [(5, k) for k in range(1000, 1500)]  # a hub
    pairs += [(k, k + 1) for k in range(2000, 2200)] + [(-7, 3), (8, 8), (8, 8)]  # a chain, a negative id, a loop twice
    d = spark.createDataFrame(pairs + [(None, 4), (4, None)], "u long, v long")
    for cell in (60, 10**6):
        got = {r.x: r.rep for r in groups.components(d, cell_links=cell).collect()}
        assert same_partition(got, union_find(pairs))


def test_groups(spark):
    rows = [(5, 5), (6, 5), (6, 9), (7, 9), (7, 9), (8, None), (5, None), (20, 8)]
    d = spark.createDataFrame([(e, c, "x") for e, c in rows], "entity_id long, canonical_id long, u string")
    assert {r.entity_id: r.group_id for r in groups.groups(d).collect()} == {5: 5, 6: 5, 7: 5, 8: 8, 20: 20}
    assert groups.groups(d.limit(0)).count() == 0


def test_found_takes_the_grid_at_every_size(spark, sf):
    """Several cells and at least one exchange on the smallest tables too, with the groups of a plain union-find."""
    a, trace = table(spark, sf, "entity_aliases"), []
    got = {r.entity_id: r.group_id for r in groups.groups(a, trace).collect()}
    assert len(trace) >= 2 and all(t["side"] >= 2 for t in trace) and trace[1]["links"] > 0
    rows = a.select("entity_id", "canonical_id").collect()
    want = union_find([(2 * r.entity_id, 2 * r.canonical_id + 1) for r in rows if r.entity_id is not None and r.canonical_id is not None])
    least = {}
    for v, rep in want.items():
        if v % 2 == 0:
            least[rep] = min(least.get(rep, v // 2), v // 2)
    assert got == {r.entity_id: least[want[2 * r.entity_id]] if 2 * r.entity_id in want else r.entity_id for r in rows if r.entity_id is not None}
    assert groups.side_of(10) == 2 and groups.side_of(10**9) == 100


def test_survivors_by_votes(spark):
    rows = [("g", "Ann", 1.0, 0.0), ("g", "ann", 1.0, 100.0), ("g", "Bob", 1.5, 0.0), ("g", None, 9.0, 0.0), ("h", None, 1.0, 0.0), (None, "x", 1.0, 0.0)]
    d = spark.createDataFrame(rows, "grp string, name string, trust double, age double")
    from pyspark.sql import functions as F

    vote = survivors.decay_vote(F.col("trust"), F.col("age"), 100.0)
    f = survivors.Field("name", lambda: F.col("name"), normal=F.lower)
    got = {r.grp: r.name for r in survivors.survivors(d, "grp", [f], vote).collect()}
    assert got == {"g": "Ann"}  # 1 + 0.5 ties with 1.5; Ann is the smaller value, h has no value at all
    assert survivors.survivors(d.limit(0), "grp", [f], vote).count() == 0


def test_canonical_survivors(spark):
    t = [datetime(2024, 1, k) for k in (1, 2, 3)]
    canon = [(1, "Ann Example", 5, t[0]), (1, "Ann Example", 1, t[1]), (2, "Ann B. Example", None, t[2]), (3, "Ann Mary Example,", 1, t[2]), (9, "Alone", 4, t[0]), (4, None, 0, t[0])]
    c = spark.createDataFrame(canon, "canonical_id long, canonical_text string, total_mentions long, updated_at timestamp")
    a = spark.createDataFrame([(10, 1), (10, 2), (11, 2), (11, 3), (12, 9), (13, 77), (13, None), (11, 4)], "entity_id long, canonical_id long")
    e = spark.createDataFrame([(10, 3), (11, None), (12, 1), (99, 8)], "entity_id long, occurrence_count long")
    got = [tuple(r) for r in survivors.canonical_survivors(c, a, e, groups.groups(a)).collect()]
    assert got == [(10, 1, "Ann Mary Example,", 3)]


def test_full_words(spark):
    names = ["Ann B. Example", "J. Q.", "O'Neil-Smith, Jürgen", "", "A1 bb"]
    d = spark.createDataFrame([(n,) for n in names], "n string")
    from pyspark.sql import functions as F

    assert [r[0] for r in d.select(survivors.full_words(F.col("n"))).collect()] == [2, 0, 2, 0, 1]
