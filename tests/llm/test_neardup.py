import random

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import neardup as N


def brute(rows, width=3, threshold=700, least=30):
    sets = {}
    for k, t in rows:
        w = N.WORD.findall((t or "").lower())
        if len(w) >= least:
            sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 1000 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(25, 120))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randrange(4)):
            b = list(base)
            for _ in range(rng.randrange(0, 6)):
                b[rng.randrange(len(b))] = rng.choice(words)
            rows.append((len(rows), " ".join(b).upper() if rng.random() < 0.3 else ", ".join(b)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", "short text", "x " * 40, "X x " * 30])]
    return rows


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    d = spark.createDataFrame([(k, t, "extra") for k, t in rows], "doc_id long, full_text string, id string")
    got = [tuple(r) for r in N.found(d).collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got)) and len(got) > 40
    assert N.found(d.limit(0)).count() == 0


def test_hot_buckets_keep_their_pairs(spark):
    rows = corpus(2)
    boiler = " ".join(f"b{i}" for i in range(300))
    rows += [(10000 + k, f"{boiler} t{k} u{k} v{k}") for k in range(90)] + [(20000 + k, f"{boiler} same") for k in range(50)]
    d = spark.createDataFrame(rows, "doc_id long, full_text string")
    members, pairs = N.class_pairs(d, "doc_id", "full_text", **N.FOUND)
    n = members.filter("id = 20000").count()
    assert n == 50 and pairs.filter("a >= 10000 and b >= 10000").count() == 91 * 90 // 2
    g = N.grouped(d).filter("doc_id >= 10000").collect()
    assert len({r.group_id for r in g}) == 1 and {r.links for r in g} == {90} and {r.class_id for r in g if r.doc_id >= 20000} == {20000}


def test_blocks_grow_with_the_group(spark):
    """Every pair of a group meets in exactly one block, whatever the block's size, and no block holds more than its share."""
    d = spark.range(200).selectExpr("id", "id % 3 as g").filter("g < 2 or id < 4")
    d = d.join(d.groupBy("g").agg(F.count("*").alias("m")), "g")
    want = {(a, b) for a in range(200) for b in range(a + 1, 200) if a % 3 == b % 3 and (a % 3 < 2 or b < 4)}
    for block in (7, 1000):
        left, right = N.blocked(d, "g", "id", "m", block)
        got = left.selectExpr("g", "_i", "_j", "id a").join(right.selectExpr("g", "_i", "_j", "id b"), ["g", "_i", "_j"]).filter("a < b")
        assert sorted((r.a, r.b) for r in got.collect()) == sorted(want)
        assert left.groupBy("g", "_i", "_j").count().agg(F.max("count")).first()[0] <= (4 * block if block == 7 else 67)
    members = spark.createDataFrame([(k, k - k % 10, 10) for k in range(40)], "d long, id long, m long")
    pairs = spark.createDataFrame([(0, 10), (10, 30)], "a long, b long")
    close = {0: {0, 10}, 10: {0, 10, 30}, 20: {20}, 30: {10, 30}}
    for block in (3, 1000):
        got = [tuple(r) for r in N.expanded(pairs, members, block).collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(40) for b in range(a + 1, 40) if b - b % 10 in close[a - a % 10]}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = x[:200], x[100:]
        errors.append(np.mean(N.sketch(a, 256) == N.sketch(b, 256)) - 100 / 300)
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.13
    assert (N.sketch(np.array([7], dtype=np.uint64), 64) != np.uint64(2**64 - 1)).all()
