from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import mixing, tokens

PATH = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def known():
    import tiktoken

    v = tokens.load(PATH)
    return v, tokens.Encoder(v), tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=v.ids, special_tokens={})


def mine(encoder, text):
    out = array("i")
    encoder.encode(text, out)
    return out.tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text("ab \n'st1é<|>_-", max_size=80))
def test_equals_reference_encoding(known, text):
    text = text.encode("utf-8", "ignore").decode()
    v, e, ref = known
    assert mine(e, text) == ref.encode_ordinary(text)
    assert b"".join(v.tokens[t] for t in mine(e, text)).decode() == text


@pytest.mark.parametrize("text", ["a" * 20000, "<|endoftext|>", " " * 3000 + "x", "مرفق نسخة 𝔘 naïve ﬁ​", "0" * 5000])
def test_long_and_odd(known, text):
    _, e, ref = known
    assert mine(e, text) == ref.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.text("abcdest ", max_size=40), st.integers(0, 40), st.integers(0, 10), st.text("abcdest ", max_size=10))
def test_edit_equals_new_start(known, text, start, size, new):
    v, data = known[0], text.encode()
    start = min(start, len(data))
    p = tokens.Prefixes(v, data)
    p.replace(start, min(start + size, len(data)), new.encode())
    assert p.last == tokens.Prefixes(v, p.data).last


def test_documents(spark):
    d = spark.createDataFrame([(1, "the quick fox", "x"), (2, None, "x"), (3, "", "y"), (1, "the quick fox", "x")], "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.ids) for r in tokens.document_ids(d).collect())
    assert got[0] == got[1] and got[2:] == [(2, []), (3, [])] and len(got[0][1]) == 3
    assert sorted(r.tokens for r in tokens.count(d).collect()) == [0, 0, 3, 3]
    assert tokens.document_ids(d.limit(0)).count() == 0


def test_mix(spark):
    rows = [(i, s, n) for i, (s, n) in enumerate([("a", 10)] * 300 + [("b", 7)] * 40 + [(None, 5)] * 3 + [("zzz", 5)] * 3 + [("c", 0)] * 2)]
    z = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, 2), ("gone", 0.1, 4), ("b", 0.3, 4)], "source string, target_share double, max_repeats int")
    chosen = mixing.select(z, t).collect()
    size = {s: sum(r.tokens * r.repeats for r in chosen if r.source == s) for s in ("a", "b", "c")}
    assert size["b"] == 40 * 7 * 4 and abs(size["a"] / size["b"] - 5 / 3) < 0.01 and size["c"] == 0
    assert max(r.repeats for r in chosen if r.source == "a") == 1 and not {r.source for r in chosen} - {"a", "b"}
    again = mixing.select(z.repartition(7), t).collect()
    assert sorted(map(tuple, chosen)) == sorted(map(tuple, again))
    s = {r.source: r for r in mixing.shares(mixing.select(z, t), t).collect()}
    assert abs(s["a"].actual_share - 0.625) < 0.005 and s["gone"].tokens == 0 and s["b"].most_repeats == 4
    assert mixing.select(z.limit(0), t).count() == 0 and mixing.select(z, t.limit(0)).count() == 0
    small = {r.source: r.budget for r in mixing.plan(z, t, total=100).collect()}
    assert small["a"] == 63
