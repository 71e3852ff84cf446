"""Near-duplicate records with small edits (problem 2).

Documents are sets of word shingles. Each set gets a fast similarity sketch: in round ``i`` every element is put by a fresh hash
into one of ``t`` bins with the value (i, hash); the least value in each bin is the coordinate. In the first ``t`` rounds the
bin is random, in the next ``t`` rounds it is the round's own, so every coordinate fills, usually within a few
rounds. Two sketches agree in a coordinate with the Jaccard similarity of the sets, concentrated as for truly random sampling.
Coordinates are banded; documents that agree in a whole band are candidates, and each candidate is verified
exactly on the shingles.

Copies with equal shingle sets are one class and take part through one representative. Members of a bucket of a band, and of a class,
meet in blocks of at most ``BLOCK`` by ``BLOCK``: a group of m members has (m / BLOCK) squared of them, so no task's work grows with the group. Pairs of
large buckets leave the join only if their sizes and a bit of each coordinate leave it open that they reach the threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.groups import components
from folioscope.session import cut, spread

#: Members of a group that meet in one block of its self-join, on either side.
BLOCK = 1024
WORD = re.compile(r"[^\W_]+")
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashed sets of ``width`` consecutive words of lower-cased texts."""

    def __init__(self, width: int, keep: int = 300_000):
        self.width, self.keep, self.words = width, keep, {}

    def hashes(self, words: list[str]) -> np.ndarray:
        known = self.words
        if len(known) > self.keep:
            known.clear()
        try:
            out = [known[w] for w in words]
        except KeyError:
            import xxhash

            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            out = [known[w] for w in words]
        return np.array(out, dtype=np.uint64)

    def shingles(self, text: str, least_words: int) -> np.ndarray | None:
        words = WORD.findall(text.lower())
        n = len(words) - self.width + 1
        if len(words) < least_words or n < 1:
            return None
        h = self.hashes(words)
        s = h[:n].copy()
        for k in range(1, self.width):
            s = mix(s + _M3) + h[k : n + k]
        return np.unique(mix(s))


def sketch(elements: np.ndarray, t: int, seed: int = 0) -> np.ndarray:
    """The ``t`` coordinates of a fast similarity sketch of a non-empty set of 64-bit hashes."""
    full = np.uint64(2**64 - 1)
    out = np.full(t, full, dtype=np.uint64)
    open_ = t
    for i in range(2 * t):
        h = mix(elements + np.uint64(((i + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) & (2**64 - 1)))
        # The value keeps the high bits of the hash; the round is not part of it, as a bin takes only its first round's values.
        bins = (h % np.uint64(t)).astype(np.int64) if i < t else None
        if bins is None:
            if out[i - t] == full:
                out[i - t] = h.min() >> np.uint64(1)
                open_ -= 1
        else:
            got = np.full(t, full, dtype=np.uint64)
            np.minimum.at(got, bins, h >> np.uint64(1))
            take = (out == full) & (got != full)
            out[take] = got[take]
            open_ -= int(take.sum())
        if open_ == 0:
            break
    return out


def _band_keys(coordinates: np.ndarray, rows: int) -> np.ndarray:
    bands = coordinates[: len(coordinates) // rows * rows].reshape(-1, rows)
    key = np.arange(len(bands), dtype=np.uint64) * _M3
    for k in range(rows):
        key = mix(key + bands[:, k])
    return key.view(np.int64)


def _made(df: DataFrame, key: str, text: str, width: int, least_words: int, schema: str, row) -> DataFrame:
    """``key`` and what ``row`` makes of the shingles of each document that has any."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import folioscope.llm.neardup as here

        s = here.Shingler(width)
        for b in batches:
            made = [(k, *row(x)) for k, t in zip(b[key], b[text], strict=True) if t and (x := s.shingles(t, least_words)) is not None]
            if made:
                yield pd.DataFrame(dict(zip([key, *names], zip(*made), strict=True)))

    return df.mapInPandas(run, f"{key} long, {schema}")


def texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return spread(df.select(F.col(key).cast("long").alias(key), text).filter(F.col(key).isNotNull() & F.col(text).isNotNull()))


def sketches(df: DataFrame, key: str, text: str, width: int, least_words: int, bands: int, rows: int) -> DataFrame:
    """key, n, h, g, bits, bands: the size of a document's shingle set, 128 bits that stand for it, a bit of each coordinate, and a key for each band.

    The shingles themselves are not kept: only candidates need them, and get them from their texts again.
    """

    def row(x: np.ndarray) -> tuple:
        h, g = mix(x).sum(dtype=np.uint64), mix(x ^ _M3).sum(dtype=np.uint64)
        s = sketch(x, bands * rows)
        return len(x), int(h.view(np.int64)), int(g.view(np.int64)), coordinate_bits(s), _band_keys(s, rows)

    return _made(df, key, text, width, least_words, "n int, h long, g long, bits array<long>, bands array<long>", row)


def coordinate_bits(coordinates: np.ndarray) -> np.ndarray:
    """One bit of each coordinate, packed: two sets agree in a bit with probability (1 + similarity) / 2."""
    bits = (mix(coordinates) & np.uint64(1)).astype(np.uint8)
    return np.packbits(np.pad(bits, (0, -len(bits) % 64))).view(np.uint64).view(np.int64)


def shingle_sets(df: DataFrame, key: str, text: str, width: int, least_words: int) -> DataFrame:
    """``key``, ``shingles`` (sorted array of bigint) of the documents of at least ``least_words`` words."""
    return _made(df, key, text, width, least_words, "shingles array<long>", lambda x: (x.view(np.int64),))


def similar(a: Column, b: Column, threshold: float) -> Column:
    """Whether two arrays without repeats have a Jaccard similarity of at least ``threshold``, compared in whole numbers."""
    both = F.size(F.array_intersect(a, b))
    return both * F.lit(1000) >= F.lit(round(threshold * 1000)) * (F.size(a) + F.size(b) - both)


def may_be_similar(a: Column, b: Column, words: int, coordinates: int, threshold: float) -> Column:
    """Whether the bits of two sketches leave it open that the sets reach ``threshold``: within six standard deviations of what they would show."""
    agree = (1 + threshold) / 2
    most = int(coordinates * (1 - agree) + 6 * (coordinates * agree * (1 - agree)) ** 0.5)
    differ = sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(words)), F.lit(0))
    return differ <= most


def blocked(rows: DataFrame, group: str, member: str, size: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both sides of the self-join of each ``group`` on (group, _i, _j): ``rows`` with the block pairs in which each ``member`` takes part, as the first and as the second.

    ``size`` is how many members the row's group has; one of up to ``block`` is a single block and no row is repeated.
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own, all_ = F.pmod(F.xxhash64(member), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    return rows.withColumn("_i", own).withColumn("_j", all_), rows.withColumn("_j", own).withColumn("_i", all_)


def candidate_pairs(banded: DataFrame, marks: DataFrame, fits, hot: int = 64, block: int = BLOCK) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` of the ids in ``banded`` (id, band) that agree in a band and whose ``marks`` fit.

    Buckets of at most ``hot`` members are expanded by a self-join. Members of larger ones are compared too, as each of their
    pairs may be similar, but in blocks, and a pair leaves the join only if the marks (size and sketch bits) of both leave it open that it
    reaches the threshold. No bucket is dropped or cut.
    """
    size = banded.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1")
    # Most buckets hold one member; only the others are kept for what follows.
    shared = cut(banded.join(size, "band"))
    keys = ("band", "_i", "_j")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(c).alias(name if c == "id" else c if c in keys else f"{c}_{name}") for c in df.columns])

    cold = shared.filter(F.col("m") <= hot)
    pairs = side(cold.select("band", "id"), "a").join(side(cold.select("band", "id"), "b"), "band").filter("a < b").select("a", "b").distinct()
    done = pairs.join(side(marks, "a"), "a").join(side(marks, "b"), "b").filter(fits).select("a", "b")
    warm = shared.filter(F.col("m") > hot).select("band", "id", "m")
    if warm.isEmpty():
        return done
    left, right = blocked(cut(warm.join(marks, "id")), "band", "id", "m", block)
    hot_pairs = side(left, "a").join(side(right, "b"), list(keys)).filter("a < b").filter(fits).select("a", "b")
    return done.unionByName(hot_pairs).distinct()


def class_pairs(df: DataFrame, key: str, text: str, width: int = 5, threshold: float = 0.8, least_words: int = 1, bands: int = 40, rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members: key, id, m), (pairs: a, b) of class representatives whose sets reach ``threshold``; a < b.

    A class holds the documents with equal shingle sets, ``m`` of them; its id is the smallest key.
    """
    docs = texts(df, key, text)
    made = cut(sketches(docs, key, text, width, least_words, bands, rows))
    first = made.groupBy("h", "g").agg(F.min(key).alias("id"), F.count("*").alias("m"))
    members = cut(made.select(key, "h", "g").join(first, ["h", "g"]).select(key, "id", "m"))
    own = made.join(members.filter(F.col(key) == F.col("id")).select(key), key)
    banded = own.select(F.col(key).alias("id"), F.explode("bands").alias("band"))
    marks = own.select(F.col(key).alias("id"), "n", "bits")
    # Sizes and sketch bits alone rule out most candidates before the sets are compared.
    whole = F.lit(round(threshold * 1000))
    fits = (F.least("n_a", "n_b") * 1000 >= whole * F.greatest("n_a", "n_b")) & may_be_similar(F.col("bits_a"), F.col("bits_b"), -(-bands * rows // 64), bands * rows, threshold)
    pairs = cut(candidate_pairs(banded, marks, fits))
    ends = pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    sets = cut(shingle_sets(docs.join(ends, key), key, text, width, least_words))
    left = sets.select(F.col(key).alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col(key).alias("b"), F.col("shingles").alias("sb"))
    checked = pairs.join(left, "a").join(right, "b").filter(similar(F.col("sa"), F.col("sb"), threshold)).select("a", "b")
    return members, cut(checked)


#: Parameters of p2_found as TESTDATA.md states them, with bands that find a pair at 0.7 with probability 0.9998.
FOUND = {"width": 3, "threshold": 0.7, "least_words": 30, "bands": 46, "rows": 5}


def expanded(pairs: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """x < y: all pairs of members of similar classes and of members of one class. ``members``: d, id, m (how many its class has)."""
    blocks = F.ceil(F.col("m") / F.lit(block)).cast("int")
    sizes = members.filter("d = id").select("id", blocks.alias("n"))
    # A pair of classes meets each block of either, so the members of a large class are spread.
    spread_ = pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("_na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("_nb")), "b")
    spread_ = spread_.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_na") - 1))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    placed = members.withColumn("_p", F.pmod(F.xxhash64("d"), blocks).cast("int"))
    first, second = placed.select(F.col("id").alias("a"), F.col("_p").alias("_i"), F.col("d").alias("x")), placed.select(F.col("id").alias("b"), F.col("_p").alias("_j"), F.col("d").alias("y"))
    across = spread_.join(first, ["a", "_i"]).join(second, ["b", "_j"]).select("x", "y")
    left, right = blocked(members.filter("m > 1"), "id", "d", "m", block)
    within = left.select("id", "_i", "_j", F.col("d").alias("x")).join(right.select("id", "_i", "_j", F.col("d").alias("y")), ["id", "_i", "_j"]).filter("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def found(documents: DataFrame, key: str = "doc_id", text: str = "full_text") -> DataFrame:
    """p2_found: all pairs doc_id_a < doc_id_b of documents of at least 30 words that share 0.7 of their 3-word shingles.

    Null, empty and shorter texts have no pair. Pairs within classes of copies are cases too, and are expanded at the end.
    """
    members, pairs = class_pairs(documents, key, text, **FOUND)
    m = members.select(F.col(key).alias("d"), "id", "m")
    return expanded(pairs, m).select(F.col("x").alias("doc_id_a"), F.col("y").alias("doc_id_b"))


def grouped(documents: DataFrame, key: str = "doc_id", text: str = "full_text", **parameters) -> DataFrame:
    """p2_groups: doc_id, class_id, group_id, links of every document that has a shingle set.

    ``class_id`` is the smallest id of the documents with the same set, ``group_id`` that of all linked directly or
    indirectly, ``links`` the number of other classes that are similar to the document's own. Copies are not expanded.
    """
    members, pairs = class_pairs(documents, key, text, **(parameters or FOUND))
    rep = components(pairs, "a", "b")
    of = members.select("id").distinct().join(rep.withColumnRenamed("x", "id"), "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    least = of.groupBy("rep").agg(F.min("id").alias("group_id"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    of = of.join(least, "rep").join(ends, "id", "left").select("id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(of, "id").select(F.col(key), F.col("id").alias("class_id"), "group_id", "links")
