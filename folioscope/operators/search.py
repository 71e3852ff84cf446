"""Full-text search: boolean queries, phrases, prefixes, BM25 ranks and snippets, on the texts or on a stored index.

A query is parsed to a tree. Its phrases are counted for each document in one pass, either over the documents' tokens or over the stored
postings of the query's terms; the tree is then a boolean expression over those counts, and ranks need one row of corpus figures. Nothing is joined
with itself. The index is three tables: postings (term, doc_id, tf, positions), lengths (doc_id, len) and corpus (docs, mean); added documents go
to a new part of it, and replaced or removed ones are listed in a part of tombstones until the index is compacted.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut
from folioscope.text import ACCENTED, FOLDED, folded, tokens

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, doc_id, tf, positions (from 0): counted within the document's own token array, without a shuffle."""
    t = docs.select(F.col(key).alias("doc_id"), F.posexplode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("pos", "term"))
    return t.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


#: Folders of a stored index; a query for whole words reads only those of its words.
BUCKETS = 64


def _write_part(docs: DataFrame, key: str, text: str, path: str, part: str, mode: str) -> None:
    p = postings(docs, key, text).withColumns({"bucket": F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"), "part": F.lit(part)})
    p.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term").write.mode(mode).partitionBy("bucket", "part").parquet(f"{path}/postings")
    lengths(docs, key, text).withColumn("part", F.lit(part)).write.mode(mode).partitionBy("part").parquet(f"{path}/lengths")


def write_index(docs: DataFrame, key: str, text: str, path: str) -> None:
    """Store postings, in folders by the hash of the term and sorted by it, and lengths, in place of what was there."""
    gone = docs.select(F.col(key).alias("doc_id"), F.lit("").alias("part")).limit(0)
    _write_part(docs, key, text, path, "p0", "overwrite")
    gone.write.mode("overwrite").parquet(f"{path}/gone")


def update_index(docs: DataFrame, key: str, text: str, path: str, part: str) -> None:
    """Add the documents ``docs`` as a part of the index under a name not used before; older states of the same documents no longer count.

    Only the new documents are tokenised. A repeated call after a failure replaces nothing, as parts are appended; give it another name.
    """
    spark = docs.sparkSession
    old = spark.read.parquet(f"{path}/lengths").select("doc_id", "part").join(docs.select(F.col(key).alias("doc_id")).distinct(), "doc_id", "left_semi")
    old.write.mode("append").parquet(f"{path}/gone")
    _write_part(docs, key, text, path, part, "append")


def remove_from_index(spark, path: str, ids: DataFrame) -> None:
    """Documents of ``ids`` (doc_id) no longer count."""
    old = spark.read.parquet(f"{path}/lengths").select("doc_id", "part").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    old.write.mode("append").parquet(f"{path}/gone")


def read_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of the documents that count."""
    gone = spark.read.parquet(f"{path}/gone").distinct()
    p, z = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")
    if gone.isEmpty():
        return p, z
    return p.join(gone, ["doc_id", "part"], "left_anti"), z.join(gone, ["doc_id", "part"], "left_anti")


def lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.size(tokens(F.coalesce(F.col(text), F.lit("")))).alias("len"))


@dataclass(frozen=True)
class Phrase:
    """Terms that follow each other; the last may be a prefix."""

    terms: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Node:
    op: str
    left: object
    right: object


def parse(query: str):
    """The tree of a query: words and "phrases", a trailing * for a prefix, AND, OR, NOT and parentheses; AND is implied.

    OR binds loosest, then AND, then NOT. An empty query or a stray quote is a ValueError.
    """
    if query.count('"') % 2:
        raise ValueError("a quote is not closed")
    items = re.findall(r'"[^"]*"\s*\*?|\(|\)|[^\s()"]+', query)
    if not items:
        raise ValueError("the query is empty")
    at = 0

    def peek():
        return items[at] if at < len(items) else None

    def take():
        nonlocal at
        at += 1
        return items[at - 1]

    def either():
        left = both()
        while peek() == "OR":
            take()
            left = Node("or", left, both())
        return left

    def both():
        left = one()
        while peek() not in (None, ")", "OR"):
            if peek() == "AND":
                take()
                left = Node("and", left, one())
            elif peek() == "NOT":
                take()
                left = Node("not", left, one())
            else:
                left = Node("and", left, one())
        return left

    def one():
        item = peek()
        if item is None or item in (")", "AND", "OR", "NOT"):
            raise ValueError("a term is missing")
        if take() == "(":
            inner = either()
            if peek() != ")":
                raise ValueError("a parenthesis is not closed")
            take()
            return inner
        star = item.rstrip().endswith("*")
        return phrase(item.strip().rstrip("*").strip().strip('"'), star)

    tree = either()
    if at < len(items):
        raise ValueError("a parenthesis is not opened")
    return tree


def phrase(text: str, prefix: bool = False) -> Phrase:
    bare = "".join(c for c in text.lower() if unicodedata.category(c) != "Mn").translate(str.maketrans(ACCENTED, FOLDED))
    words = tuple(w for w in re.split(r"[\W_]+", bare) if w)
    if not words:
        raise ValueError("a phrase holds no word")
    return Phrase(words, prefix)


def phrases(tree) -> list[Phrase]:
    """The phrases whose hits count for the rank: not those behind NOT."""
    if isinstance(tree, Phrase):
        return [tree]
    return phrases(tree.left) + ([] if tree.op == "not" else phrases(tree.right))


def all_phrases(tree) -> list[Phrase]:
    return [tree] if isinstance(tree, Phrase) else all_phrases(tree.left) + all_phrases(tree.right)


def _fits(tree, count: dict[Phrase, Column]) -> Column:
    """Whether a document fits the tree, given how often each phrase occurs in it."""
    if isinstance(tree, Phrase):
        return count[tree] > 0
    a, b = _fits(tree.left, count), _fits(tree.right, count)
    return a & b if tree.op == "and" else a | b if tree.op == "or" else a & ~b


def _is(term: Column, p: Phrase, k: int) -> Column:
    """Whether a term is the ``k``-th of a phrase, whose last may be a prefix."""
    return term.startswith(p.terms[k]) if p.prefix and k == len(p.terms) - 1 else term == p.terms[k]


def hits_in_texts(docs: DataFrame, key: str, text: str, wanted: list[Phrase]) -> DataFrame:
    """doc_id, len, tf0, tf1, ...: one scan of the documents; a text is tokenised once, and only counts leave it."""
    t = docs.select(F.col(key).alias("doc_id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))

    def tf(p: Phrase) -> Column:
        if len(p.terms) == 1:
            return F.size(F.filter("_t", lambda x: _is(x, p, 0)))
        # Beside each token the one at its place in the phrase; try_element_at is null behind the end.
        at = lambda i, k: F.coalesce(_is(F.try_element_at("_t", (i + k + 1).cast("int")), p, k), F.lit(False))
        return F.size(F.filter(F.transform("_t", lambda x, i: _is(x, p, 0) & reduce(lambda c, k: c & at(i, k), range(1, len(p.terms)), F.lit(True))), lambda x: x))

    return t.select("doc_id", F.size("_t").alias("len"), *[tf(p).cast("long").alias(f"tf{n}") for n, p in enumerate(wanted)])


def hits_in_index(index: DataFrame, wanted: list[Phrase]) -> DataFrame:
    """doc_id, tf0, tf1, ... of the documents that hold any term: one read of the postings of the query's terms, one aggregation by document."""
    exact = sorted({t for p in wanted for k, t in enumerate(p.terms) if not (p.prefix and k == len(p.terms) - 1)})
    begins = sorted({p.terms[-1] for p in wanted if p.prefix})
    keep = reduce(lambda a, b: a | b, [F.col("term").isin(exact)] * bool(exact) + [F.col("term").startswith(b) for b in begins])
    if "bucket" in index.columns and not begins:
        spark = index.sparkSession
        of = spark.range(1).select(F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(BUCKETS)).cast("int") for t in exact])).first()[0]  # a constant for each term
        keep = keep & F.col("bucket").isin(sorted(set(of)))

    def tf(p: Phrase) -> Column:
        if len(p.terms) == 1:
            return F.sum(F.when(_is(F.col("term"), p, 0), F.col("tf")).otherwise(0))

        def starts(k: int) -> Column:
            """Where the phrase would begin for its ``k``-th term to stand where it does."""
            return F.transform(F.flatten(F.collect_list(F.when(_is(F.col("term"), p, k), F.col("positions")))), lambda x: x - k)

        return F.size(reduce(F.array_intersect, [starts(k) for k in range(len(p.terms))]))

    return index.filter(keep).groupBy("doc_id").agg(*[tf(p).cast("long").alias(f"tf{n}") for n, p in enumerate(wanted)])


def bm25(tf: Column, n: Column, documents: Column, length: Column, mean: Column) -> Column:
    """One phrase's part of the rank; an idf of nothing or less counts as 1e-6."""
    idf = F.log((documents - n + 0.5) / (n + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _ranked(hits: DataFrame, tree, wanted: list[Phrase], corpus: DataFrame) -> DataFrame:
    """Ranks of rows doc_id, len, tf0, ... that fit the tree; ``corpus`` is one row: _docs, _mean, _n0, _n1, ..."""
    count = {p: F.col(f"tf{n}") for n, p in enumerate(wanted)}
    ranks = dict.fromkeys(phrases(tree))
    score = sum((F.when(count[p] > 0, bm25(count[p], F.col(f"_n{n}"), F.col("_docs"), F.col("len"), F.col("_mean"))).otherwise(0.0) for n, p in enumerate(wanted) if p in ranks), F.lit(0.0))
    return hits.filter(_fits(tree, count)).join(F.broadcast(corpus)).select("doc_id", (-score).alias("rank"))  # one row


def ranked_texts(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """doc_id, rank (the best is the smallest) of all documents that fit ``query``, without an index: their counts are written once, and read for figures and ranks."""
    tree = parse(query)
    wanted = list(dict.fromkeys(all_phrases(tree)))
    hits = cut(hits_in_texts(docs, key, text, wanted))
    corpus = hits.agg(F.count("*").alias("_docs"), F.avg("len").alias("_mean"), *[F.count_if(F.col(f"tf{n}") > 0).alias(f"_n{n}") for n in range(len(wanted))])
    return _ranked(hits, tree, wanted, corpus)


def ranked(index: DataFrame, size: DataFrame, query: str) -> DataFrame:
    """doc_id, rank (the best is the smallest) of all documents that fit ``query``, from an index."""
    tree = parse(query)
    wanted = list(dict.fromkeys(all_phrases(tree)))
    hits = cut(hits_in_index(index, wanted))
    figures = hits.agg(*[F.count_if(F.col(f"tf{n}") > 0).alias(f"_n{n}") for n in range(len(wanted))])
    corpus = size.agg(F.count("*").alias("_docs"), F.avg("len").alias("_mean")).join(F.broadcast(figures))  # one row each
    return _ranked(hits.join(size.select("doc_id", "len"), "doc_id"), tree, wanted, corpus)


def _shown(docs: DataFrame, ranks: DataFrame, query: str, limit: int, key: str) -> DataFrame:
    """The best documents with their text and a snippet: at most 50 ids, which are pushed to the scan."""
    best = cut(ranks.orderBy("rank", "doc_id").limit(min(limit, 50)))
    ids = [r.doc_id for r in best.select("doc_id").collect()]  # at most 50
    words = [w for p in phrases(parse(query)) for w in p.terms]
    d = docs.filter(F.col(key).isin(ids))
    d = d.withColumnRenamed(key, "doc_id") if key != "doc_id" else d
    return F.broadcast(best).join(d, "doc_id").withColumn("snippet", snippet(F.col("full_text"), words)).orderBy("rank", "doc_id")  # at most 50 rows


def search(docs: DataFrame, index: DataFrame, size: DataFrame, query: str, limit: int = 10, key: str = "doc_id") -> DataFrame:
    """The best documents, at most min(limit, 50), by rank and then doc_id, with a snippet, from an index."""
    return _shown(docs, ranked(index, size, query), query, limit, key)


def search_texts(docs: DataFrame, query: str, limit: int = 10, key: str = "doc_id") -> DataFrame:
    """The same without an index."""
    return _shown(docs, ranked_texts(docs, key, "full_text", query), query, limit, key)


def snippet(text: Column, words: list[str], size: int = 64, mark: str = "**", dots: str = "...") -> Column:
    """``size`` words around the first hit, hits marked, dots where text is cut off."""
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")
    plain = lambda x: F.regexp_replace(folded(x), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    hit = lambda x: plain(x).isin(words)
    first = F.aggregate(F.transform(raw, lambda x, i: F.when(hit(x), i)), F.lit(None).cast("int"), lambda acc, i: F.coalesce(acc, i))
    begin = F.greatest(F.lit(0), F.least(F.coalesce(first, F.lit(0)) - size // 2, F.size(raw) - size))
    shown = F.transform(F.slice(raw, begin + 1, size), lambda x: F.when(hit(x), F.concat(F.lit(mark), x, F.lit(mark))).otherwise(x))
    return F.concat(F.when(begin > 0, dots).otherwise(""), F.array_join(shown, " "), F.when(begin + size < F.size(raw), dots).otherwise(""))


def prefix_phrase(column: Column, text: str) -> Column:
    """Whether the words of ``text`` stand next to each other in a column, the last as a prefix; for short columns, without an index."""
    p = phrase(text, True)
    joined = F.concat(F.lit(" "), F.array_join(tokens(F.coalesce(column, F.lit(""))), " "))
    return F.contains(joined, F.lit(" " + " ".join(p.terms)))
