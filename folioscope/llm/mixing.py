"""Mixing sources to target weights (problem 9).

Every document gets a hash-random key; within each source the documents are put in the order of their keys, and a
prefix sum of their token counts is cut at the source's exact budget. The order and the sums are distributed: the keys' leading bits split
a source into ranges, one aggregation sums each range, a window over the ranges (a fixed number a source, not the
documents) gives where each begins, and a window within each range does the rest. A source that holds most
rows is so spread over as many tasks as it has ranges.

The budget: the largest total at which every source that has tokens can reach its share within ``max_repeats``, or a given total.
A budget beyond a source's tokens takes all of it as often as it fits, and the cut in the epoch that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm import tokens
from folioscope.session import cut

#: Ranges of keys in each source, a power of two.
RANGES = 1024


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """One row a listed source: source, target_share, max_repeats, available, budget, epochs, rest.

    Sources with share 0 or null, without documents or tokens, get budget 0; the shares of the others are scaled to 1.
    Repeated sources in ``targets`` count once (the greatest share).
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"))
    t = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(have, "source", "left").withColumns({"available": F.coalesce("available", F.lit(0)), "target_share": F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)), "max_repeats": F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))})
    live = F.when((F.col("available") > 0) & (F.col("max_repeats") > 0), F.col("target_share")).otherwise(0.0)
    everything = W.partitionBy(F.lit(1))  # one row a listed source
    t = t.withColumn("share", F.try_divide(live, F.sum(live).over(everything)))
    room = F.col("available") * F.col("max_repeats")
    most = F.floor(F.min(F.when(F.col("share") > 0, room / F.col("share"))).over(everything)) if total is None else F.lit(total)
    t = t.withColumn("budget", F.coalesce(F.least(room, F.round(F.col("share") * most).cast("long")), F.lit(0).cast("long")))
    return t.withColumns({"epochs": F.coalesce(F.floor(F.try_divide("budget", "available")), F.lit(0)), "rest": F.coalesce(F.expr("try_mod(budget, available)"), F.lit(0))}).drop("share")


def select(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, ranges: int = RANGES) -> DataFrame:
    """doc_id, source, tokens, repeats of every document that is used at least once.

    ``sizes`` has doc_id, source, tokens. Documents of null or unlisted sources are not used; those of 0 tokens
    are used as often as their place in the order says. Ties of keys end by doc_id.
    """
    keyed = sizes.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_range", F.shiftrightunsigned("_key", 65 - ranges.bit_length()))
    p = plan(sizes, targets, total).select(F.col("source").alias("_s"), "epochs", "rest")
    sums = keyed.groupBy("source", "_range").agg(F.sum("tokens").alias("_t"))
    begin = sums.select(F.col("source").alias("_bs"), F.col("_range").alias("_br"), (F.sum("_t").over(W.partitionBy("source").orderBy("_range")) - F.col("_t")).alias("_begin"))
    rows = keyed.join(begin, (F.col("source") == F.col("_bs")) & (F.col("_range") == F.col("_br"))).join(p, F.col("source") == F.col("_s"))
    before = F.col("_begin") + F.sum("tokens").over(W.partitionBy("source", "_range").orderBy(F.shiftrightunsigned("_key", 1), "_key", "doc_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens")
    # The document that crosses the cut is used if the sum is then nearer to the budget.
    last = (before + F.col("tokens") / 2.0 <= F.col("rest")) & (F.col("rest") > 0)
    rows = rows.withColumn("repeats", (F.col("epochs") + F.when(last, 1).otherwise(0)).cast("long"))
    return rows.filter("repeats > 0").select("doc_id", "source", "tokens", "repeats")


def sizes_of(documents: DataFrame, path: str = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, source, tokens: the corpus is tokenised once and cut, as plan and selection both read it."""
    return cut(tokens.count(documents.select("doc_id", "source", "text"), "text", path))


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, tokens, actual_share, documents, most_repeats of every listed source."""
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    t = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share")).join(got, "source", "left")
    t = t.fillna(0, ["tokens", "documents", "most_repeats"])
    return t.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(W.partitionBy(F.lit(1)))), F.lit(0.0))).select("source", "target_share", "tokens", "actual_share", "documents", "most_repeats")
