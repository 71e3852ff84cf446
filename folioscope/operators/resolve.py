"""Similar entities as merge candidates: a blocked self-join with a token and an edit measure, confidence and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of the lower-cased words between white space; 0 where either has none."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))
    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)).cast("double") / F.size(F.array_union(x, y)))


def confidence(distance: Column, shared: Column, n1: Column, n2: Column) -> Column:
    """From the edit distance, raised by shared words and by rarity of one, lowered by few shared words; added in this order."""
    base = F.when(distance == 1, 0.95).when(distance == 2, 0.85).when(distance == 3, 0.70).otherwise(0.50)
    c = base + F.when(shared >= 0.8, 0.10).when(shared >= 0.5, 0.05).otherwise(0.0)
    low, high = F.least(n1, n2), F.greatest(n1, n2)
    rare = (high > 10) & (F.try_divide(low.cast("double"), high) < 0.1)
    c = c + F.when(rare, 0.05).otherwise(0.0)
    c = F.when(shared < 0.3, c - 0.15).otherwise(c)
    return F.when(distance == 0, 1.0).otherwise(F.least(c, F.lit(1.0)))


# The texts of the reasons.
def reason(distance: Column, shared: Column, n1: Column, n2: Column) -> Column:
    pct = lambda: F.format_string("%d%%", F.bround(shared * 100).cast("int"))
    edit = F.when(distance == 1, "Edit distance=1 (likely typo)").when(distance == 2, "Edit distance=2 (possible typo)").otherwise(F.concat(F.lit("Edit distance="), distance.cast("string")))
    overlap = F.when(shared >= 0.8, F.concat(F.lit("High token overlap ("), pct(), F.lit(")"))).when(shared >= 0.5, F.concat(F.lit("Good token overlap ("), pct(), F.lit(")")))
    low, high = F.least(n1, n2), F.greatest(n1, n2)
    rare = F.when((high > 10) & (F.try_divide(low.cast("double"), high) < 0.1), F.concat(F.lit("Rare variant ("), low.cast("string"), F.lit(" vs "), high.cast("string"), F.lit(")")))
    few = F.when(shared < 0.3, F.concat(F.lit("Low token overlap ("), pct(), F.lit(")")))
    return F.when(distance == 0, "Exact match (different case)").otherwise(F.concat_ws("; ", edit, overlap, rare, few))


def marks(text: Column) -> Column:
    """64 bits of the characters of a text: of each code point whether it comes an odd number of times, by its remainder.

    An inserted or deleted character turns one bit, a replaced one at most two; so texts at edit distance d differ in 2 d bits at most.
    """
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))
    return F.aggregate(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(bit(c)))


def candidates(entities: DataFrame, aliases: DataFrame, kind: str | None = None, least_count: int = 5, most_distance: int = 3, least_confidence: float = 0.70, salts: int = 8) -> DataFrame:
    """Pairs of entities that still stand for their own record (``is_canonical`` in ``aliases``), within a block of equal type and first
    three characters of the normal form, in the order of (count desc, id); an entity that was merged is in no pair.

    A pair shares a word, so the join has the shared word in its key beside type and prefix, and pairs that share several count once; what makes
    the key hot is a common word behind a common prefix, so one side is spread over ``salts``. The pairs of a key grow with the square of its
    entities, so what is cheap comes first: counts, lengths and ``marks``, then the bounded edit distance, and words only for what is left.
    """
    own = aliases.filter(F.col("is_canonical") & F.col("entity_id").isNotNull()).select("entity_id").distinct()
    e = entities.filter(F.col("normalized_text").isNotNull() & (F.col("normalized_text") != "") & (F.col("occurrence_count") >= least_count)).join(own, "entity_id", "left_semi")
    if kind:
        e = e.filter(F.col("type") == kind)
    e = e.select("entity_id", "text", "type", "normalized_text", "occurrence_count", F.substring("normalized_text", 1, 3).alias("prefix"), F.char_length("normalized_text").alias("n"), marks(F.col("normalized_text")).alias("m"))
    word = F.explode(F.array_distinct(F.filter(F.split(F.lower("normalized_text"), r"\s+"), lambda x: x != ""))).alias("_w")
    salt = {1: F.pmod(F.xxhash64("entity_id"), F.lit(salts)).cast("int").alias("_s"), 2: F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s")}
    worded = e.select("*", word)
    side = lambda k: worded.select("type", "prefix", "_w", salt[k], *[F.col(c).alias(f"{c}_{k}") for c in ("entity_id", "text", "normalized_text", "occurrence_count", "n", "m")])
    earlier = (F.col("occurrence_count_1") > F.col("occurrence_count_2")) | ((F.col("occurrence_count_1") == F.col("occurrence_count_2")) & (F.col("entity_id_1") < F.col("entity_id_2")))
    near = (F.abs(F.col("n_1") - F.col("n_2")) <= most_distance) & (F.bit_count(F.col("m_1").bitwiseXOR(F.col("m_2"))) <= 2 * most_distance)
    distance = F.levenshtein("normalized_text_1", "normalized_text_2", most_distance)
    p = side(1).join(side(2), ["type", "prefix", "_w", "_s"]).filter(near & earlier & (distance >= 0))
    # Of the words that a pair shares the first by code point keeps it, so no pair comes twice and nothing has to be made distinct.
    shared = F.array_min(F.array_intersect(*[F.filter(F.split(F.lower(f"normalized_text_{k}"), r"\s+"), lambda x: x != "") for k in (1, 2)]))
    # A generator's columns keep the filters on them above it; as plain columns, these would be taken into the join and worked out for each pair of a key.
    p = p.select("*", F.stack(F.lit(1), shared, distance, jaccard(F.col("normalized_text_1"), F.col("normalized_text_2"))).alias("_shared", "levenshtein", "jaccard")).filter(F.col("_w") == F.col("_shared"))
    args = (F.col("levenshtein"), F.col("jaccard"), F.col("occurrence_count_1"), F.col("occurrence_count_2"))
    p = p.withColumns({"confidence": confidence(*args), "reason": reason(*args)}).filter(F.col("confidence") >= least_confidence)
    return p.select(
        F.col("type"), F.col("entity_id_1").alias("entity1_id"), F.col("text_1").alias("entity1_text"), F.col("occurrence_count_1").alias("entity1_count"),
        F.col("entity_id_2").alias("entity2_id"), F.col("text_2").alias("entity2_text"), F.col("occurrence_count_2").alias("entity2_count"), "levenshtein", "jaccard", "confidence", "reason",
    )


def top(pairs: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` surest pairs; ties end by the ids."""
    return pairs.orderBy(F.desc("confidence"), "entity1_id", "entity2_id").limit(k)


def tier(conf: Column) -> Column:
    """Which hands a pair goes to; the bounds are compared as doubles, so 0.95 - 0.15 stays below 0.8."""
    return F.when(conf >= 0.95, "auto_merge").when(conf >= 0.80, "llm_review").when(conf >= 0.70, "manual_review")


def tiers(pairs: DataFrame, k: int = 200) -> DataFrame:
    return top(pairs, k).withColumn("tier", tier(F.col("confidence")))


def tier_counts(tiered: DataFrame) -> DataFrame:
    return tiered.groupBy("tier").agg(F.count("*").alias("pairs"), F.round(F.avg("confidence"), 9).alias("mean_confidence"))


def _before(a: Column, b: Column) -> Column:
    """The surer pair first, of equals by the ids."""
    one, two = (F.struct(-x["confidence"], x["entity1_id"], x["entity2_id"]) for x in (a, b))
    return F.when(one < two, -1).when(one > two, 1).otherwise(0)


def report(tiered: DataFrame) -> DataFrame:
    """One row with the tiers as arrays: at most as many pairs as the report's limit."""
    cols = [c for c in tiered.columns if c != "tier"]
    arr = lambda t: F.array_sort(F.collect_list(F.when(F.col("tier") == t, F.struct(*cols))), _before).alias(t)
    return tiered.agg(F.count("*").alias("total_candidates"), arr("auto_merge"), arr("llm_review"), arr("manual_review"))


def ordered(pairs: DataFrame) -> DataFrame:
    """With ``ord``, the place of each pair in the report; the report's limit bounds the rows of this one ordering."""
    return pairs.withColumn("ord", F.row_number().over(W.orderBy(F.desc("confidence"), "entity1_id", "entity2_id")))
