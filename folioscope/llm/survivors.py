"""Best representative of each duplicate group (problem 7).

The fields of all records of a group are unpivoted to long rows (group, field, value, vote). Votes of equal
normalised values are summed per group and field, winners come by ``max_by`` over the summed vote and its
tie-breaks, and the winners are pivoted back to one row a group. All three are aggregations with partial
combine before the shuffle, so a group that holds a third of all records reaches its final task as a few rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.session import cut


@dataclass(frozen=True)
class Field:
    """One field of the surviving record.

    ``value`` is the column. ``vote`` gives a record's vote (default: source trust times recency decay).
    ``normal`` maps a value to what counts as equal (default: itself). ``rank`` orders values before their votes (``rank_first``)
    or after them. Ties end at the smallest value by code point. With ``total`` the field is the sum of all its votes instead of a value.
    """

    name: str
    value: Callable[[], Column]
    vote: Callable[[], Column] | None = None
    normal: Callable[[Column], Column] | None = None
    rank: Callable[[Column], list[Column]] | None = None
    rank_first: bool = False
    total: bool = False


def decay_vote(trust: Column, age_days: Column, half_life_days: float = 180.0) -> Column:
    """Trust times recency decay; null trust counts 0.5, null age as ten half-lives."""
    age = F.greatest(F.coalesce(age_days, F.lit(10 * half_life_days)), F.lit(0.0))
    return F.coalesce(trust, F.lit(0.5)) * F.pow(F.lit(0.5), age / F.lit(half_life_days))


def survivors(records: DataFrame, group: str, fields: list[Field], vote: Column | None = None) -> DataFrame:
    """One row a group with the winning value of each field; values are strings in the long rows.

    Null values have no vote: a field that is null in all records of a group stays null. A null group is no
    group and has no row. Repeated records vote once each. Records in equal votes give the smallest value.
    """
    default = vote if vote is not None else F.lit(1.0)
    cells = F.array(*[
        F.struct(F.lit(f.name).alias("field"), f.value().cast("string").alias("value"), (f.vote() if f.vote else default).cast("double").alias("vote"))
        for f in fields
    ])
    long = records.filter(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.explode(cells).alias("_c"))
    long = long.select("_g", "_c.*").filter("value is not null")
    key = F.col("value")
    for f in fields:
        if f.normal:
            key = F.when(F.col("field") == f.name, f.normal(F.col("value"))).otherwise(key)
    # Votes of equal normalised values add up; the most voted spelling of a value stands for it. Without normal forms each value is its own.
    if any(f.normal for f in fields):
        spelt = long.groupBy("_g", "field", key.alias("_n"), "value").agg(F.sum("vote").alias("v"))
        summed = spelt.groupBy("_g", "field", "_n").agg(F.sum("v").alias("vote"), F.max_by("value", F.struct(F.col("v"), _last(F.col("value")))).alias("value"))
    else:
        summed = long.groupBy("_g", "field", "value").agg(F.sum("vote").alias("vote"))
    order = F.struct(F.lit(0.0), F.col("vote"), F.lit(0.0))
    for f in fields:
        if f.rank:
            # At most two rank columns, as doubles.
            r = [x.cast("double") for x in f.rank(F.col("value"))] + [F.lit(0.0)]
            if f.rank_first:
                order = F.when(F.col("field") == f.name, F.struct(r[0].alias("col1"), r[1].alias("vote"), F.lit(0.0).alias("col3"))).otherwise(order)
            else:
                order = F.when(F.col("field") == f.name, F.struct(F.lit(0.0).alias("col1"), F.col("vote"), r[0].alias("col3"))).otherwise(order)
    ranked = summed.select("_g", "field", "value", "vote", order.alias("o"))
    best = F.struct(F.col("o"), _last(F.col("value")))
    mine = lambda f, c: F.when(F.col("field") == f.name, c)
    won = ranked.groupBy("_g").agg(*[F.sum(mine(f, F.col("vote"))).alias(f.name) if f.total else F.max_by(mine(f, F.col("value")), mine(f, best)).alias(f.name) for f in fields])
    return won.withColumnRenamed("_g", group)


def _last(value: Column) -> Column:
    """A binary that sorts opposite to ``value`` by code point, so that a maximum takes the smallest value.

    The UTF-8 bytes are complemented; a closing 0xFF makes a prefix sort behind what it begins.
    """
    flipped = F.translate(F.hex(value.cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210")
    return F.concat(flipped, F.lit("G"))


def full_words(name: Column) -> Column:
    """Pieces between spaces, without full stops and commas at their ends, of two or more letters, hyphens or apostrophes."""
    pieces = F.transform(F.split(name, " "), lambda x: F.regexp_replace(x, r"^[.,]+|[.,]+$", ""))
    return F.size(F.filter(pieces, lambda x: x.rlike(r"^[\p{L}\p{M}'’‐-]{2,}$")))


def canonical_survivors(canonicals: DataFrame, aliases: DataFrame, entities: DataFrame, groups: DataFrame) -> DataFrame:
    """p7_found: group_id, canonical_id, canonical_text, total_mentions, for groups of two or more stored records.

    Everything about a group comes as long rows: a row for the newest state of each record, one for each of its names, one for each entity.
    Groups and records are written once, as several kinds of rows are made of them.
    """
    groups = cut(groups)
    member = aliases.filter("canonical_id is not null and entity_id is not null").select("entity_id", "canonical_id").distinct()
    of = member.join(groups, "entity_id").groupBy("canonical_id").agg(F.min("group_id").alias("group_id"))
    states = canonicals.filter("canonical_id is not null").select("canonical_id", "updated_at", F.coalesce("total_mentions", F.lit(0)).alias("t"), "canonical_text").distinct()
    recs = cut(states.join(of, "canonical_id"))
    # The newest state of each record, of equally new ones that with the higher total.
    newest = recs.groupBy("group_id", "canonical_id").agg(F.max(F.struct("updated_at", "t")).alias("s"))
    blank = lambda kind: F.lit(None).cast(kind)
    rows = newest.select("group_id", "canonical_id", F.col("s.t").alias("weight"), blank("string").alias("name"), blank("long").alias("mentions"))
    rows = rows.unionByName(recs.select("group_id", blank("long").alias("canonical_id"), F.lit(0).cast("long").alias("weight"), F.col("canonical_text").alias("name"), blank("long").alias("mentions")))
    counted = entities.filter("entity_id is not null").groupBy("entity_id").agg(F.max(F.coalesce("occurrence_count", F.lit(0))).alias("n"))
    total = groups.join(counted, "entity_id", "left")
    rows = rows.unionByName(total.select("group_id", blank("long").alias("canonical_id"), F.lit(0).cast("long").alias("weight"), blank("string").alias("name"), F.coalesce("n", F.lit(0)).alias("mentions")))
    # Ids go through the long rows as zero-padded text, so that the smallest text is the smallest id.
    padded = F.when(F.col("canonical_id").isNotNull(), F.format_string("%020d", F.col("canonical_id")))
    won = survivors(
        rows,
        "group_id",
        [
            Field("canonical_id", lambda: padded, vote=lambda: F.col("weight")),
            Field("canonical_text", lambda: F.col("name"), rank=lambda v: [full_words(v), F.char_length(v)], rank_first=True),
            Field("total_mentions", lambda: F.when(F.col("mentions").isNotNull(), F.lit("all")), vote=lambda: F.col("mentions"), total=True),
            Field("records", lambda: F.when(F.col("canonical_id").isNotNull(), F.lit("all")), vote=lambda: F.lit(1), total=True),
        ],
    )
    return won.filter("records >= 2").select("group_id", F.col("canonical_id").cast("long").alias("canonical_id"), "canonical_text", F.coalesce("total_mentions", F.lit(0)).cast("long").alias("total_mentions"))


def trusted_survivors(canonicals: DataFrame, aliases: DataFrame, groups: DataFrame, trust: dict[str, float] | None = None, half_life_days: float = 180.0) -> DataFrame:
    """One row a group (of any size) by source trust times recency decay: group_id, canonical_text, entity_type, records.

    The trust of a record is the greatest one among the merge methods of its links.
    """
    trust = trust or {"seed": 0.7, "auto": 0.6, "llm": 0.8, "manual": 1.0}
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in trust.items() for x in kv]), F.col("merge_method"))
    link = aliases.filter("canonical_id is not null").join(cut(groups), "entity_id").groupBy("canonical_id").agg(F.min("group_id").alias("group_id"), F.max(weight).alias("trust"))
    recs = cut(canonicals.select("canonical_id", "updated_at", "canonical_text", "entity_type").distinct().join(link, "canonical_id"))
    # Ages count from a fixed day: a later one only scales all votes by the same factor.
    age = F.datediff(F.lit("2025-01-01").cast("date"), F.col("updated_at").cast("date")).cast("double")
    fields = [
        Field("canonical_text", lambda: F.nullif(F.trim("canonical_text"), F.lit("")), normal=lambda v: F.lower(F.regexp_replace(v, r"[^\p{L}\p{N}]+", " "))),
        Field("entity_type", lambda: F.col("entity_type")),
        # A record counts once, with the first of its states.
        Field("records", lambda: F.lit("all"), vote=lambda: F.col("_first"), total=True),
    ]
    first = F.when(F.row_number().over(W.partitionBy("canonical_id").orderBy("updated_at", "canonical_text", "entity_type")) == 1, 1).otherwise(0)
    won = survivors(recs.withColumn("_first", first), "group_id", fields, decay_vote(F.col("trust"), age, half_life_days))
    return won.select("group_id", "canonical_text", "entity_type", F.col("records").cast("long").alias("records"))
