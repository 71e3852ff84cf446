"""Canonical records: initialising, lookups, merging and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.session import cut

#: Pairs that a report may hold for its replay.
MOST_PAIRS = 100_000


def initialise(entities: DataFrame, now: str = "2024-01-01 00:00:00", existing: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(canonical_entities, entity_aliases), one record an entity, with the entity's id; where ``existing`` records are there, those, unchanged."""
    if existing is not None and not existing[0].isEmpty():
        return existing
    at = F.lit(now).cast("timestamp")
    c = entities.select(F.col("entity_id").alias("canonical_id"), F.col("type").alias("entity_type"), F.col("text").alias("canonical_text"), F.col("normalized_text").alias("canonical_normalized"), F.coalesce("occurrence_count", F.lit(0)).alias("total_mentions"), at.alias("created_at"), at.alias("updated_at"))
    a = entities.select("entity_id", F.col("entity_id").alias("canonical_id"), F.lit(True).alias("is_canonical"), F.lit("seed").alias("merge_method"), F.lit(1.0).alias("merge_confidence"), at.alias("merged_at"), F.lit("init").alias("merged_by"))
    return c, a


def current(canonicals: DataFrame) -> DataFrame:
    """The newest state of each record; of equally new ones that with the most mentions, then the greatest text."""
    key = F.struct("updated_at", F.coalesce("total_mentions", F.lit(-1)), F.coalesce("canonical_text", F.lit("")))
    rest = [c for c in canonicals.columns if c != "canonical_id"]
    return canonicals.filter("canonical_id is not null").groupBy("canonical_id").agg(F.max_by(F.struct(*rest), key).alias("_r")).select("canonical_id", "_r.*")


def of_entity(aliases: DataFrame, canonicals: DataFrame) -> DataFrame:
    """entity_id with the records that it is an alias of."""
    return aliases.filter("canonical_id is not null").select("entity_id", "canonical_id").distinct().join(current(canonicals), "canonical_id")


def aliases_of(aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """canonical_id with the names of its aliases and their counts."""
    return aliases.filter("canonical_id is not null").select("canonical_id", "entity_id").distinct().join(entities.select("entity_id", "text", "occurrence_count"), "entity_id")


def merge(aliases: DataFrame, moves: DataFrame, method: str = "auto", by: str = "auto") -> DataFrame:
    """``aliases`` with each entity in ``moves`` (entity_id, target, confidence) moved to its target, that alias only."""
    m = moves.select("entity_id", F.col("target").alias("_t"), F.col("confidence").alias("_c"))
    moved = F.col("_t").isNotNull() & ~F.col("canonical_id").eqNullSafe(F.col("_t"))
    j = aliases.join(m, "entity_id", "left")
    return j.withColumns(
        {
            "is_canonical": F.when(moved, False).otherwise(F.col("is_canonical")),
            "merge_method": F.when(moved, method).otherwise(F.col("merge_method")),
            "merge_confidence": F.when(moved, F.col("_c")).otherwise(F.col("merge_confidence")),
            "merged_by": F.when(moved, by).otherwise(F.col("merged_by")),
            "canonical_id": F.when(moved, F.col("_t")).otherwise(F.col("canonical_id")),
        }
    ).select(*aliases.columns)


def merge_one(aliases: DataFrame, entity_id: int, target: int, method: str = "manual", confidence: float = 1.0, by: str = "user") -> DataFrame:
    """``aliases`` with one entity moved; ValueError if it is in no alias."""
    if aliases.filter(F.col("entity_id") == entity_id).isEmpty():
        raise ValueError(f"entity {entity_id} is in no alias")
    return merge(aliases, aliases.sparkSession.createDataFrame([(entity_id, target, confidence)], "entity_id long, target long, confidence double"), method, by)


def totals(canonicals: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """``canonicals`` with totals counted again from their aliases; records without aliases are gone."""
    n = aliases.filter("canonical_id is not null").select("entity_id", "canonical_id").distinct().join(entities.select("entity_id", "occurrence_count"), "entity_id")
    n = n.groupBy("canonical_id").agg(F.coalesce(F.sum("occurrence_count"), F.lit(0)).alias("_n"))
    return canonicals.join(n, "canonical_id").withColumn("total_mentions", F.col("_n")).drop("_n")


def auto_merge(pairs: DataFrame, aliases: DataFrame, least: float = 0.95, method: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(moves, log): a report's pairs replayed in their order on the alias map as it stands at that moment.

    The report holds a bounded number of pairs (its limit), so one task replays them in order; only their aliases are
    looked up. The rarer entity of a pair, of equals the second, moves to the other's record. More than ``MOST_PAIRS`` pairs are a ValueError.
    The report is written first, as the counting, the look-ups and the replay each read it and would each compare all entities again.
    """
    import pandas as pd

    pairs = cut(pairs.limit(MOST_PAIRS + 1))
    if pairs.count() > MOST_PAIRS:
        raise ValueError("the report holds too many pairs to be replayed in order")
    p = pairs.filter(F.col("confidence") >= least)
    ends = p.select(F.explode(F.array("entity1_id", "entity2_id")).alias("entity_id")).distinct()
    home = aliases.join(ends, "entity_id").groupBy("entity_id").agg(F.min("canonical_id").alias("home"))
    h1, h2 = home.select(F.col("entity_id").alias("entity1_id"), F.col("home").alias("home1")), home.select(F.col("entity_id").alias("entity2_id"), F.col("home").alias("home2"))
    rows = p.join(h1, "entity1_id", "left").join(h2, "entity2_id", "left").select("ord", "entity1_id", "entity1_count", "entity2_id", "entity2_count", "confidence", "home1", "home2")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        at, out = {}, []
        for r in pdf.sort_values("ord").itertuples(index=False):
            for e, h in ((r.entity1_id, r.home1), (r.entity2_id, r.home2)):
                at.setdefault(int(e), None if pd.isna(h) else int(h))
            source, target = (int(r.entity1_id), int(r.entity2_id)) if r.entity1_count < r.entity2_count else (int(r.entity2_id), int(r.entity1_id))
            to, now = at[target], at[source]
            status = "error" if to is None or now is None else "already_merged" if to == now else "merged"
            if status == "merged":
                at[source] = to
            out.append((int(r.ord), source, target, float("nan") if to is None else float(to), float(r.confidence), status))
        return pd.DataFrame(out, columns=["ord", "entity_id", "with_entity", "target", "confidence", "status"])

    log = rows.groupBy(F.lit(1).alias("_all")).applyInPandas(replay, "ord int, entity_id long, with_entity long, target double, confidence double, status string")
    log = log.withColumn("target", F.when(~F.isnan("target"), F.col("target")).cast("long"))
    moves = log.filter("status = 'merged'").groupBy("entity_id").agg(F.max_by("target", "ord").alias("target"), F.max_by("confidence", "ord").alias("confidence"))
    return moves, log


def stats(canonicals: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row: records, aliases and their ratio (0 without records)."""
    c = canonicals.agg(F.countDistinct("canonical_id").alias("total_canonical"))
    a = aliases.filter("canonical_id is not null").agg(F.countDistinct("entity_id", "canonical_id").alias("total_aliases"))
    both = c.withColumn("_k", F.lit(1)).join(a.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.withColumn("avg_aliases", F.when(F.col("total_canonical") > 0, F.round(F.col("total_aliases") / F.col("total_canonical"), 9)).otherwise(0.0))


def by_type(canonicals: DataFrame) -> DataFrame:
    return canonicals.groupBy("entity_type").agg(F.countDistinct("canonical_id").alias("records"))


def most_aliases(canonicals: DataFrame, aliases: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` records of most aliases, of those with more than one; ties end by id."""
    n = aliases.filter("canonical_id is not null").groupBy("canonical_id").agg(F.countDistinct("entity_id").alias("alias_count")).filter("alias_count > 1")
    return n.join(current(canonicals).select("canonical_id", "canonical_text"), "canonical_id").orderBy(F.desc("alias_count"), "canonical_id").limit(k)


def review_cases(pairs: DataFrame, mentions: DataFrame, low: float = 0.80, high: float = 0.95) -> DataFrame:
    """Pairs in the middle tier with one context each (that of the smallest mention_id), for a reviewer or model.

    The pairs are written first, as both their contexts and the cases read them; only mentions of their entities are grouped.
    """
    p = cut(pairs.filter((F.col("confidence") >= low) & (F.col("confidence") < high)))
    ends = p.select(F.explode(F.array("entity1_id", "entity2_id")).alias("entity_id")).distinct()
    c = mentions.filter("context is not null").join(ends, "entity_id", "left_semi").groupBy("entity_id").agg(F.min_by("context", "mention_id").alias("context"))
    p = p.join(c.select(F.col("entity_id").alias("entity1_id"), F.col("context").alias("entity1_context")), "entity1_id", "left")
    return p.join(c.select(F.col("entity_id").alias("entity2_id"), F.col("context").alias("entity2_context")), "entity2_id", "left")


def reviewed(cases: DataFrame, decide) -> DataFrame:
    """Cases with should_merge and note; ``decide`` maps (text, text, context, context) to (bool, note), a failure counts as no.

    The verdicts are added to the cases' own batches, so the cases are read, and each is decided, once.
    """
    import pyarrow as pa

    asked = ["entity1_text", "entity2_text", "entity1_context", "entity2_context"]

    def run(batches):
        for b in batches:
            got = []
            for names in zip(*(b.column(c).to_pylist() for c in asked), strict=True):
                try:
                    got.append(decide(*names))
                except Exception as e:
                    got.append((False, f"error: {e}"))
            verdicts = [pa.array([bool(g[0]) for g in got], pa.bool_()), pa.array([str(g[1]) for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *verdicts], names=[*b.schema.names, "should_merge", "note"])

    keys = ["entity1_id", "entity2_id"]
    cases = cases.select(*keys, *[c for c in cases.columns if c not in keys])
    return cases.mapInArrow(run, T.StructType([*cases.schema.fields, T.StructField("should_merge", T.BooleanType()), T.StructField("note", T.StringType())]))
