"""Versioned steps with dependencies: what must run, what a change invalidates, and the state of each document.

A document's state is a manifest row with an array of step results. The graph of steps is tiny and static, so closures over it are
taken on the driver; everything by document is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.schemas import MANIFEST, STEP
from folioscope.session import cut
from folioscope.sources import sinks


@dataclass(frozen=True)
class Step:
    """A named, versioned function after the steps it depends on: from documents (with ``steps``, what is known of each) to (doc_id, outcome and, if it has any, metadata)."""

    name: str
    version: int
    depends_on: tuple[str, ...] = ()
    run: Callable[[DataFrame], DataFrame] | None = None


# The steps, their versions and dependencies.
STEPS = (
    Step("classify", 2),
    Step("extract_email_metadata", 4, ("classify",)),
    Step("extract_urls", 1),
    Step("extract_entities", 7, ("extract_email_metadata",)),
    Step("assemble_metadata", 1, ("classify", "extract_email_metadata", "extract_urls", "extract_entities")),
)


def dependents(name: str, steps: tuple[Step, ...] = STEPS) -> set[str]:
    """All steps that depend on ``name``, directly or through others."""
    out: set[str] = set()
    while True:
        more = {s.name for s in steps if s.name not in out and any(d == name or d in out for d in s.depends_on)}
        if not more:
            return out
        out |= more


def in_order(steps: tuple[Step, ...] = STEPS) -> list[Step]:
    """Steps so that each stands behind those that it depends on."""
    done: list[Step] = []
    left = list(steps)
    while left:
        ready = [s for s in left if all(any(d.name == x for d in done) or all(x != o.name for o in steps) for x in s.depends_on)]
        if not ready:
            raise ValueError("steps depend on each other in a circle")
        done += ready
        left = [s for s in left if s not in ready]
    return done


# ---------------------------------------------------------------- one manifest's steps, as an array column


def get_step(steps: Column, name: str) -> Column:
    return F.element_at(F.filter(steps, lambda s: s["step_name"] == name), -1)


def has_step(steps: Column, name: str) -> Column:
    return F.exists(steps, lambda s: (s["step_name"] == name) & (s["status"] == "success"))


def last_step(steps: Column) -> Column:
    return F.try_element_at(steps, F.lit(-1))


def put_step(steps: Column, result: Column) -> Column:
    """With ``result`` in the place of the step of its name, or at the end."""
    there = F.exists(steps, lambda s: s["step_name"] == result["step_name"])
    return F.when(there, F.transform(steps, lambda s: F.when(s["step_name"] == result["step_name"], result).otherwise(s))).otherwise(F.concat(steps, F.array(result)))


def drop_after(steps: Column, name: str) -> Column:
    at = F.array_position(F.transform(steps, lambda s: s["step_name"]), F.lit(name))
    return F.when(at > 0, F.slice(steps, F.lit(1), at.cast("int"))).otherwise(steps)


def drop_steps(steps: Column, names: set[str]) -> Column:
    return F.filter(steps, lambda s: ~s["step_name"].isin(*sorted(names))) if names else steps


def dedupe(steps: Column) -> Column:
    """One result a step: that with the latest start (as text), at the place of its first."""
    names = F.array_distinct(F.transform(steps, lambda s: s["step_name"]))

    def newest(n: Column) -> Column:
        mine = F.filter(steps, lambda s: s["step_name"] == n)
        return F.element_at(F.array_sort(mine, lambda a, b: F.when(F.coalesce(a["started_at"], F.lit("")) < F.coalesce(b["started_at"], F.lit("")), -1).when(F.coalesce(a["started_at"], F.lit("")) > F.coalesce(b["started_at"], F.lit("")), 1).otherwise(0)), -1)

    return F.transform(names, newest)


# ---------------------------------------------------------------- many documents


def create(docs: DataFrame, key: str, path: str, now: str) -> DataFrame:
    return docs.select(
        F.col(key).cast("string").alias("doc_id"), F.col(path).alias("original_file"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.lit("pending").alias("status"),
        F.create_map().cast("map<string,string>").alias("provenance"), F.array().cast(f"array<{STEP.simpleString()}>").alias("steps"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit(None).cast("string").alias("error"),
    )


def _is_done(step: Step) -> Column:
    done = F.exists("steps", lambda s: (s["step_name"] == step.name) & (s["status"] == "success") & (s["step_version"] == step.version))
    return F.coalesce(done, F.lit(False))


def due(manifests: DataFrame, step: Step) -> DataFrame:
    """Manifests for which ``step`` has not succeeded in this version, with its dependents' results dropped where its version changed."""
    return _invalidated(manifests.filter(~_is_done(step)), step)


def _invalidated(manifests: DataFrame, step: Step) -> DataFrame:
    """Without the dependents' results where a success of another version is there."""
    changed = F.exists("steps", lambda s: (s["step_name"] == step.name) & (s["status"] == "success") & (s["step_version"] != step.version))
    gone = dependents(step.name)
    return manifests.withColumn("steps", F.when(changed, drop_steps(F.col("steps"), gone)).otherwise(F.col("steps"))) if gone else manifests


def run_step(manifests: DataFrame, docs: DataFrame, step: Step, now: str) -> DataFrame:
    """All manifests after ``step``: done ones unchanged; documents for which it gives no outcome have failed.

    Only documents that are due reach the step; its outcomes come back by one left join, and each manifest is changed or kept in place.
    """
    todo = due(manifests, step)
    made = step.run(docs.join(todo.select("doc_id", "steps"), "doc_id"))
    more = F.col("metadata") if "metadata" in made.columns else F.create_map().cast("map<string,string>")
    made = made.select("doc_id", F.col("outcome").cast("string").alias("_o"), more.alias("_more"))
    ok, runs = F.col("_o").isNotNull(), ~_is_done(step)
    result = F.struct(
        F.lit(step.name).alias("step_name"), F.lit(step.version).alias("step_version"), F.lit(now).alias("started_at"), F.lit(now).alias("completed_at"),
        F.when(ok, "success").otherwise("failed").alias("status"), F.col("_o").alias("outcome"), F.when(~ok, "no outcome").alias("error"),
    )
    rest = F.map_filter("metadata", lambda k, _: ~F.coalesce(F.map_contains_key("_more", k), F.lit(False)))
    changes = {
        "updated_at": F.lit(now), "status": F.when(ok, F.col("status")).otherwise("failed"), "error": F.when(~ok, F.lit(f"{step.name}: no outcome")).otherwise(F.col("error")),
        "metadata": F.when(F.col("_more").isNotNull(), F.map_concat(rest, "_more")).otherwise(F.col("metadata")),
    }
    kept = manifests.join(made, "doc_id", "left").withColumn("_runs", runs)
    fresh = _invalidated(kept, step).withColumn("steps", F.when(F.col("_runs"), put_step(F.col("steps"), result)).otherwise(F.col("steps")))
    return fresh.select(*[F.when(F.col("_runs"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in manifests.columns])


def run_all(manifests: DataFrame, docs: DataFrame, steps: tuple[Step, ...], now: str) -> DataFrame:
    """All steps in the order of their dependencies, then the status; each step's manifests are written before the next begins."""
    for step in in_order(steps):
        manifests = cut(run_step(manifests, docs, step, now))
    return complete(manifests, steps)


def update_metadata(manifests: DataFrame, key: str, value: Column, now: str) -> DataFrame:
    """With ``value`` as text under ``key`` of each manifest's metadata."""
    rest = F.map_filter("metadata", lambda k, _: k != key)
    return manifests.withColumns({"metadata": F.map_concat(rest, F.create_map(F.lit(key), value.cast("string"))), "updated_at": F.lit(now)})


def write_manifests(manifests: DataFrame, path: str) -> None:
    """All manifests as one state of a table that readers see at once."""
    sinks.swap_table(manifests, path)


def load_manifests(spark, path: str) -> DataFrame:
    """The manifests that ``write_manifests`` left, or none where nothing was written yet."""
    if not has_manifests(spark, path):
        return spark.createDataFrame([], MANIFEST)
    return sinks.read_table(spark, path)


def has_manifests(spark, path: str, doc_id: str | None = None) -> bool:
    """Whether manifests are stored, or one of a document."""
    if sinks.current_version(spark, path) is None:
        return False
    return doc_id is None or not sinks.read_table(spark, path).filter(F.col("doc_id") == doc_id).isEmpty()


def complete(manifests: DataFrame, steps: tuple[Step, ...] = STEPS) -> DataFrame:
    """Status ``completed`` where all steps have succeeded."""
    done = F.lit(True)
    for s in steps:
        done = done & has_step(F.col("steps"), s.name)
    return manifests.withColumn("status", F.when(done, "completed").otherwise(F.col("status")))


def assemble(classified: DataFrame, mentions: DataFrame, urls: DataFrame, mails: DataFrame) -> DataFrame:
    """One row a document: type, the 20 surest people, 10 organisations and locations, URLs, participants and counts.

    The lists are cut by a window in each document, whose mentions are bounded by its text.
    """
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("doc_id", "type").orderBy(F.desc("confidence"), "text"))
    most = F.when(F.col("type") == "person", 20).otherwise(10)
    best = mentions.withColumn("_p", place).filter((F.col("_p") <= most) & (F.col("type") != "date"))
    listed = best.groupBy("doc_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == t, F.struct("_p", "text")))), lambda x: x["text"]).alias(name) for t, name in (("person", "people"), ("organization", "organizations"), ("location", "locations"))])
    counts = mentions.groupBy("doc_id").agg(F.count("*").alias("mentions"))
    none = F.array().cast("array<string>")
    out = classified.join(listed, "doc_id", "left").join(counts, "doc_id", "left").join(urls.select("doc_id", F.transform("urls", lambda u: u["url"]).alias("urls")), "doc_id", "left").join(mails, "doc_id", "left")
    return out.withColumns({c: F.coalesce(F.col(c), none) for c in ("people", "organizations", "locations", "urls")} | {"mentions": F.coalesce("mentions", F.lit(0))})


def summary(manifests: DataFrame) -> DataFrame:
    """status, documents."""
    return manifests.groupBy("status").agg(F.count("*").alias("documents"))
