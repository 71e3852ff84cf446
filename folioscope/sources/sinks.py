"""Writing tables: upserts as set operations, JSON reports and load counters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.numbering import numbered


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys; of equal keys in ``new`` the greatest ``order`` (else row) stays."""
    rest = [c for c in new.columns if c not in keys]
    by = F.col(order) if order else F.to_json(F.struct(*rest))
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*old.columns))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` with keys that it lacks, one a key."""
    rest = [c for c in new.columns if c not in keys]
    fresh = new.dropDuplicates(keys) if not rest else new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return old.unionByName(fresh.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def entity_upsert(old: DataFrame, seen: DataFrame) -> DataFrame:
    """Entities with the counts of newly seen (normalized_text, type, text, doc_id) added; new ones get ids behind the greatest."""
    n = seen.groupBy("normalized_text", "type").agg(F.count("*").alias("_n"), F.min_by("text", "doc_id").alias("_t"), F.min("doc_id").alias("_d"))
    kept = old.join(n.select("normalized_text", "type", "_n"), ["normalized_text", "type"], "left").withColumn("occurrence_count", F.coalesce("occurrence_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).select(*old.columns)
    top = old.agg(F.coalesce(F.max("entity_id"), F.lit(0)).alias("_top"))
    new = n.join(old.select("normalized_text", "type"), ["normalized_text", "type"], "left_anti").join(F.broadcast(top))  # one row
    new = numbered(new, ["_d", "normalized_text", "type"], "entity_id", F.col("_top") + 1)
    made = new.select("entity_id", F.col("_t").alias("text"), "type", "normalized_text", F.col("_d").alias("first_seen_doc_id"), F.col("_n").alias("occurrence_count"))
    return kept.unionByName(made.select(*old.columns))


def load_status(classified: DataFrame, files: DataFrame) -> DataFrame:
    """Classified documents with their text and a status: loaded, skipped (no path) or error (no such file)."""
    j = classified.join(files.select("filepath", "full_text"), "filepath", "left")
    status = F.when(F.col("filepath").isNull() | (F.col("filepath") == ""), "skipped").when(F.col("full_text").isNull(), "error").otherwise("loaded")
    return j.withColumn("status", status)


def counters(status: DataFrame) -> DataFrame:
    return status.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("loaded", "skipped", "error")])


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; the commit protocol renames finished files only."""
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def swap_table(df: DataFrame, path: str) -> None:
    """Replace a table at once: ``df`` becomes a version folder, and a pointer file, renamed into place, names it; readers see the old or the new state.

    Versions that no pointer names are removed but for the last before, which a running reader may still use.
    """
    spark = df.sparkSession
    fs, here = _fs(spark, path)
    before = current_version(spark, path)
    name = f"v{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(f"{path}/{name}")
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fresh = Path(f"{path}/_{name}")
    out = fs.create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(here.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, Path(f"{path}/_current"), options)
    for s in fs.listStatus(here):
        version = s.getPath().getName()
        if version.startswith("v") and version not in (name, before):
            fs.delete(s.getPath(), True)


def _fs(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def current_version(spark, path: str) -> str | None:
    """The version folder that a table's pointer names, or None where there is no table."""
    fs, _ = _fs(spark, path)
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_current")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def read_table(spark, path: str) -> DataFrame:
    """The present state of a table that ``swap_table`` wrote."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/{version}")
