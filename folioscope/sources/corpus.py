"""Reading a corpus of text files and the JSON files that the commands exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from folioscope import schemas
from folioscope.operators.survey import doc_id
from folioscope.text import decode


def read_corpus(spark: SparkSession, folder: str, glob: str = "*.txt", keep_bom: bool = True, most_chars: int | None = None, in_order: bool = False) -> DataFrame:
    """doc_id, filepath, file_size, sha256, full_text of every file below ``folder``; bytes that are no UTF-8 are replaced.

    ``in_order`` sorts by path, in ranges; without it no order is kept and none is paid for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    text = decode(F.col("content"), keep_bom)
    if most_chars:
        text = F.substring(text, 1, most_chars)
    files = files.orderBy("path") if in_order else files
    return files.select(doc_id(F.col("path")).alias("doc_id"), F.col("path").alias("filepath"), F.col("length").alias("file_size"), F.sha2("content", 256).alias("sha256"), text.alias("full_text"))


def _json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_classifications(spark: SparkSession, path: str) -> DataFrame:
    """One row a classified document; the file is an array of objects."""
    return _json(spark, path, schemas.CLASSIFICATION)


def read_merge_candidates(spark: SparkSession, path: str, tier: str = "auto_merge") -> DataFrame:
    pairs = ArrayType(schemas.MERGE_CANDIDATE)
    report = StructType([StructField(t, pairs) for t in ("auto_merge", "llm_review", "manual_review")])
    return _json(spark, path, report).select(F.posexplode(tier).alias("ord", "p")).select("ord", "p.*")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The row of a survey report that ``sinks.write_json`` wrote."""
    return _json(spark, path, schemas.REPORT)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any file system that the session knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """The manifests below a folder, or none where it is not there yet."""
    return _json(spark, path, schemas.MANIFEST) if exists(spark, path) else spark.createDataFrame([], schemas.MANIFEST)


def by_keys(df: DataFrame, key: str, values: list) -> DataFrame:
    """Rows of a short list of keys (pushed to the scan), or of a longer one by a semi-join."""
    if len(values) <= 1000:
        return df.filter(F.col(key).isin(values))
    keys = df.sparkSession.createDataFrame([(v,) for v in values], StructType([StructField(key, df.schema[key].dataType)]))
    return df.join(keys.distinct(), key, "left_semi")


