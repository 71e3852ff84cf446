"""Files that arrive in an inbox: classified as a stream, with documents that cannot be used in a second sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.classify import document_type
from folioscope.operators.survey import doc_id


def stream(spark: SparkSession, inbox: str, glob: str = "*.txt") -> DataFrame:
    """doc_id, filepath, full_text of each new file."""
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(inbox)
    path = F.col("_metadata.file_path")
    return files.select(doc_id(path).alias("doc_id"), path.alias("filepath"), F.col("value").alias("full_text"))


def process(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classified, dead letters) of one batch; blank texts are dead letters."""
    blank = F.coalesce(F.trim("full_text"), F.lit("")) == ""
    good = batch.filter(~blank).withColumn("_t", document_type(F.col("full_text"))).select("doc_id", "filepath", "_t.doc_type", "_t.confidence", "full_text")
    return good, batch.filter(blank).select("doc_id", "filepath", F.lit("empty file").alias("reason"))


def run_available(spark: SparkSession, inbox: str, completed: str, dead_letters: str, checkpoint: str) -> None:
    """Process what is there now and stop; files seen before are not read again, as the folder ``checkpoint`` remembers them.

    That folder must outlive the session, beside the results: without it a next run would count its batches from 0 again.

    A batch that is repeated after a failure writes to the folder of its own number, in place of what it left.
    """

    def write(batch: DataFrame, number: int) -> None:
        good, bad = process(batch)
        good.write.mode("overwrite").parquet(f"{completed}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")

    q = stream(spark, inbox).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()

