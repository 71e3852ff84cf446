"""Consecutive numbers in a global order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.session import cut


def numbered(df: DataFrame, order: list[str], name: str, start: Column | int = 1) -> DataFrame:
    """``df`` with a bigint column ``name``: start, start + 1, ... in the order of the columns ``order``, nulls first.

    Rows are put into ranges of the order; each range is numbered by itself and moved on by the sizes of the ranges before it. Only those
    sizes, one a range, meet in one window. Rows with equal ``order`` are numbered in the order of their other values.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    full = [*order, *[c for c in df.columns if c not in order and not df.schema[c].dataType.simpleString().startswith("map")]]
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*full))
    first = F.lit(start) if isinstance(start, int) else start
    return ranged.withColumn("_own", own).join(before, "_part").withColumn(name, (first + F.col("_before") + F.col("_own") - 1).cast("long")).drop("_part", "_own", "_before")
