"""Reading the tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], by: str = "loaded_at") -> DataFrame:
    """The newest row for each key: one ``max_by`` over a struct, which combines before the shuffle.

    Rows with a null ``by`` count as the oldest; of rows of the same age, the greatest by its values stays.
    """
    from pyspark.sql import functions as F

    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    age = F.struct(F.col(by).isNotNull(), F.col(by), F.to_json(row))
    return df.groupBy(*keys).agg(F.max_by(row, age).alias("_row")).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])
