"""Sinks. Executors write; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V

KEEP_SPACES = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}


def save(df: DataFrame, path: str, fmt: str, mode: str = "overwrite") -> None:
    """csv, json or parquet."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.options(**KEEP_SPACES).csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported output format: {fmt}")


def disposition(floor: float = V.ROUTE_SCORE) -> Column:
    """Output folder of a record: valid ones split by score, the rest are bad."""
    return F.when(~F.col("is_valid"), "bad").when(F.col("quality_score") >= floor, "high_quality").otherwise("good")


def save_split(results: DataFrame, path: str, floor: float = V.ROUTE_SCORE, mode: str = "overwrite") -> None:
    """All outputs of a run in one pass: one folder per disposition.

    Good data is ``good`` and ``high_quality`` together; a reader prunes the folders it does not need.
    """
    results.withColumn("disposition", disposition(floor)).write.mode(mode).partitionBy("disposition").parquet(path)


def read_good(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("disposition") != "bad")


def read_bad(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("disposition") == "bad")


def read_high_quality(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("disposition") == "high_quality")


def append_fact(fact: DataFrame, path: str, partition: str) -> None:
    """Add facts to a table by job or day, whose partitions are replaced: a load that runs again leaves no second copy.

    ``rebalance`` keeps few files per partition value and splits a large one.
    """
    fact.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_jdbc(fact: DataFrame, url: str, table: str, batch: int = 5000, **properties: str) -> None:
    """Append to a database table in batches; needs a driver on the cluster."""
    fact.write.mode("append").option("batchsize", batch).jdbc(url, table, properties=properties)
