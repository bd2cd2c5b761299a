"""The market tables as the operators take them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.clean import restore_ms


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def restored(df: DataFrame, *columns: str) -> DataFrame:
    """df with the columns' stamps in whole ms."""
    return df.withColumns({c: restore_ms(F.col(c)) for c in columns})
