"""Results out: JSON rows, thinned payloads and a history table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_KEPT = 20


def to_json(df: DataFrame) -> DataFrame:
    """One JSON document a row; NaN and infinities, which JSON lacks, become null."""
    bad = {c: F.when(~(F.isnan(c) | F.abs(c).isin(float("inf"))), F.col(c)) for c, k in df.dtypes if k in ("double", "float")}
    return (df.withColumns(bad) if bad else df).select(F.to_json(F.struct("*")).alias("json"))


def thin(df: DataFrame, rows: int = 50) -> DataFrame:
    """The first rows, as a payload to show."""
    return df.limit(rows)


def save_session(df: DataFrame, path: str) -> None:
    df.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(path)


def recent_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc("saved_at")).limit(HISTORY_KEPT)
