"""Training rows of the anomaly model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packetrisk.functions.features import FEATURES, raw_features


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """A header CSV with the four feature columns; missing columns are an error."""
    return checked(spark.read.option("header", True).csv(path))


def checked(df: DataFrame) -> DataFrame:
    missing = [c for c in FEATURES if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def clean_training(df: DataFrame, *keep: str) -> DataFrame:
    """Numbers or 0; no rows at all is an error."""
    out = checked(df).select(*keep, *raw_features())
    if out.isEmpty():
        raise ValueError("no training rows")
    return out
