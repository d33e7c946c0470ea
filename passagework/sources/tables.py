"""Scans of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.config import spread


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_for_compute(spark: SparkSession, folder: str, name: str, columns: list[str]) -> DataFrame:
    """Pruned scan that fills the cores; only a table too small to split is rebalanced, by its
    first column."""
    return spread(read_table(spark, folder, name).select(*columns), columns[0])
