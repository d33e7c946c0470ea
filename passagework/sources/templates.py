"""Prompt templates: one file per template, ``key = value`` or a triple-quoted block."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.paths import base_name, local_path


def template_value(text: Column, key: str) -> Column:
    """Value of ``key``: the text up to a comment or line end, or all between triple quotes; NULL if absent."""
    head = rf"(?m)^[ \t]*{key}[ \t]*=[ \t]*"
    block = F.regexp_extract(text, head + r"(?s)('''|\"\"\")(.*?)\1", 2)
    line = F.regexp_extract(text, head + r"([^\r\n]*?)[ \t]*(?:#[^\r\n]*)?\r?$", 1)
    return F.when(text.rlike(head + r"('''|\"\"\")"), block).when(text.rlike(head), line)


def scan_templates(spark: SparkSession, folders: dict[str, str], suffix: str) -> DataFrame:
    """(kind, name, greeting, prompt) of every file with ``suffix`` in each kind's folder."""

    def one(kind: str, folder: str) -> DataFrame:
        files = (
            spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
            .select(base_name(F.col("_metadata.file_path")).alias("file"), "value")
        )
        return files.select(
            F.lit(kind).alias("kind"), F.replace("file", F.lit(suffix), F.lit("")).alias("name"),
            template_value(F.col("value"), "greeting").alias("greeting"),
            template_value(F.col("value"), "prompt").alias("prompt"),
        )

    return reduce(DataFrame.unionByName, [one(k, f) for k, f in folders.items()])


def attach_source_files(queries: DataFrame, files: DataFrame, path_col: str = "source_file_path") -> DataFrame:
    """Add the text of the file each input names as ``source_file``, NULL where it names none.

    ``files`` has path and value (``scan_source_files``). A named file that does not exist fails.
    """
    known = files.select(F.col("path").alias(path_col), F.col("value").alias("__text"))
    missing = F.col(path_col).isNotNull() & F.col("__text").isNull()
    message = F.concat(F.lit("The file "), F.col(path_col), F.lit(" does not exist!"))
    text = F.when(missing, F.raise_error(message).cast("string")).otherwise(F.col("__text"))
    return queries.join(known, path_col, "left").withColumn("source_file", text).drop("__text")


def scan_source_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, value) of whole text files."""
    return spark.read.text(list(paths), wholetext=True).select(
        local_path(F.col("_metadata.file_path")).alias("path"), "value"
    )
