"""Listing, counting, fetching and deleting over a collection's tables.

All functions take and return DataFrames. Counts are aggregated map-side before they are joined,
so a document with very many pages or chunks costs one partial row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.config import written

DOC_KEY = ["type", "doc_id"]


def of_document(doc_type: Column | str, doc_id: Column | str) -> Column:
    """Rows of one document: a pair of equalities that reaches the scan."""
    return (F.col("doc_id") == doc_id) & (F.col("type") == doc_type)


def with_field(rows: DataFrame, field: str) -> DataFrame:
    return rows.filter(F.col(field).isNotNull())


def without_field(rows: DataFrame, field: str) -> DataFrame:
    return rows.filter(F.col(field).isNull())


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy(*DOC_KEY).agg(F.count("*").alias("page_count"))


def vector_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(*DOC_KEY).agg(F.count("*").alias("vector_count"))


def list_documents(
    documents: DataFrame, pages: DataFrame, chunks: DataFrame, collection: str, limit: int | None = None,
    after: tuple[str, str] | None = None,
) -> DataFrame:
    """Documents with their page and vector counts.

    ``limit`` gives one page of the listing in (source, id) order, and ``after``, the source and id of the last document
    seen, the page behind that. The counts of the others are not computed.
    """
    if after is not None:
        source, doc_id = map(F.lit, after)
        documents = documents.filter((F.col("source") > source) | ((F.col("source") == source) & (F.col("doc_id") > doc_id)))
    if limit is not None:
        documents = documents.orderBy("source", "doc_id").limit(limit)
        chosen = documents = written(documents)
        pages, chunks = (t.join(chosen.select(*DOC_KEY), DOC_KEY, "left_semi") for t in (pages, chunks))
    none = F.lit(0).cast("bigint")
    return (
        documents.withColumn("index", F.concat_ws(".", F.lit(collection), "type"))
        .join(page_counts(pages), DOC_KEY, "left")
        .join(vector_counts(chunks), DOC_KEY, "left")
        .withColumns({
            "page_count": F.coalesce("page_count", none),
            "vector_count": F.coalesce("vector_count", none),
        })
    )


def collection_sizes(documents: DataFrame, collection_col: str) -> DataFrame:
    return documents.groupBy(collection_col).agg(F.count("*").alias("documents"))


def union_rows(*tables: DataFrame) -> DataFrame:
    """All rows of differently shaped tables; fields a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def fetch_binaries(binaries: DataFrame, keys: DataFrame) -> DataFrame:
    """Bytes and media type of the documents in ``keys``, as lower-case hex for export."""
    return binaries.join(written(keys.select(*DOC_KEY).distinct()), DOC_KEY, "left_semi").select(
        *DOC_KEY, F.lower(F.hex("data")).alias("data_hex"), "media_type"
    )


def fetch_binary(binaries: DataFrame, doc_type: str, doc_id: str) -> DataFrame:
    """First stored file of one document."""
    return binaries.filter(of_document(F.lit(doc_type), F.lit(doc_id))).select("data", "media_type").limit(1)


def without_documents(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows that do not belong to the documents in ``keys``."""
    return rows.join(written(keys.select(*DOC_KEY).distinct()), DOC_KEY, "left_anti")


def removed_counts(
    keys: DataFrame, documents: DataFrame, pages: DataFrame, chunks: DataFrame, binaries: DataFrame
) -> DataFrame:
    """Per existing document in ``keys``: its rows in every table, itself included."""
    keys = written(keys.select(*DOC_KEY).distinct())
    found = documents.select(*DOC_KEY).join(keys, DOC_KEY, "left_semi").withColumn("own", F.lit(1))
    parts = [t.select(*DOC_KEY).join(keys, DOC_KEY, "left_semi") for t in (pages, chunks, binaries)]
    return (
        reduce(DataFrame.unionByName, [p.withColumn("own", F.lit(0)) for p in parts], found)
        .groupBy(*DOC_KEY).agg(F.count("*").alias("removed"), F.max("own").alias("own"))
        .filter(F.col("own") == 1).drop("own")
    )
