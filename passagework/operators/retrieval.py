"""From hits to pages, documents, context and sources.

Hits should be written (``config.written``) before they are looked up: Spark then knows their size and
broadcasts their keys if they are small, so that the page and document tables are neither shuffled nor
sorted. Beyond that both sides shuffle. Metadata of any length never travels in a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIT_KEY = ["query_id", "rank"]
PAGE_FIELDS = ["page", "title", "language", "source"]
DOC_FIELDS = ["source", "ingest_date", "filename", "media_type", "extension"]


def hits_with_pages(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Each hit with its page's metadata as ``page_metadata``."""
    wanted = pages.select("type", "page_id", F.struct("doc_id", "type", *PAGE_FIELDS).alias("page_metadata"))
    return _look_up(hits, hits, wanted, ["type", "page_id"], "page_metadata")


def hits_with_documents(hits: DataFrame, documents: DataFrame, written_hits: DataFrame | None = None) -> DataFrame:
    """Each hit with its document's metadata as ``doc_metadata``. ``written_hits`` are the hits
    whose keys to look up, where ``hits`` itself is not written."""
    wanted = documents.select("type", "doc_id", F.struct("doc_id", "type", *DOC_FIELDS).alias("doc_metadata"))
    return _look_up(hits, hits if written_hits is None else written_hits, wanted, ["type", "doc_id"], "doc_metadata")


def _look_up(hits: DataFrame, written_hits: DataFrame, wanted: DataFrame, key: list[str], field: str) -> DataFrame:
    keys = written_hits.select(*HIT_KEY, *key)
    found = hits.join(wanted.join(keys, key).select(*HIT_KEY, field), HIT_KEY, "left")
    # a hit without its page or document is damage; it must not read as fewer sources
    lost = F.raise_error(F.concat(F.lit(f"{field} is missing for "), F.concat_ws(" ", *key)))
    kind = found.schema[field].dataType
    return found.withColumn(field, F.when(F.col(field).isNull(), lost.cast(kind)).otherwise(F.col(field)))


def orphan_chunks(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that chunks refer to but that do not exist, with the number of such chunks.

    Aggregated before the anti join: a page with very many chunks is one row by then.
    """
    referred = chunks.groupBy("type", "page_id").agg(F.count("*").alias("chunks"))
    return referred.join(pages.select("type", "page_id"), ["type", "page_id"], "left_anti")


def distinct_hit_pages(hits: DataFrame) -> DataFrame:
    return hits.select("type", "page_id").distinct()


def build_context(hits: DataFrame) -> DataFrame:
    """Per query its hits' texts in rank order, one per line. At most k rows meet per query."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(ranked, lambda h: h["text"]), "\n").alias("context"),
        F.count("*").alias("hits"),
    )


def retrieval_sources(hits: DataFrame) -> DataFrame:
    """Per query context and the list of sources in rank order; pages hit twice are listed twice.

    ``hits`` carries ``page_metadata`` and ``doc_metadata``.
    """
    ranked = F.array_sort(F.collect_list(F.struct("rank", "text", "type", "page_metadata", "doc_metadata")))
    grouped = hits.groupBy("query_id").agg(ranked.alias("r"))
    return grouped.select(
        "query_id",
        F.array_join(F.transform("r", lambda h: h["text"]), "\n").alias("context"),
        F.transform(
            "r",
            lambda h: F.struct(
                h["type"].alias("type"), h["page_metadata"].alias("page_metadata"),
                h["doc_metadata"].alias("doc_metadata"),
            ),
        ).alias("sources"),
    )
