"""Documents, pages, chunks and binaries out of loaded files and web pages.

``parsed`` is the output of ``load_files``: document columns, a ``pages`` array and the bytes.
Each function is narrow: nothing is shuffled between a file and its chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework import schemas
from passagework.config import DEFAULT_MEDIA_TYPE
from passagework.functions.chunking import ChunkPass, chunk_pass
from passagework.functions.embedding import HashingEncoder, packed_vectors

DEFAULT_ENCODER = HashingEncoder()


def documents_of(parsed: DataFrame) -> DataFrame:
    """One row per document, also for those without pages; fields that loaders add come last."""
    known = schemas.DOCUMENTS.names
    return parsed.select(*known, *[c for c in parsed.columns if c not in {*known, "pages", "content", "failed"}])


def pages_of(parsed: DataFrame) -> DataFrame:
    """One row per page with its position; ``content`` travels along for chunking."""
    return parsed.select("doc_id", "type", F.posexplode("pages").alias("page_no", "p")).select(
        F.concat_ws("/", "doc_id", "page_no").alias("page_id"), "doc_id", "type",
        F.col("page_no").cast("bigint").alias("page_no"), "p.*",
    )


def web_pages_of(web: DataFrame) -> DataFrame:
    """Page rows of ``load_web`` in the shape of ``pages_of``."""
    return web.select(
        F.concat_ws("/", "doc_id", "page_no").alias("page_id"), "doc_id", "type", "page_no",
        F.lit(None).cast("bigint").alias("page"), "title", "language", "source", "content",
    )


def chunks_of(pages: DataFrame, encoder=DEFAULT_ENCODER, packed: bool = False) -> DataFrame:
    """Chunks of 200 characters with their vectors, ``packed`` as bytes; chunked and encoded in one Arrow pass."""
    chunks = chunk_pass_of(pages, encoder, packed).rows()
    return chunks.select(*[c for c in schemas.CHUNKS.names if c in chunks.columns])


def chunk_pass_of(pages: DataFrame, encoder=DEFAULT_ENCODER, packed: bool = True) -> ChunkPass:
    """The same before it is run, for a search that goes on where chunks are made."""
    return chunk_pass(pages, "content", keep=["page_id", "doc_id", "type", "page_no"], encoder=encoder,
                      pack=packed_vectors if packed else None)


def binaries_of(parsed: DataFrame) -> DataFrame:
    """Original bytes of documents that have pages."""
    return binaries_of_files(parsed.filter(F.size("pages") > 0))


def binaries_of_files(files: DataFrame) -> DataFrame:
    """Rows of ``files(doc_id, type, media_type, content)`` that hold bytes."""
    return files.filter(F.octet_length("content") > 0).select(
        "doc_id", "type", F.col("content").alias("data"),
        F.coalesce("media_type", F.lit(DEFAULT_MEDIA_TYPE)).alias("media_type"),
    )


def progress_of(pages: DataFrame) -> DataFrame:
    """Per page: how many of its document's pages are done with it, and how many there are.

    Totals are aggregated map-side; adaptive execution splits the join of a document that holds most of the pages.
    """
    totals = pages.groupBy("doc_id").agg(F.count("*").alias("total"))
    return pages.select("doc_id", "page_no").join(totals, "doc_id").select(
        "doc_id", (F.col("page_no") + 1).alias("done"), "total"
    )
