"""Row shapes of a collection's tables. Every document type shares them; fields a type lacks are NULL."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()


def extend(schema: T.StructType, fields: T.StructType | None) -> T.StructType:
    """``schema`` with the further fields that loaders declare."""
    return T.StructType([*schema.fields, *(f for f in fields or [] if f.name not in schema.names)])


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


# a page before it has keys, as loaders produce it
PAGE = _struct(page=_L, title=_S, language=_S, source=_S, content=_S)

DOCUMENTS = _struct(doc_id=_S, type=_S, source=_S, ingest_date=_L, filename=_S, media_type=_S, extension=_S)
PAGES = _struct(page_id=_S, doc_id=_S, type=_S, page_no=_L, page=_L, title=_S, language=_S, source=_S)
CHUNKS = _struct(
    page_id=_S, doc_id=_S, type=_S, page_no=_L, chunk_no=_L, text=_S, document_vector=T.ArrayType(T.FloatType(), True)
)
BINARIES = _struct(doc_id=_S, type=_S, data=T.BinaryType(), media_type=_S)
REJECTED = _struct(source=_S, reason=_S)
# the search index: vectors as little-endian 32-bit floats, by hash bucket
VECTORS = _struct(type=_S, doc_id=_S, page_no=_L, chunk_no=_L, bucket=T.IntegerType(), packed=T.BinaryType())

# chunks as they are stored: an array of mostly zeros would be ten times the text
STORED_CHUNKS = T.StructType([
    T.StructField(f.name, T.BinaryType()) if f.name == "document_vector" else f for f in CHUNKS.fields])

TABLES = {"chunks": STORED_CHUNKS, "vectors": VECTORS, "pages": PAGES, "binaries": BINARIES, "documents": DOCUMENTS,
          "rejected": REJECTED}

# what identifies a chunk, and breaks ties between equal scores
CHUNK_KEY = ["type", "doc_id", "page_no", "chunk_no"]
