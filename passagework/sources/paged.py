"""Files whose readers yield page by page: a page is a row from the start, so a book is never an array in one row.

A reader is a predicate on path and bytes and a function from bytes to an iterator of pages. Readers are tried in order; one
that raises, be it on the last page, lets the next one try. Its pages are therefore drawn twice, once to see that it gets
through and once to emit them, and held one batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework import schemas
from passagework.config import PAGE_OVERLAP, PAGE_SIZE, stable_id
from passagework.functions.chunking import iter_text
from passagework.functions.paths import base_name, extension

ROWS_PER_BATCH = 256
_CHARS_PER_BATCH = 4 << 20


@dataclass(frozen=True)
class PageReader:
    type: str
    can_read: Callable[[str, bytes], bool]
    read_pages: Callable[[bytes], Iterable[str | dict]]  # texts, or dicts of content and further page fields
    media_type: str | None = None
    suffix_kept: bool = False  # whether documents show the extension of their file
    page_fields: T.StructType = field(default_factory=T.StructType)
    split: bool = True  # long pages in parts, which keep the page's number


def text_reader() -> PageReader:
    """The whole file as one page, if all its bytes read as text."""

    def can_read(path: str, data: bytes) -> bool:
        try:
            data.decode("utf-8")
        except UnicodeDecodeError:
            return False
        return b"\x00" not in data

    def read(data: bytes) -> Iterator[dict]:
        yield {"page": None, "content": data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")}

    return PageReader("plaintext", can_read, read, suffix_kept=True, split=False)


def _pages(reader: PageReader, data: bytes, size: int, overlap: int) -> Iterator[dict]:
    for n, page in enumerate(reader.read_pages(data), 1):
        page = page if isinstance(page, dict) else {"content": page}
        page = {"page": n, **page}
        for part in iter_text(page["content"], size, overlap) if reader.split else [page["content"]]:
            yield {**page, "content": part}


def read_batches(files: Iterable[tuple[str, bytes]], readers: list[PageReader], names: list[str], size: int, overlap: int,
                 rows_per_batch: int = ROWS_PER_BATCH) -> Iterator[list[dict]]:
    """Rows of the pages of all files, at most ``rows_per_batch`` at a time."""
    blank, rows, chars = dict.fromkeys(names), [], 0
    for path, data in files:
        data, failed, chosen = bytes(data or b""), [], None
        for reader in readers:
            if not reader.can_read(path, data):
                continue
            try:
                for _ in reader.read_pages(data):
                    pass
            except Exception as e:
                failed.append(f"{reader.type}: {type(e).__name__}: {e}")
                continue
            chosen = reader
            break
        known = {**blank, "source": path, "failed": "; ".join(failed)}
        if chosen is None:
            rows.append(known)
            continue
        known |= {"type": chosen.type, "media_type": chosen.media_type}
        at = -1
        for at, page in enumerate(_pages(chosen, data, size, overlap)):
            rows.append({**known, **page, "page_no": at})
            chars += len(page["content"])
            if len(rows) >= rows_per_batch or chars >= _CHARS_PER_BATCH:
                yield rows
                rows, chars = [], 0
        if at < 0:
            rows.append(known)
        if len(rows) >= rows_per_batch:
            yield rows
            rows, chars = [], 0
    if rows:
        yield rows


def scan_pages(files: DataFrame, readers: list[PageReader], collection: str, ingest_date: Column | int, *,
               size: int = PAGE_SIZE, overlap: int = PAGE_OVERLAP, rows_per_batch: int = ROWS_PER_BATCH) -> DataFrame:
    """A row per page of ``files(path, content)``, with the columns of its document, ``page_no`` from 0 and ``failed``, what
    the readers said that raised. A file without pages, or that no reader took (``type`` NULL), is one row without
    ``page_no``. Nothing is shuffled."""
    extra = T.StructType(list({f.name: f for r in readers for f in r.page_fields}.values()))
    page_type = schemas.extend(schemas.PAGE, extra)
    own = [T.StructField(n, T.StringType()) for n in ("source", "type", "media_type", "failed")]
    fields = [*own, T.StructField("page_no", T.LongType()),
              *[T.StructField("page_source" if f.name == "source" else f.name, f.dataType) for f in page_type.fields]]
    schema = T.StructType(fields)
    kinds = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in fields])
    shown = {r.type for r in readers if r.suffix_kept}

    def run(batches):
        def one_by_one():
            for batch in batches:
                for path, content in zip(batch.column(0), batch.column(1)):
                    yield path.as_py(), content.as_py()

        for rows in read_batches(one_by_one(), readers, kinds.names, size, overlap, rows_per_batch):
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in kinds.names} for r in rows], schema=kinds)

    date = F.lit(ingest_date) if isinstance(ingest_date, int) else ingest_date
    rows = files.select("path", "content").mapInArrow(run, schema).withColumns({
        "ingest_date": date.cast("bigint"), "filename": base_name(F.col("source")),
        "extension": F.when(F.col("type").isin(*shown), extension(F.col("source")))})
    return rows.withColumn("doc_id", F.when(F.col("type").isNotNull(), stable_id(F.lit(collection), "type", "source", "ingest_date")))


def documents_of_pages(scanned: DataFrame) -> DataFrame:
    """The documents of ``scan_pages``, those without pages too; each has one row without or with the first ``page_no``."""
    first = F.col("page_no").isNull() | (F.col("page_no") == 0)
    return scanned.filter(F.col("type").isNotNull() & first).select(*schemas.DOCUMENTS.names)


def pages_of_scan(scanned: DataFrame) -> DataFrame:
    """Page rows as ``plans.ingest.pages_of`` gives them."""
    known = {"source", "type", "media_type", "failed", "ingest_date", "filename", "extension", "doc_id", "page_no", "page_source"}
    rest = [F.col("page_source").alias("source") if c == "page_source" else F.col(c) for c in scanned.columns
            if c not in known or c == "page_source"]
    return scanned.filter(F.col("page_no").isNotNull()).select(
        F.concat_ws("/", "doc_id", "page_no").alias("page_id"), "doc_id", "type", "page_no", *rest)
