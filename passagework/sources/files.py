"""File scan and loader dispatch.

A loader is a predicate plus an extractor that turns (path, bytes) into an array of pages, NULL
where it fails. Loaders are tried in order: the first whose predicate holds and whose extractor
succeeds wins, so a failing loader falls through to the next. Files no loader takes are kept
aside in ``rejected``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework import schemas
from passagework.config import PAGE_OVERLAP, PAGE_SIZE, stable_id, written
from passagework.functions.chunking import split_text
from passagework.functions.paths import base_name, extension, local_path


@dataclass(frozen=True)
class Loader:
    type: str
    can_load: Callable[[Column, Column], Column]  # (path, content) -> boolean
    extract: Callable[[Column, Column], Column]  # (path, content or NULL) -> array of pages or NULL
    media_type: str | None = None
    extra: dict[str, Callable[[Column], Column]] = field(default_factory=dict)  # string document column -> of path
    page_fields: T.StructType = field(default_factory=T.StructType)  # of a page, besides the usual ones


def is_text_content(content: Column) -> Column:
    """Bytes that read as text: UTF-8 throughout and no NUL anywhere."""
    return F.is_valid_utf8(content.cast("string")) & ~F.contains(content, F.lit(b"\x00"))


def decode_text(content: Column) -> Column:
    """Valid UTF-8 bytes as text, every kind of line end read as a newline."""
    return F.replace(F.replace(content.cast("string"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def page_struct(content: Column, **known: Column) -> Column:
    return F.struct(*[
        (content if f.name == "content" else known.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
        for f in schemas.PAGE.fields
    ])


def text_loader() -> Loader:
    """The whole file as one page. The predicate checks all bytes, so decoding cannot fail."""

    def extract(path: Column, content: Column) -> Column:
        return F.when(content.isNotNull(), F.array(page_struct(decode_text(content))))

    return Loader("plaintext", lambda path, content: is_text_content(content), extract,
                  extra={"extension": extension})


def paged_loader(
    doc_type: str,
    suffix: str,
    media_type: str,
    read_pages: Callable[[bytes], list[str] | list[dict]],
    page_fields: T.StructType | None = None,
    size: int = PAGE_SIZE,
    overlap: int = PAGE_OVERLAP,
) -> Loader:
    """Files that a user-given decoder turns into page texts, or into dicts of ``content`` and
    further ``page_fields``. Long pages are split into several rows that keep the 1-based page
    number; a decoder that raises lets the next loader try."""
    page_type = schemas.extend(schemas.PAGE, page_fields)
    blank = dict.fromkeys(page_type.names)

    @F.pandas_udf(T.ArrayType(page_type))
    def extract_pages(content: pd.Series) -> pd.Series:
        def one(data):
            if data is None:
                return None
            try:
                pages = [p if isinstance(p, dict) else {"content": p} for p in read_pages(bytes(data))]
            except Exception:
                return None
            return [
                {**blank, "page": n, **page, "content": part}
                for n, page in enumerate(pages, 1)
                for part in split_text(page["content"], size, overlap)
            ]

        return content.map(one, na_action=None)

    return Loader(doc_type, lambda path, content: path.endswith(suffix),
                  lambda path, content: extract_pages(content), media_type,
                  page_fields=page_fields or T.StructType())


def pdf_loader(read_pages: Callable[[bytes], list[str]]) -> Loader:
    return paged_loader("pdf", ".pdf", "application/pdf", read_pages)


def scan_files(spark: SparkSession, *paths: str, include_empty: bool = False) -> DataFrame:
    """(path, content) of the files directly inside each folder, or of the files themselves.

    Spark's file index skips files of zero bytes and names that start with "." or "_"; ``scan_folder``
    has them all. ``include_empty`` lists the folders once more on the driver to add the former.
    """
    files = spark.read.format("binaryFile").load(list(paths)).select(local_path(F.col("path")).alias("path"), "content")
    if not include_empty:
        return files
    hadoop = spark._jsc.hadoopConfiguration()
    found = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    listed = [s for p in found for s in p.getFileSystem(hadoop).listStatus(p)]
    empty = [(s.getPath().toString(), bytearray()) for s in listed
             if s.isFile() and s.getLen() == 0 and s.getPath().getName()[0] not in "._"]
    more = spark.createDataFrame(empty, "path string, content binary")
    return files.unionByName(more.withColumn("path", local_path(F.col("path"))))


def with_display_names(files: DataFrame, names: DataFrame) -> DataFrame:
    """Attach the name shown to users where an uploaded file has another one; ``names(path, name)``."""
    return files.join(written(names.select("path", "name")), "path", "left")


def _common_pages(pages: Column, loader: Loader, fields: T.StructType) -> Column:
    """A loader's pages with the fields of all loaders, so that they fit one column."""
    if set(loader.page_fields.names) >= set(fields.names):
        return pages
    own = {*schemas.PAGE.names, *loader.page_fields.names}
    return F.transform(pages, lambda p: F.struct(*[
        (p[f.name] if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.extend(schemas.PAGE, fields)
    ]))


def load_files(files: DataFrame, loaders: list[Loader], collection: str, ingest_date: Column | int) -> DataFrame:
    """Documents with their pages: one row per file, ``type`` NULL where no loader succeeded.

    ``files`` has path, content and optionally name.
    """
    path, content = F.col("path"), F.col("content")
    date = F.lit(ingest_date) if isinstance(ingest_date, int) else ingest_date
    page_fields = T.StructType(list({f.name: f for ld in loaders for f in ld.page_fields}.values()))
    extras = list(dict.fromkeys(["extension", *(name for ld in loaders for name in ld.extra)]))
    # an extractor sees only the bytes its predicate lets through
    tried = files.withColumns({
        f"__pages{i}": _common_pages(
            ld.extract(path, F.when(ld.can_load(path, content), content)), ld, page_fields)
        for i, ld in enumerate(loaders)
    })

    def by_loader(value: Callable[[Loader], Column | None]) -> Column:
        out = None
        for i, ld in enumerate(loaders):
            cond, v = F.col(f"__pages{i}").isNotNull(), value(ld)
            v = F.lit(None).cast("string") if v is None else v
            out = F.when(cond, v) if out is None else out.when(cond, v)
        return out

    shown = F.coalesce(F.col("name"), base_name(path)) if "name" in files.columns else base_name(path)
    parsed = tried.select(
        by_loader(lambda ld: F.lit(ld.type)).alias("type"),
        path.alias("source"),
        date.cast("bigint").alias("ingest_date"),
        shown.alias("filename"),
        by_loader(lambda ld: F.lit(ld.media_type).cast("string")).alias("media_type"),
        *[by_loader(lambda ld, x=x: ld.extra[x](path) if x in ld.extra else None).alias(x) for x in extras],
        F.coalesce(*[F.col(f"__pages{i}") for i in range(len(loaders))]).alias("pages"),
        content,
        F.concat_ws(", ", *[
            F.when(F.col(f"__pages{i}").isNull() & ld.can_load(path, content), ld.type) for i, ld in enumerate(loaders)
        ]).alias("failed"),
    )
    return parsed.withColumn("doc_id", stable_id(F.lit(collection), "type", "source", "ingest_date"))


def loaded(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("type").isNotNull())


def rejected(parsed: DataFrame) -> DataFrame:
    """(source, reason) of the files that no loader took."""
    return parsed.filter(F.col("type").isNull()).select("source", reason_of("failed"))


def reason_of(failed: str) -> Column:
    """Why a file was refused: what could not read it, and what that said if it is known."""
    return F.when(F.col(failed) == "", "no loader takes such a file").otherwise(
        F.concat(F.lit("cannot be read as "), failed)).alias("reason")


def current_millis() -> int:
    """One ingest time per batch, passed as a literal so that retries agree on it."""
    import time

    return round(time.time() * 1000)
