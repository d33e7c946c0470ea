"""Collections: named sets of Parquet tables under one root folder.

    <root>/<name>/<table>/batch=<id>/attempt=<id>/type=<type>/part=<first digits of the document id>/*.parquet
    <root>/<name>/vectors/batch=<id>/attempt=<id>/bucket=<number>/*.parquet
    <root>/<name>/commits/*.parquet        (batch, attempt, number)

Batch and attempt are columns. Every write of a batch is a new attempt; one row in ``commits`` makes all its tables visible
at once, and of several rows of a batch the highest number counts: readers join the tables with it. So writing a batch again
replaces it, which makes retries and streaming replays harmless. Folders of replaced attempts are removed afterwards; a plan
made before a replacement has to be made again.

Deleting documents rewrites the partitions that hold them, found by the first digits of their ids, and no others; reads need
no list of what is gone. Vectors are stored packed (``packed_vectors``) and made arrays where they are read; ``vectors`` is the
search index: packed vectors by hash bucket, written at ingest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework import schemas
from passagework.config import copy_id, spread, with_copies, written
from passagework.functions.embedding import unpacked_column
from passagework.functions.paths import check_batch_name, check_collection_name
from passagework.operators import management as M
from passagework.operators.vector_search import INDEX_BITS, bucketed, search_buckets
from passagework.plans import ingest as I
from passagework.plans import search as S
from passagework.sources import files as files_source
from passagework.sources import paged
from passagework.sources import web as web_source
from passagework.sources.folders import scan_folder

_MARKER = "catalog"
# ids are hashes, so row groups have no useful ranges: lookups of one document skip by Bloom filter
_DOC_ID_FILTERS = {
    "parquet.bloom.filter.enabled#doc_id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}
_COMMITS = "batch string, attempt string, number bigint"
_TIMES = "batch string, time bigint"
_COUNTED = ("documents", "pages", "chunks", "rejected")
_PROGRESS = "stream string, batch_id bigint, " + ", ".join(f"{t} bigint" for t in _COUNTED)
# first hex digits of a document id that name its partition: 16 partitions a type and batch for one digit
PART_DIGITS = 1


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    found = _fs(spark, pattern).globStatus(_path(spark, pattern))
    return [s.getPath().toString() for s in found] if found else []


def _delete(spark: SparkSession, path: str) -> bool:
    return bool(_fs(spark, path).delete(_path(spark, path), True))


def list_collections(spark: SparkSession, root: str) -> DataFrame:
    """(collection, vector_column, dim) of every collection under ``root``."""
    marks = _glob(spark, f"{root}/*/{_MARKER}")
    if not marks:
        return spark.createDataFrame([], "collection string, vector_column string, dim int")
    return spark.read.schema("collection string, vector_column string, dim int").parquet(*marks).filter(
        F.col("vector_column").isNotNull())


class Collection:
    """One named collection. Methods that read return DataFrames; methods that write run jobs."""

    def __init__(
        self, spark: SparkSession, root: str, name: str, encoder=I.DEFAULT_ENCODER,
        document_fields: T.StructType | None = None, page_fields: T.StructType | None = None, bits: int = INDEX_BITS,
        part_digits: int = PART_DIGITS,
    ):
        """``bits`` and ``part_digits`` set the number of index buckets and of partitions by id; like the encoder they stay
        the same for the life of a collection."""
        self.spark, self.root, self.name = spark, root.rstrip("/"), check_collection_name(name)
        self.encoder, self.bits, self.part_digits = encoder, bits, part_digits
        # fields that the collection's loaders add; NULL for rows of other loaders
        self.schemas = {
            **schemas.TABLES,
            "documents": schemas.extend(schemas.DOCUMENTS, document_fields),
            "pages": schemas.extend(schemas.PAGES, page_fields),
        }
        self.path = f"{self.root}/{self.name}"

    # ---- catalog

    def create(self) -> Collection:
        """Create the collection if it is absent."""
        if not self.exists():
            row = [(self.name, "document_vector", self.encoder.dim)]
            df = self.spark.createDataFrame(row, "collection string, vector_column string, dim int")
            df.coalesce(1).write.mode("ignore").parquet(f"{self.path}/{_MARKER}")
            for table, schema in (("commits", _COMMITS), ("times", _TIMES)):
                self.spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{table}")
        return self

    def exists(self) -> bool:
        return _exists(self.spark, f"{self.path}/{_MARKER}")

    def drop(self) -> bool:
        """Remove the collection with all its tables; False if there was none."""
        if not self.exists():
            return False
        return _delete(self.spark, self.path)

    # ---- reading

    def batches(self) -> list[str]:
        """Committed batches."""
        return sorted(r["batch"] for r in self._live().select("batch").collect())

    def table(self, name: str) -> DataFrame:
        """Rows of documents, pages, chunks, vectors, binaries or rejected in committed batches."""
        rows = self._stored(name)
        if name == "chunks":
            rows = rows.withColumn("document_vector", unpacked_column(F.col("document_vector"), self.encoder.dim))
        return rows

    def documents(self) -> DataFrame:
        return self.table("documents")

    def pages(self) -> DataFrame:
        return self.table("pages")

    def chunks(self) -> DataFrame:
        return self.table("chunks")

    def vectors(self) -> DataFrame:
        """Packed vectors of the chunks with their key and bucket; the column ``document_vector`` holds the bytes."""
        return self.table("vectors").withColumnRenamed("packed", "document_vector")

    def binaries(self) -> DataFrame:
        return self.table("binaries")

    def rejected(self) -> DataFrame:
        """(source, reason) of the files that no loader took."""
        return self.table("rejected")

    def rows(self) -> DataFrame:
        """Rows of all tables together."""
        return M.union_rows(self.documents(), self.pages(), self.chunks(), self.binaries())

    def list_documents(self, limit: int | None = None, after: tuple[str, str] | None = None) -> DataFrame:
        """Documents with their counts; ``limit`` of them in (source, id) order, those behind the key ``after``."""
        return M.list_documents(self.documents(), self.pages(), self.chunks(), self.name, limit, after)

    def fetch_binary(self, doc_type: str, doc_id: str) -> DataFrame:
        rows = self._rows("binaries").filter(F.col("part") == doc_id[:self.part_digits])
        return M.fetch_binary(rows, doc_type, doc_id)

    # ---- searching

    def search(self, queries: DataFrame, hashed: bool = False, **options) -> DataFrame:
        """Context and sources of every query that has hits, over the packed vectors of the index.

        Exact, or with ``hashed`` among the buckets that the queries probe (``recall``), reading only their files.
        """
        if hashed:
            def search(vectors, index, **how):
                return search_buckets(vectors, index, bits=self.bits, **how)

            options = {**options, "search": search}
        index = self.table("vectors") if hashed else self.vectors()
        return S.retrieve(queries, index, self.pages(), self.documents(), self.encoder, texts=self.chunks(), **options)

    def prompts(self, queries: DataFrame, templates: DataFrame, on_empty: str = "message", **options) -> DataFrame:
        """Citations and prompt of every query; ``queries`` as for ``rag_prompts``."""
        return S.rag_prompts(queries, self.search(queries, **options), templates, self.name, on_empty)

    # ---- writing

    def ingest_files(
        self, files: DataFrame, loaders: list[files_source.Loader], batch: str, ingest_date: int | Column | None = None
    ) -> dict[str, int]:
        """Load, chunk, encode and store (path, content[, name]) rows as one batch.

        Returns the rows written per table, counted while writing; ``rejected`` are the files no
        loader took. A source that comes twice in a batch is two documents.
        """
        date = files_source.current_millis() if ingest_date is None else ingest_date
        parsed = files_source.load_files(files, loaders, self.name, date)

        def tables(staged: DataFrame) -> dict[str, DataFrame]:
            kept = with_copies(files_source.loaded(staged), "doc_id")
            kept = kept.withColumn("doc_id", copy_id(F.col("doc_id"), F.col("copy"))).drop("copy")
            pages = I.pages_of(spread(kept, "doc_id"))
            return {"chunks": I.chunks_of(pages, self.encoder, packed=True), "pages": pages, "binaries": I.binaries_of(kept),
                    "documents": I.documents_of(kept), "rejected": files_source.rejected(staged)}

        return self._ingest(batch, parsed, tables)

    def ingest_folder(self, folder: str, loaders: list[files_source.Loader], batch: str,
                      ingest_date: int | None = None) -> dict[str, int]:
        """Ingest every file directly inside a folder, empty and hidden ones too (``scan_folder``)."""
        return self.ingest_files(scan_folder(self.spark, folder), loaders, batch, ingest_date)

    def ingest_paged(self, files: DataFrame, readers: list[paged.PageReader], batch: str,
                     ingest_date: int | Column | None = None) -> dict[str, int]:
        """Like ``ingest_files``, with readers that yield page by page; ``files`` holds a path once."""
        date = files_source.current_millis() if ingest_date is None else ingest_date
        scanned = paged.scan_pages(files, readers, self.name, date)

        def tables(staged: DataFrame) -> dict[str, DataFrame]:
            pages, documents = paged.pages_of_scan(staged), paged.documents_of_pages(staged)
            refused = staged.filter(F.col("type").isNull())
            with_pages = documents.join(pages.select("doc_id").distinct(), "doc_id", "left_semi")
            stored = with_pages.select("doc_id", "type", "media_type", F.col("source").alias("path")).join(files, "path")
            return {"chunks": I.chunks_of(pages, self.encoder, packed=True), "pages": pages, "documents": documents,
                    "binaries": I.binaries_of_files(stored), "rejected": refused.select("source", files_source.reason_of("failed"))}

        return self._ingest(batch, scanned, tables)

    def ingest_web(
        self, stored: DataFrame, batch: str, roots: DataFrame | None = None,
        max_depth: int | None = None, ingest_date: int | None = None,
    ) -> dict[str, int]:
        """Ingest stored pages (url, html). With ``roots(url)`` a document is a root URL and all
        pages reached from it, none if the root is not stored, and ``stored`` holds a URL once; without,
        every stored page is a document, and a URL that comes twice is two."""
        date = files_source.current_millis() if ingest_date is None else ingest_date
        if roots is None:
            stored = with_copies(stored.select("url", "html"), "url")
            urls, reached = stored.select("url", "copy"), None
        else:
            urls = web_source.url_list(roots).select("url").distinct().withColumn("copy", F.lit(None).cast("string"))
            reached = web_source.crawl(stored, urls.select("url"), max_depth)
        documents = urls.select(*web_source.web_documents(F.col("url"), self.name, date), "copy")
        documents = documents.withColumn("doc_id", copy_id(F.col("doc_id"), F.col("copy"))).drop("copy")

        def tables(staged: DataFrame) -> dict[str, DataFrame]:
            pages = spread(staged, "page_id")
            return {"chunks": I.chunks_of(pages, self.encoder, packed=True), "pages": pages, "documents": documents}

        return self._ingest(batch, I.web_pages_of(web_source.load_web(stored, self.name, date, reached)), tables)

    def batch_time(self, batch: str) -> int:
        """Ingest time of a batch, chosen when it is first asked for and kept for all retries."""
        self.create()
        times = self.spark.read.schema(_TIMES).parquet(f"{self.path}/times")
        kept = times.filter(F.col("batch") == check_batch_name(batch)).agg(F.min("time")).first()[0]
        if kept is None:
            kept = files_source.current_millis()
            self.spark.createDataFrame([(batch, kept)], _TIMES).coalesce(1).write.mode("append").parquet(f"{self.path}/times")
        return kept

    def log_progress(self, stream: str, batch_id: int, counts: dict[str, int]) -> None:
        """Keep what a micro-batch wrote, as observed while writing."""
        row = [(stream, batch_id, *(counts.get(t, 0) for t in _COUNTED))]
        self.spark.createDataFrame(row, _PROGRESS).coalesce(1).write.mode("append").parquet(f"{self.path}/progress")

    def progress(self) -> DataFrame:
        """(stream, batch_id, documents, pages, chunks, rejected) of every micro-batch; one that was replayed counts once."""
        if not _exists(self.spark, f"{self.path}/progress"):
            return self.spark.createDataFrame([], _PROGRESS)
        rows = self.spark.read.schema(_PROGRESS).parquet(f"{self.path}/progress")
        return rows.groupBy("stream", "batch_id").agg(*[F.max(c).alias(c) for c in _COUNTED])

    def delete_documents(self, keys: DataFrame) -> DataFrame:
        """Delete the documents in ``keys(type, doc_id)``; returns how many rows went with each.

        Only partitions that hold such rows are written again, by dynamic partition overwrite; files of the others stay as
        they are. The documents themselves go last, so a delete that was interrupted can be run again with the same keys.
        A batch that is ingested again brings its documents back.
        """
        removed = written(M.removed_counts(keys, self.documents(), self.pages(), self.chunks(), self.binaries()))
        gone = removed.select(*M.DOC_KEY)
        parts = [r[0] for r in gone.select(self._part()).distinct().collect()]
        for table in ("vectors", "chunks", "pages", "binaries", "documents"):
            self._delete_rows(table, gone, parts)
        return removed

    def copy_to(self, name: str, batch: str = "copy") -> Collection:
        """Write the live rows into another collection as one batch."""
        other = Collection(self.spark, self.root, name, self.encoder, bits=self.bits, part_digits=self.part_digits)
        other.schemas = self.schemas
        other._store(check_batch_name(batch), uuid.uuid4().hex, {t: self._stored(t) for t in self.schemas})
        return other

    # ---- parts

    def _part(self, doc_id: str = "doc_id") -> Column:
        return F.substring(doc_id, 1, self.part_digits).alias("part")

    def _layout(self, table: str) -> list[str]:
        """Partition columns below the attempt."""
        if table == "vectors":
            return ["bucket"]
        return ["type", "part"] if "type" in self.schemas[table].names else []

    def _live(self) -> DataFrame:
        """(batch, attempt) that count."""
        self.create()
        commits = self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits")
        # the condition lets Spark prune the folders of other attempts
        return commits.filter("number >= 0").groupBy("batch").agg(F.max_by("attempt", "number").alias("attempt"))

    def _stored(self, name: str) -> DataFrame:
        """Live rows of a table as they are stored."""
        return self._rows(name).select(*self.schemas[name].names)

    def _rows(self, name: str) -> DataFrame:
        """Live rows of a table with the columns of its partitions."""
        schema, base = self.schemas[name], f"{self.path}/{name}"
        further = [c for c in ("batch", "attempt", *self._layout(name)) if c not in schema.names]
        full = T.StructType([*schema.fields, *[T.StructField(c, T.StringType()) for c in further]])
        if not _exists(self.spark, base):
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).parquet(base)
        return rows.join(F.broadcast(self._live()), ["batch", "attempt"], "left_semi")

    def _delete_rows(self, table: str, gone: DataFrame, parts: list[str]) -> None:
        """Write the partitions of ``table`` again that hold rows of ``gone``, and drop those left without rows."""
        place = ["batch", "attempt", *self._layout(table)]
        rows = self._rows(table)
        if "part" in place:
            rows = rows.filter(F.col("part").isin(parts))
        counts = (
            rows.select(*dict.fromkeys([*place, *M.DOC_KEY]))
            .join(gone.withColumn("gone", F.lit(1)), M.DOC_KEY, "left")
            .groupBy(*place).agg(F.count("*").alias("rows"), F.count("gone").alias("gone")).filter("gone > 0"))
        counts = written(counts)
        kept = rows.join(counts.filter("gone < rows").select(*place), place, "left_semi").join(gone, M.DOC_KEY, "left_anti")
        columns = list(dict.fromkeys([*self.schemas[table].names, *place]))
        (kept.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**_DOC_ID_FILTERS)
         .partitionBy(*place).parquet(f"{self.path}/{table}"))
        for r in counts.filter("gone = rows").collect():
            folder = "/".join(f"{c}={r[c]}" for c in place)
            _delete(self.spark, f"{self.path}/{table}/{folder}")

    def _ingest(self, batch: str, parsed: DataFrame, tables) -> dict[str, int]:
        """Write ``parsed`` once, derive the tables from that with column pruning and commit them."""
        attempt = uuid.uuid4().hex
        staging = f"{self.path}/_staging/{check_batch_name(batch)}-{attempt}"
        try:
            parsed.write.parquet(staging)
            return self._store(batch, attempt, tables(self.spark.read.schema(parsed.schema).parquet(staging)))
        finally:
            _delete(self.spark, staging)

    def _store(self, batch: str, attempt: str, tables: dict[str, DataFrame]) -> dict[str, int]:
        """Write all tables of a batch, commit them with one row, then remove replaced attempts."""
        self.create()
        counts = {name: self._save(tables[name], name, batch, attempt) for name in self.schemas if name in tables}
        if "vectors" not in tables and "chunks" in tables:
            chunks = self.spark.read.schema(self.schemas["chunks"]).parquet(f"{self.path}/chunks/batch={batch}/attempt={attempt}")
            self._save(self._index_of(chunks), "vectors", batch, attempt)
        commits = self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits").filter(F.col("batch") == batch)
        before = commits.select("attempt", "number").collect()
        number = max((r["number"] for r in before), default=-1) + 1
        self.spark.createDataFrame([(batch, attempt, number)], _COMMITS).coalesce(1).write.mode("append").parquet(
            f"{self.path}/commits")
        for old in before:
            for table in self.schemas:
                _delete(self.spark, f"{self.path}/{table}/batch={batch}/attempt={old['attempt']}")
        return {name: counts.get(name, 0) for name in self.schemas if name != "vectors"}

    def _index_of(self, chunks: DataFrame) -> DataFrame:
        held = chunks.filter(F.col("document_vector").isNotNull())
        return bucketed(held, schemas.CHUNK_KEY, "document_vector", self.encoder.dim, self.bits)

    def _save(self, rows: DataFrame, table: str, batch: str, attempt: str) -> int:
        seen = Observation()
        fields, layout = self.schemas[table], self._layout(table)
        rows = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in fields if f.name not in rows.columns})
        out = rows.select(*fields.names).observe(seen, F.count(F.lit(1)).alias("rows"))
        if "part" in layout:
            out = out.withColumn("part", self._part())
        if layout:
            # one shuffle puts the rows of a partition together; adaptive execution splits the large ones
            out = out.hint("rebalance", *layout)
        writer = out.write.options(**_DOC_ID_FILTERS) if layout else out.write
        (writer.partitionBy(*layout) if layout else writer).parquet(f"{self.path}/{table}/batch={batch}/attempt={attempt}")
        return seen.get.get("rows", 0)
