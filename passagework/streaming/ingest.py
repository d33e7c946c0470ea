"""Incremental ingest of a folder: each new file once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagework.functions.paths import local_path
from passagework.plans.collection import Collection
from passagework.sources.files import Loader

FILES_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(FILES_SCHEMA)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder).select(local_path(F.col("path")).alias("path"), "content")


def start_ingest(
    files: DataFrame,
    collection: Collection,
    loaders: list[Loader],
    checkpoint: str,
    *,
    stream_name: str = "files",
    ingest_date: int | None = None,
    processing_time: str | None = None,
    on_batch: Callable[[str, dict[str, int]], None] | None = None,
) -> StreamingQuery:
    """Ingest what is new in a stream of (path, content) and stop, or keep polling with
    ``processing_time``.

    The checkpoint remembers the files taken. A batch replayed after a failure replaces itself and
    keeps the time of its first attempt, so nothing is stored twice and ids stay. ``on_batch`` receives the rows written per table.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        name = f"{stream_name}-{batch_id}"
        counts = collection.ingest_files(batch, loaders, name, collection.batch_time(name) if ingest_date is None else ingest_date)
        collection.log_progress(stream_name, batch_id, counts)
        if on_batch is not None:
            on_batch(name, counts)

    trigger = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    return (
        files.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def progress(query: StreamingQuery) -> dict[str, int]:
    """Batches finished and rows read, over the progress reports that Spark retains."""
    seen = query.recentProgress
    return {
        "batches": len({p["batchId"] for p in seen if p["numInputRows"]}),
        "rows": sum(p["numInputRows"] for p in seen),
    }
