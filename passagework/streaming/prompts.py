"""Answering a stream of user inputs over a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from passagework.plans import search as S
from passagework.plans.collection import Collection


def start_prompts(
    requests: DataFrame,
    collection: Collection,
    templates: DataFrame,
    out: str,
    checkpoint: str,
    *,
    make_client=None,
    processing_time: str | None = None,
    **search_options,
) -> StreamingQuery:
    """Per micro-batch: search, cite and build the prompts of all new requests, and with
    ``make_client`` generate responses; results go to ``out/batch=<id>``.

    ``requests`` is a stream of query_id, user_input, task, persona, enhancers, source_file. The
    top k of a query is final within its batch, since the chunks are a static table. A replayed
    batch overwrites its own folder.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            result = collection.prompts(batch, templates, **search_options)
            if make_client is not None:
                result = S.answers(result, make_client)
            result.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        finally:
            batch.unpersist()

    trigger = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    return (
        requests.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
