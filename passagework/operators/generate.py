"""Batch text generation through a user-given client, at once or so that it can be resumed."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.config import written

# fixed values
OK_STATUS = 200
STATUS_TEXT = "ollama status: {status}"

# status of a call whose client raised
CLIENT_ERROR = 599


def generate(
    prompts: DataFrame,
    make_client: Callable[[], Callable[[str], tuple[int, str]]],
    prompt_col: str = "prompt",
    concurrency: int = 4,
    rows_per_call: int = 256,
) -> DataFrame:
    """Append ``status`` and ``response``. ``make_client`` runs once per task and returns a
    callable ``prompt -> (status, text)``; at most ``concurrency`` calls run at once per task.
    A NULL prompt gets no call; a client that raises gives a row of status ``CLIENT_ERROR``."""
    schema = T.StructType([
        *prompts.schema.fields,
        T.StructField("status", T.IntegerType()), T.StructField("response", T.StringType()),
    ])

    def run(batches):
        client = make_client()

        def call(prompt):
            if prompt is None:
                return None, None
            try:
                status, text = client(prompt)
            except Exception as e:
                return CLIENT_ERROR, f"{STATUS_TEXT.format(status=CLIENT_ERROR)}: {type(e).__name__}: {e}"
            return status, text if status == OK_STATUS else STATUS_TEXT.format(status=status)

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, rows_per_call):
                    part = batch.slice(at, rows_per_call)
                    done = list(pool.map(call, part.column(prompt_col).to_pylist()))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array([s for s, _ in done], pa.int32()),
                         pa.array([r for _, r in done], pa.string())],
                        names=schema.names,
                    )

    return prompts.mapInArrow(run, schema)


def generate_once(
    prompts: DataFrame,
    make_client: Callable[[], Callable[[str], tuple[int, str]]],
    store: str,
    prompt_col: str = "prompt",
    concurrency: int = 4,
    calls_per_commit: int = 10_000,
) -> DataFrame:
    """Like ``generate``, with answers kept in the Parquet folder ``store`` by the hash of their prompt.

    A prompt with a kept answer, from this job or an earlier one, gets no call, and equal prompts get one. Answers are
    committed after every ``calls_per_commit`` calls or so, so a job that fails and runs again pays for at most that many
    twice. Only good answers are kept: a call that failed is made again by the next job.
    """
    spark = prompts.sparkSession
    kept = "_hash string, status int, response string"
    spark.createDataFrame([], kept).coalesce(1).write.mode("append").parquet(store)
    hashed = prompts.withColumn("_hash", F.sha2(prompt_col, 256))
    known = spark.read.schema(kept).parquet(store).select("_hash").distinct()
    open_ = hashed.filter(F.col(prompt_col).isNotNull()).select("_hash", F.col(prompt_col).alias("_prompt"))
    open_ = written(open_.dropDuplicates(["_hash"]).join(known, "_hash", "left_anti"))
    groups, failed = max(1, -(-open_.count() // calls_per_commit)), []
    for i in range(groups):
        some = open_.filter(F.pmod(F.xxhash64("_hash"), F.lit(groups)) == i)
        done = written(generate(some, make_client, "_prompt", concurrency).drop("_prompt"))
        done.filter(F.col("status") == OK_STATUS).write.mode("append").parquet(store)
        failed.append(done.filter(F.col("status") != OK_STATUS))
    answers = spark.read.schema(kept).parquet(store).dropDuplicates(["_hash"])
    for rows in failed:
        answers = answers.unionByName(rows)
    return hashed.join(answers, "_hash", "left").drop("_hash")
