"""Fixed values of the workload and helpers that read the session."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: results depend on them
CHUNK_SIZE = 200
CHUNK_OVERLAP = 25
PAGE_SIZE = 4000
PAGE_OVERLAP = 200
VECTOR_DIM = 384
REFERENCE_LIMIT = 5
MIN_SCORE = 0.8
DEFAULT_MEDIA_TYPE = "text/plain"
NO_SOURCES_MESSAGE = (
    "No sources were found matching your query. Please refine your request to closer match "
    "the data in the database or ingest more data."
)

# scores are rounded before thresholding and ranking, so that the order of a
# floating point sum never decides a rank
SCORE_DIGITS = 9

# upper bound for anything sent to every executor
MAX_BROADCAST_BYTES = 128 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which the driver and all executors have to share."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.master.startswith("local"):
        path = _local_folder()
    if not path:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


@functools.cache
def _local_folder() -> str:
    """In local mode driver and executors are one process, so a temporary folder is shared; it goes with the process."""
    path = tempfile.mkdtemp(prefix="passagework-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there.

    Cuts the lineage, and gives Spark the true size of the rows: it broadcasts them in a join only if that is small.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, bytes_per_task: int = 32 << 20) -> DataFrame:
    """Rebalance a scan that is too small to fill the cores before CPU-heavy work, by a unique key.

    Large tables already split by row group and are left alone, so nothing is shuffled at scale.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    scan_bytes = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if scan_bytes < cores * bytes_per_task else df


def stable_id(*parts: Column | str) -> Column:
    """128-bit hex id from its parts; the same on every retry, unlike ``uuid()``."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.substring(F.sha2(F.concat_ws("\u0001", *[c.cast("string") for c in cols]), 256), 1, 32)


def with_copies(rows: DataFrame, key: str) -> DataFrame:
    """Add ``copy``: NULL for the first row of a key, what tells it apart for every further one.

    Rows of a key are ordered by the hash of all their columns, so the same rows always get the same copies; equal rows
    are counted, and told apart by a number. Only rows whose key comes more than once are shuffled.
    """
    twice = written(rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key))
    first = F.lit(None).cast("string")
    if twice.isEmpty():
        return rows.withColumn("copy", first)
    marked = rows.join(twice, key, "left_semi").withColumn("_order", F.sha2(F.to_json(F.struct(*rows.columns)), 256))
    equal = marked.groupBy(key, "_order").agg(F.first(F.struct(*rows.columns)).alias("_row"), F.count("*").alias("_n"))
    lowest = marked.groupBy(key).agg(F.min("_order").alias("_low"))
    each = equal.join(lowest, key).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)))
    name = F.when((F.col("_order") != F.col("_low")) | (F.col("_i") > 0), F.concat_ws(":", "_order", "_i"))
    return rows.join(twice, key, "left_anti").withColumn("copy", first).unionByName(
        each.select("_row.*", name.alias("copy")))


def copy_id(row_id: Column, copy: Column) -> Column:
    """The id of a row that shares its id with others."""
    return F.when(copy.isNull(), row_id).otherwise(stable_id(row_id, copy))
