"""Helpers of this subpackage: batches, scratch tables, word hashes and connected components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.config import ensure_checkpoint_dir

SLICE_BYTES = 4 << 20
LONG_WORD = 256
_POLY = np.uint64(0x9E3779B97F4A7C15)
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_slices(batches, at: int = 1, max_bytes: int = SLICE_BYTES):
    """Arrow batches cut so that the text column of each piece holds about ``max_bytes``; one long text stays whole."""
    for batch in batches:
        sizes = batch.column(at).cast(pa.large_binary()) if batch.num_rows else None
        if sizes is None:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(lengths) - lengths) // max_bytes
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            yield batch.slice(lo, hi - lo)


def arrow_rows(names, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)


def file_bytes(path: str) -> bytes:
    """A vocabulary file, read where the job is planned and sent along with its tasks (a few MB)."""
    with open(path, "rb") as f:
        return f.read()


class Scratch:
    """Tables written to the folder that the cluster shares; a table that is no longer read can be dropped."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table.scratch_path = path
        return table

    def drop(self, table: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries inside delete their shuffle files as they end (a setting of Spark 4.1), where each ends in a written table or
    a collected summary and no later one reads its shuffles."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def word_hashes(words: list) -> np.ndarray:
    """64-bit hashes of words given as bytes or text."""
    if not words:
        return np.empty(0, np.uint64)
    values = np.empty(len(words), object)
    values[:] = words
    return pd.util.hash_array(values, categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the public splitmix64 finalizer, a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ngram_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive word hashes: one polynomial, mixed once."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out *= _POLY
            out += h[i:i + n]
    return mix(out)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of a column of texts (null: none), and the position of the text of each."""
    parts = pa.compute.ascii_split_whitespace(pa.compute.fill_null(texts, ""))
    owner = np.repeat(np.arange(len(texts)), pa.compute.list_value_length(parts).to_numpy(zero_copy_only=False))
    words = parts.flatten().cast(pa.large_binary())
    full = pa.compute.binary_length(words).to_numpy(zero_copy_only=False) > 0
    return (words, owner) if full.all() else (words.filter(pa.array(full)), owner[full])


def column_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of a column of words without nulls, eight bytes of every word at a time; equal words have equal ones."""
    if not len(words):
        return np.empty(0, np.uint64)
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int64)[words.offset:words.offset + len(words) + 1]
    text = np.zeros(ends[-1] - ends[0] + 8, np.uint8)
    text[:-8] = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]
    eight = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    start, size = ends[:-1] - ends[0], np.diff(ends)
    out = mix(mix(size.view(np.uint64)) ^ (eight[start] & _LOW_BYTES[np.minimum(size, 8)]))
    for done in range(8, LONG_WORD, 8):
        left = np.flatnonzero(size > done)
        if not len(left):
            return out
        out[left] = mix(out[left] ^ (eight[start[left] + done] & _LOW_BYTES[np.minimum(size[left] - done, 8)]))
    left = np.flatnonzero(size > LONG_WORD)
    out[left] = word_hashes(words.take(pa.array(left)).to_pylist())
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, component)`` per node, the smallest node naming it.

    Alternates large-star and small-star steps (Kiveris et al. 2014). Each round is two aggregates and joins over
    shrinking edges, written to the shared folder; nothing is collected but a count and a checksum.
    """
    ends = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct()
    table = scratch.write(ends)
    state = _state(table)
    while state[0]:
        both = table.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            table.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(lowest, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
                 .distinct())
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(lowest, "hi")
        small = (joined.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .unionAll(joined.select("hi", F.col("m").alias("lo"))).distinct())
        new = scratch.write(small)
        scratch.drop(table)
        table, before, state = new, state, _state(new)
        if state == before:
            break
    return table.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(
        table.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct()


def _state(table: DataFrame) -> tuple:
    row = table.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def bounded_sample(df: DataFrame, key: str, rows: int, by: str | None = None) -> DataFrame:
    """About ``rows`` rows (of each value of ``by``) at most, chosen by the hash of ``key``; all rows if there are fewer."""
    picked = F.xxhash64(F.lit("sample"), key)
    if by is None:
        return df.filter(F.pmod(picked, F.lit(max(1, -(-df.count() // rows)))) == 0)
    one_in = {r[by]: max(1, -(-r["n"] // rows)) for r in df.groupBy(by).agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for step in sorted(set(one_in.values())):
        values = [v for v, s in one_in.items() if s == step]
        keep = keep | (F.col(by).isin(values) & (F.pmod(picked, F.lit(step)) == 0))
    return df.filter(keep)
