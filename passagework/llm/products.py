"""Exact inner products of integer vectors, and the best of them per row. Shared by the searches on whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.neighbors import one_per_id
from passagework.operators import grid

SCALE = 256
NONE = -(2**63 - 1)
LARGEST = 2**63 - 1
# whole numbers of so many bits are exact in a double, in sums and products too
EXACT_BITS = 53
HELD_ROWS = 16_384
BLOCKS_PER_CELL = 64


def finite(vector: str) -> Column:
    """Vectors that are not null and hold no null, infinite or NaN component; zero and empty ones are among them."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & good


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, extra: list[str], scale: int = SCALE) -> DataFrame:
    """``(_id, _dim, _vector, *extra)``: a row per id with components ``floor(scale * x)`` as 64-bit integers, clamped to
    that range. Of repeated ids the smallest row counts; null ids, and vectors that are not ``finite``, are left out."""
    rows = one_per_id(vectors.filter(finite(vector_col)), id_col, [*extra, vector_col])
    return rows.select("_id", F.size(vector_col).alias("_dim"), *extra,
                       F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("_vector"))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, len(flat) // rows if rows else 0)


def clamped(values) -> np.ndarray:
    """Python integers as 64-bit ones, those beyond as the nearest."""
    return np.array([min(max(int(v), NONE), LARGEST) for v in values.ravel()], np.int64).reshape(values.shape)


def largest(values: np.ndarray) -> int:
    """Largest magnitude, as a Python integer."""
    return max(int(values.max()), -int(values.min())) if values.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of ``a`` with those of ``b``, exact; beyond 64 bits the nearest 64-bit integer."""
    if a.shape[1] * largest(a) * largest(b) < 2**EXACT_BITS:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return clamped(a.astype(object) @ b.astype(object).T)


class Best:
    """The ``k`` highest (score, id) of every row, ties to smaller ids."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.scores = np.full((rows, k), NONE, np.int64)
        self.ids = np.full((rows, k), LARGEST, np.int64)

    def least(self) -> np.ndarray:
        """What a score has to reach to enter; equal ones may by their id."""
        return np.maximum(self.scores[:, -1], NONE + 1)

    def offer(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Scores of a block, one column per id; ``NONE`` where a pair doesn't count. ``rows`` names the rows if not all."""
        rows = np.arange(len(self.scores)) if rows is None else rows
        enough = scores >= self.least()[rows, None]
        n = scores.shape[1]
        if n > self.k and np.count_nonzero(enough) > 4 * self.k * len(rows):
            enough &= scores >= np.partition(scores, n - self.k, axis=1)[:, n - self.k][:, None]
        r, c = np.nonzero(enough)
        self.merge(rows[r], scores[r, c], ids[c])

    def merge(self, row: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(row):
            return
        touched = np.unique(row)
        row = np.concatenate([row, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.scores[touched].ravel()])
        ident = np.concatenate([ident, self.ids[touched].ravel()])
        by = np.lexsort((ident, -score, row))
        row, score, ident = row[by], score[by], ident[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.scores[row[keep], place[keep]] = score[keep]
        self.ids[row[keep], place[keep]] = ident[keep]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and score index of all that was found, best first."""
        row, place = np.nonzero(self.scores > NONE)
        return row, place, self.scores[row, place]


def dealt_to_cells(held: DataFrame, streamed: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """Both tables with their ``cells``, and the number of tasks.

    ``held`` has the group and ``_line``, numbered from 0 in each group; ``streamed`` the group and ``_place``, any number.
    A cell streams at most about 64 blocks; small groups are cut further until there is a cell for every shuffle partition.
    """
    spark = held.sparkSession
    enough = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = held.groupBy(*group).agg((F.max("_line") + 1).alias("_lines"))
    blocks = streamed.groupBy(*group).agg(F.count("*").alias("_blocks"))
    per_group = F.greatest(F.ceil(F.col("_blocks") / BLOCKS_PER_CELL),
                           F.least(F.col("_blocks"), F.ceil(F.lit(enough) / F.col("_lines"))))
    sizes = lines.join(blocks, group).select(*group, F.col("_lines").cast("int"), per_group.cast("int").alias("_columns"))
    cells = sizes.agg(F.coalesce(F.sum(F.col("_lines").cast("long") * F.col("_columns")), F.lit(1))).first()[0]
    column = F.pmod(F.xxhash64("_place"), F.col("_columns")).cast("int")
    held = held.join(sizes, group).withColumn("cells", grid.held_cells("_line", "_columns", group))
    streamed = (streamed.join(sizes, group).withColumn("_column", column)
                .withColumn("cells", grid.streamed_cells("_lines", "_column", "_columns", group)))
    return held, streamed, min(int(cells), 20_000)
