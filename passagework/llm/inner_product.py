"""Exact top-k by inner product: vectors grouped by length, pruned inside each group, survivors verified.

Vectors are sorted by length over the cluster and cut into buckets of about equal length, a written block each. Queries are
held in the cells of a grid, buckets stream past them by descending length (``operators/grid.py``). A query's k-th best
score so far, divided by its own length and that of the bucket's longest vector, is the cosine that a vector of the bucket
must reach, its local threshold:

- above 1 the bucket cannot hold a better score and is left out for the query;
- a high one selects coordinate pruning: on the query's largest coordinates only an interval of values is compatible with
  that cosine, found by bisection in the bucket's sorted coordinates, and the narrowest interval is checked on the others;
- a low one selects length pruning: only the first vectors of the bucket, those long enough, are candidates.

Products of the candidates are computed exactly on integers. First bounds come from the longest bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm.neighbors import dealt
from passagework.llm.products import HELD_ROWS, NONE, SCALE, Best, dealt_to_cells, matrix, products, whole_vectors
from passagework.llm.shared import Scratch, arrow_rows
from passagework.operators import grid

BUCKET_ROWS = 1024
QUERIES_AT_ONCE = 1024
COORDINATE_COSINE = 0.8
FOCUS = 4
# relative error allowed for in bounds that are computed in doubles
_SLACK = 1e-9


class Bucket:
    """Vectors by descending length; sorted coordinates of their directions are made on first use."""

    def __init__(self, block: pa.RecordBatch):
        self.ids = block.column("_id").to_numpy()
        self.values = matrix(block.column("_vector"), block.num_rows)
        self.lengths = lengths(self.values)
        by = np.lexsort((self.ids, -self.lengths))
        self.ids, self.values, self.lengths = self.ids[by], self.values[by], self.lengths[by]
        self.longest = float(self.lengths[0])
        self._sorted = None

    def coordinates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Directions, and per coordinate their sorted values and order."""
        if self._sorted is None:
            unit = self.values / np.where(self.lengths > 0, self.lengths, 1.0)[:, None]
            order = np.argsort(unit, axis=0, kind="stable")
            self._sorted = unit, np.take_along_axis(unit, order, 0), order
        return self._sorted


def lengths(values: np.ndarray) -> np.ndarray:
    wide = values.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", wide, wide))


class Retrieval:
    """The queries of one cell and the best scores they have met there."""

    def __init__(self, blocks: list[pa.RecordBatch], k: int):
        block = grid.merged(blocks)
        self.ids = block.column("_id").to_numpy()
        self.values = matrix(block.column("_vector"), block.num_rows)
        self.lengths = lengths(self.values)
        # k-th best score among other vectors, if that is known
        self.known = block.column("_least").to_numpy(zero_copy_only=False).astype(np.int64)
        self.best = Best(len(self.ids), k)
        self.tried = self.skipped = self.by_length = self.by_coordinate = 0

    def add(self, block: pa.RecordBatch):
        bucket = Bucket(block)
        least = np.maximum(self.best.least(), self.known)
        reach = self.lengths * bucket.longest * (1 + _SLACK)
        # local threshold: the cosine that the bucket's longest vector would need
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(least > 0, least / reach, -1.0)
        local[(reach == 0) & (least > 0)] = np.inf
        open_ = local <= 1
        # a score that cannot be positive cannot be bounded by lengths: all candidates count
        near = open_ & (local >= COORDINATE_COSINE)
        self.skipped += int((~open_).sum())
        self.by_length += int((open_ & ~near).sum())
        self.by_coordinate += int(near.sum())
        some = np.flatnonzero(open_ & ~near)
        for lo in range(0, len(some), QUERIES_AT_ONCE):
            self._by_length(bucket, some[lo:lo + QUERIES_AT_ONCE], least)
        for q in np.flatnonzero(near).tolist():
            self._by_coordinate(bucket, q, float(local[q]))

    def _by_length(self, bucket: Bucket, rows: np.ndarray, least: np.ndarray):
        """Candidates are the vectors long enough to reach the score with this query."""
        wanted = least[rows]
        need = np.where(wanted > 0, wanted / np.maximum(self.lengths[rows] * (1 + _SLACK), 1e-300), 0.0)
        first = np.searchsorted(-bucket.lengths, -need, side="right")
        most = int(first.max()) if len(first) else 0
        if not most:
            return
        scores = products(self.values[rows], bucket.values[:most])
        self.tried += int(first.sum())
        scores[np.arange(most)[None] >= first[:, None]] = NONE
        scores[self.ids[rows][:, None] == bucket.ids[None, :most]] = NONE
        scores[scores < wanted[:, None]] = NONE
        self.best.offer(scores, bucket.ids[:most], rows)

    def _by_coordinate(self, bucket: Bucket, q: int, cosine: float):
        """Candidates lie, on the query's largest coordinates, in the interval that the cosine leaves."""
        unit, sorted_, order = bucket.coordinates()
        direction = self.values[q] / self.lengths[q]
        focus = np.argsort(-np.abs(direction), kind="stable")[:FOCUS]
        centre = direction[focus]
        # an angle of at most g to the query leaves, of a coordinate cos(b) of the query, cos(b + g) to cos(b - g)
        own, angle = np.arccos(np.clip(centre, -1, 1)), np.arccos(cosine)
        low = np.cos(np.minimum(np.pi, own + angle)) - _SLACK
        high = np.cos(np.maximum(0.0, own - angle)) + _SLACK
        ranges = [(np.searchsorted(sorted_[:, d], lo, side="left"), np.searchsorted(sorted_[:, d], hi, side="right"))
                  for d, lo, hi in zip(focus.tolist(), low, high)]
        narrow = int(np.argmin([b - a for a, b in ranges]))
        a, b = ranges[narrow]
        found = order[a:b, focus[narrow]]
        if len(found):
            values = unit[found][:, focus]
            found = found[((values >= low) & (values <= high)).all(1)]
        found = found[bucket.ids[found] != self.ids[q]]
        self.tried += len(found)
        if len(found):
            score = products(self.values[q:q + 1], bucket.values[found])[0]
            keep = score >= max(int(self.best.least()[q]), int(self.known[q]))
            self.best.merge(np.full(int(keep.sum()), q), score[keep], bucket.ids[found[keep]])

    def finish(self):
        row, place, score = self.best.found()
        yield arrow_rows(["query_id", "_id", "score"], [
            pa.array(self.ids[row]), pa.array(self.best.ids[row, place]), pa.array(score)])


def buckets(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(_dim, block)``: vectors sorted by length over all partitions, cut into blocks. Equal lengths are spread by id."""
    squares = F.aggregate("_vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    by_length = rows.withColumn("_length", squares)
    dealt_ = by_length.repartitionByRange("_dim", F.col("_length").desc(), F.xxhash64("_id"))
    ordered = dealt_.sortWithinPartitions("_dim", F.col("_length").desc(), F.xxhash64("_id"))
    return grid.packed(ordered.select("_dim", "_length", "_id", "_vector"), ["_dim"], bucket_rows)


def top_products(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding",
                 k: int = 5, scale: int = SCALE, bucket_rows: int = BUCKET_ROWS, held_rows: int = HELD_ROWS) -> DataFrame:
    """Per query the ``k`` rows with the highest inner product of components ``floor(scale * x)``, ties to smaller ids.

    ``queries`` has the columns of ``vectors``; a query never finds its own id. Null ids, null vectors and those with a null
    or non-finite component take no part; zero and empty vectors do (their products are 0). Repeated ids count once (the
    smallest row), vectors meet only vectors of their length, other columns are ignored, an empty table gives no rows.
    Scaled components and products beyond 64 bits are held as the nearest 64-bit integer, also in the rank. Returns
    ``query_id, rank, <id>, score``.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = whole_vectors(vectors, id_col, vector_col, [], scale)
    index = scratch.write(buckets(rows, bucket_rows).withColumn("_place", F.monotonically_increasing_id()))
    index = index.withColumn("at", F.col("_place"))
    asked = dealt(whole_vectors(queries, id_col, vector_col, [], scale), ["_dim"], held_rows)
    asked = scratch.write(asked.withColumnRenamed("_shard", "_line").select("_dim", "_line", "_id", "_vector"))

    def best(blocks: DataFrame, held: DataFrame) -> DataFrame:
        """``(query_id, _id, score)``, the k best of every query in each cell."""
        held, streamed, tasks = dealt_to_cells(_held(held, bucket_rows), blocks, ["_dim"])
        return grid.meet(held, streamed, lambda held_blocks: Retrieval(held_blocks, k), "query_id long, _id long, score long",
                         tasks=tasks)

    unknown = asked.withColumn("_least", F.lit(NONE))
    # the first block of a length in sort order is its longest bucket: partitions are numbered in that order
    first = index.join(index.groupBy("_dim").agg(F.min("_place").alias("_place")), ["_dim", "_place"])
    bounds = best(first, unknown).groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("_low"))
    bounds = bounds.filter(F.col("_n") >= k).select(F.col("query_id").alias("_id"), "_low")
    bounded = scratch.write(asked.join(bounds, "_id", "left").select(
        "_dim", "_line", "_id", "_vector", F.coalesce("_low", F.lit(NONE)).alias("_least")))
    best_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "_id")
    return (best(index, bounded).withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("_id").alias(id_col), "score"))


def _held(queries: DataFrame, rows_per_block: int) -> DataFrame:
    ordered = queries.repartition("_dim", "_line", F.pmod(F.xxhash64("_id"), F.lit(16))).sortWithinPartitions("_dim", "_line")
    return grid.packed(ordered, ["_dim", "_line"], rows_per_block)
