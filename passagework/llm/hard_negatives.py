"""Hard negatives by Kronecker-packed products.

The components of several candidates, biased so that none is negative, are put into separated fields of one wide integer
per coordinate. An anchor component is multiplied once with that integer, the sums of a field never reach the next one, and
unpacking a field and undoing the bias gives the exact score of its candidate. The wide integer is held in the 53 bits in
which a double is exact, so that the multiplication is one matrix product; vectors too large for that are packed into
Python's integers of any width.

Two rounds over a grid of cells (``operators/grid.py``), where anchors are held and candidates stream past: one among the
rows of a label, for the positives, and one among all rows, for the negatives whose score is a given share of a positive's.
Labels are cut into shards, so that one with most rows is many cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm.neighbors import dealt
from passagework.llm.products import (
    EXACT_BITS, HELD_ROWS, NONE, SCALE, Best, clamped, dealt_to_cells, largest, matrix, whole_vectors,
)
from passagework.llm.shared import Scratch, arrow_rows
from passagework.operators import grid

BLOCK_ROWS = 1024
SHARD_ROWS = 4096
ANCHORS_AT_ONCE = 1024
POSITIVES = 5
NEGATIVES = 3
LEAST_PERCENT, MOST_PERCENT = 50, 95
# candidates in one of Python's integers, where doubles are too small
_WIDE_FIELDS = 8


def pack_fields(biased: np.ndarray, width: int, fields: int) -> np.ndarray:
    """Wide integers, a row of them for ``fields`` candidates: field ``f`` holds the components of candidate ``f``."""
    short = -len(biased) % fields
    padded = np.vstack([biased, np.zeros((short, biased.shape[1]), biased.dtype)])
    words = padded[0::fields].copy()
    for f in range(1, fields):
        words = words + (padded[f::fields] << (width * f))
    return words


def unpack_fields(words: np.ndarray, width: int, fields: int, candidates: int) -> np.ndarray:
    """The sums in the fields of ``(anchors, words)``, a column per candidate."""
    out = np.empty((words.shape[0], words.shape[1] * fields), words.dtype)
    for f in range(fields):
        out[:, f::fields] = (words >> (width * f)) & ((1 << width) - 1)
    return out[:, :candidates]


def packed_products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All inner products of integer rows, exact; beyond 64 bits the nearest 64-bit integer."""
    if not anchors.size or not candidates.size:
        return np.zeros((len(anchors), len(candidates)), np.int64)
    dim = anchors.shape[1]
    bias_a, bias_c = -int(anchors.min()), -int(candidates.min())
    top_a, top_c = int(anchors.max()) + bias_a, int(candidates.max()) + bias_c
    width = max(1, (dim * top_a * top_c).bit_length())
    fields = EXACT_BITS // width
    # what the biases add is subtracted in 64 bits
    if fields and dim * (largest(anchors) + abs(bias_a)) * (largest(candidates) + abs(bias_c)) < 2**62:
        a, c = anchors + bias_a, candidates + bias_c
        words = pack_fields(c, width, fields).astype(np.float64)
        sums = unpack_fields((a.astype(np.float64) @ words.T).astype(np.int64), width, fields, len(c))
    else:
        a, c = anchors.astype(object) + bias_a, candidates.astype(object) + bias_c
        words = pack_fields(c, width, _WIDE_FIELDS)
        sums = unpack_fields(a @ words.T, width, _WIDE_FIELDS, len(c))
    # sum of (a - A)(c - C), with A and C the biases
    exact = sums - bias_c * a.sum(1)[:, None] - bias_a * c.sum(1)[None] + dim * bias_a * bias_c
    return exact if exact.dtype == np.int64 else clamped(exact)


def bands(positive_score: np.ndarray, least_percent: int, most_percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score ``s`` with ``least * p <= 100 * s <= most * p``, in whole numbers of any size."""
    wide = positive_score.astype(object)
    return clamped((-(-least_percent * wide // 100))), clamped(most_percent * wide // 100)


class Anchors:
    """The anchors of one cell: ids, labels, vectors."""

    def __init__(self, blocks: list[pa.RecordBatch]):
        self.block = grid.merged(blocks)
        self.ids = self.block.column("_id").to_numpy()
        self.labels = self.block.column("_label").to_numpy(zero_copy_only=False)
        self.values = matrix(self.block.column("_vector"), len(self.ids))

    def scores(self, block: pa.RecordBatch):
        """Slices of the anchors with their scores against a block, and the block's ids and labels."""
        ids, labels = block.column("_id").to_numpy(), block.column("_label").to_numpy(zero_copy_only=False)
        values = matrix(block.column("_vector"), len(ids))
        for lo in range(0, len(self.ids), ANCHORS_AT_ONCE):
            rows = np.arange(lo, min(len(self.ids), lo + ANCHORS_AT_ONCE))
            yield rows, packed_products(self.values[rows], values), ids, labels


class Positives(Anchors):
    """The best other rows of an anchor's label."""

    def __init__(self, blocks, k: int):
        super().__init__(blocks)
        self.best = Best(len(self.ids), k)

    def add(self, block):
        for rows, scores, ids, labels in self.scores(block):
            scores[self.ids[rows][:, None] == ids[None]] = NONE
            scores[self.labels[rows][:, None] != labels[None]] = NONE
            self.best.offer(scores, ids, rows)

    def finish(self):
        row, place, score = self.best.found()
        yield arrow_rows(["_anchor", "_positive", "_score"], [
            pa.array(self.ids[row]), pa.array(self.best.ids[row, place]), pa.array(score)])


class Negatives(Anchors):
    """Per anchor and positive the best rows of other labels inside the positive's band."""

    def __init__(self, blocks, k: int, least_percent: int, most_percent: int):
        super().__init__(blocks)
        scores = self.block.column("_scores")
        sizes = pa.compute.list_value_length(scores).to_numpy(zero_copy_only=False)
        self.owner = np.repeat(np.arange(len(self.ids)), sizes)
        self.place = np.arange(len(self.owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.positive = self.block.column("_positives").flatten().to_numpy()
        self.positive_score = scores.flatten().to_numpy()
        self.low, self.high = bands(self.positive_score, least_percent, most_percent)
        self.best = Best(len(self.owner), k)

    def add(self, block):
        for rows, scores, ids, labels in self.scores(block):
            scores[self.labels[rows][:, None] == labels[None]] = NONE
            start, end = np.searchsorted(self.owner, [rows[0], rows[-1] + 1])
            places = self.place[start:end]
            for p in range(int(places.max(initial=-1)) + 1):
                # the anchors that have a positive of this place, and their row among the positives
                which = start + np.flatnonzero(places == p)
                mine = scores[self.owner[which] - rows[0]]
                inside = (mine >= self.low[which, None]) & (mine <= self.high[which, None])
                self.best.offer(np.where(inside, mine, NONE), ids, which)

    def finish(self):
        row, place, score = self.best.found()
        yield arrow_rows(["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"], [
            pa.array(self.ids[self.owner[row]]), pa.array(self.positive[row]), pa.array(self.best.ids[row, place]),
            pa.array(self.positive_score[row]), pa.array(score)])


def _packed(rows: DataFrame, key: list[str]) -> DataFrame:
    return grid.packed(rows, key, BLOCK_ROWS, order=["_id"]).withColumn("_place", F.monotonically_increasing_id())


def mine_negatives(vectors: DataFrame, anchors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
                   least_percent: int = LEAST_PERCENT, most_percent: int = MOST_PERCENT, scale: int = SCALE,
                   shard_rows: int = SHARD_ROWS, held_rows: int = HELD_ROWS) -> DataFrame:
    """Per anchor its ``positives`` best other rows of its label, and per such positive the ``negatives`` best rows of other
    labels whose score is ``least_percent`` to ``most_percent`` of the positive's; scores are inner products of components
    ``floor(scale * x)``, ties go to smaller ids.

    ``anchors`` has the columns of ``vectors``. Rows with a null id or label, a null vector or a null or non-finite
    component take no part; zero and empty vectors do. Repeated ids count once (the smallest row), vectors meet only vectors
    of their length, other columns are ignored, an empty table gives no rows; an anchor without positives, or a positive
    without negatives in its band (always if its score is negative), gives none. Scaled components and scores beyond 64 bits
    are held as the nearest 64-bit integer. Labels are compared as 64-bit hashes of their text.
    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    """
    scratch = Scratch(vectors.sparkSession)

    def rows(table: DataFrame) -> DataFrame:
        good = whole_vectors(table.filter(F.col(label_col).isNotNull()), id_col, vector_col, [label_col], scale)
        return good.select("_id", "_dim", F.xxhash64(F.col(label_col).cast("string")).alias("_label"), "_vector")

    # written by label and shard, so that blocks of one label lie together and a large label is many of them
    of_label = ["_dim", "_label"]
    sharded = dealt(rows(vectors), of_label, shard_rows).repartition(*of_label, "_shard")
    table = scratch.write(sharded.sortWithinPartitions(*of_label, "_shard").select("_dim", "_label", "_id", "_vector"))
    asked = dealt(rows(anchors), of_label, held_rows).withColumnRenamed("_shard", "_line")
    asked = asked.select("_dim", "_label", "_line", "_id", "_vector")

    same = table.select("_dim", F.col("_label").alias("_group"), "_label", "_id", "_vector")
    held = asked.select("_dim", F.col("_label").alias("_group"), "_line", "_label", "_id", "_vector")
    near = _meet(held, same, ["_dim", "_group"], lambda blocks: Positives(blocks, positives),
                 "_anchor long, _positive long, _score long", scratch)
    best_first = Window.partitionBy("_anchor").orderBy(F.col("_score").desc(), "_positive")
    near = near.withColumn("_n", F.row_number().over(best_first)).filter(F.col("_n") <= positives)
    near = near.groupBy("_anchor").agg(F.array_sort(F.collect_list(F.struct("_n", "_positive", "_score"))).alias("_p"))
    near = near.select("_anchor", F.col("_p._positive").alias("_positives"), F.col("_p._score").alias("_scores"))

    known = asked.drop("_line").join(near, F.col("_id") == F.col("_anchor")).drop("_anchor")
    known = dealt(known, ["_dim"], held_rows).withColumnRenamed("_shard", "_line")
    held = known.select("_dim", "_line", "_label", "_id", "_vector", "_positives", "_scores")
    found = _meet(held, table, ["_dim"], lambda blocks: Negatives(blocks, negatives, least_percent, most_percent),
                  "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long", scratch)
    best_first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return (found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
                    "negative_score"))


def _meet(held: DataFrame, streamed: DataFrame, group: list[str], start, schema: str, scratch: Scratch) -> DataFrame:
    key = [*group, "_line"]
    # a line is dealt to a few tasks, which pack its blocks
    ordered = held.repartition(*key, F.pmod(F.xxhash64("_id"), F.lit(16))).sortWithinPartitions(*key)
    held_blocks = scratch.write(grid.packed(ordered, key, BLOCK_ROWS))
    blocks = _packed(streamed, group).withColumn("at", F.col("_place"))
    held_blocks, blocks, tasks = dealt_to_cells(held_blocks, blocks, group)
    return grid.meet(held_blocks, blocks, start, schema, tasks=tasks)
