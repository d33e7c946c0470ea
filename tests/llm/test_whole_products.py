"""Searches on whole-number products against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.llm import hard_negatives as H
from passagework.llm import inner_product as I
from passagework.llm import products as P
from passagework.operators import grid

LIMIT = 2**63 - 1


def whole(x):
    return [min(max(math.floor(256 * v), -2**63), LIMIT) for v in x]


def dot(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), -LIMIT), LIMIT)


def usable(rows):
    """Smallest row of every id, of those that take part."""
    good = {}
    for i, x, *rest in rows:
        if i is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        key = (rest, x)
        if i not in good or key < good[i][0]:
            good[i] = (key, whole(x), *rest)
    return {i: v[1:] for i, v in good.items()}


def brute_top(rows, k, asked):
    good, out = usable(rows), set()
    for q in filter(asked, good):
        best = sorted((-dot(good[q][0], good[c][0]), c) for c in good if c != q and len(good[c][0]) == len(good[q][0]))[:k]
        out |= {(q, n, c, -s) for n, (s, c) in enumerate(best, 1)}
    return out


def brute_negatives(rows, asked, positives=5, negatives=3):
    good = {i: v for i, v in usable([(i, x, y) for i, x, y in rows if y is not None]).items()}
    out = set()
    for a in filter(asked, good):
        other = sorted((-dot(good[a][0], good[c][0]), c) for c in good if c != a and len(good[c][0]) == len(good[a][0]))
        for p, i in [(-s, c) for s, c in other if good[c][1] == good[a][1]][:positives]:
            inside = [(-s, c) for s, c in other if good[c][1] != good[a][1] and 50 * p <= -100 * s <= 95 * p][:negatives]
            out |= {(a, i, n, c, p, s) for n, (s, c) in enumerate(inside, 1)}
    return out


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.withColumns({"_id": F.lit("x"), "_dim": F.lit(1), "score": F.lit(2), "rank": F.lit(3), "cells": F.lit(4)})


def made(seed, n, dim=12, spread=1.0):
    random = np.random.default_rng(seed)
    x = random.normal(size=(n, dim)) * np.exp(spread * random.normal(size=(n, 1)))
    x[n // 2: n // 2 + n // 3] = x[0]  # a third of all rows are copies
    x[-5:] = 0
    ids = random.permutation(3 * n)[:n]
    return [(int(i), v.tolist(), int(y)) for i, v, y in zip(ids, x, random.integers(0, 4, n))]


ODD = [(-50, None, 1), (-100, [], 1), (-101, [], 2), (-3, [math.nan] * 12, 1), (-4, [None] + [1.0] * 11, 1),
       (-5, [math.inf] + [1.0] * 11, 1), (-6, [1.0] * 12, None), (-150, [1.0, 2.0, 3.0], 1), (-151, [3.0, 2.0, 1.0], 2),
       (None, [1.0] * 12, 1), (-200, [1e25] * 12, 1), (-201, [-1e25] * 12, 2), (-250, [1e-25] * 12, 2)]


@pytest.mark.parametrize("spread", [0.05, 1.5])
def test_top_products(spark, spread):
    rows = made(1, 900, spread=spread) + ODD
    rows += rows[:40]
    t = table(spark, rows)
    got = I.top_products(t, t.filter("vec_id % 10 = 0"), k=5, bucket_rows=64, held_rows=50)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in got.collect()} == brute_top(rows, 5, lambda i: i % 10 == 0)
    assert I.top_products(t.limit(0), t.limit(0)).count() == 0


def test_fewer_candidates_than_asked_for(spark):
    rows = [(i, [float(i), 1.0], 0) for i in range(4)]
    t = table(spark, rows)
    assert {tuple(r) for r in I.top_products(t, t, k=7).collect()} == brute_top(rows, 7, lambda i: True)


def _blocks(ids, x, rows):
    for lo in range(0, len(ids), rows):
        part = x[lo:lo + rows]
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)), pa.array(part.ravel()))
        n = len(part)
        yield pa.RecordBatch.from_arrays([pa.array(ids[lo:lo + n]), vectors, pa.array(np.full(n, P.NONE))],
                                         names=["_id", "_vector", "_least"])


@pytest.mark.parametrize("kind", ["lengths differ", "near copies"])
def test_buckets_are_pruned_by_length_and_by_coordinates(kind):
    random = np.random.default_rng(4)
    x = random.normal(size=(6000, 32))
    if kind == "lengths differ":
        x *= np.exp(random.normal(size=(6000, 1)))
    else:
        x = np.repeat(x[:300], 20, axis=0) + 0.02 * x
    x = np.floor(256 * x).astype(np.int64)
    by = np.argsort(-I.lengths(x))
    ids, x = np.arange(6000)[by], x[by]
    asked = np.flatnonzero(ids % 50 == 0)
    cell = I.Retrieval(list(_blocks(ids[asked], x[asked], 1000)), 5)
    for block in _blocks(ids, x, 512):
        cell.add(block)
    assert cell.tried < 0.7 * len(asked) * len(ids)
    assert cell.by_coordinate > 0 if kind == "near copies" else cell.skipped > 0
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = P.NONE
    for q in range(len(asked)):
        best = np.lexsort((ids, -scores[q]))[:5]
        assert cell.best.ids[q].tolist() == ids[best].tolist() and cell.best.scores[q].tolist() == scores[q, best].tolist()


def test_hard_negatives(spark):
    rows = made(2, 700, spread=0.3) + ODD
    rows = [(i, x, 0 if y == 1 else y) for i, x, y in rows]  # one label holds half of the rows
    rows += rows[:40]
    t = table(spark, rows)
    got = H.mine_negatives(t, t.filter("vec_id % 10 = 0"), shard_rows=60, held_rows=40)
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 200
    assert H.mine_negatives(t.limit(0), t.limit(0)).count() == 0
    assert H.mine_negatives(t.filter("label = 0"), t).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5), st.integers(1, 9), st.integers(1, 6), st.sampled_from([0, 1, 3, 200, 10**5, 10**9, 2**62]), st.randoms())
def test_packed_products_are_exact(n, m, dim, size, random):
    a = [[random.randint(-size, size) for _ in range(dim)] for _ in range(n)]
    b = [[random.randint(-size, size) for _ in range(dim)] for _ in range(m)]
    want = [[dot(x, y) for y in b] for x in a]
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    assert H.packed_products(x, y).tolist() == want and P.products(x, y).tolist() == want


def test_several_candidates_share_an_integer():
    c = np.arange(20).reshape(5, 4)
    words = H.pack_fields(c, 24, 2)
    assert words.shape == (3, 4) and words[1, 2] == c[2, 2] + (c[3, 2] << 24)
    assert (H.unpack_fields(words.T, 24, 2, 5) == c.T).all()


def test_no_broadcast_and_no_python_rows_of_pairs(spark):
    t = table(spark, made(3, 300))
    plan = I.top_products(t, t.filter("vec_id % 10 = 0"), bucket_rows=64)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "FlatMapGroups" not in plan


def test_blocks_of_one_side_give_nothing(spark):
    class Pairs:
        def __init__(self, held):
            self.n = sum(b.num_rows for b in held)

        def add(self, block):
            yield pa.RecordBatch.from_arrays([pa.array([self.n * block.num_rows])], names=["n"])

        def finish(self):
            return None

    rows = spark.range(100).select((F.col("id") % 4).cast("int").alias("g"), F.col("id").alias("v")).repartition(1)
    packed = grid.packed(rows.sortWithinPartitions("g"), ["g"], 7, order=["v"])
    sizes = [(r.g, grid.from_block(pa.py_buffer(r.block)).num_rows) for r in packed.collect()]
    assert all(n <= 7 for _, n in sizes) and [sum(n for g, n in sizes if g == k) for k in range(4)] == [25] * 4
    held = packed.filter("g < 2").withColumns({"_line": F.lit(0), "_columns": F.lit(3)})
    held = held.withColumn("cells", grid.held_cells("_line", "_columns", ["g"]))
    streamed = packed.filter("g > 0").withColumns({"_lines": F.lit(1), "_columns": F.lit(3), "at": F.monotonically_increasing_id()})
    streamed = streamed.withColumn("_column", F.pmod("at", F.lit(3)).cast("int"))
    streamed = streamed.withColumn("cells", grid.streamed_cells("_lines", "_column", "_columns", ["g"]))
    met = grid.meet(held, streamed, Pairs, "n long", tasks=5)
    assert met.agg(F.sum("n")).first()[0] == 25 * 25
