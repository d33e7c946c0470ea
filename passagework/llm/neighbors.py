"""Approximate nearest neighbours: one navigable graph per shard, every query block meets every shard.

Equal vectors are one class, a single node with its k + 1 smallest ids: no query needs more of them, as one may be its
own. The index is a written table with one row per shard of classes: ids, vectors and flat neighbour arrays. Shards are
dealt by the hash of the smallest id, so neither labels nor copies make one large. A shard is scaled by a power of two and
measured in double precision, so components of any finite size can be compared. Query blocks are matched with shards by
an equi-join on the shard number; a task searches one block in one graph, puts the ids in place of the classes found and
keeps k rows per query, which are ranked at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm import hnsw
from passagework.llm.shared import Scratch, arrow_rows

SHARD_ROWS = 4096
QUERIES_PER_BLOCK = 1024
BEAM = 128


def usable(vector: str) -> Column:
    """Vectors with a direction: not null, empty or zero, no null, infinite or NaN component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def one_per_id(vectors: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """One row ``_id`` and columns per id; of repeated ids the smallest row counts. Null ids are left out."""
    row = F.min(F.struct(*columns)).alias("_r")
    return (vectors.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(row)
            .select("_id", *[F.col("_r")[c].alias(c) for c in columns]))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.ascontiguousarray(flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim))


def scale_of(values: np.ndarray) -> int:
    """Exponent of the power of two that brings the largest component to about 1."""
    return -int(np.frexp(np.abs(values).max(initial=0.0))[1]) if values.size else 0


def scaled(values: np.ndarray, exponent: int) -> np.ndarray:
    """Components times ``2 ** exponent`` in double precision, kept in a range whose squares are finite."""
    return np.clip(np.ldexp(values.astype(np.float64), exponent), -1e150, 1e150)


def euclidean(gap: np.ndarray) -> np.ndarray:
    """Lengths of rows; components are scaled first, so their squares neither overflow nor vanish."""
    most = np.abs(gap).max(axis=1, initial=0.0)
    exponent = np.frexp(most)[1]
    small = np.ldexp(gap, -exponent[:, None])
    return np.ldexp(np.sqrt(np.einsum("ij,ij->i", small, small)), exponent)


def number_of_shards(rows: DataFrame, key: list[str], shard_rows: int) -> int:
    sizes = rows.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(shard_rows)).alias("n"))
    return max(1, int(sizes.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]))


def dealt(rows: DataFrame, key: list[str], shard_rows: int) -> DataFrame:
    """Add ``_shards``, the number of shards of a key, and ``_shard``, the one that the hash of ``_id`` names."""
    sizes = rows.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("int").alias("_shards"))
    return rows.join(sizes, key).withColumn("_shard", F.pmod(F.xxhash64("_id"), F.col("_shards")).cast("int"))


def classes(vectors: DataFrame, *, id_col: str, vector_col: str, most_ids: int) -> DataFrame:
    """``(_dim, _id, _ids, _vector)`` per distinct vector: its smallest id, and at most ``most_ids`` of the smallest.

    Larger ids of a class are dropped before the shuffle (a partial group limit), so many copies don't gather in a task.
    """
    good = one_per_id(vectors.filter(usable(vector_col)), id_col, [vector_col]).withColumns({
        "_dim": F.size(vector_col), "_h1": F.xxhash64(vector_col), "_h2": F.xxhash64(F.lit("second"), vector_col)})
    same = ["_dim", "_h1", "_h2"]
    smallest = good.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy("_id")))
    return (smallest.filter(F.col("_n") <= most_ids).groupBy(*same)
            .agg(F.array_sort(F.collect_list("_id")).alias("_ids"), F.min(vector_col).alias("_vector"))
            .select("_dim", F.col("_ids")[0].alias("_id"), "_ids", "_vector"))


def build_index(vectors: DataFrame, scratch: Scratch, *, id_col: str, vector_col: str, k: int,
                shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Written table ``(_dim, _shard, _shards, _ids, _ends, _scale, _graph)``, a row per shard; the ids of class
    ``i`` are those before ``_ends[i]``. Every shard is built in a task of its own."""
    good = scratch.write(classes(vectors, id_col=id_col, vector_col=vector_col, most_ids=k + 1))
    tasks = number_of_shards(good, ["_dim"], shard_rows)
    good = dealt(good, ["_dim"], shard_rows).repartition(tasks, "_dim", "_shard")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_id").combine_chunks()
        dim, ids = table.column("_dim")[0].as_py(), table.column("_ids")
        ends = np.cumsum(pa.compute.list_value_length(ids).to_numpy())
        values = matrix(table.column("_vector"), dim).astype(np.float64)
        exponent = scale_of(values)
        graph = hnsw.build(scaled(values, exponent), table.column("_id").to_numpy())
        return pa.table({"_dim": pa.array([dim], pa.int32()), "_shard": table.column("_shard")[:1].combine_chunks(),
                         "_shards": table.column("_shards")[:1].combine_chunks(),
                         "_ids": pa.array([pa.compute.list_flatten(ids).to_numpy().astype("<i8").tobytes()], pa.binary()),
                         "_ends": pa.array([ends.astype("<i8").tobytes()], pa.binary()),
                         "_scale": pa.array([exponent], pa.int32()), "_graph": pa.array([graph.to_bytes()], pa.binary())})

    return scratch.write(good.groupBy("_dim", "_shard").applyInArrow(
        run, "_dim int, _shard int, _shards int, _ids binary, _ends binary, _scale int, _graph binary"))


def nearest(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
            beam: int = BEAM, shard_rows: int = SHARD_ROWS, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """Per query its ``k`` nearest rows found, by Euclidean distance in double precision, ties to smaller ids.

    ``queries`` has the columns of ``vectors``; a query never finds its own id. Vectors without a direction and null ids
    take no part, repeated ids count once, other columns are ignored; vectors meet only vectors of their length. Components
    of any finite size count (a distance beyond the largest double is infinite). Returns ``query_id, rank, <id>, score``; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession)
    index = build_index(vectors, scratch, id_col=id_col, vector_col=vector_col, k=k, shard_rows=shard_rows)
    asked = one_per_id(queries.filter(usable(vector_col)), id_col, [vector_col]).withColumn("_dim", F.size(vector_col))
    asked = dealt(asked, ["_dim"], queries_per_block).withColumnRenamed("_shard", "_block")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("_id")
        values = matrix(table.column(vector_col), table.column("_dim")[0].as_py())
        return pa.table({"_dim": table.column("_dim")[:1].combine_chunks(),
                         "_query_ids": pa.array([table.column("_id").to_numpy().astype("<i8").tobytes()], pa.binary()),
                         "_queries": pa.array([values.astype("<f8").tobytes()], pa.binary())})

    blocks = asked.groupBy("_dim", "_block").applyInArrow(pack, "_dim int, _query_ids binary, _queries binary")
    counts = index.groupBy("_dim").agg(F.max("_shards").alias("_n"))
    blocks = blocks.join(counts, "_dim").select(
        "_dim", "_query_ids", "_queries", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_shard"))
    # a hashed shard may be empty; the join leaves it out
    pairs = index.repartition(max(1, index.count()), "_dim", "_shard").join(blocks, ["_dim", "_shard"]).select(
        "_dim", "_ids", "_graph", "_query_ids", "_queries", "_ends", "_scale")
    names = ["query_id", id_col, "score"]

    def run(batches):
        last, graph = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch.column(0)[row].as_py()
                raw = batch.column(2)[row].as_buffer()
                if last is None or not raw.equals(last):
                    last, graph = raw, hnsw.Graph.from_bytes(raw.to_pybytes())
                ids = np.frombuffer(batch.column(1)[row].as_buffer(), "<i8")
                own = np.frombuffer(batch.column(3)[row].as_buffer(), "<i8")
                asked = np.frombuffer(batch.column(4)[row].as_buffer(), "<f8").reshape(-1, dim)
                ends = np.frombuffer(batch.column(5)[row].as_buffer(), "<i8")
                exponent = batch.column(6)[row].as_py()
                found, _ = hnsw.search(graph, scaled(asked, exponent), max(beam, k + 1))
                ask, column = np.nonzero(found >= 0)
                node = found[ask, column]
                score = np.empty(len(node))
                for lo in range(0, len(node), 65_536):
                    # the scaling is exact, so these are the original vectors
                    original = np.ldexp(graph.vectors[node[lo:lo + 65_536]], -exponent)
                    score[lo:lo + 65_536] = euclidean(asked[ask[lo:lo + 65_536]] - original)
                sizes = np.diff(ends, prepend=0)[node]
                each = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                found_ids = ids[np.repeat(ends[node] - sizes, sizes) + each]
                ask, score = np.repeat(ask, sizes), np.repeat(score, sizes)
                other = found_ids != own[ask]
                ask, found_ids, score = ask[other], found_ids[other], score[other]
                by = np.lexsort((found_ids, score, ask))
                ask, found_ids, score = ask[by], found_ids[by], score[by]
                keep = np.arange(len(ask)) - np.searchsorted(ask, ask) < k
                yield arrow_rows(names, [pa.array(own[ask[keep]]), pa.array(found_ids[keep]), pa.array(score[keep])])

    hits = pairs.mapInArrow(run, f"query_id long, `{id_col}` long, score double")
    nearest_first = Window.partitionBy("query_id").orderBy("score", id_col)
    return (hits.withColumn("rank", F.row_number().over(nearest_first)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), id_col, "score"))
