"""Top-k similarity join of query vectors against chunk vectors, exact or through hash buckets.

Queries and chunks meet in the cells of a grid: queries are dealt to lines, chunks to columns by the hash of their key,
and both are shuffled by cell, one row a vector and cell. A task holds the queries of its line, streams its chunks past
them in Arrow batches and keeps at most ``k`` rows per query, so only those leave a cell. No table is broadcast: more
queries mean more lines, more chunks more columns. A key, source or group of copies that holds most of the chunks is
spread like any others. Only keys and vectors travel; texts are looked up for the hits.

Scoring compares every chunk of a cell with every query of it, so it is the cost of a large search. Most pairs are told to
be too far apart by a product of shorter vectors: components are put into groups, and a vector's norms in the groups have a
product that is never below that of the vectors (Cauchy-Schwarz in every group). Vectors with few components that are not
zero lose little by that. Queries and chunks are dealt to a few directions; how short the vectors of two directions are, or
whether these are used at all, is estimated from some of their pairs. The pairs that are left are scored in double
precision, so the result does not depend on any of this.

Queries whose vectors are smaller than what the session broadcasts in a join are sent to the tasks instead, and nothing is
shuffled but the hits: chunks are scored where they lie, those of a ``ChunkPass`` in the task that makes them.

The hashed search deals every chunk to one random-hyperplane bucket. A query probes buckets in the order of the margins by
which its own bucket would have to be missed, until those probed hold a neighbour at the least score with a stated
probability. Chunks meet only the queries that probe their bucket; a stored index (``bucketed``), partitioned by
bucket, is read only where some query probes.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.config import MAX_BROADCAST_BYTES, MIN_SCORE, REFERENCE_LIMIT, SCORE_DIGITS, written
from passagework.functions.chunking import ChunkPass
from passagework.functions.embedding import packed_vectors, unpacked_vectors

_CHUNKS_AT_ONCE = 8192
_QUERIES_AT_ONCE = 2048
_PAIRS_AT_ONCE = 8192
# chunks by queries whose products stay in a cache of the processor
_ROWS_AT_ONCE = 128
# components of the vectors for one of the short ones
_FOLDS = (8, 5, 4, 3, 2)
_DIRECTIONS, _QUERIES_PER_DIRECTION = 4, 1024
_SAMPLED_CHUNKS, _SAMPLED_QUERIES = 192, 512
# what scoring a pair and preparing a chunk take, measured in products of two components within a matrix product
_PAIR_COST, _SPARSE_PAIR_COST, _CHUNK_COST = 30_000, 10_000, 250_000
# hits that wait for their keys
_WAITING = 65_536
# a task holds their vectors twice, at 384 dimensions 200 MB; chunks are shuffled once a line
_QUERIES_PER_LINE = 65_536
_NORMS_AT_ONCE = 8192
_MOST_TASKS = 20_000
_TASKS_PER_CORE = 3

BITS = 8
# of a stored index: 64 folders a batch; more for large collections
INDEX_BITS = 6
RECALL = 0.95
# fixed value: slope of the logistic curve that comes closest to the normal distribution function
_LOGISTIC = 1.702


def top_k_similar(
    queries: DataFrame,
    chunks: DataFrame | ChunkPass,
    *,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    chunk_key: list[str],
    chunk_vector: str = "document_vector",
    carry: list[str] | None = None,
    texts: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    dim: int,
    k: int = REFERENCE_LIMIT,
    min_score: float = MIN_SCORE,
    queries_per_line: int = _QUERIES_PER_LINE,
) -> DataFrame:
    """Exact search: per query the best ``k`` chunks with ``(1 + cosine) / 2 >= min_score``.

    ``query_id`` is unique; NULL vectors match nothing. Ranked by score, ties by ``chunk_key``. Returns query id, rank,
    score, key and ``carry``; the latter is looked up for the hits in ``texts`` (``chunks`` if not given), or in what ``texts``
    gives for their keys.
    """
    made, chunks = (chunks, chunks.rows()) if isinstance(chunks, ChunkPass) else (None, chunks)
    rows = chunks.filter(F.col(chunk_vector).isNotNull()).select(*chunk_key, F.col(chunk_vector).alias("_vector"))
    asked = queries.filter(F.col(query_vector).isNotNull()).select(query_id, F.col(query_vector).alias("_vector"))
    hits = _search(asked, rows, query_id, chunk_key, dim, k, min_score, queries_per_line, hashed=False,
                   made=made and (made, chunk_vector))
    return _with_carried(hits, chunks if texts is None else texts, chunk_key, carry or [])


def top_k_similar_lsh(
    queries: DataFrame,
    chunks: DataFrame,
    *,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    chunk_key: list[str],
    chunk_vector: str = "document_vector",
    carry: list[str] | None = None,
    texts: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    dim: int,
    k: int = REFERENCE_LIMIT,
    min_score: float = MIN_SCORE,
    bits: int = BITS,
    recall: float = RECALL,
    queries_per_line: int = _QUERIES_PER_LINE,
) -> DataFrame:
    """Approximate search: exact scores inside the buckets that a query probes.

    ``recall`` is the probability that a chunk with exactly ``min_score`` lies in a probed bucket; those with higher scores
    are found more often. With ``recall=1`` every bucket is probed and the result equals the exact search.
    """
    rows = bucketed(chunks.filter(F.col(chunk_vector).isNotNull()), chunk_key, chunk_vector, dim, bits)
    return search_buckets(queries, rows, query_id=query_id, query_vector=query_vector, chunk_key=chunk_key, carry=carry,
                          texts=chunks if texts is None else texts, dim=dim, k=k, min_score=min_score, bits=bits,
                          recall=recall, queries_per_line=queries_per_line)


def bucketed(chunks: DataFrame, chunk_key: list[str], chunk_vector: str, dim: int, bits: int = BITS) -> DataFrame:
    """``(*chunk_key, bucket, packed)``: the bucket of every vector and its components as of ``packed_vectors``. Written partitioned by bucket this is the index that ``search_buckets`` reads. Nothing is shuffled."""
    planes = _planes(dim, bits)
    names = [*chunk_key, "bucket", "packed"]

    def run(batches):
        for batch in batches:
            column = batch.column(chunk_vector)
            held, matrix = pa.types.is_binary(column.type), _matrix(column, batch.num_rows, dim)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in chunk_key], pa.array(_bucket(matrix, planes)),
                 column if held else packed_vectors(matrix)], names=names)

    schema = T.StructType([*[chunks.schema[c] for c in chunk_key], T.StructField("bucket", T.IntegerType()),
                           T.StructField("packed", T.BinaryType())])
    return chunks.select(*chunk_key, chunk_vector).mapInArrow(run, schema)


def search_buckets(
    queries: DataFrame,
    index: DataFrame,
    *,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    chunk_key: list[str],
    carry: list[str] | None = None,
    texts: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    dim: int,
    k: int = REFERENCE_LIMIT,
    min_score: float = MIN_SCORE,
    bits: int = BITS,
    recall: float = RECALL,
    queries_per_line: int = _QUERIES_PER_LINE,
) -> DataFrame:
    """The hashed search over rows of ``bucketed``; ``carry`` is looked up in ``texts``.

    The buckets that any query probes, at most ``2 ** bits`` numbers, are gathered first, so that an index partitioned by
    bucket lists and reads no other files.
    """
    asked = queries.filter(F.col(query_vector).isNotNull()).select(query_id, F.col(query_vector).alias("_vector"))
    asked = written(_with_probes(asked, dim, bits, min_score, recall))
    probed = [b for b, in asked.select(F.explode(_buckets_of("_probes", bits)).alias("b")).distinct().collect()]
    rows = index.filter(F.col("bucket").isin(probed)).select(*chunk_key, "bucket", F.col("packed").alias("_vector"))
    hits = _search(asked, rows, query_id, chunk_key, dim, k, min_score, queries_per_line, hashed=True)
    return _with_carried(hits, texts, chunk_key, carry or [])


# ---- buckets ------------------------------------------------------------------------------


def _planes(dim: int, bits: int) -> np.ndarray:
    """Normals of random hyperplanes with entries +1 and -1, drawn from the hash of their place."""
    signs = [[hashlib.md5(f"{d}:{b}".encode(), usedforsecurity=False).digest()[0] < 128 for b in range(bits)]
             for d in range(dim)]
    return np.where(np.array(signs), 1.0, -1.0)


def _bucket(matrix: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return ((matrix.astype(np.float64) @ planes > 0) @ (1 << np.arange(planes.shape[1]))).astype(np.int32)


def probed_buckets(matrix: np.ndarray, planes: np.ndarray, min_score: float, recall: float) -> np.ndarray:
    """Which buckets each query probes, as flags.

    A neighbour at cosine ``c`` lies on the other side of a plane if its random part, of about ``sqrt(1 - c^2)`` over the
    root of the dimension, outweighs ``c`` times the query's margin. With the normal distribution as a logistic curve, the
    log-odds of a flip are proportional to that margin; so buckets by the sum of the margins to be flipped are buckets by
    probability, and the first ones that together reach ``recall`` are taken.
    """
    dim, bits = planes.shape
    codes = np.arange(1 << bits)
    cosine = min(max(2 * min_score - 1, 0.0), 1 - 1e-9)
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix, dtype=np.float64))
    side = matrix.astype(np.float64) @ planes
    margin = np.abs(side) / (np.where(norms > 0, norms, 1.0)[:, None] * math.sqrt(dim))
    odds = _LOGISTIC * margin * math.sqrt(dim) * cosine / math.sqrt(1 - cosine * cosine)
    stays = -np.log1p(np.exp(-odds))
    home = (side > 0) @ (1 << np.arange(bits))
    flips = ((codes[:, None] >> np.arange(bits)) & 1).astype(np.float64)
    out = np.zeros((len(matrix), 1 << bits), bool)
    for lo in range(0, len(matrix), _QUERIES_AT_ONCE):
        at = slice(lo, lo + _QUERIES_AT_ONCE)
        chance = np.round(np.exp(stays[at].sum(1)[:, None] - odds[at] @ flips.T), 12)
        order = np.lexsort((np.broadcast_to(codes, chance.shape), -chance))
        ranked = np.take_along_axis(chance, order, 1)
        before = np.cumsum(ranked, axis=1) - ranked
        taken = np.zeros_like(chance, bool)
        np.put_along_axis(taken, order, (np.round(before, 9) < recall) | (recall >= 1), 1)
        np.put_along_axis(out[at], home[at][:, None] ^ codes[None], taken, 1)
    return out


def _with_probes(asked: DataFrame, dim: int, bits: int, min_score: float, recall: float) -> DataFrame:
    """Add ``_probes``, a bit per bucket."""
    planes = _planes(dim, bits)
    schema = T.StructType([*asked.schema.fields, T.StructField("_probes", T.BinaryType())])

    def run(batches):
        for batch in batches:
            flags = probed_buckets(_matrix(batch.column("_vector"), batch.num_rows, dim), planes, min_score, recall)
            bits_ = [row.tobytes() for row in np.packbits(flags, axis=1, bitorder="little")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits_, pa.binary())], names=schema.names)

    return asked.mapInArrow(run, schema)


def _buckets_of(probes: str, bits: int):
    """Numbers of the bits that are set: of every byte, as hex, and every bit in it."""
    code = F.sequence(F.lit(0), F.lit((1 << bits) - 1))

    def is_set(b):
        byte = F.conv(F.substring(F.hex(probes), (F.shiftright(b, 3) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        return F.getbit(byte, b.bitwiseAND(F.lit(7))) == 1

    return F.filter(code, is_set)


# ---- cells --------------------------------------------------------------------------------


def _search(asked: DataFrame, rows: DataFrame, query_id: str, chunk_key: list[str], dim: int, k: int, min_score: float,
            queries_per_line: int, hashed: bool, made: tuple[ChunkPass, str] | None = None) -> DataFrame:
    """Ranked ``(query_id, score, *chunk_key)``. ``asked`` has ``_vector``, with ``hashed`` also ``_probes``, and ``rows``
    has ``_vector``, with ``hashed`` also ``bucket``. ``made`` is the pass that gives ``rows`` and its vector column."""
    spark = asked.sparkSession
    keys = [rows.schema[c] for c in chunk_key]
    schema = T.StructType([T.StructField(query_id, asked.schema[query_id].dataType), T.StructField("score", T.DoubleType()), *keys])
    n, size = _size_of(asked, hashed)
    most = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if size <= min(most, MAX_BROADCAST_BYTES):
        hits = _in_place(asked, rows, query_id, chunk_key, schema, dim, k, min_score, hashed, made)
        return _best(hits, query_id, chunk_key, k)
    lines = max(1, math.ceil(n / queries_per_line))
    # a few tasks a core at least, since the last ones to run leave cores without work
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    columns = max(1, math.ceil(wanted / lines))
    tasks = min(lines * columns, _MOST_TASKS)

    def cell(line, column):
        return (line * F.lit(columns) + column).cast("int")

    def null(field):
        return F.lit(None).cast(field.dataType).alias(field.name)

    # every row goes by its own hash, so that a task that runs again deals alike
    line = F.pmod(F.xxhash64(query_id), F.lit(lines))
    column = F.pmod(F.xxhash64(*chunk_key), F.lit(columns))
    extra = [T.StructField("bucket", T.IntegerType()), T.StructField("_probes", T.BinaryType())] if hashed else []
    alike = asked.schema["_vector"].dataType.simpleString() == rows.schema["_vector"].dataType.simpleString()
    vector_of = (lambda side: F.col("_vector")) if alike else _as_packed
    held = asked.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: cell(line, c))).alias("_cell"),
        F.lit(0).alias("_side"), F.col(query_id).alias("_query"), *[null(f) for f in keys],
        *[F.col(f.name) if f.name == "_probes" else null(f) for f in extra], vector_of(asked).alias("_vector"))
    every_line = F.explode(F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), lambda x: cell(x, column)))
    streamed = rows.select(
        (every_line if lines > 1 else cell(F.lit(0), column)).alias("_cell"), F.lit(1).alias("_side"),
        F.lit(None).cast(asked.schema[query_id].dataType).alias("_query"), *chunk_key,
        *[F.col(f.name) if f.name == "bucket" else null(f) for f in extra], vector_of(rows).alias("_vector"))
    order = ["_cell", "_side", *(["bucket"] if hashed else [])]
    dealt = held.unionAll(streamed).repartitionById(tasks, F.pmod("_cell", F.lit(tasks)).cast("int"))

    def run(batches):
        here, task = None, None
        for batch in batches:
            cells = batch.column("_cell").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if cells[lo] != here:
                    if task is not None:
                        yield from task.finish()
                    here, task = cells[lo], _Cell(schema, chunk_key, dim, k, min_score, hashed)
                task.add(batch.slice(lo, hi - lo))
        if task is not None:
            yield from task.finish()

    return _best(dealt.sortWithinPartitions(*order).mapInArrow(run, schema), query_id, chunk_key, k)


def _size_of(asked: DataFrame, hashed: bool) -> tuple[int, int]:
    """Number of queries and bytes of their vectors and probes."""
    kind = asked.schema["_vector"].dataType
    if isinstance(kind, T.BinaryType):
        of_vector = F.octet_length("_vector")
    else:
        of_vector = F.size("_vector") * (4 if isinstance(kind.elementType, T.FloatType) else 8)
    of_all = of_vector + F.octet_length("_probes") if hashed else of_vector
    n, size = asked.agg(F.count("*"), F.sum(of_all.cast("bigint"))).first()
    return n, size or 0


def _in_place(asked: DataFrame, rows: DataFrame, query_id: str, chunk_key: list[str], schema: T.StructType, dim: int, k: int,
              min_score: float, hashed: bool, made: tuple[ChunkPass, str] | None) -> DataFrame:
    """The best ``k`` chunks a query of every task, for queries that fit a broadcast."""
    extra = ["_probes"] if hashed else []
    held = asked.select(F.col(query_id).alias("_query"), "_vector", *extra).toArrow()
    sent = asked.sparkSession.sparkContext.broadcast(held.combine_chunks())

    def run(batches):
        task = _Cell(schema, chunk_key, dim, k, min_score, hashed)
        task.held = sent.value.to_batches()
        for batch in batches:
            if hashed and batch.num_rows:
                batch = batch.take(pc.sort_indices(batch.column("bucket")))
            task.stream(batch)
        yield from task.finish()

    if made is not None:
        chunks_of, vector = made[0].run, made[1]

        def make_and_run(batches):
            return run(b.select([*chunk_key, vector]).rename_columns([*chunk_key, "_vector"]) for b in chunks_of(batches))

        return made[0].source.mapInArrow(make_and_run, schema)
    more = ["bucket"] if hashed else []
    return rows.select(*chunk_key, *more, "_vector").mapInArrow(run, schema)


def _best(hits: DataFrame, query_id: str, chunk_key: list[str], k: int) -> DataFrame:
    """The best ``k`` of the hits of all tasks, with their ranks."""
    by_score = Window.partitionBy(query_id).orderBy(F.col("score").desc(), *[F.col(c) for c in chunk_key])
    return hits.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)


def _as_packed(rows: DataFrame):
    """One type for both sides of the union, where they differ: vectors of an index are bytes, others arrays of floats or doubles."""
    if isinstance(rows.schema["_vector"].dataType, T.BinaryType):
        return F.struct(F.lit(None).cast("array<double>").alias("wide"), F.lit(None).cast("array<float>").alias("list"),
                        F.col("_vector").alias("packed"))
    single = isinstance(rows.schema["_vector"].dataType.elementType, T.FloatType)
    none = F.lit(None)
    return F.struct(
        (none if single else F.col("_vector")).cast("array<double>").alias("wide"),
        (F.col("_vector") if single else none).cast("array<float>").alias("list"), none.cast("binary").alias("packed"))


class _Cell:
    """The queries of one cell, and the best ``k`` chunks of each among those that have passed."""

    def __init__(self, schema: T.StructType, chunk_key: list[str], dim: int, k: int, min_score: float, hashed: bool):
        self.names, self.chunk_key, self.dim, self.k = schema.names, chunk_key, dim, k
        self.min_score, self.hashed = min_score, hashed
        # the error of a product of single-precision unit vectors is below dim * 2^-24, and twice that is allowed for
        self.slack = (dim + 16) * 2.0**-23 + 10.0**-SCORE_DIGITS
        self.held, self.queries, self.found, self.rows = [], None, [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        sides = batch.column("_side").to_numpy()
        n = int(np.searchsorted(sides, 1))
        if n:
            self.held.append(batch.slice(0, n))
        self.stream(batch.slice(n))

    def stream(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        if self.queries is None:
            if not self.held:
                return
            self._start()
        chunk = _vectors(batch.column("_vector"), batch.num_rows, self.dim)
        edges = [0, batch.num_rows]
        if self.hashed:
            bucket = batch.column("bucket").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            which = np.flatnonzero(self.probes[:, bucket[lo]]) if self.hashed else None
            if which is not None and not len(which):
                continue
            for at in range(lo, hi, _CHUNKS_AT_ONCE):
                self._score(batch, chunk[at:min(hi, at + _CHUNKS_AT_ONCE)], at, which)

    def _start(self) -> None:
        held = pa.Table.from_batches(self.held).combine_chunks()
        self.ids = held.column("_query").combine_chunks()
        vectors = held.column("_vector").combine_chunks()
        self.queries = _vectors(vectors, len(held), self.dim)
        self.norms = np.concatenate([_squared_norms(self.queries[at]) for at in _slices(len(held))])
        self.directions, order = None, np.arange(len(held))
        self.edges = [0, len(held)]
        some = np.arange(0, len(held), max(1, len(held) // (_DIRECTIONS * _QUERIES_PER_DIRECTION)))
        if len(some) >= _DIRECTIONS * _QUERIES_PER_DIRECTION and 4 * np.count_nonzero(self.queries[some]) <= len(some) * self.dim:
            self.directions = _directions(_unit(self.queries[some], self.norms[some]))
            nearest = np.concatenate([_nearest(self._units(at), self.directions) for at in _slices(len(held))])
            order = np.argsort(nearest, kind="stable")
            self.edges = np.searchsorted(nearest[order], np.arange(_DIRECTIONS + 1)).tolist()
        self.ids, self.queries, self.norms = self.ids.take(pa.array(order)), self.queries[order], self.norms[order]
        self.best = np.full((len(held), self.k), -np.inf)
        self.least = np.full(len(held), -np.inf)
        self.seen, self.chosen_until = 0, 0
        # by directions of queries and chunks: how these are compared, the queries' vectors for that, and how many chunks came
        self.groups, self.theirs, self.met = {}, {}, Counter()
        self.room = _Room(_ROWS_AT_ONCE, _QUERIES_AT_ONCE)
        if self.hashed:
            raw = np.stack([np.frombuffer(p.as_buffer(), np.uint8) for p in held.column("_probes")])
            self.probes = np.unpackbits(raw, axis=1, bitorder="little").astype(bool)[order]
        self.held = []

    def _floor(self, which) -> np.ndarray:
        """The cosines that the queries ``which`` are after: the threshold, or the ``k``-th best so far."""
        return 2 * np.maximum(self.min_score, self.least[which]) - 1 - self.slack

    def _units(self, which) -> np.ndarray:
        return _unit(self.queries[which], self.norms[which])

    def _choose(self, of_queries: int, of_chunks: int, unit: np.ndarray, cost_of_pair: int, queries: int) -> None:
        """How these directions are compared: what would be cheapest for some of their chunks ``unit`` and queries.
        ``queries`` is how many a chunk meets; as many chunks as came so far are expected to come."""
        lo, hi = self.edges[of_queries:of_queries + 2]
        cost, chosen, prepare = math.inf, None, _CHUNK_COST / queries
        if prepare < self.dim:
            ours = unit[::max(1, len(unit) // _SAMPLED_CHUNKS)]
            which = np.arange(lo, hi, max(1, (hi - lo) // _SAMPLED_QUERIES))
            theirs, floor = self._units(which), self._floor(which)[None]
            load, cost = (np.abs(ours).mean(0), np.abs(theirs).mean(0)), self.dim + _PAIR_COST * (ours @ theirs.T >= floor).mean()
            last = math.inf
            for parts in sorted({self.dim // f for f in _FOLDS if self.dim >= 4 * f}):
                groups = _groups(*load, parts)
                near = _folded(ours, groups) @ _folded(theirs, groups).T >= floor - self.slack
                each = parts + prepare + cost_of_pair * near.mean()
                each += self.dim * parts * (1 / (hi - lo) + 1 / self.met[of_queries, of_chunks])
                if each < cost:
                    cost, chosen = each, groups
                if each > last:
                    break
                last = each
        key = of_queries, of_chunks
        before = self.groups.get(key)
        if chosen is None:
            self.groups[key] = None
            self.theirs.pop(key, None)
            if (of_queries, None) not in self.theirs:
                self.theirs[of_queries, None] = self._units(slice(lo, hi))
        elif before is None or before.shape != chosen.shape:
            self.groups[key] = chosen
            self.theirs[key] = np.concatenate([_folded(self._units(slice(lo + at.start, min(hi, lo + at.stop))), chosen)
                                               for at in _slices(hi - lo)])

    def _score(self, batch: pa.RecordBatch, chunk: np.ndarray, at: int, which: np.ndarray | None) -> None:
        """Keep what a slice of chunks has for the queries ``which``, all without it.

        A single-precision product of unit vectors, or of the short ones that is never below it, finds the pairs that can
        reach the threshold or the best scores so far, with its error allowed for. Only those pairs are scored in double
        precision, so the result is that of a double-precision product over all pairs.
        """
        norms = _squared_norms(chunk)
        unit, scorer = _unit(chunk, norms), _Pairs(chunk, self.queries)
        nearest = np.zeros(len(chunk), np.int64) if self.directions is None else _nearest(unit, self.directions)
        if self.seen >= self.chosen_until:
            self.stale, self.chosen_until = {*self.groups}, 4 * max(self.seen + len(chunk), 512)
        self.seen += len(chunk)
        waiting, n = [], 0
        for of_chunks in np.unique(nearest).tolist():
            rows = np.flatnonzero(nearest == of_chunks)
            mine = unit[rows]
            for of_queries, (lo, hi) in enumerate(zip(self.edges, self.edges[1:])):
                asked = slice(lo, hi) if which is None else which[slice(*np.searchsorted(which, (lo, hi)))]
                if lo == hi or which is not None and not len(asked):
                    continue
                key = of_queries, of_chunks
                self.met[key] += len(rows)
                if key not in self.groups or key in self.stale:
                    self._choose(*key, mine, scorer.cost, len(self.queries) if which is None else len(which))
                    self.stale.discard(key)
                folded = self.groups[key] is not None
                ours, theirs = (_folded(mine, self.groups[key]), self.theirs[key]) if folded else (mine, self.theirs[of_queries, None])
                for q in range(lo, hi, _QUERIES_AT_ONCE) if which is None else range(0, len(asked), _QUERIES_AT_ONCE):
                    some = slice(q, min(hi, q + _QUERIES_AT_ONCE)) if which is None else asked[q:q + _QUERIES_AT_ONCE]
                    there = theirs[q - lo:q - lo + _QUERIES_AT_ONCE] if which is None else theirs[some - lo]
                    floor = (self._floor(some) - self.slack * folded).astype(np.float32)
                    if folded and floor.min() > 0.1:
                        # to compare with one number is faster; the rounding is far below the slack
                        there, floor = there / floor[:, None], np.float32(1)
                    ci, qi, near = self.room.reaching(ours, there, floor)
                    if not len(ci):
                        continue
                    if not folded:
                        ci, qi = _contenders(ci, qi, near, self.k, 2 * self.slack)
                    ci, own = rows[ci], qi + q if which is None else some[qi]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        cosine = scorer.products(ci, own) / np.sqrt(norms[ci] * self.norms[own])
                        score = np.round((1.0 + cosine) / 2.0, SCORE_DIGITS)
                    enough = score >= np.maximum(self.min_score, self.least[own])
                    if enough.any():
                        ci, own, score = ci[enough], own[enough], score[enough]
                        self._raise(own, score)
                        enough = score >= self.least[own]
                        waiting.append((ci[enough], own[enough], score[enough]))
                        n += len(waiting[-1][0])
                        if n > _WAITING:
                            self._keep(batch, at, waiting)
                            waiting, n = [], 0
        self._keep(batch, at, waiting)

    def _raise(self, own: np.ndarray, score: np.ndarray) -> None:
        """Take scores among the best of their queries; the ``k``-th is what later chunks have to reach."""
        order = np.lexsort((-score, own))
        own, score = own[order], score[order]
        asked, first, of = np.unique(own, return_index=True, return_inverse=True)
        place = np.arange(len(own)) - first[of]
        top = place < self.k
        new = np.full((len(asked), self.k), -np.inf)
        new[of[top], place[top]] = score[top]
        self.best[asked] = -np.partition(-np.concatenate([self.best[asked], new], 1), self.k - 1, axis=1)[:, :self.k]
        self.least[asked] = self.best[asked].min(1)

    def _keep(self, batch: pa.RecordBatch, at: int, waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        if not waiting:
            return
        ci, own, score = map(np.concatenate, zip(*waiting))
        rows = pa.array(at + ci)
        keys = [batch.column(c).take(rows) for c in self.chunk_key]
        self.found.append(pa.table([pa.array(own), pa.array(score), *keys], names=["_q", *self.names[1:]]))
        self.rows += len(own)
        if self.rows > 4 * self.k * len(self.queries) + 4096:
            self._compact()

    def _compact(self) -> None:
        """The best ``k`` per query of all that was kept."""
        if not self.found:
            return
        table = pa.concat_tables(self.found)
        by = [("_q", "ascending"), ("score", "descending"), *[(c, "ascending") for c in self.chunk_key]]
        table = table.take(pc.sort_indices(table, sort_keys=by))
        q = table.column("_q").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        table = table.filter(pa.array(place < self.k)).combine_chunks()
        self.found, self.rows = [table], len(table)

    def finish(self):
        self._compact()
        for table in self.found:
            ids = self.ids.take(table.column("_q").combine_chunks())
            for batch in table.drop_columns("_q").add_column(0, self.names[0], ids).to_batches():
                yield batch


class _Room:
    """Where the products of some rows with others go, used again for the next ones."""

    def __init__(self, rows: int, others: int):
        self.rows = rows
        self.near = np.empty(rows * others, np.float32)
        self.flags = np.empty(rows * -(-others // 8) * 8, bool)

    def reaching(self, left: np.ndarray, right: np.ndarray, floor: np.ndarray | np.float32):
        """Places and products of the pairs that reach the floor, or that of their row of ``right``."""
        wide, found = -(-len(right) // 8) * 8, []
        for lo in range(0, len(left), self.rows):
            some = left[lo:lo + self.rows]
            near = self.near[:len(some) * len(right)].reshape(len(some), len(right))
            flags = self.flags[:len(some) * wide].reshape(len(some), wide)
            flags[:, len(right):] = False
            np.matmul(some, right.T, out=near)
            np.greater_equal(near, floor, out=flags[:, :len(right)])
            # few are set: eight at a time are looked at
            eight = np.flatnonzero(flags.view(np.uint64) != 0)
            if len(eight):
                which, bit = np.nonzero(flags.reshape(-1, 8)[eight])
                ci, qi = np.divmod(8 * eight[which] + bit, wide)
                found.append((ci + lo, qi, near[ci, qi]))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(map(np.concatenate, zip(*found)))


class _Pairs:
    """Double-precision products of chunks with queries, from the chunks' components that are not zero where these are few."""

    def __init__(self, chunk: np.ndarray, queries: np.ndarray):
        self.chunk, self.queries, self.cost, self.places = chunk, queries, _PAIR_COST, None
        rows, places = np.nonzero(chunk)
        counts = np.bincount(rows, minlength=len(chunk))
        most = int(counts.max(initial=0))
        if 0 < 4 * most <= chunk.shape[1]:
            column = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            self.cost = _SPARSE_PAIR_COST
            self.places, self.values = np.zeros((len(chunk), most), np.int64), np.zeros((len(chunk), most))
            self.places[rows, column], self.values[rows, column] = places, chunk[rows, places]

    def products(self, ci: np.ndarray, own: np.ndarray) -> np.ndarray:
        return np.concatenate([self._some(ci[p:p + _PAIRS_AT_ONCE], own[p:p + _PAIRS_AT_ONCE])
                               for p in range(0, len(ci), _PAIRS_AT_ONCE)])

    def _some(self, ci: np.ndarray, own: np.ndarray) -> np.ndarray:
        if self.places is None:
            return np.einsum("ij,ij->i", self.chunk[ci].astype(np.float64), self.queries[own].astype(np.float64))
        at = self.places[ci]
        at += own[:, None] * self.queries.shape[1]
        return np.einsum("ij,ij->i", self.queries.reshape(-1).take(at).astype(np.float64), self.values[ci])


def _directions(units: np.ndarray) -> np.ndarray:
    """Directions around which the vectors lie, by a few rounds of spherical k-means."""
    found = units[:: len(units) // _DIRECTIONS][:_DIRECTIONS]
    for _ in range(6):
        nearest = _nearest(units, found)
        sums = np.stack([units[nearest == i].sum(0) for i in range(len(found))])
        found = _unit(sums, _squared_norms(sums))
    return found


def _nearest(units: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return (units @ directions.T).argmax(1)


def _groups(ours: np.ndarray, theirs: np.ndarray, parts: int) -> np.ndarray:
    """A column for each of ``parts`` groups of components, with ones for its members. With the mean components of both
    sides, the largest are dealt first, each to the group where it least often meets another one of the other side."""
    ours, theirs = ours + 1e-4, theirs + 1e-4
    out, of_ours, of_theirs = np.zeros((len(ours), parts), np.float32), np.zeros(parts), np.zeros(parts)
    for i in np.argsort(-ours * theirs, kind="stable"):
        group = (ours[i] * of_theirs + theirs[i] * of_ours).argmin()
        out[i, group] = 1
        of_ours[group] += ours[i]
        of_theirs[group] += theirs[i]
    return out


def _folded(unit: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Norms of the vectors within the groups."""
    return np.sqrt((unit * unit) @ groups)


def _slices(rows: int) -> list[slice]:
    return [slice(at, at + _NORMS_AT_ONCE) for at in range(0, rows, _NORMS_AT_ONCE)]


def _matrix(vectors: pa.Array, rows: int, dim: int) -> np.ndarray:
    if pa.types.is_binary(vectors.type):
        return unpacked_vectors(vectors, dim)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if flat.size != rows * dim:
        raise ValueError(f"vectors must have {dim} dimensions")
    return flat.reshape(rows, dim)


def _vectors(vectors: pa.Array, rows: int, dim: int) -> np.ndarray:
    """The vectors, as they are or of ``_as_packed``, whichever form they have."""
    if not pa.types.is_struct(vectors.type):
        return _matrix(vectors, rows, dim)
    wide, listed, packed = vectors.flatten()
    if listed.null_count == 0:
        return _matrix(listed, rows, dim)
    if wide.null_count == 0:
        return _matrix(wide, rows, dim)
    return _matrix(packed, rows, dim)


def _contenders(ci, qi, near, k: int, margin: float):
    """Drop pairs that k others of the same query beat by more than the error of both."""
    order = np.lexsort((-near, qi))
    ci, qi, near = ci[order], qi[order], near[order]
    first = np.searchsorted(qi, qi, side="left")
    kth = np.minimum(first + k - 1, np.searchsorted(qi, qi, side="right") - 1)
    keep = near >= near[kth] - np.float32(margin)
    return ci[keep], qi[keep]


def _squared_norms(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return np.einsum("ij,ij->i", rows, rows)


def _unit(rows: np.ndarray, squared_norms: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.where(squared_norms > 0, squared_norms, 1.0))
    return (rows / scale[:, None]).astype(np.float32)


def _with_carried(hits: DataFrame, texts, chunk_key: list[str], carry: list[str]) -> DataFrame:
    """The further columns of the hits. They are written first, so that their size is known: Spark broadcasts a small
    table of hits to the scan of ``texts`` and shuffles both sides otherwise."""
    missing = [c for c in carry if c not in chunk_key]
    if not missing:
        return hits
    hits = written(hits)
    texts = texts(hits.select(*chunk_key)) if callable(texts) else texts
    return hits.join(texts.select(*chunk_key, *missing), chunk_key)
