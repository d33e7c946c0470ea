"""Near-duplicate vectors: navigable graphs per shard, audited beams, verified cosines, united components.

Equal vectors of a label are one class with a number of copies, so a hot group of copies is one node. The classes of a
label are dealt into shards by the hash of their smallest id; each shard gets one graph. The shards of a label meet in the
cells of a grid: the vectors of one are searched in the graph of the other and the other way round. A beam that is full of
links doubles. A hashed part of the queries is audited against all vectors of the shard, and beams widen until the audit
finds every link; where it still fails at the widest beam, its failing queries are compared with the shard exactly, and so
are all that link with what these link with. Shards of up to 256 vectors are compared at once. What was found is verified in
double precision. A task returns per vector its number of links and the smallest id it hangs together with there, never
pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm import hnsw
from passagework.llm.neighbors import dealt, matrix, number_of_shards, one_per_id, usable
from passagework.llm.products import dealt_to_cells
from passagework.llm.shared import Scratch, arrow_rows, components, mix
from passagework.operators import grid

MIN_COSINE = 0.93
SHARD_ROWS = 4096
FIRST_BEAM = 32
WIDEST_BEAM = 512
AUDIT_ONE_IN = 8
HELD_SHARDS = 4
# a shard of so few vectors needs no graph to be searched in
_SMALL = 256
_SLACK = 1e-5


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", min_cosine: float = MIN_COSINE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per id: ``n_links`` (other vectors of its label with cosine >= ``min_cosine``), ``component_id`` (smallest
    id reachable by links) and ``kept``.

    A null label, or a vector that is null, empty, zero or holds a null or non-finite component, links with nothing;
    vectors of different length never link. Repeated ids count once (the smallest row), null ids are left out, other
    columns are ignored, an empty table gives no rows. Directions are taken after scaling, so components of any finite size
    count.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = one_per_id(vectors, id_col, [label_col, vector_col]).select(
        "_id", F.col(label_col).alias("_label"), F.col(vector_col).alias("_vector"))
    good = rows.filter(F.col("_label").isNotNull() & usable("_vector")).withColumns({
        "_dim": F.size("_vector"), "_h1": F.xxhash64("_vector"), "_h2": F.xxhash64(F.lit("second"), "_vector")})
    same = ["_label", "_dim", "_h1", "_h2"]
    classes = good.groupBy(*same).agg(F.min("_id").alias("_rep"), F.count("*").alias("_copies"),
                                      F.min("_vector").alias("_vector"))
    index = scratch.write(_shards(classes, shard_rows))
    touched = scratch.write(_links(index, min_cosine))
    group = components(touched.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    links = touched.groupBy("node").agg(F.sum("n").alias("_n"))
    known = (
        good.select("_id", *same).join(classes.select(*same, "_rep", "_copies"), same)
        .join(links, F.col("_rep") == F.col("node"), "left").drop("node")
        .join(group, F.col("_rep") == F.col("node"), "left")
        .select("_id", (F.coalesce("_n", F.lit(0)) + F.col("_copies") - 1).alias("n_links"),
                F.coalesce("component", "_rep").alias("component_id"))
    )
    out = rows.select("_id").join(known, "_id", "left").select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "_id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def _shards(classes: DataFrame, shard_rows: int) -> DataFrame:
    """A row per label, length and shard: ids, copies, directions and their graph. Each shard is built in its own task."""
    key = ["_label", "_dim"]
    rows = classes.withColumnRenamed("_rep", "_id").select(
        "_id", "_copies", "_vector", "_dim", F.col("_label").cast("string").alias("_label"))
    rows = dealt(rows, key, shard_rows).repartition(number_of_shards(rows, key, shard_rows), *key, "_shard")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_id")
        ids, values = table.column("_id").to_numpy(), matrix(table.column("_vector"), table.column("_dim")[0].as_py())
        unit = directions(values)
        one = {c: table.column(c)[:1].combine_chunks() for c in ("_label", "_dim", "_shard")}
        return pa.table({**one, "_ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                         "_copies": pa.array([table.column("_copies").to_numpy().astype("<i8").tobytes()], pa.binary()),
                         "_unit": pa.array([unit.astype("<f8").tobytes()], pa.binary()),
                         "_graph": pa.array([shard_graph(unit, ids).to_bytes()], pa.binary())})

    return rows.groupBy(*key, "_shard").applyInArrow(
        run, "_label string, _dim int, _shard int, _ids binary, _copies binary, _unit binary, _graph binary")


def directions(values: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, scaled first so that no square overflows or vanishes."""
    values = values.astype(np.float64)
    values = np.ldexp(values, -np.frexp(np.abs(values).max(1))[1][:, None])
    return values / np.linalg.norm(values, axis=1)[:, None]


def shard_graph(unit: np.ndarray, ids: np.ndarray) -> hnsw.Graph:
    """The graph of a shard, its lowest level connected: from every part that hangs together a node is linked both ways
    with the nearest one outside, until there is one part."""
    graph = hnsw.build(unit.astype(np.float32), ids)
    if len(unit) <= _SMALL:
        return graph
    while True:
        part = parts(graph.levels[0])
        roots, sizes = np.unique(part, return_counts=True)
        if len(roots) == 1:
            return graph
        bridges = np.full((len(part), 1), -1, np.int32)
        for root in roots[np.argsort(sizes)][:-1].tolist():
            outside = np.flatnonzero((part != root) & (bridges[:, 0] < 0))
            if bridges[root, 0] >= 0 or not len(outside):
                continue
            near = outside[np.argmax(graph.vectors[outside] @ graph.vectors[root])]
            bridges[root, 0], bridges[near, 0] = near, root
        graph.levels[0] = np.hstack([graph.levels[0], bridges])


def parts(lists: np.ndarray) -> np.ndarray:
    """Smallest node that each node hangs together with, links taken both ways."""
    n = len(lists)
    a = np.repeat(np.arange(n), lists.shape[1])
    b = lists.ravel()
    a, b = a[b >= 0], b[b >= 0]
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, new[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _links(index: DataFrame, min_cosine: float) -> DataFrame:
    """``(node, n, root)``: links of a vector in one pair of shards and the smallest id it hangs together with there."""
    key = ["_label", "_dim"]
    blocks = grid.packed(index.select(*key, "_shard", F.col("_shard").alias("number"), F.col("_dim").alias("dim"),
                                      "_ids", "_copies", "_unit", "_graph"), [*key, "_shard"], 1)
    held = blocks.withColumn("_line", F.expr(f"_shard div {HELD_SHARDS}").cast("int")).drop("_shard")
    streamed = blocks.withColumn("_place", F.col("_shard")).withColumn("at", F.col("_shard")).drop("_shard")
    held, streamed, tasks = dealt_to_cells(held, streamed, key)
    return grid.meet(held, streamed, lambda shards: Meeting(shards, min_cosine), "node long, n long, root long", tasks=tasks)


class Meeting:
    """Shards held in a cell; each meets the streamed ones of the same or a higher number."""

    def __init__(self, blocks: list[pa.RecordBatch], min_cosine: float):
        self.held, self.min_cosine = [Shard.of(b) for b in blocks], min_cosine

    def add(self, block: pa.RecordBatch):
        other = Shard.of(block)
        for shard in self.held:
            if shard.number <= other.number:
                found = link_shards(shard, None if shard.number == other.number else other, self.min_cosine)
                yield arrow_rows(["node", "n", "root"], [pa.array(c) for c in found])

    def finish(self):
        return None


class Shard:
    def __init__(self, ids, copies, unit, graph, number=0):
        self.ids, self.copies, self.unit, self.graph, self.number = ids, copies, unit, graph, number
        # pairs that were compared, for tests
        self.compared = 0

    @staticmethod
    def of(block: pa.RecordBatch) -> Shard:
        ids, copies = (np.frombuffer(block.column(c)[0].as_buffer(), "<i8") for c in ("_ids", "_copies"))
        unit = np.frombuffer(block.column("_unit")[0].as_buffer(), "<f8").reshape(-1, block.column("dim")[0].as_py())
        graph = hnsw.Graph.from_bytes(block.column("_graph")[0].as_buffer().to_pybytes())
        return Shard(ids, copies, unit, graph, block.column("number")[0].as_py())


def link_shards(a: Shard, b: Shard | None, min_cosine: float):
    """Links between two shards, or inside ``a`` if ``b`` is None: ids, links in copies, and smallest connected id."""
    inside = b is None
    b = a if inside else b
    linked = found_links(b, a, min_cosine)
    linked |= (linked if inside else found_links(a, b, min_cosine)).T
    if inside:
        np.fill_diagonal(linked, False)
    n_a, n_b = len(a.ids), len(b.ids)
    label = np.arange(n_a if inside else n_a + n_b)
    shift = 0 if inside else n_a
    count_a, count_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    for lo in range(0, n_a, 256):
        r, c = np.nonzero(linked[lo:lo + 256])
        if not len(r):
            continue
        cosines = np.concatenate([np.einsum("ij,ij->i", a.unit[lo + r[at:at + 65_536]], b.unit[c[at:at + 65_536]])
                                  for at in range(0, len(r), 65_536)])
        enough = cosines >= min_cosine
        r, c = lo + r[enough], c[enough]
        np.add.at(count_a, r, b.copies[c])
        np.add.at(count_b, c, a.copies[r])
        starts = np.flatnonzero(np.diff(r, prepend=-1))
        for first, last in zip(starts.tolist(), [*starts[1:].tolist(), len(r)]):
            roots = np.unique(np.append(label[shift + c[first:last]], label[r[first]]))
            if len(roots) > 1:
                label[np.isin(label, roots[1:])] = roots[0]
    ids = a.ids if inside else np.concatenate([a.ids, b.ids])
    count = count_a if inside else np.concatenate([count_a, count_b])
    lowest = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(lowest, label, ids)
    hit = count > 0
    return ids[hit], count[hit], lowest[label][hit]


def found_links(shard: Shard, asking: Shard, min_cosine: float) -> np.ndarray:
    """Matrix of the vectors of ``asking`` and the nodes of ``shard`` within the cosine, as beams and audits find them."""
    graph, queries = shard.graph, asking.graph.vectors
    n = len(graph.vectors)
    limit = np.float32(2 - 2 * min_cosine + _SLACK)
    linked = np.zeros((len(queries), n), bool)
    everyone = np.arange(len(queries))
    if n <= _SMALL:
        _compare(shard, queries, everyone, linked, limit)
        return linked
    audited = np.flatnonzero(mix(asking.ids.astype(np.int64).view(np.uint64)) % np.uint64(AUDIT_ONE_IN) == 0)
    exact = np.zeros((len(audited), n), bool)
    _compare(shard, queries[audited], np.arange(len(audited)), exact, limit - np.float32(2 * _SLACK))
    beam = FIRST_BEAM
    while True:
        rows, width = everyone, beam
        while len(rows) and width <= n:
            full = []
            step = max(1, (1 << 20) // width)
            for lo in range(0, len(rows), step):
                some = rows[lo:lo + step]
                ids, dist = hnsw.search(graph, queries[some], width)
                shard.compared += ids.size
                within = (dist <= limit) & (ids >= 0)
                r, c = np.nonzero(within)
                linked[some[r], ids[r, c]] = True
                full.append(some[within[:, -1]])
            rows, width = np.concatenate(full), 2 * width
        # beams as wide as the shard that are full of links: such a vector is compared with all
        _compare(shard, queries, rows, linked, limit)
        missed = (exact & ~linked[audited]).any(1)
        if not missed.any():
            return linked
        if 4 * beam > min(n, WIDEST_BEAM):
            break
        beam *= 4
    # the audit still fails: its queries, and those that the failing ones are near to, are compared with the whole shard
    linked[audited] |= exact
    wrong = audited[missed]
    near = np.zeros(len(queries), bool)
    reached = linked[wrong].any(0)
    for lo in range(0, len(queries), 1024):
        near[lo:lo + 1024] = linked[lo:lo + 1024][:, reached].any(1)
    near[wrong] = True
    _compare(shard, queries, np.flatnonzero(near), linked, limit)
    return linked


def _compare(shard: Shard, queries: np.ndarray, rows: np.ndarray, linked: np.ndarray, limit) -> None:
    """Compare some queries with every vector of a shard, a block at a time."""
    for lo in range(0, len(rows), 256):
        some = rows[lo:lo + 256]
        shard.compared += len(some) * len(shard.graph.vectors)
        linked[some] |= 2 - 2 * (queries[some] @ shard.graph.vectors.T) <= limit
