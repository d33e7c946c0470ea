"""Near-duplicate documents by HyperMinHash registers, bands, canopies and exact verification.

1. Every text becomes its set of hashed word shingles and a sketch: one register per bucket with the number of leading
   zeros and some mantissa bits of the bucket's smallest hash; empty buckets borrow in a fixed hashed order. Documents with
   equal sets become one class.
2. Bands of registers give bucket keys. Keys held by one class only are dropped by a count, so only (key, id) rows of
   classes that meet another are joined with their sketches.
3. Inside a key, canopies around hashed centres link what may belong together: a member loosely similar to a centre (by
   the collision-corrected estimate) is joined to it, and only members well above that leave the round, so a pair at
   the threshold shares a canopy. What a batch of keys joins is passed on as one edge per member. A key with very many members is linked without estimates. No pairs are emitted.
4. The connected candidates are dealt into blocks of bounded size, their sets travel once, and a search from set to set
   confirms links exactly. Blocks of one candidate component meet in pairs; a task returns one row per document.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.shared import Scratch, arrow_rows, components, mix, ngram_hashes, text_slices, word_hashes

BANDS = 40
ROWS_PER_BAND = 5
MANTISSA_BITS = 10
# a canopy links from LOOSE on, and a member leaves the round from TIGHT on; the gap is the distance that a pair at the
# threshold may lie apart, with room for the error of the estimate
LOOSE = 0.25
TIGHT = 0.65
CANOPY_ROWS = 8192
BLOCK_DOCUMENTS = 2048


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word runs of a text; ASCII letters count in lower case. Few words are one run."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(ngram_hashes(word_hashes(words), min(width, len(words))))


@lru_cache(maxsize=4)
def _turns(registers: int) -> np.ndarray:
    """Hashed order in which each bucket asks the others for a value when it has none."""
    cells = np.arange(registers * registers, dtype=np.uint64).reshape(registers, registers)
    return mix(cells + np.uint64(0x51ED270B))


def sketch(values: np.ndarray, registers: int) -> np.ndarray:
    """HyperMinHash registers of a non-empty set: leading zeros above mantissa bits, as 16-bit numbers."""
    spread = mix(values)
    bucket = ((spread >> np.uint64(40)) * np.uint64(registers)) >> np.uint64(24)
    rest = mix(spread + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
    by = np.lexsort((rest, bucket))
    bucket, rest = bucket[by].astype(np.int64), rest[by]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    lowest = np.full(registers, np.iinfo(np.uint64).max, np.uint64)
    lowest[bucket[first]] = rest[first]
    empty, filled = lowest == np.iinfo(np.uint64).max, np.flatnonzero(lowest < np.iinfo(np.uint64).max)
    if empty.any():
        turn = _turns(registers)
        lowest[empty] = lowest[filled[turn[np.ix_(empty, filled)].argmin(1)]]
    mantissa, exponent = np.frexp(lowest.astype(np.float64) + 0.5)
    zeros = (53 - np.clip(exponent, 0, 53)).astype(np.uint16)
    fine = ((mantissa - 0.5) * 2 * (1 << MANTISSA_BITS)).astype(np.uint16)
    return (zeros << np.uint16(MANTISSA_BITS)) | fine


def estimate(one: np.ndarray, many: np.ndarray, n_one: int, n_many: np.ndarray) -> np.ndarray:
    """Jaccard estimates of one sketch with many: the share of equal registers less what chance makes equal.

    Chance is the sum over the leading zeros of the probability that both sets have them, over the mantissa values.
    """
    equal = (one[None] == many).mean(1)
    size = np.maximum(np.minimum(n_one, n_many) / one.shape[0], 1.0)
    steps = 2.0 ** -np.arange(54)
    below = np.exp(-size[:, None] * steps[None])
    chance = (np.diff(below, axis=1) ** 2).sum(1) / (1 << MANTISSA_BITS)
    return np.maximum(equal - chance, 0) / (1 - chance)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, registers: int) -> DataFrame:
    """``(id, n, h1, h2, registers)`` per row; the hashes name the set. Empty sets have no registers."""

    def run(batches):
        for batch in text_slices(batches):
            n, h1, h2, out = [], [], [], []
            for text in batch.column(1).to_pylist():
                values = shingle_set(text, width)
                n.append(len(values))
                with np.errstate(over="ignore"):
                    h1.append(int(mix(values).sum().astype(np.uint64).view(np.int64)) if len(values) else 0)
                    h2.append(int(mix(values ^ np.uint64(0x5555555555555555)).sum().view(np.int64)) if len(values) else 0)
                out.append(sketch(values, registers).astype("<u2").tobytes() if len(values) else None)
            yield arrow_rows(["id", "n", "h1", "h2", "registers"], [
                batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(h1, pa.int64()),
                pa.array(h2, pa.int64()), pa.array(out, pa.binary())])

    return docs.select(id_col, text_col).mapInArrow(run, "id long, n long, h1 long, h2 long, registers binary")


def candidate_edges(classes: DataFrame, bands: int, rows: int, canopy_rows: int) -> DataFrame:
    """``(a, b)`` edges that connect all classes which may be similar, at most a few per class and key."""
    size = 2 * rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                       lambda i: F.xxhash64(i, F.substr("registers", i * size + 1, F.lit(size))))
    keyed = classes.select("id", F.explode(keys).alias("key"))
    shared = keyed.groupBy("key").agg(
        F.count("*").alias("members"), F.min("id").alias("lowest"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who")).filter("members > 1")
    # keys with the very same members ask the same question
    shared = shared.groupBy("members", "lowest", "who").agg(F.min("key").alias("key")).drop("who")
    met = keyed.join(shared, "key")
    large = met.filter((F.col("members") > canopy_rows) & (F.col("id") != F.col("lowest"))).select(
        F.col("lowest").alias("a"), F.col("id").alias("b"))
    small = met.filter(F.col("members") <= canopy_rows).select("key", "id", "members")
    with_sketch = small.join(classes.select("id", "n", "registers"), "id")
    dealt = with_sketch.repartition("key").sortWithinPartitions("key", "id").select("key", "id", "n", "registers")
    near = dealt.mapInArrow(_canopies, "a long, b long")
    # a member has few centres, at most some per band: it stays with the lowest one, which the others join
    centres = near.unionAll(large).groupBy("b").agg(F.collect_set("a").alias("centres"))
    lowest = F.array_min("centres")
    return centres.select(lowest.alias("a"), F.explode(F.concat("centres", F.array("b"))).alias("b")).filter(
        "a <> b").distinct()


def _canopies(batches):
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        key = batch.column(0).to_numpy()
        if key[0] == key[-1] and held[0].column(0)[0].as_py() == key[0]:
            continue  # the whole of what is held has one key; its members are bounded
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        yield from _canopy_edges(table.slice(0, cut))
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield from _canopy_edges(pa.Table.from_batches(held).combine_chunks())


def _canopy_edges(table: pa.Table):
    keys, ids, n = (table.column(c).to_numpy() for c in ("key", "id", "n"))
    if not len(ids):
        return
    raw = b"".join(table.column("registers").to_pylist())
    registers = np.frombuffer(raw, "<u2").reshape(len(ids), -1)
    edges = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1 if keys[0] > -(1 << 62) else keys[0] + 1))
    sizes = np.diff(np.append(edges, len(keys)))
    a, b = [], []
    for first, size in zip(edges[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        order = first + np.argsort(mix(ids[first:first + size].view(np.uint64)), kind="stable")
        own, count = registers[order], n[order]
        left = np.arange(size)
        while len(left):
            centre = left[0]
            # those that left earlier rounds lay close to another centre with all that may belong to them
            like = estimate(own[centre], own[left], int(count[centre]), count[left])
            near = left[(like >= LOOSE) & (left != centre)]
            a.append(np.full(len(near), ids[order[centre]]))
            b.append(ids[order[near]])
            left = left[(like < TIGHT) & (left != centre)]
    if a:
        yield arrow_rows(["a", "b"], _hung_together(np.concatenate(a), np.concatenate(b)))


def _hung_together(a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    """What the edges connect, as one edge from the smallest id of each component to every other member."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = ends[:len(a)], ends[len(a):]
    root = np.arange(len(ids))
    while True:
        least = np.minimum(root[one], root[two])
        new = root.copy()
        for end in (one, two):
            np.minimum.at(new, end, least)
            np.minimum.at(new, root[end], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(ids)))
    return [pa.array(ids[root[other]]), pa.array(ids[other])]


def confirm(docs: DataFrame, groups: DataFrame, scratch: Scratch, *, id_col: str, text_col: str, width: int,
            similar: tuple[int, int], block_documents: int) -> DataFrame:
    """``(node, component)`` of exact links among documents of the same candidate group."""
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / F.lit(block_documents)).cast("int").alias("blocks"))
    placed = groups.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def sets(batches):
        for batch in text_slices(batches):
            out = [shingle_set(t, width).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
            yield arrow_rows(["node", "set"], [batch.column(0).cast(pa.int64()), pa.array(out, pa.binary())])

    # only documents of a group are read into sets; a repeated id keeps one of its texts per set
    wanted = docs.join(placed.select(F.col("node").alias("_n")), F.col(id_col) == F.col("_n"), "left_semi")
    hashed = wanted.select(id_col, text_col).mapInArrow(sets, "node long, set binary").join(placed, "node")
    single = hashed.filter("blocks = 1").withColumn("part", F.lit(0)).select("component", "part", "block", "node", "set")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                         lambda o: F.least("block", o) * F.col("blocks") + F.greatest("block", o))
    several = hashed.filter("blocks > 1").withColumn("part", F.explode(F.array_distinct(others))).select(
        "component", "part", "block", "node", "set")
    dealt = single.unionAll(several).repartition("component", "part").sortWithinPartitions("component", "part", "node")

    def run(batches):
        held, key = [], None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:2] != key:
                    if held:
                        yield _exact_groups(held, similar)
                    held, key = [], row[:2]
                held.append(row[2:])
        if held:
            yield _exact_groups(held, similar)

    found = scratch.write(dealt.mapInArrow(run, "a long, b long"))
    return components(found, scratch)


def _exact_groups(rows, similar) -> pa.RecordBatch:
    """Each document with the smallest one it hangs together with, by a search from set to set.

    A popped document is compared with all unvisited ones at once: the members of its set are marked, and marks are
    summed over the others' members.
    """
    need, of = similar
    nodes = np.array([r[1] for r in rows], np.int64)
    sets = [np.frombuffer(r[2], "<u8") for r in rows]
    sizes = np.array([len(s) for s in sets], np.int64)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, np.int64)
    left = np.flatnonzero(sizes > 0)
    root = np.arange(len(nodes))
    while len(left):
        first, left = left[0], left[1:]
        waiting = [first]
        members = [first]
        flat, offsets = _gather(codes, starts, ends, left)
        while waiting and len(left):
            at = waiting.pop()
            mark[codes[starts[at]:ends[at]]] = 1
            both = np.add.reduceat(mark[flat], offsets)
            mark[codes[starts[at]:ends[at]]] = 0
            link = of * both >= need * (sizes[at] + sizes[left] - both)
            if link.any():
                new = left[link]
                members.extend(new.tolist())
                waiting.extend(new.tolist())
                left = left[~link]
                flat, offsets = _gather(codes, starts, ends, left)
        members = np.array(members)
        root[members] = members[np.argmin(nodes[members])]
    return arrow_rows(["a", "b"], [pa.array(nodes), pa.array(nodes[root])])


def _gather(codes, starts, ends, some):
    if not len(some):
        return codes[:0], np.empty(0, np.int64)
    flat = np.concatenate([codes[s:e] for s, e in zip(starts[some].tolist(), ends[some].tolist())])
    lengths = ends[some] - starts[some]
    return flat, np.cumsum(lengths) - lengths


def near_duplicate_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                             similar: tuple[int, int] = (80, 100), bands: int = BANDS, rows: int = ROWS_PER_BAND,
                             canopy_rows: int = CANOPY_ROWS, block_documents: int = BLOCK_DOCUMENTS) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``kept``.

    Two documents are linked if ``similar[1] * |both sets| >= similar[0] * |either set|``. A text that is null or has no
    words has an empty set, links with nothing and is kept; a null id is its own component (null) and is kept. Rows that
    repeat an id are one document per distinct text in the search and share a component. Other columns are ignored; an
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    known = scratch.write(sketches(docs, id_col, text_col, width, bands * rows))
    full = known.filter("n > 0 and id is not null")
    named = full.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"))
    # the sketch follows from the set, so any copy's will do; one row per representative
    classes = full.join(named, ["n", "h1", "h2"]).filter("id = rep").select("id", "n", "h1", "h2", "registers")
    classes = scratch.write(classes.dropDuplicates(["n", "h1", "h2"]).select("id", "n", "registers"))
    groups = scratch.write(components(candidate_edges(classes, bands, rows, canopy_rows), scratch))
    linked = confirm(docs, groups, scratch, id_col=id_col, text_col=text_col, width=width, similar=similar,
                     block_documents=block_documents)
    classed = known.select("id", "n", "h1", "h2").join(named, ["n", "h1", "h2"], "left")
    out = classed.join(linked, F.col("rep") == F.col("node"), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
