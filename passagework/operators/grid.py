"""Two tables whose blocks have to meet: cells of a grid, shuffled by cell.

One side is held in a cell, the other streams past it. A block travels once to every cell that it is needed in, so with
``lines`` groups of held blocks and ``columns`` groups of streamed ones, held blocks are copied ``columns`` times and
streamed blocks ``lines`` times. Nothing is broadcast and no task holds more than the held blocks of one cell and one
streamed block, however large the tables or a key among them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Cell(Protocol):
    """What a task does in one cell."""

    def add(self, block: pa.RecordBatch) -> Iterable[pa.RecordBatch] | None: ...

    def finish(self) -> Iterable[pa.RecordBatch] | None: ...


def to_block(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_block(buffer: pa.Buffer) -> pa.RecordBatch:
    return pa.ipc.open_stream(buffer).read_next_batch()


def merged(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns],
                                      schema=table.schema)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of exactly ``rows`` rows, the last one smaller."""
    waiting, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            waiting.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == rows:
                yield merged(waiting)
                waiting, n = [], 0
    if waiting:
        yield merged(waiting)


def packed(rows: DataFrame, key: list[str], rows_per_block: int, order: list[str] | None = None) -> DataFrame:
    """``(*key, block)``: blocks of at most ``rows_per_block`` rows of one key, the other columns as Arrow bytes.

    Rows are packed where they lie. They should come sorted by ``key`` within partitions, or blocks are small. Inside a
    block they are sorted by ``order``.
    """
    names = [c for c in rows.columns if c not in key]

    def run(batches):
        for batch in gathered(batches, 4 * rows_per_block):
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for k in key:
                column = batch.column(k)
                change = pa.compute.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1))
                new[1:] |= change.to_numpy(zero_copy_only=False)
            edges = [*np.flatnonzero(new).tolist(), batch.num_rows]
            rest = batch.select(names)
            for lo, hi in zip(edges, edges[1:]):
                for at in range(lo, hi, rows_per_block):
                    part = rest.slice(at, min(rows_per_block, hi - at))
                    if order:
                        part = part.take(pa.compute.sort_indices(part, sort_keys=[(c, "ascending") for c in order]))
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(k).slice(at, 1) for k in key], pa.array([to_block(part)], pa.binary())],
                        names=[*key, "block"])

    return rows.mapInArrow(run, T.StructType([*[rows.schema[k] for k in key], T.StructField("block", T.BinaryType(), False)]))


def _cell(group: list[str], line: Column, column: Column, columns: Column) -> Column:
    # neighbouring cells of a group go to different tasks
    deal = F.xxhash64(F.lit(0), *group) + line * columns + column
    return F.struct(*group, line.cast("long").alias("line"), column.cast("long").alias("column"), deal.alias("deal"))


def held_cells(line: str, columns: str, group: list[str] | None = None) -> Column:
    """Cells of a held block: all columns of its line."""
    return F.transform(F.sequence(F.lit(0), F.col(columns).cast("int") - 1),
                       lambda c: _cell(group or [], F.col(line), c, F.col(columns).cast("long")))


def streamed_cells(lines: str, column: str, columns: str, group: list[str] | None = None) -> Column:
    """Cells of a streamed block: all lines of its column."""
    return F.transform(F.sequence(F.lit(0), F.col(lines).cast("int") - 1),
                       lambda x: _cell(group or [], x, F.col(column), F.col(columns).cast("long")))


def meet(held: DataFrame, streamed: DataFrame, start: Callable[[list[pa.RecordBatch]], Cell], schema, *,
         tasks: int) -> DataFrame:
    """Let the blocks of two tables meet in the cells they share.

    Both have ``cells`` (of ``held_cells`` and ``streamed_cells``) and ``block``; ``streamed`` has also ``at``, the order
    in which its blocks pass. ``start`` gets the held blocks of a cell once the first other block comes; a cell with
    blocks of one side alone gives nothing. Cells are dealt to ``tasks`` partitions, each sorted by cell.
    """
    none = F.lit(None).cast(streamed.schema["at"].dataType)
    both = held.select(F.explode("cells").alias("cell"), F.lit(0).alias("side"), none.alias("at"), "block").unionAll(
        streamed.select(F.explode("cells").alias("cell"), F.lit(1).alias("side"), "at", "block"))
    dealt = both.repartitionById(tasks, F.pmod("cell.deal", F.lit(tasks)).cast("int")).sortWithinPartitions("cell", "side", "at")

    def run(batches):
        cell, waiting, task = None, [], None
        for batch in batches:
            cells, sides, blocks = (batch.column(i) for i in (0, 1, 2))
            for i in range(batch.num_rows):
                if (here := cells[i].as_py()) != cell:
                    if task is not None:
                        yield from task.finish() or ()
                    cell, waiting, task = here, [], None
                block = from_block(blocks[i].as_buffer())
                if sides[i].as_py() == 0:
                    waiting.append(block)
                elif task is not None or waiting:
                    if task is None:
                        task, waiting = start(waiting), []
                    yield from task.add(block) or ()
        if task is not None:
            yield from task.finish() or ()

    return dealt.select("cell", "side", "block").mapInArrow(run, schema)
