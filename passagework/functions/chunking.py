"""Recursive text splitting with overlap.

A chunk is always a contiguous slice of its text, so the splitter works on offsets: it
finds the piece boundaries once per level and picks chunk ends and starts by bisection.
The cost is linear in the text, and no piece is ever copied until its chunk is cut.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from passagework.config import CHUNK_OVERLAP, CHUNK_SIZE

# fixed values: tried in this order, the empty one cuts between any two characters
SEPARATORS = ("\n\n", "\n", " ", "")

_ROWS_PER_OUTPUT = 8192


def split_text(
    text: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: tuple[str, ...] = SEPARATORS,
) -> list[str]:
    """Chunks of at most ``size`` characters that share at most ``overlap`` with the one before."""
    return list(iter_text(text, size, overlap, separators))


def iter_text(
    text: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: tuple[str, ...] = SEPARATORS,
) -> Iterator[str]:
    """The same chunks, one at a time."""
    if not text:
        return iter(())
    slices = (text[a:b].strip() for a, b in _spans(text, 0, len(text), size, overlap, separators))
    return filter(None, slices)


def _spans(text, lo, hi, size, overlap, separators) -> Iterator[tuple[int, int]]:
    level = next(i for i, s in enumerate(separators) if not s or text.find(s, lo, hi) >= 0)
    sep, finer = separators[level], separators[level + 1 :]
    if not sep:
        yield from _pack(range(lo, hi + 1), size, overlap)
        return
    # a separator belongs to the piece it opens
    cuts = [m.start() for m in re.compile(re.escape(sep)).finditer(text, lo, hi)]
    if cuts[0] != lo:
        cuts.insert(0, lo)
    cuts.append(hi)
    run = 0
    for i in range(len(cuts) - 1):
        if cuts[i + 1] - cuts[i] >= size:
            if run < i:
                yield from _pack(cuts[run : i + 1], size, overlap)
            if finer:
                yield from _spans(text, cuts[i], cuts[i + 1], size, overlap, finer)
            else:
                yield cuts[i], cuts[i + 1]
            run = i + 1
    if run < len(cuts) - 1:
        yield from _pack(cuts[run:] if run else cuts, size, overlap)


def _pack(cuts, size, overlap) -> Iterator[tuple[int, int]]:
    """Fill chunks with whole pieces; restart on the earliest cut that respects the overlap."""
    last = len(cuts) - 1
    start = 0
    while True:
        end = bisect_right(cuts, cuts[start] + size) - 1
        yield cuts[start], cuts[end]
        if end >= last:
            return
        start = bisect_left(cuts, max(cuts[end] - overlap, cuts[end + 1] - size), start, end)


@dataclass(frozen=True)
class ChunkPass:
    """How chunks are made of texts: the rows with these, what a task does with its Arrow batches, and what that gives.

    A search may go on in the same task instead of having Spark move every vector between two Python processes.
    """

    source: DataFrame
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
    schema: T.StructType

    def rows(self) -> DataFrame:
        return self.source.mapInArrow(self.run, self.schema)


def explode_chunks(df: DataFrame, text_col: str, **options) -> DataFrame:
    """The rows of ``chunk_pass``, which takes the ``options``."""
    return chunk_pass(df, text_col, **options).rows()


def chunk_pass(
    df: DataFrame,
    text_col: str,
    *,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    out_col: str = "text",
    pos_col: str = "chunk_no",
    keep: list[str] | None = None,
    encoder: Callable[[list[str]], "object"] | None = None,
    vector_col: str = "document_vector",
    pack: Callable[["object"], pa.Array] | None = None,
) -> ChunkPass:
    """One row per chunk of ``text_col``: the ``keep`` columns, position, chunk and, with an
    ``encoder``, its vector, as bytes with ``pack``. Narrow: one Arrow pass over each partition, no shuffle."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    fields = [df.schema[c] for c in keep]
    fields += [T.StructField(pos_col, T.LongType(), False), T.StructField(out_col, T.StringType(), False)]
    if encoder is not None:
        kind = T.ArrayType(T.FloatType(), False) if pack is None else T.BinaryType()
        fields.append(T.StructField(vector_col, kind, False))
    names = [f.name for f in fields]

    def emit(batch, rows, pos, chunks):
        cols = [batch.column(c).take(pa.array(rows, pa.int64())) for c in keep]
        cols += [pa.array(pos, pa.int64()), pa.array(chunks, pa.string())]
        if encoder is not None:
            cols.append((pack or vectors_to_arrow)(encoder(chunks)))
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        for batch in batches:
            rows, pos, chunks = [], [], []
            for i, text in enumerate(batch.column(text_col)):
                found, at = iter_text(text.as_py(), size, overlap), 0
                while part := list(islice(found, _ROWS_PER_OUTPUT)):
                    rows += [i] * len(part)
                    pos += range(at, at + len(part))
                    chunks += part
                    at += len(part)
                    if len(chunks) >= _ROWS_PER_OUTPUT:
                        yield emit(batch, rows, pos, chunks)
                        rows, pos, chunks = [], [], []
            if chunks:
                yield emit(batch, rows, pos, chunks)

    return ChunkPass(df.select(*keep, text_col), run, T.StructType(fields))


def vectors_to_arrow(matrix) -> pa.Array:
    """Rows of a float matrix as an Arrow list column."""
    import numpy as np

    matrix = np.ascontiguousarray(matrix, dtype=np.float32)
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))
