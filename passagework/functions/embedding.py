"""Embedding hook and the built-in feature-hashing encoder.

An encoder is a picklable callable ``list[str] -> float matrix (n, dim)`` with a ``dim``
attribute. It runs inside Arrow batches on the executors; a model-backed encoder should load
its weights on first call, so that each Python worker loads them once.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.config import VECTOR_DIM
from passagework.functions.chunking import vectors_to_arrow

# fixed value: tokens are runs of letters and digits of any script, in lower case
_TOKENS = re.compile(r"[^\W_]+").findall

# rows whose dense matrix stays in a cache of the processor
_ROWS_PER_CALL = 1024
_CACHE_LIMIT = 1_000_000
_ENTRY = np.dtype([("place", "<u2"), ("x", "<f4")])


def tokens_of(text: str) -> list[str]:
    return _TOKENS(text.lower())


class _Bins(dict):
    """Bin of a token, hashed on first sight."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: str) -> int:
        digest = hashlib.md5(token.encode(), usedforsecurity=False).digest()
        found = self[token] = int.from_bytes(digest[:4], "big") % self.dim
        return found


class HashingEncoder:
    """Counts of md5-hashed lower-case tokens in ``dim`` bins.

    Vectors hold whole counts: cosine does not depend on their length, and products of
    whole numbers are exact, so every engine finds the same score.
    """

    def __init__(self, dim: int = VECTOR_DIM):
        self.dim = dim
        self._bins = _Bins(dim)

    def __getstate__(self):
        return {"dim": self.dim}

    def __setstate__(self, state):
        self.__init__(**state)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), self.dim), dtype=np.float32)
        for at in range(0, len(texts), _ROWS_PER_CALL):
            tokens = [tokens_of(t or "") for t in texts[at : at + _ROWS_PER_CALL]]
            n = len(tokens)
            if len(self._bins) > _CACHE_LIMIT:
                self._bins.clear()
            total = sum(map(len, tokens))
            bins = np.fromiter(map(self._bins.__getitem__, chain.from_iterable(tokens)), np.int64, total)
            rows = np.repeat(np.arange(n) * self.dim, list(map(len, tokens)))
            out[at : at + n] = np.bincount(rows + bins, minlength=n * self.dim).reshape(n, self.dim)
        return out


def packed_vectors(matrix) -> pa.Array:
    """Rows of a float matrix as bytes, little-endian: the places and 32-bit components that are not zero, where that is
    shorter, else all components."""
    matrix = np.ascontiguousarray(matrix, "<f4")
    n, dim = matrix.shape
    filled = matrix.view("<u4") != 0
    lengths = _ENTRY.itemsize * filled.sum(1)
    sparse = (lengths < 4 * dim) & (dim <= 1 << 16)
    rows, places = np.nonzero(filled & sparse[:, None])
    entries = np.empty(len(rows), _ENTRY)
    entries["place"], entries["x"] = places, matrix[rows, places]
    lengths = np.where(sparse, lengths, 4 * dim)
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    out, of_sparse = np.empty(int(offsets[-1]), np.uint8), np.repeat(sparse, lengths)
    out[of_sparse] = entries.view(np.uint8)
    out[~of_sparse] = matrix[~sparse].reshape(-1).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked_vectors(vectors: pa.Array, dim: int) -> np.ndarray:
    """The matrix behind ``packed_vectors``."""
    n, (_, offsets, data) = len(vectors), vectors.cast(pa.binary()).buffers()
    offsets = np.frombuffer(offsets, np.int32)[vectors.offset:vectors.offset + n + 1] if n else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    lengths = np.diff(offsets)
    full = lengths == 4 * dim
    of_full = np.repeat(full, lengths)
    entries = data[~of_full]
    if (lengths > 4 * dim).any() or (lengths[~full] % _ENTRY.itemsize).any():
        raise ValueError(f"vectors must have {dim} dimensions")
    entries = entries.view(_ENTRY)
    if len(entries) and entries["place"].max() >= dim:
        raise ValueError(f"vectors must have {dim} dimensions")
    out = np.zeros((n, dim), "<f4")
    out[np.repeat(np.arange(n), np.where(full, 0, lengths // _ENTRY.itemsize)), entries["place"]] = entries["x"]
    out[full] = data[of_full].view("<f4").reshape(-1, dim)
    return out


def unpacked_column(vectors: Column, dim: int) -> Column:
    """Arrays of floats out of a column of ``packed_vectors``, NULL where that is."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def unpack(packed: pa.Array) -> pa.Array:
        flat = pa.array(unpacked_vectors(packed.fill_null(b""), dim).ravel())
        offsets = pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, flat, mask=packed.is_null())

    return unpack(vectors)


def add_vectors(df: DataFrame, text_col: str, encoder, vector_col: str = "document_vector", packed: bool = False) -> DataFrame:
    """Append the vector of ``text_col``, ``packed`` as bytes; Arrow batches, no shuffle."""
    kind = T.BinaryType() if packed else T.ArrayType(T.FloatType(), False)
    schema = T.StructType([*df.schema.fields, T.StructField(vector_col, kind, False)])
    to_arrow = packed_vectors if packed else vectors_to_arrow

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_PER_CALL):
                part = batch.slice(at, _ROWS_PER_CALL)
                vectors = to_arrow(encoder(part.column(text_col).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], names=schema.names)

    return df.mapInArrow(run, schema)
