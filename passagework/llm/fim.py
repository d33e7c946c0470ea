"""Fill-in-middle transformation of whole texts, cut at code point boundaries.

The bytes of a text at which a code point begins, and its end, form a boundary set in the manner of Roaring bitmaps: a
container per 65536 bytes, kept as a sorted array, a bitmap or runs, whichever is smallest, and the cumulative
cardinalities of the containers. The k-th boundary is found by a search in these and a selection inside one container, so
both cuts of a text are byte offsets and its text is never decoded. ASCII is one run a container, whatever its length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.shared import arrow_rows, text_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FIM_PERCENT = 90
SPM_PERCENT = 20
_SPAN = 1 << 16
_COUNTS = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class ArrayContainer:
    """Sorted low halves of the members."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype("<u2")

    def __len__(self):
        return len(self.low)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """A bit per possible member, and members before every group of 64 bytes."""

    def __init__(self, members: np.ndarray):
        self.bits = np.packbits(members, bitorder="little")
        counts = _COUNTS[self.bits].astype(np.int64)
        starts = np.arange(0, len(counts), 64)
        self.before = np.append(0, np.cumsum(np.add.reduceat(counts, starts)))

    def __len__(self):
        return int(self.before[-1])

    def select(self, k: int) -> int:
        group = int(np.searchsorted(self.before, k, side="right")) - 1
        bits = np.unpackbits(self.bits[64 * group:64 * group + 64], bitorder="little")
        return 512 * group + int(np.flatnonzero(bits)[k - self.before[group]])


class RunContainer:
    """Starts of the runs of consecutive members, and members before every run."""

    def __init__(self, starts: np.ndarray, sizes: np.ndarray):
        self.starts, self.before = starts.astype("<u2"), np.append(0, np.cumsum(sizes))

    def __len__(self):
        return int(self.before[-1])

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def container(members: np.ndarray):
    """The smallest of the three forms of up to 65536 flags."""
    edges = np.flatnonzero(np.diff(members.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    n = int((ends - starts).sum())
    sizes = {RunContainer: 4 * len(starts), ArrayContainer: 2 * n, BitmapContainer: _SPAN // 8}
    kind = min(sizes, key=sizes.get)
    if kind is RunContainer:
        return RunContainer(starts, ends - starts)
    return ArrayContainer(np.flatnonzero(members)) if kind is ArrayContainer else BitmapContainer(members)


class BoundarySet:
    """Byte offsets at which the code points of a UTF-8 text begin, and the offset of its end."""

    def __init__(self, text: bytes):
        raw = np.frombuffer(text, np.uint8)
        self.containers = []
        for lo in range(0, len(raw) + 1, _SPAN):
            begins = (raw[lo:lo + _SPAN] & 0xC0) != 0x80
            if len(begins) < _SPAN:
                begins = np.append(begins, True)
            self.containers.append(container(begins))
        self.before = np.cumsum([0] + [len(c) for c in self.containers])

    def __len__(self):
        """Code points of the text."""
        return int(self.before[-1]) - 1

    def select(self, k: int) -> int:
        """Byte offset of code point ``k``; the end of the text for ``k = len(self)``."""
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return at * _SPAN + self.containers[at].select(k - int(self.before[at]))


def draws(doc_id) -> list[int]:
    """Four pseudo-random numbers below 2^32 of an id; a null id draws as an empty one."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]


def transform(text: bytes, doc_id) -> tuple[int, str, int | None, int | None, bytes]:
    """Code points, form, code points of prefix and middle (None if plain) and output of one text."""
    cuts = BoundarySet(text)
    n = len(cuts)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= FIM_PERCENT:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cuts.select(first), cuts.select(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_PERCENT:
        return n, "spm", first, second - first, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", first, second - first, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text that ``transform`` made ``output`` of. Such a text holds no mark, so each mark is found once."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = head[len(PREFIX):].split(SUFFIX, 1)
    else:
        suffix, prefix = head[len(SUFFIX):].split(PREFIX, 1)
    return b"".join((prefix, middle, suffix))


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n`` (code points), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (null if plain)
    and ``output`` (UTF-8 bytes).

    A null text counts as empty, and an empty text is plain; a null id draws as an empty one. Rows that repeat an id or a
    text are transformed row by row and alike; cuts may coincide, then parts are empty. Texts of any length are cut whole;
    other columns are not read, and an empty table gives no rows. Nothing is shuffled.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches):
        for batch in text_slices(batches):
            rows = [transform(text or b"", doc_id)
                    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            n, form, prefix, middle, output = zip(*rows)
            yield arrow_rows(names, [batch.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()),
                                     pa.array(middle, pa.int64()), pa.array(output, pa.binary())])

    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("binary").alias("_bytes"))
    return rows.mapInArrow(
        run, f"`{id_col}` {id_type}, n long, form string, prefix_chars long, middle_chars long, output binary")


def with_restored(transformed: DataFrame) -> DataFrame:
    """The same rows with ``restored``, the exact bytes of the text rebuilt from ``output`` and ``form``."""
    fields = transformed.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in transformed.schema.fields)

    def run(batches):
        for batch in text_slices(batches, at=fields.index("output")):
            back = [restore(o, f) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist())]
            yield arrow_rows([*fields, "restored"], [*batch.columns, pa.array(back, pa.binary())])

    return transformed.mapInArrow(run, f"{schema}, restored binary")
