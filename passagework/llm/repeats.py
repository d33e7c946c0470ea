"""Substring dedup by repeated-phrase automata.

1. Every window of words names its smallest 5-word hash (its minimizer), so equal windows of two documents name the same
   one. Minimizers that occur in more than one document are found by one aggregate over (hash, document) rows, a fifth of
   the words; a bitmap sized by the text, of 128 MB at most, keeps them for the next scans. The second scan does the same
   with the hashes of the windows that name them. A wrong bit only costs work.
2. The third scan writes fragments: runs of windows marked in both bitmaps that share a minimizer, with the words they
   cover. Fragments are dealt by that minimizer; equal fragments are one row with the first and last document that hold
   them.
3. Each shard of fragments confirms the windows that occur in two documents, joins those that always occur in one row to
   passages, compiles the passages into an Aho-Corasick automaton over words and streams its fragments through it to
   locate every occurrence.
4. Locations go back to the documents that hold the fragment, and each word covered by a window that starts in an earlier
   document is removed.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.shared import (Scratch, arrow_rows, column_hashes, mix, ngram_hashes, shuffles_freed, split_words,
                                    text_slices)

WINDOW = 13
PHRASE = 5
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
SHARD_FRAGMENTS = 20_000
STRETCH_BYTES = 16 << 20
_BLOCK_CELLS = 4096


def _sliding(values: np.ndarray, width: int, smaller=np.minimum) -> np.ndarray:
    """Extreme of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = smaller(out[:len(out) - step], out[step:])
        have += step
    return out


def window_keys(hashes: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, minimizer and hash of every window of word hashes that lies in one text; the hash is made of phrases that
    cover the window."""
    if len(hashes) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    size = min(PHRASE, window)
    phrases = ngram_hashes(hashes, size)
    low = _sliding(phrases, window - size + 1)
    whole = np.zeros(len(low), np.uint64)
    with np.errstate(over="ignore"):
        for at in [*range(0, window - size, size), window - size]:
            whole *= np.uint64(0x9E3779B97F4A7C15)
            whole += phrases[at:at + len(low)]
    place = np.flatnonzero(owner[:len(low)] == owner[window - 1:])
    return place, low[place], whole[place]


def _marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def bitmap_bits(rows: DataFrame) -> int:
    """One to two bits for eight bytes of text, so that few are set by chance; 2^30 bits at most."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(1 << max(size // 8, 1).bit_length(), LEAST_BITS), MOST_BITS)


def recurring_bitmap(rows: DataFrame, window: int, bits: int, marked: np.ndarray | None = None) -> np.ndarray:
    """Bits of the minimizers that more than one document holds, or of the windows whose minimizer is ``marked``."""
    marked = None if marked is None else rows.sparkSession.sparkContext.broadcast(marked)

    def run(batches):
        for batch in text_slices(batches):
            words, owner = split_words(batch.column(1))
            place, low, whole = window_keys(column_hashes(words), owner, window)
            if marked is None:
                # neighbours mostly name the same minimizer
                keep = np.flatnonzero((np.diff(low, prepend=~low[:1]) != 0) | (np.diff(owner[place], prepend=-1) != 0))
                found = low[keep]
            else:
                keep = np.flatnonzero(_marked(marked.value, low))
                found = whole[keep]
            yield arrow_rows(["h", "doc"], [pa.array(found.view(np.int64)),
                                            batch.column(0).take(pa.array(owner[place[keep]]))])

    met = rows.select("doc", "text").mapInArrow(run, "h long, doc long").groupBy("h").agg(
        F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high")
    bit = F.col("h").bitwiseAND(F.lit(bits - 1))
    cells = met.groupBy(F.shiftright(bit, 6).alias("cell")).agg(
        F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits"))

    def pack(table: pa.Table) -> pa.Table:
        block = np.zeros(_BLOCK_CELLS, np.uint64)
        cell = table.column("cell").to_numpy()
        block[cell % _BLOCK_CELLS] = table.column("bits").to_numpy().view(np.uint64)
        return pa.table({"block": pa.array(cell[:1] // _BLOCK_CELLS), "bits": pa.array([block.tobytes()], pa.binary())})

    blocks = cells.groupBy(F.expr(f"cell div {_BLOCK_CELLS}").alias("b")).applyInArrow(pack, "block long, bits binary")
    bitmap = np.zeros(bits // 64, np.uint64)
    for row in blocks.collect():
        bitmap[row["block"] * _BLOCK_CELLS:(row["block"] + 1) * _BLOCK_CELLS] = np.frombuffer(row["bits"], np.uint64)
    return bitmap


def fragments(rows: DataFrame, minimizers: np.ndarray, windows: np.ndarray, window: int) -> DataFrame:
    """``(doc, text_hash, start, route, fragment)``: runs of windows that share a minimizer, both marked."""
    shared = rows.sparkSession.sparkContext.broadcast((minimizers, windows))
    names = ["doc", "text_hash", "start", "route", "fragment"]

    def run(batches):
        minimizers, windows = shared.value
        for batch in text_slices(batches):
            words, owner = split_words(batch.column(1))
            place, low, whole = window_keys(column_hashes(words), owner, window)
            # a window that is marked by chance mostly names a minimizer that is not
            keep = np.flatnonzero(_marked(minimizers, low))
            keep = keep[_marked(windows, whole[keep])]
            if not len(keep):
                continue
            place, low = place[keep], low[keep]
            fresh = np.flatnonzero((np.diff(place, prepend=-2) > 1) | (np.diff(low, prepend=low[:1]) != 0)
                                   | (np.diff(owner[place], prepend=-1) != 0))
            lo, route = place[fresh], low[fresh]
            sizes = place[np.append(fresh[1:], len(place)) - 1] - lo + window
            begins = np.cumsum(sizes) - sizes
            taken = words.take(pa.array(np.arange(sizes.sum()) + np.repeat(lo - begins, sizes)))
            runs = pa.LargeListArray.from_arrays(pa.array(np.append(begins, sizes.sum())), taken)
            index = pa.array(owner[lo])
            yield arrow_rows(names, [batch.column(0).take(index), batch.column(2).take(index),
                                     pa.array(lo - np.searchsorted(owner, owner[lo])),
                                     pa.array(route.view(np.int64)),
                                     pa.compute.binary_join(runs, pa.scalar(b" ", pa.large_binary())).cast(pa.binary())])

    return rows.select("doc", "text", "text_hash").mapInArrow(
        run, "doc long, text_hash long, start long, route long, fragment binary")


def _combined(batches):
    """Equal fragments of a stretch of ``(route, fragment, doc)`` as one row with their first and last document, so that a
    passage that most documents share reaches its shard as one row a stretch."""
    held, size = [], 0

    def rows():
        met = pa.Table.from_batches(held).group_by(["route", "fragment"], use_threads=False).aggregate(
            [("doc", "min"), ("doc", "max")]).combine_chunks()
        return [arrow_rows(["route", "fragment", "low", "high"],
                           [b.column(c) for c in ("route", "fragment", "doc_min", "doc_max")])
                for b in met.to_batches(max_chunksize=10_000)]

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > STRETCH_BYTES:
            yield from rows()
            held, size = [], 0
    if held:
        yield from rows()


def _inner(kind: np.ndarray, owner: np.ndarray, kinds: int) -> np.ndarray:
    """Windows that follow one and the same window wherever they occur, which nothing else follows."""
    same = owner[1:] == owner[:-1]
    before, after = np.full(len(kind), -1), np.full(len(kind), -1)
    before[1:][same], after[:-1][same] = kind[:-1][same], kind[1:][same]
    ranges = []
    for near in (before, after):
        least, most = np.full(kinds, kinds), np.full(kinds, -1)
        np.minimum.at(least, kind, near)
        np.maximum.at(most, kind, near)
        ranges.append(np.where(least == most, least, -1))
    only_before, only_after = ranges
    return (only_before >= 0) & (only_after[only_before] == np.arange(kinds))


def _locate(batches, window):
    """Locate the recurring passages of one shard in all its fragments: confirmed windows, those that always occur in one
    row joined to one pattern."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    table = pa.Table.from_batches(table)
    low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
    words, owner = split_words(table.column("fragment").combine_chunks().cast(pa.string(), safe=False))
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.searchsorted(owner, np.arange(len(table)), side="right").tolist()
    flat = tuple(numbers.tolist())
    texts = [flat[lo:hi] for lo, hi in zip([0, *ends], ends)]
    hashes = ngram_hashes(mix(numbers.astype(np.uint64)), window)
    place = np.flatnonzero(owner[:len(hashes)] == owner[window - 1:])
    owner = owner[place]
    _, one, kind = np.unique(hashes[place], return_index=True, return_inverse=True)
    if any((numbers[place + i] != numbers[place[one[kind]] + i]).any() for i in range(window)):
        # two windows share a hash: compare the words themselves
        whole = np.lib.stride_tricks.sliding_window_view(numbers, window)[place]
        _, one, kind = np.unique(whole, axis=0, return_index=True, return_inverse=True)
    first, last = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
    np.minimum.at(first, kind, low[owner])
    np.maximum.at(last, kind, high[owner])
    begins = np.flatnonzero(~_inner(kind, owner, len(one))[kind])
    lengths = np.zeros(len(place), np.int64)
    lengths[begins] = np.diff(np.append(begins, len(place)))
    one = one[(first < last) & (lengths[one] > 0)]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p, (at, more) in enumerate(zip(place[one].tolist(), lengths[one].tolist())):
        automaton.add_word(flat[at:at + window + more - 1], p)
    if not len(automaton):
        return
    automaton.make_automaton()
    hits = [(i, end, p) for i, text in enumerate(texts) for end, p in automaton.iter(text)]
    fragment, end, pattern = (np.array(c, np.int64) for c in zip(*hits))
    earliest = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(earliest, pattern, low[fragment])
    useful = earliest[pattern] < high[fragment]
    fragment, end, earliest, held = (fragment[useful], end[useful], earliest[pattern[useful]],
                                     lengths[one][pattern[useful]])
    # a passage starts as many windows as it has words beyond the first window
    step = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
    offset = np.repeat(end - (window + held - 1) + 1, held) + step
    fragment, earliest = np.repeat(fragment, held), np.repeat(earliest, held)
    edges = np.flatnonzero(np.diff(fragment, prepend=-1))
    ends = np.append(edges[1:], len(fragment))
    index = pa.array(fragment[edges])
    lists = pa.array(np.append(edges, len(fragment)).astype(np.int32))
    if len(edges):
        assert (ends > edges).all()
        yield arrow_rows(["f1", "f2", "offsets", "earliest"], [
            table.column("f1").combine_chunks().take(index), table.column("f2").combine_chunks().take(index),
            pa.ListArray.from_arrays(lists, pa.array(offset)), pa.ListArray.from_arrays(lists, pa.array(earliest))])


def repeated_windows(docs: DataFrame, scratch: Scratch, *, id_col: str, text_col: str, window: int) -> DataFrame:
    """``(doc, text_hash, starts)``: starts of windows that also start in a document with a smaller id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("text_hash")).filter("doc is not null")
    with shuffles_freed(docs.sparkSession):
        bits = bitmap_bits(rows)
        minimizers = recurring_bitmap(rows, window, bits)
        windows = recurring_bitmap(rows, window, bits, minimizers)
        found = scratch.write(fragments(rows, minimizers, windows, window))
        named = [F.xxhash64("fragment").alias("f1"), F.xxhash64(F.lit("second"), "fragment").alias("f2")]
        shards = max(1, -(-found.count() // SHARD_FRAGMENTS))
        # rows are dealt by the minimizer alone, so equal fragments meet without a second shuffle of their words
        dealt = found.select("route", "fragment", "doc").mapInArrow(
            _combined, "route long, fragment binary, low long, high long").repartition(shards, "route")
        distinct = dealt.groupBy("route", "fragment").agg(F.min("low").alias("low"), F.max("high").alias("high"))

        def locate(batches):
            yield from _locate(batches, window)

        # written before the join: the shuffle of fragments is gone when that of places begins
        located = scratch.write(distinct.select("*", *named).mapInArrow(
            locate, "f1 long, f2 long, offsets array<long>, earliest array<long>"))
        # one place of a fragment has all its windows, so it is enough to join by the fragment
        held = found.select("doc", "text_hash", "start", *named).join(located, ["f1", "f2"])
        earlier = F.filter(F.arrays_zip("offsets", "earliest"), lambda o: o["earliest"] < F.col("doc"))
        starts = F.transform(earlier, lambda o: o["offsets"] + F.col("start"))
        repeated = scratch.write(held.select("doc", "text_hash", starts.alias("starts")).filter(F.size("starts") > 0)
                                 .groupBy("doc", "text_hash").agg(F.flatten(F.collect_list("starts")).alias("starts")))
        scratch.drop(found)
        scratch.drop(located)
    return repeated


def _kept(text: str | None, starts, window: int) -> tuple[list[bytes], int]:
    words = _words(text)
    if starts is None or not len(starts):
        return words, 0
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(np.asarray(starts, np.int64))
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return [words[i] for i in keep.tolist()], len(words) - len(keep)


def _joined(docs: DataFrame, extra: list, id_col: str, text_col: str, window: int) -> DataFrame:
    repeated = repeated_windows(docs, Scratch(docs.sparkSession), id_col=id_col, text_col=text_col, window=window)
    rows = docs.select(*extra, F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"),
                       F.xxhash64(text_col).alias("_hash"))
    met = (F.col("_id") == F.col("doc")) & (F.col("_hash") == F.col("text_hash"))
    return rows.join(repeated, met, "left").drop("doc", "text_hash", "_hash")


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
                      ) -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed`` and the hash of the kept words joined by one space.

    A null text has no words; texts shorter than a window, and rows with a null id, lose nothing. Rows that repeat an id
    are no earlier documents to each other. Other columns are ignored; an empty table gives no rows.
    """
    joined = _joined(docs, [], id_col, text_col, window)

    def run(batches):
        for batch in batches:
            kept = [_kept(t, s, window) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield arrow_rows([id_col, "n_words", "n_removed", "kept_sha256"], [
                batch.column(0), pa.array([len(k) + n for k, n in kept], pa.int64()),
                pa.array([n for _, n in kept], pa.int64()),
                pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k, _ in kept], pa.string())])

    return joined.select("_id", "_text", "starts").mapInArrow(
        run, f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The same rows and columns; texts that lose words are their kept words joined by one space, others are unchanged."""
    joined = _joined(docs, [F.struct("*").alias("_row")], id_col, text_col, window)
    fields = docs.columns

    def run(batches):
        for batch in batches:
            text = []
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kept, n = _kept(t, s, window)
                text.append(b" ".join(kept).decode("utf-8", "surrogatepass") if n else t)
            columns = [pa.array(text, pa.string()) if f == text_col else c
                       for f, c in zip(fields, batch.column(0).flatten())]
            yield arrow_rows(fields, columns)

    return joined.select("_row", "_text", "starts").mapInArrow(run, docs.schema)
