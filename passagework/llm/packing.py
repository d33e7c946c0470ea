"""Best-two-fit packing of token sequences.

Documents are tokenized where they lie; one small row per piece (id, piece, start, length, checksum) goes on, no tokens.
Pieces are dealt by hash into groups of about ``group_pieces``, and each group is packed in one task: a bin is filled
greedily with the longest pieces that fit; then, if the gap that remains together with the bin's smallest document holds
two unpacked documents more tightly, they take its place. A group loses at most a few part-filled bins, whatever the
size of the input, and no group depends on a document, source or key.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.shared import Scratch, arrow_rows, file_bytes, text_slices

SEQUENCE_TOKENS = 4096
END_ID = 1
GROUP_PIECES = 32_768
CACHED_PIECES = 600_000
CACHED_LENGTH = 64
# fixed value: the pre-tokens of the vocabulary that the fast path knows, in lower case
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# the same for texts of printable ASCII, white space and the letters and signs from U+00C0 to U+00FF, as Latin-1 bytes
_FIND = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+").findall
_KNOWN = bytes([*range(9, 14), *range(32, 127), *range(192, 256)])
# composed letters of that range are already in normal form, and each has one lower-case letter there
_LOWER = bytes(b + 32 if 65 <= b <= 90 or (192 <= b <= 222 and b != 215) else b for b in range(256))


class WordEncoder:
    """Ids of whole texts by the tokenizers library, each distinct pre-token of a task encoded once.

    The vocabulary has to normalize (composition, white space, lower case), split and end its words in the one way that
    ``_known_rules`` states; then the ids of a text are those of its pre-tokens in turn. Any other vocabulary, and any text
    with characters beyond those of ``_KNOWN`` or with an added token, goes through the library as it is.
    """

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the library keeps such caches of every thread as long as the process lives, and a worker serves many tasks
        self.tokenizer.model._resize_cache(0)
        rules = json.loads(raw)
        self.fast = _known_rules(rules)
        self.added = [t["content"] for t in rules.get("added_tokens") or []]
        # the same model for pre-tokens, which are normal and split already
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [array("I", f.ids).tobytes() for f in found]

    def _learn(self, pieces: list[bytes]) -> None:
        """Ids of pre-tokens, many in one text; each ends with the one id that ends a word."""
        for lo in range(0, len(pieces), 4096):
            some = pieces[lo:lo + 4096]
            lines = [b" ".join(some[at:at + 64]).decode("latin-1") for at in range(0, len(some), 64)]
            found = self.model.encode_batch_fast(lines, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(f.ids for f in found), "<u4")
            cuts = 4 * (np.flatnonzero(self.ends_word[ids]) + 1)
            raw = ids.tobytes()
            if len(cuts) == len(some) and cuts[-1] == len(raw):
                cuts = cuts.tolist()
                self.cache.update((p, raw[a:b]) for p, a, b in zip(some, [0, *cuts], cuts))
            else:
                self.cache.update(zip(some, self._library([p.decode("latin-1") for p in some])))

    def encode(self, texts: list[str]) -> list[bytes]:
        fast = [self.fast and not any(token in t for token in self.added) for t in texts]
        parts = [_pieces(t) if ok else None for t, ok in zip(texts, fast)]
        rest = [i for i, p in enumerate(parts) if p is None]
        out = dict(zip(rest, self._library([texts[i] for i in rest])))
        known, split = self.cache, [p for p in parts if p is not None]
        new = set().union(*split).difference(known)
        if len(known) + len(new) > CACHED_PIECES:
            known.clear()
            new = set().union(*split)
        self._learn(list(new))
        done = [out[i] if p is None else b"".join(map(known.__getitem__, p)) for i, p in enumerate(parts)]
        for piece in new:
            if len(piece) > CACHED_LENGTH:
                del known[piece]
        return done


def _pieces(text: str) -> list[bytes] | None:
    """Pre-tokens of a text in lower case, None if it holds other characters than the fast path knows."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if raw.translate(None, _KNOWN) else _FIND(raw.translate(_LOWER))


def _known_rules(vocabulary: dict) -> bool:
    """Whether a vocabulary file has the rules that the fast path builds on."""
    normal, split, model = (vocabulary.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    white = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    steps = split.get("pretokenizers") or [{}]
    return (
        normal.get("normalizers") == [{"type": "NFC"}, white, {"type": "Lowercase"}]
        and len(steps) == 2 and steps[0].get("pattern") == {"Regex": _SPLIT}
        and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
        and (steps[1].get("type"), steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == ("ByteLevel", False, False)
        and (model.get("type"), model.get("end_of_word_suffix"), model.get("dropout")) == ("BPE", "</w>", None)
        and not any(model.get(k) for k in ("continuing_subword_prefix", "unk_token", "byte_fallback"))
        and not [t for t in vocabulary.get("added_tokens") or [] if not t.get("special")]
    )


def token_pieces(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` tokens per row: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``spread``.

    A null text counts as empty and is its end id alone; only texts longer than ``capacity`` are cut. ``spread`` is a
    hash that deals pieces into groups.
    """
    raw = file_bytes(vocabulary)
    id_type = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # every core runs its own task
        encoder = WordEncoder(raw)
        for batch in text_slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo:lo + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield arrow_rows([id_col, "piece", "start", "length", "ids_crc32"], [
                batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())])

    pieces = docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long")
    return pieces.withColumn("spread", F.xxhash64(id_col, "piece", "ids_crc32"))


def fill_bins(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length by best-two-fit. Equal lengths are taken in their order."""
    order = np.argsort(-lengths, kind="stable")
    first = np.searchsorted(-lengths[order], -np.arange(capacity + 1), side="left")  # first rank of each length
    left = np.bincount(lengths, minlength=capacity + 1)  # unpacked pieces of each length
    taken = np.zeros(capacity + 1, np.int64)
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    sizes = np.arange(capacity + 1)
    n_bins, unpacked = 0, len(lengths)
    largest = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # longest unpacked piece up to each length
    stale = 0

    def fitting(room):
        """The longest unpacked piece within ``room``, or 0; the table is renewed once it misleads too often."""
        nonlocal largest, stale
        size = int(largest[room])
        while size and not left[size]:
            stale += 1
            size = int(largest[size - 1])
        if stale > 64:
            largest, stale = np.maximum.accumulate(np.where(left > 0, sizes, 0)), 0
        return size

    while unpacked:
        held, room = [], capacity
        while room and (size := fitting(room)):
            held.append(size)
            left[size] -= 1
            room -= size
        if room and len(held) > 1:
            smallest = held[-1]
            wide = room + smallest
            pair = _best_pair(left, wide, fitting)
            if pair and sum(pair) > smallest:
                held[-1:] = pair
                left[smallest] += 1
                largest[smallest:] = np.maximum(largest[smallest:], smallest)
                for size in pair:
                    left[size] -= 1
        at = 0
        for size in held:
            k = order[first[size] + taken[size]]
            taken[size] += 1
            bin_of[k], offset[k] = n_bins, at
            at += size
        n_bins += 1
        unpacked -= len(held)
    return bin_of, offset


def _best_pair(left, room, fitting) -> list[int]:
    """Two unpacked lengths with the largest sum within ``room``, the longer as long as can be."""
    best, pair = 0, []
    a = fitting(room - 1) if room > 1 else 0
    while a and 2 * a > best:
        left[a] -= 1
        b = fitting(min(a, room - a))
        left[a] += 1
        if b and a + b > best:
            best, pair = a + b, [a, b]
            if best == room:
                break
        a = fitting(a - 1) if a > 1 else 0
    return pair


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack whole texts into sequences: one row per piece with ``sequence_id`` and gapless ``offset``.

    Repeated rows and ids are packed row by row; an empty table gives no rows; other columns are not read. The pieces
    are written once, so their number is known before they are dealt into groups.
    """
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.write(token_pieces(docs, vocabulary, id_col=id_col, text_col=text_col, capacity=capacity,
                                        end_id=end_id))
    groups = max(1, -(-pieces.count() // group_pieces))
    names = [id_col, "piece", "start", "length", "ids_crc32"]
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        table = table.sort_by([(n, "ascending") for n in ("spread", id_col, "piece")]).select(names)
        lengths = table.column("length").to_numpy()
        bin_of, offset = fill_bins(lengths, capacity)
        number = (np.int64(TaskContext.get().partitionId()) << 40) + bin_of
        table = table.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))
        yield from table.to_batches(10_000)

    return pieces.repartition(groups, "spread").mapInArrow(
        run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
