"""Byte-level BPE on whole texts: encoding by a segment tree over pair ranks, and decoding.

A text is cut at special tokens and by the public pre-token pattern. Each distinct piece of a task is encoded once:
the leaves of a segment tree hold the ranks of adjacent pairs, its root names the leftmost pair of lowest rank, a merge
changes three leaves and the nodes above them, until the root holds no pair. The trees of many pieces are kept as rows
of one array and merge in step, so a piece costs microseconds; a single piece of any length is one row.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from passagework.llm.shared import arrow_rows, file_bytes, text_slices

# fixed values: the pre-token pattern of the public byte-level tokenizers; White_Space is what their engine takes \s for
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
CACHED_PIECES = 300_000
CACHED_LENGTH = 64
CELLS_AT_ONCE = 1 << 16


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    for b in range(256):
        if b not in shown:
            letters[chr(256 + len(letters) - len(shown))] = b
    return letters


class ByteBpe:
    """Encoder and decoder of a byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.first = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.cache: dict[str, bytes] = {}

    def leaf(self, left, right, at, bits, dtype):
        """Rank of each pair of ids above its position in ``bits`` bits; the largest value if there is no such pair."""
        key = (left << 32) | right
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[found] == key, (self.ranks[found] << bits) | at, np.iinfo(dtype).max).astype(dtype)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces])
        widths = 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(int)
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            step = max(1, CELLS_AT_ONCE // width)
            for lo in range(0, len(rows), step):
                some = rows[lo:lo + step]
                for i, ids in zip(some.tolist(), self._merge_rows([pieces[i] for i in some], width)):
                    out[i] = ids
        return out

    def _merge_rows(self, pieces, width):
        n, bits = len(pieces), width.bit_length() - 1
        dtype = np.uint32 if (len(self.keys) << bits) < (1 << 32) - 1 else np.int64
        none, mask = np.iinfo(dtype).max, width - 1
        length = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        place = np.arange(width, dtype=np.int32)
        ids = np.where(place < length[:, None], self.first[data], -1)
        after = np.where(place + 1 < length[:, None], place + 1, width).astype(np.int32)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), none, dtype)
        inner = place[1:] < length[:, None]
        tree[:, width:2 * width - 1][inner] = self.leaf(
            ids[:, :-1][inner], ids[:, 1:][inner], np.broadcast_to(place[:-1], inner.shape)[inner], bits, dtype)
        for level in range(bits - 1, -1, -1):
            lo, hi = 1 << level, 2 << level
            tree[:, lo:hi] = np.minimum(tree[:, 2 * lo:2 * hi:2], tree[:, 2 * lo + 1:2 * hi:2])
        live = np.flatnonzero(tree[:, 1] < none)
        while len(live):
            root = tree[live, 1].astype(np.int64)
            at = root & mask
            ids[live, at] = self.merged[root >> bits]
            gone = after[live, at]
            follow = after[live, gone]
            after[live, at] = follow
            ids[live, gone] = -1
            inner = follow < width
            before[live[inner], follow[inner]] = at[inner]
            prev = before[live, at]
            self._set(tree, live, gone, none, width)
            self._set(tree, live, at, self._pair(ids, live, at, follow, bits, dtype), width)
            inner = prev >= 0
            rows, prev = live[inner], prev[inner]
            self._set(tree, rows, prev, self._pair(ids, rows, prev, at[inner], bits, dtype), width)
            live = live[tree[live, 1] < none]
        kept = ids >= 0
        flat, ends = ids[kept].astype("<u4").tobytes(), 4 * np.cumsum(kept.sum(1))
        return [flat[lo:hi] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _pair(self, ids, rows, at, right, bits, dtype):
        """Leaves of the pairs that start at ``at``; an end of the row pairs with -1, which no rank has."""
        right_ids = np.where(right < ids.shape[1], ids[rows, np.minimum(right, ids.shape[1] - 1)], -1)
        return self.leaf(ids[rows, at], right_ids & 0xFFFFFFFF, at, bits, dtype)

    @staticmethod
    def _set(tree, rows, at, value, width):
        node = at + width
        tree[rows, node] = value
        while width > 1:
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width >>= 1

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; special tokens in a text keep their ids."""
        parts, marked = [], False
        for text in texts:
            cut = self.special.split(text) if self.special else [text]
            own = self.split(cut[0])
            for i, part in enumerate(cut[1:], 1):
                own.extend([(part,)] if i % 2 else self.split(part))
                marked = True
            parts.append(own)
        known = self.cache
        new = set().union(*parts).difference(known)
        if len(known) + len(new) > CACHED_PIECES:
            known.clear()
            new = set().union(*parts)
        if marked:
            for token, i in self.specials.items():
                known[(token,)] = np.array([i], "<u4").tobytes()
            new = new.difference(known)
        new = list(new)
        known.update(zip(new, self.merge([p.encode() for p in new])))
        out = [b"".join(map(known.__getitem__, own)) for own in parts]
        for p in new:
            if len(p) > CACHED_LENGTH:
                del known[p]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def bpe_round_trip(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text",
                   with_ids: bool = False) -> DataFrame:
    """Per row: id, ``n_tokens``, SHA-256 of the ids and of the decoded text, and the ids themselves if asked for.

    Map-only: each task encodes and decodes whole texts of its own rows. A null text counts as empty, an empty text has
    no ids; repeated rows and ids are kept row by row; other columns are not read.
    """
    raw = file_bytes(vocabulary)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids binary" if with_ids else ""

    def run(batches):
        bpe = ByteBpe(raw)
        names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][:5 if with_ids else 4]
        for batch in text_slices(batches):
            coded = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
            columns = [
                batch.column(0),
                pa.array([len(c) // 4 for c in coded], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(c).encode()).hexdigest() for c in coded], pa.string()),
            ]
            yield arrow_rows(names, [*columns, pa.array(coded, pa.binary())] if with_ids else columns)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
