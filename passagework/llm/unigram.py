"""Token counts of whole texts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character. Dynamic programming carries the
best score and the piece count up to each character. Ties go as in the public tokenizers: candidates come in order of
their start, and only a strictly better one replaces the best. A character that no single-character piece covers gets an
unknown edge ten below the lowest score; with byte pieces it counts one token per byte, else neighbouring unknowns are one.

No piece holds a word mark after another character (checked when the vocabulary is read), so a text falls apart before
each run of marks and equal parts are counted once per task. With scores that are whole numbers all sums are exact and
this is the same as counting the text at once; vocabularies for which that doesn't hold are counted text by text.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from passagework.llm.shared import arrow_rows, file_bytes, text_slices

# fixed values: the word mark and the penalty of unknown characters in the public unigram tokenizers
MARK = "▁"
UNKNOWN_PENALTY = 10.0
_LOWEST = float("-inf")
CACHED_PARTS = 300_000
CACHED_LENGTH = 64


def read_pieces(raw: bytes) -> tuple[list[tuple[str, float]], bool]:
    """Pieces with scores and whether bytes stand in for unknown characters, from a sentencepiece model file.

    Control, unknown, unused and byte pieces match no text.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    rows, has_bytes = [], False
    for i in range(model.get_piece_size()):
        has_bytes |= model.is_byte(i)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            rows.append((model.id_to_piece(i), model.get_score(i)))
    return rows, has_bytes


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces
        self.letters = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min([s for _, s in pieces], default=0.0) - UNKNOWN_PENALTY
        self.bytes = byte_fallback
        whole = all(float(s).is_integer() and abs(s) < 2**31 for _, s in pieces)
        apart = not any(MARK in p.lstrip(MARK) for p, _ in pieces)
        self.parts = re.compile(f"{MARK}*[^{MARK}]*").findall if whole and apart else None
        self.cache: dict[str, tuple[int, float]] = {}

    def count_whole(self, text: str) -> tuple[int, float]:
        """Number of tokens and score of the best segmentation of ``text``."""
        n = len(text)
        if self.letters.issuperset(text):  # every character has an edge of its own, none is unknown
            best, count = [0.0] + [_LOWEST] * n, [0] * (n + 1)
            for last, (length, score) in self.automaton.iter(text) if n else ():
                end = last + 1
                score += best[end - length]
                if score > best[end]:
                    best[end], count[end] = score, count[end - length] + 1
            return count[n], best[n]
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        tail = [False] * (n + 1)  # the best path so far ends with an unknown character
        set_to = [False] * (n + 1)
        set_to[0] = True
        single, unknown = self.letters, self.unknown

        def through_unknown(end):
            # candidates of longer pieces start earlier, so this one comes last and must be strictly better
            c = text[end - 1]
            score = best[end - 1] + unknown
            if not set_to[end] or score > best[end]:
                best[end], set_to[end], tail[end] = score, True, True
                width = len(c.encode("utf-8", "surrogatepass")) if self.bytes else 0 if tail[end - 1] else 1
                count[end] = count[end - 1] + width

        done = 0
        for last, (length, score) in () if self.empty else self.automaton.iter(text):
            end = last + 1
            while done < last:  # characters that were passed without a match, or after their last match
                done += 1
                if text[done - 1] not in single:
                    through_unknown(done)
            score += best[end - length]
            if not set_to[end] or score > best[end]:
                best[end], count[end], set_to[end], tail[end] = score, count[end - length] + 1, True, False
        while done < n:
            done += 1
            if text[done - 1] not in single:
                through_unknown(done)
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        if self.parts is None or not self.bytes:  # without bytes, unknowns on both sides of a cut are one token
            return self.count_whole(text)
        total, score, known = 0, 0.0, self.cache
        for part in self.parts(text):
            found = known.get(part)
            if found is None:
                found = self.count_whole(part)
                if len(part) <= CACHED_LENGTH:
                    if len(known) >= CACHED_PARTS:
                        known.clear()
                    known[part] = found
            total += found[0]
            score += found[1]
        return total, score


def unigram_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text",
                   lead: bool = True) -> DataFrame:
    """Per row: id, ``n_tokens`` and ``score`` of the best segmentation. Spaces are word marks, ``lead`` puts one first.

    Map-only over whole texts. A null or empty text has no tokens and score 0; repeated rows and ids are counted row by
    row; other columns are not read.
    """
    pieces, byte_fallback = read_pieces(file_bytes(vocabulary))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = UnigramCounter(pieces, byte_fallback)
        for batch in text_slices(batches):
            found = []
            for text in batch.column(1).to_pylist():
                text = (text or "").replace(" ", MARK)
                found.append(counter.count(MARK + text if lead and text else text))
            yield arrow_rows([id_col, "n_tokens", "score"], [
                batch.column(0), pa.array([n for n, _ in found], pa.int64()),
                pa.array(np.array([s for _, s in found], np.float64))])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, score double")
