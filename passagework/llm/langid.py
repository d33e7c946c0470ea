"""Language identification with Bloom filters whose slots hold one bit per language.

For every language the character n-grams that occur in a given share of its sampled documents go into one table: each
n-gram sets the language's bit in a few slots. A lookup is the AND of those slots and returns all languages that know
the n-gram. Per document the bits are counted per language, the counts are corrected for false positives with the share
of slots that the language fills, and the largest corrected share decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.shared import arrow_rows, bounded_sample, mix, text_slices

NGRAM = 4
HASHES = 3
SLOTS_PER_NGRAM = 16
TRAIN_ROWS_PER_LANGUAGE = 3_000
LEAST_SHARE = 0.02
UNKNOWN = "und"
SLICE_BYTES = 1 << 20


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def text_ngrams(texts: list[str | None], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, the text each comes from, and which texts have a letter.

    Texts are lower-cased; a run of other characters is one gap; two gaps stand before and after each text.
    """
    codes, owner, any_letter = [], [], []
    for i, text in enumerate(texts):
        c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(letters[c], c, 0)
        c = c[(c != 0) | (np.concatenate([[1], c[:-1]]) != 0)]
        any_letter.append(bool(c.any()))
        if any_letter[-1]:
            edge = np.zeros(2, np.uint32)
            codes.append(np.concatenate([edge, c, edge]))
            owner.append(np.full(len(codes[-1]), i, np.int64))
    if not codes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.array(any_letter, bool)
    codes, owner = np.concatenate(codes).astype(np.uint64), np.concatenate(owner)
    n = len(codes) - NGRAM + 1
    grams = np.zeros(n, np.uint64)
    for k in range(NGRAM):
        grams = mix((grams << np.uint64(21)) ^ (grams >> np.uint64(43)) ^ codes[k:k + n])
    inside = owner[:n] == owner[NGRAM - 1:]
    return grams[inside], owner[:n][inside], np.array(any_letter, bool)


class LanguageFilters:
    """Bit-sliced Bloom filters: ``table[word, slot]`` holds the bits of 64 languages."""

    def __init__(self, languages: list[str], grams: list[np.ndarray]):
        self.languages = languages
        most = max([len(g) for g in grams], default=0)
        self.bits = max(10, int(np.ceil(np.log2(max(1, most * SLOTS_PER_NGRAM)))))
        self.table = np.zeros((max(1, -(-len(languages) // 64)), 1 << self.bits), np.uint64)
        for i, own in enumerate(grams):
            for slot in self.slots(own):
                self.table[i // 64, slot] |= np.uint64(1) << np.uint64(i % 64)
        filled = np.array([float(((self.table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean())
                           for i in range(len(languages))])
        self.false_rate = filled**HASHES

    def slots(self, grams: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64((1 << self.bits) - 1)
        with np.errstate(over="ignore"):
            return [(mix(grams + np.uint64(k * 0x9E3779B9)) & mask).astype(np.int64) for k in range(HASHES)]

    def shares(self, grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Per text and language the corrected share of n-grams that the language knows."""
        total = np.maximum(np.bincount(owner, minlength=n), 1)
        slots = self.slots(grams)
        out = np.zeros((n, len(self.languages)))
        for word in range(len(self.table)):
            known = self.table[word, slots[0]]
            for slot in slots[1:]:
                known = known & self.table[word, slot]
            for bit in range(min(64, len(self.languages) - 64 * word)):
                has = (known >> np.uint64(bit)) & np.uint64(1)
                out[:, 64 * word + bit] = np.bincount(owner, weights=has, minlength=n) / total
        rate = np.minimum(self.false_rate, 0.999)
        return np.maximum((out - rate) / (1 - rate), 0)


def held_out(id_col: str) -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    rows_per_language: int = TRAIN_ROWS_PER_LANGUAGE, least_share: float = LEAST_SHARE
                    ) -> LanguageFilters:
    """Fit on at most about ``rows_per_language`` rows of each language, chosen by the hash of their id.

    Rows with a null id, text or language teach nothing. N-grams are counted by documents on the cluster; only those in
    at least ``least_share`` of a language's sample reach the driver, so their number is bounded by the mean number of
    n-grams per document divided by that share.
    """
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    known = known.filter("_id is not null and _text is not null and _lang is not null").filter(~held_out("_id"))
    sample = bounded_sample(known, "_id", rows_per_language, by="_lang").select("_lang", "_text")

    def run(batches):
        letters = _letters()
        for batch in text_slices(batches, max_bytes=SLICE_BYTES):
            grams, owner, _ = text_ngrams(batch.column(1).to_pylist(), letters)
            langs, index = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            for k, lang in enumerate(langs.tolist()):
                rows = np.flatnonzero(index == k)
                edges = zip(np.searchsorted(owner, rows, "left").tolist(), np.searchsorted(owner, rows, "right").tolist())
                mine = [np.unique(grams[lo:hi]) for lo, hi in edges]
                own, n = np.unique(np.concatenate(mine), return_counts=True)
                yield arrow_rows(["lang", "gram", "n"], [
                    pa.array([lang] * (len(own) + 1)), pa.array([None, *own.view(np.int64).tolist()], pa.int64()),
                    pa.array([len(rows), *n.tolist()], pa.int64())])

    counted = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sizes = counted.filter("gram is null").select("lang", F.col("n").alias("size"))
    languages = sorted(r["lang"] for r in sizes.collect())
    kept = (counted.filter("gram is not null").join(F.broadcast(sizes), "lang")
            .filter(F.col("n") >= F.col("size") * least_share).select("lang", "gram").toPandas())
    grams = [kept.loc[kept["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64) for lang in languages]
    return LanguageFilters(languages, grams)


def identify_languages(docs: DataFrame, filters: LanguageFilters, *, id_col: str = "doc_id", text_col: str = "text"
                       ) -> DataFrame:
    """Per row: id, ``lang_pred`` and ``score``, the winner's part of all corrected shares.

    Map-only over whole texts. A text that is null or has no letter is ``und`` with score 0, as is every text if nothing
    was learned; ties go to the first language by name; repeated rows are judged row by row; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        letters = _letters()
        for batch in text_slices(batches, max_bytes=SLICE_BYTES):
            grams, owner, any_letter = text_ngrams(batch.column(1).to_pylist(), letters)
            lang, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if filters.languages:
                shares = filters.shares(grams, owner, batch.num_rows)
                best, total = shares.argmax(1), shares.sum(1)
                score = np.where(any_letter, shares.max(1) / np.where(total > 0, total, 1), 0.0)
                lang = [filters.languages[b] if ok else UNKNOWN for b, ok in zip(best, any_letter)]
            yield arrow_rows([id_col, "lang_pred", "score"], [batch.column(0), pa.array(lang, pa.string()), pa.array(score)])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, lang_pred string, score double")
