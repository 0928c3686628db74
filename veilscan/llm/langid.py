"""Language ID by language-bitmask n-gram filters.

Each language has the set of its most frequent byte 4-grams that together make up ``COVERED`` of
its text. All sets lie in one bit-sliced Bloom filter: a row of bits, one for each language, at each
position; a 4-gram's languages are the bits that all its positions share, read in one look-up for
64 languages. A row has as many 64-bit words as the languages need. Per document, the bits are counted by language, each count is corrected for the
filter's false positives at that language's fill, and the language with the largest count
decides. Its corrected share of the document's 4-grams is the score.

4-grams are taken after A-Z is lower-cased and each other ASCII byte that is no letter becomes a
space; those with two spaces in a row are left out.

Learned from the rows whose crc32(doc_id as text) mod 5 is not 0 and whose lang is not null:
``rows_per_lang`` rows of each language by the order of a hash (of texts of ``fit_bytes`` at most; a
language without such texts is learned from ``LONG_ROWS`` of its longer ones, whole).

A null text, a text without letters and any text when nothing was learned is ``und`` with score
0. Ties go to the language that comes first by name. Repeated rows each get a row. Only doc_id
and text of the documents are read when predicting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textbytes import text_slices

FOLDS, HELD_OUT = 5, 0
COVERED = 0.8
MOST = 64  # languages in a word
LONG_ROWS = 16
BITS, HASHES = 18, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def held_out(id_col: str = "doc_id") -> Column:
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == HELD_OUT


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-grams as 32-bit numbers, and each document's number of them."""
    if len(data) < 4:
        return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
    folded = _FOLD[data]
    wide = folded.astype(np.uint32)
    code = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
    space = folded == 32
    double = space[:-1] & space[1:]
    keep = ~(double[:-2] | double[1:-1] | double[2:])
    for back in (1, 2, 3):  # none reaches into the next document
        ends = offsets[1:] - back
        keep[ends[(ends >= 0) & (ends < len(keep))]] = False
    counted = np.concatenate([[0], np.cumsum(keep)])
    return code[keep], np.diff(counted[np.minimum(offsets, len(keep))])


@dataclass
class LanguageFilter:
    names: list[str]
    rows: np.ndarray  # 2^BITS rows of bits, one for each language
    fill: np.ndarray  # each language's share of rows with its bit

    @classmethod
    def build(cls, sets: dict[str, np.ndarray]) -> LanguageFilter:
        names = sorted(sets)
        if len(names) > MOST:
            raise ValueError(f"a word has bits for {MOST} languages")
        kind = next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(names) <= n)
        rows = np.zeros(1 << BITS, kind)
        for k, name in enumerate(names):
            for at in cls.positions(sets[name].astype(np.uint32)):
                rows[at] |= kind(1 << k)
        fill = np.array([((rows >> kind(k)) & kind(1)).mean() for k in range(len(names))])
        return cls(names, rows, fill)

    @staticmethod
    def positions(code: np.ndarray) -> Iterator[np.ndarray]:
        for factor in HASHES:
            spread = code * np.uint32(factor)
            yield (spread ^ (spread >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)

    def languages(self, code: np.ndarray) -> np.ndarray:
        """The bits of all languages that have each 4-gram (or seem to, at the filter's error)."""
        found = None
        for at in self.positions(code):
            found = self.rows[at] if found is None else found & self.rows[at]
        return found

    def corrected(self, code: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Each document's number of 4-grams of each language, corrected for the filter's error."""
        found = self.languages(code)
        ends = np.cumsum(counts)
        wrong = self.fill ** len(HASHES)
        corrected = np.empty((len(counts), len(self.names)))
        for k in range(len(self.names)):
            bit = (found >> self.rows.dtype.type(k)) & self.rows.dtype.type(1)
            total = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
            hits = total[ends] - total[ends - counts]
            corrected[:, k] = np.maximum(0, hits - counts * wrong[k]) / (1 - wrong[k])
        return corrected


@dataclass
class LanguageFilters:
    """A filter for each ``MOST`` languages, in the order of the names."""

    words: list[LanguageFilter]

    @classmethod
    def build(cls, sets: dict[str, np.ndarray]) -> LanguageFilters:
        names = sorted(sets)
        return cls([LanguageFilter.build({n: sets[n] for n in names[k : k + MOST]}) for k in range(0, len(names), MOST)])

    @property
    def names(self) -> list[str]:
        return [name for word in self.words for name in word.names]

    def decide(self, code: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and score of each document."""
        corrected = np.concatenate([word.corrected(code, counts) for word in self.words], 1)
        best = corrected.argmax(1)
        return best, np.minimum(1, corrected[np.arange(len(counts)), best] / np.maximum(1, counts))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lo, hi, data, offsets in text_slices(batch.column(1)):
            code, counts = grams(data, offsets)
            of = np.repeat(langs[lo:hi], counts)
            for lang in set(langs[lo:hi]):
                seen, n = np.unique(code[of == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "gram", "n"],
                )


def learn(docs: DataFrame, id_col: str = "doc_id", rows_per_lang: int = 2000, fit_bytes: int = 1 << 16) -> LanguageFilters | None:
    """The filter over each language's most frequent 4-grams, or None if no row can be learned from."""
    rows = docs.select(F.col(id_col).alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(~held_out("id") & F.col("lang").isNotNull())
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40).cast("bigint")) / F.lit(float(1 << 40))
    rows = rows.withColumn("place", place).withColumn("short", F.octet_length("text") <= fit_bytes)
    sizes = rows.groupBy("lang").agg(
        F.count_if("short").alias("shorts"),
        F.count_if(~F.col("short")).alias("longs"),
        F.min(F.when(F.col("short"), F.col("place"))).alias("first_short"),
        F.min(F.when(~F.col("short"), F.col("place"))).alias("first_long"),
    )
    some = F.col("shorts") > 0
    sizes = sizes.select(
        "lang",
        some.alias("of_short"),
        F.when(some, rows_per_lang).otherwise(LONG_ROWS).alias("most"),
        F.when(some, F.col("shorts")).otherwise(F.col("longs")).alias("n"),
        F.when(some, F.col("first_short")).otherwise(F.col("first_long")).alias("lowest"),
    )
    # a share of each language's rows by their hash, twice what is wanted, before any are dealt or ranked
    share = F.greatest(F.col("lowest"), 2.0 * F.col("most") / F.col("n"))
    few = rows.join(F.broadcast(sizes), "lang").where((F.col("short") == F.col("of_short")) & (F.col("place") <= share))
    first = Window.partitionBy("lang").orderBy("place", "id", F.xxhash64("text"))
    sample = few.withColumn("at", F.row_number().over(first)).where(F.col("at") <= F.col("most"))
    counted = sample.select("lang", "text").mapInArrow(_gram_counts, "lang string, gram bigint, n bigint")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_rank = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    every = Window.partitionBy("lang")
    common = counted.withColumn(
        "before", F.coalesce(F.sum("n").over(by_rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("all", F.sum("n").over(every))
    kept = common.where(F.col("before") < F.col("all") * COVERED).select("lang", "gram").toArrow()
    langs, codes = kept.column("lang").to_pandas().to_numpy(), kept.column("gram").to_numpy()
    sets = {lang: codes[langs == lang] for lang in sorted(set(langs))}
    return LanguageFilters.build(sets) if sets else None


def predict_language(docs: DataFrame, id_col: str = "doc_id", rows_per_lang: int = 2000, fit_bytes: int = 1 << 16) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, lang_pred, score."""
    learned = learn(docs, id_col, rows_per_lang, fit_bytes)
    rows = docs.select(F.col(id_col), F.col("text").cast("string").alias("text"))
    rows = rows.select(id_col, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text")
    if learned is None:
        return rows.select(id_col, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(learned.names, object)
        for batch in batches:
            best, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, data, offsets in text_slices(batch.column(2)):
                b, s = learned.decide(*grams(data, offsets))
                best.append(b)
                scores.append(s)
            letters = np.array(batch.column(1).to_pylist(), bool)
            lang = np.where(letters, names[np.concatenate(best)], "und")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(np.where(letters, np.concatenate(scores), 0.0))],
                names=[id_col, "lang_pred", "score"],
            )

    schema = rows.select(id_col, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(predicted, schema)
