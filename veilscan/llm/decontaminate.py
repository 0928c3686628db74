"""Benchmark decontamination by template canonicalisation.

Texts are cut into tokens (runs of letters and digits; a point or comma between digits belongs to
the number; characters of scripts written without spaces are tokens of their own) and
re-parameterisable ones are replaced by typed placeholders: numbers, units that follow a number,
and names (capitalised words that do not begin a sentence). The rest is compared in lower case.
Windows of ``WINDOW`` template tokens (the whole item if it is shorter) of which ``LITERAL`` at
least are no placeholders are joined by hash with those of the benchmark. Every window is joined in
its literal form too, all tokens in lower case and none replaced, so a copy is found whatever its
capitals and also where it is nothing but numbers and names.

Matched windows are gathered by row, item and alignment (the difference of the two places in
tokens). The values behind the placeholders must correspond: one value of the item stands for one
value of the document. A document contains an item if, along one alignment, ``MIN_WINDOWS`` windows
(or all of the item's, if it has fewer) match literally, or match with values that correspond over
the whole alignment, or over ``MIN_WINDOWS`` neighbouring windows. So a passage of
WINDOW + MIN_WINDOWS - 1 tokens is found, whether copied or with other numbers, names and units,
whatever stands elsewhere in the document.

Items of fewer than ``SHORTEST`` tokens have no template form: of 3 and 4 tokens they are found
word for word anywhere, of 1 and 2 only where they are a whole sentence, as a lone word such as
"yes" stands in clean texts too.

The benchmark's windows are sent to the tasks as a filter only if there are ``FILTER_WINDOWS`` at
most; otherwise every window of the documents is joined. The result is the same.

Nulls, ties and repeats: null texts hold nothing, items without a token are not looked for; each
row is judged by its own text, also where rows share a doc_id or have none (``contaminated`` then
returns the best match of the id); equal items are reported each. An empty table on either side
gives no rows. Other columns than the ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unused
from .textbytes import give_memory_back, mix64, prefix_hash, span_hash, text_slices

WINDOW, LITERAL, MIN_WINDOWS, SHORTEST, SENTENCE = 8, 4, 3, 5, 2
FILTER_WINDOWS = 1 << 20

# Units of measure that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi mile miles inch inches foot feet yard yards meter meters metre metres kilometer kilometers "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes "
    "ml cl l liter liters litre litres gallon gallons cup cups "
    "ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "mph kph kmh percent dollar dollars cent cents euro euros usd eur gbp degree degrees watt watts volt volts"
).split()

_LITERAL, _NUMBER, _UNIT, _NAME = range(4)
_DIGIT, _UPPER, _LETTER, _STOP = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_STOP[[33, 46, 58, 59, 63, 124, 10]] = True  # ! . : ; ? | and a line's end
_WHITE = np.zeros(256, bool)
_WHITE[[9, 11, 12, 13, 32]] = True


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    return np.sort(span_hash(prefix_hash(data, True), np.append(0, ends[:-1] + 1), ends))


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 bytes: those of punctuation beyond ASCII, those that lead a character of a script
    without spaces (Han, kana, Thai and Lao), and all bytes of such characters."""
    mark, lead, wide = (np.zeros(len(data), bool) for _ in range(3))
    at = np.flatnonzero(data >= 0xC2)
    if len(at):
        first, second = data[at], data[np.minimum(at + 1, len(data) - 1)]
        third = data[np.minimum(at + 2, len(data) - 1)]
        # U+0080-00BF, U+2000-207F, U+3000-303F, and full-width signs before and after the digits
        signs = (first == 0xEF) & (second == 0xBC) & ((third < 0x90) | ((third > 0x99) & (third < 0xA1)))
        two = at[first == 0xC2]
        three = at[((first == 0xE2) & (second < 0x82)) | ((first == 0xE3) & (second == 0x80)) | signs]
        mark[np.concatenate([two, two + 1, three, three + 1, three + 2])] = True
        short = at[((first >= 0xE3) & (first <= 0xE9)) | ((first == 0xE0) & (second >= 0xB8) & (second <= 0xBB))]
        long_ = at[(first == 0xF0) & (second >= 0xA0)]
        lead[short] = lead[long_] = True
        wide[np.concatenate([short, short + 1, short + 2, long_, long_ + 1, long_ + 2, long_ + 3])] = True
    return mark, lead & ~mark, wide & ~mark


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A lower-case hash and the kind of each token, whether it begins a sentence, and each
    document's number of tokens."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool), np.zeros(len(offsets) - 1, np.int64)
    digit = _DIGIT[data]
    mark, lead, wide = _characters(data)
    inside = digit | (_LETTER[data] & ~mark)
    if n > 2:
        inside[1:-1] |= ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
    begins = np.zeros(n, bool)
    begins[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    closes = np.zeros(n, bool)
    closes[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    # a cut lies before a byte that is not in one run or one wide character with the byte before
    cut = np.ones(n + 1, bool)
    cut[1:-1] = ~inside[:-1] | ~inside[1:] | lead[1:] | (wide[:-1] & ~wide[1:])
    starts = np.flatnonzero(inside & (begins | cut[:-1]))
    ends = np.flatnonzero(inside & (closes | cut[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    hashes = span_hash(prefix_hash(data, True), starts, ends)
    # a token begins a sentence if a stop (or its text's begin) lies between it and the token before
    stops = np.concatenate([[0], np.cumsum(_STOP[data] & ~inside)])
    previous = np.append(0, ends[:-1])[: len(starts)]
    first = np.zeros(len(starts), bool)
    where = np.cumsum(counts) - counts
    first[where[counts > 0]] = True
    first |= stops[starts] > stops[np.minimum(previous, starts)]
    kind = np.full(len(starts), _LITERAL, np.int8)
    digits = np.concatenate([[0], np.cumsum(digit)])
    kind[_UPPER[data[starts]] & ~first] = _NAME
    number = digits[ends] > digits[starts]
    kind[number] = _NUMBER
    units = _unit_hashes()
    unit = units[np.minimum(np.searchsorted(units, hashes), len(units) - 1)] == hashes
    unit[1:] &= number[:-1]
    unit[where[counts > 0]] = False
    kind[unit & ~number] = _UNIT
    return hashes, kind, first, counts


def windows(
    hashes: np.ndarray, kind: np.ndarray, first: np.ndarray, counts: np.ndarray, size: int, literal: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``size`` tokens in literal or template form: hash, first token (over all documents), document.

    A template window has a placeholder and ``LITERAL`` other tokens at least (it equals its literal
    form otherwise, or says too little); windows of ``SENTENCE`` tokens at most are whole sentences."""
    n = np.maximum(0, counts - size + 1)
    doc = np.repeat(np.arange(len(counts)), n)
    at = np.arange(n.sum()) + np.repeat((np.cumsum(counts) - counts) - (np.cumsum(n) - n), n)
    if literal:
        keep = np.ones(len(at), bool)
        if size <= SENTENCE:
            keep = first[at] & np.append(first, True)[at + size]
            keep |= first[at] & (at + size == np.cumsum(counts)[doc])
    else:
        plain = np.concatenate([[0], np.cumsum(kind == _LITERAL)])
        plain = plain[at + size] - plain[at]
        keep = (plain >= min(LITERAL, size)) & (plain < size) & (size >= SHORTEST)
    at, doc = at[keep], doc[keep]
    token = hashes if literal else np.where(kind == _LITERAL, hashes, mix64(kind.astype(np.uint64) + np.uint64(7)))
    out = np.full(len(at), 2 * size + literal, np.uint64)
    for k in range(size):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + token[at + k])
    return out, at, doc


def _slots(hashes: np.ndarray, kind: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    """For each window the values behind its placeholders, in order."""
    place = at[:, None] + np.arange(size)
    open_ = kind[place] != _LITERAL
    ends = np.concatenate([[0], np.cumsum(open_.sum(1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[place[open_]].view(np.int64)))


_ROWS = "window bigint, place bigint, slots array<bigint>, size int, literal boolean"


def _window_rows(keys: list[pa.Array], names: list[str], column: pa.Array, sizes, wanted) -> Iterator[pa.RecordBatch]:
    """``sizes``: the window lengths to look for, or None for that of each text as an item."""
    for lo, hi, data, offsets in text_slices(column):
        hashes, kind, first, counts = tokens(data, offsets)
        own = np.minimum(counts, WINDOW)
        for size in np.unique(own[own > 0]).tolist() if sizes is None else sizes:
            for literal in (True, False):
                found, at, doc = windows(hashes, kind, first, counts, size, literal)
                keep = np.ones(len(found), bool) if sizes is not None else own[doc] == size
                if wanted is not None:
                    near = np.minimum(np.searchsorted(wanted, found), max(0, len(wanted) - 1))
                    keep &= wanted[near] == found if len(wanted) else False
                found, at, doc = found[keep], at[keep], doc[keep]
                if not len(found):
                    continue
                place = at - (np.cumsum(counts) - counts)[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(k.slice(lo, hi - lo).take(pa.array(doc)) for k in keys),
                        pa.array(found.view(np.int64)),
                        pa.array(place.astype(np.int64)),
                        _slots(hashes, kind, at, size),
                        pa.array(np.full(len(found), size, np.int32)),
                        pa.array(np.full(len(found), literal)),
                    ],
                    names=[*names, "window", "place", "slots", "size", "literal"],
                )


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id") -> DataFrame:
    """item, window, item_place, item_slots, size, literal, item_windows of all items."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _window_rows([batch.column(0)], ["id"], batch.column(1), None, None)

    kind = benchmark.schema[item_col].dataType.simpleString()
    found = benchmark.select(F.col(item_col), F.col("text").cast("string").alias("text")).mapInArrow(rows, f"id {kind}, {_ROWS}")
    number = found.groupBy("id").agg(F.countDistinct("place").alias("item_windows"))
    found = found.join(number, found["id"].eqNullSafe(number["id"])).select(found["*"], "item_windows")
    return staged(found.withColumnsRenamed({"id": "item", "place": "item_place", "slots": "item_slots"}), "benchmark-windows")


def _row_key(id_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col("text").cast("string"))


def _correspond(pairs: Column) -> Column:
    """Whether each value of the item stands for one value of the document."""
    return F.size(F.array_distinct(pairs)) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["i"])))


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """One row for each row of ``docs`` and item it contains: id, key (of id and text), item, windows, item_windows, copied."""
    items = benchmark_windows(benchmark, item_col)
    wanted = None
    if items.count() <= FILTER_WINDOWS:
        wanted = np.unique(items.select("window").toArrow().column("window").to_numpy()).view(np.uint64)
        wanted.sort()
    filter_of = docs.sparkSession.sparkContext.broadcast(wanted)
    # at most WINDOW different lengths
    lengths = [r["size"] for r in items.select("size").distinct().collect()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_memory_back()
        for batch in batches:
            yield from _window_rows([batch.column(0), batch.column(1)], ["id", "key"], batch.column(2), lengths, filter_of.value)

    kind = docs.schema[id_col].dataType.simpleString()
    found = (
        docs.select(F.col(id_col), _row_key(id_col).alias("key"), F.col("text").cast("string").alias("text"))
        .mapInArrow(rows, f"id {kind}, key bigint, {_ROWS}")
        .select("id", "key", "window", "place", "slots")
    )
    same = F.transform("item_slots", lambda v: F.struct(v.alias("i"), v.alias("d")))
    other = F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    # equal rows have one key, so they meet in the partial aggregate; a literal match comes before a template match
    by_place = (
        found.join(items, "window")
        .withColumn("pairs", F.when(F.col("literal"), same).otherwise(other))
        .groupBy("id", "key", "item", (F.col("place") - F.col("item_place")).alias("shift"), "item_place")
        .agg(F.max("item_windows").alias("item_windows"), F.max(F.struct("literal", "pairs")).alias("match"))
    )
    # one alignment holds no more windows than the item
    window = F.struct(F.col("item_place").alias("place"), F.col("match.literal").alias("literal"), F.col("match.pairs").alias("pairs"))
    aligned = (
        by_place.groupBy("id", "key", "item", "shift")
        .agg(F.max("item_windows").alias("item_windows"), F.sort_array(F.collect_list(window)).alias("found"))
        .withColumn("least", F.least(F.lit(MIN_WINDOWS).cast("bigint"), F.col("item_windows")).cast("int"))
    )
    pairs_of = lambda some: F.flatten(F.transform(some, lambda w: w["pairs"]))
    places_of = lambda some: F.transform(some, lambda w: w["place"])
    runs = F.filter(
        F.transform(F.col("found"), lambda _, k: F.slice("found", k + 1, F.col("least"))),
        lambda run: (F.size(run) == F.col("least"))
        & (F.element_at(run, -1)["place"] - F.element_at(run, 1)["place"] == F.col("least") - 1)
        & _correspond(pairs_of(run)),
    )
    literal = F.filter("found", lambda w: w["literal"])
    parts = F.array_distinct(F.concat(places_of(literal), F.flatten(F.transform(runs, places_of))))
    judged = aligned.select(
        "id",
        "key",
        "item",
        "item_windows",
        "least",
        F.size(literal).alias("literals"),
        F.when(_correspond(pairs_of(F.col("found"))), F.size("found")).otherwise(F.size(parts)).alias("windows"),
    ).where(F.col("windows") >= F.col("least"))
    best = F.struct(F.col("windows").cast("bigint").alias("windows"), (F.col("windows") == F.col("literals")).alias("copied"))
    return (
        judged.groupBy("id", "key", "item")
        .agg(F.max(best).alias("best"), F.max("item_windows").alias("item_windows"))
        .select("id", "key", "item", "best.windows", "item_windows", "best.copied")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """One row for each document and item it contains: ``id_col``, ``item_col``, windows, item_windows, copied.

    ``windows`` is the number that match along the best alignment; ``copied`` tells whether all of
    them are the item's own words and values."""
    return (
        contaminated_rows(docs, benchmark, id_col, item_col)
        .groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col))
        .agg(F.max(F.struct("windows", "copied")).alias("best"), F.max("item_windows").alias("item_windows"))
        .select(id_col, item_col, "best.windows", "item_windows", "best.copied")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs``, with all columns, whose own text contains no item."""
    bad_id, bad_key = unused(docs.columns, "bad_id", "bad_key")
    bad = contaminated_rows(docs, benchmark, id_col, item_col)
    bad = bad.select(F.col("id").alias(bad_id), F.col("key").alias(bad_key)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(bad_id)) & (_row_key(id_col) == F.col(bad_key))
    return docs.join(bad, same, "left_anti")
