"""Suffix dedup: remove every byte under a string of ``span`` bytes that starts more than once.

Texts are UTF-8 bytes; strings never cross documents; the two starts may lie in one document and
may overlap; strings are judged on the input.

Sparse suffix arrays. A string's anchor is the place among its first ``reach`` starts where the
hash of the next 16 bytes is lowest (the first such place). It follows from the string alone, so
equal strings have their anchors at equal places, and all strings of one anchor that start in a
row are one entry: a suffix of the text, known by its core (the ``span - reach + 1`` bytes from the
anchor on, which lie in all of the entry's strings) and its hull (all bytes under its strings).
There is about one entry for each ``reach / 2`` bytes. Cores, hulls and strings are known by 64-bit
hashes, and the arrays are sorted by those: about 1 % of all suffixes, 8 bytes each, where whole
suffix arrays of the corpus would sort and move hundreds of bytes for every byte of text.

Logarithmic index family. Entries are dealt to tasks by their core. A task takes them batch by
batch: a new batch is sorted (its suffix array), scanned against itself and against every level
of the family in merge order, marking both sides of each match, and becomes a level; levels of
equal size are merged into one of twice the size (:class:`SuffixIndex`).

1. Cores. Entries whose core is nowhere else have no repeated string and are dropped.
2. Hulls. If an entry's hull is somewhere else, all its strings are repeated.
3. Borders. What is left are entries at the ends of matches. They, and one of each other hull with
   the same core, are spelled out string by string, and those are matched by a family again.
4. Each document is joined with its repeated strings and loses the bytes under them.

Hot groups: entries that a task finds repeated in its own slice of text are known at once and pass
by; of their core only a marker is sent. A core with many different hulls has its strings dealt
to several tasks by their hashes.

Nulls and ties: a null text is empty; documents shorter than ``span`` keep all bytes; rows that
repeat are each other's copies. Documents are told apart by a 64-bit hash of id and text. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty
from .textbytes import mix64, prefix_hash, span_hash, text_slices

SPAN, REACH, GRAM = 400, 200, 16
#: strings of a core's border entries go to one task up to so many entries
ENTRIES_TOGETHER = 4096

_PLACE = np.uint64((1 << 31) - 1)
# kinds of entries and of what documents are joined with
_PLAIN, _KNOWN, _MARKER, _BORDER = range(4)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(values)] = values
    block = padded.reshape(-1, width)
    left = np.minimum.accumulate(block, axis=1).reshape(-1)
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def entries(data: np.ndarray, offsets: np.ndarray, span: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Core, hull, first start and number of strings of each entry."""
    if len(data) < span:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    prefix = prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    ranked = (span_hash(prefix, at, at + GRAM) & ~_PLACE) | at.astype(np.uint64)
    anchor = (sliding_min(ranked, reach) & _PLACE).astype(np.int64)
    change = np.zeros(len(data) + 1, np.int64)
    long = np.diff(offsets) >= span
    np.add.at(change, offsets[:-1][long], 1)
    np.add.at(change, offsets[1:][long] - span + 1, -1)
    starts = np.flatnonzero(np.cumsum(change[:-1]))
    own = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    own, lo = own[first], starts[first]
    core = span_hash(prefix, own, own + span - reach + 1)
    hull = mix64(span_hash(prefix, lo, lo + n - 1 + span) + (own - lo).astype(np.uint64))
    return core, hull, lo, n


def _pack(lo: np.ndarray, n: np.ndarray, kind: int | np.ndarray) -> np.ndarray:
    return (lo.astype(np.int64) << 10) | (n.astype(np.int64) << 2) | kind


class SuffixIndex:
    """A logarithmic family of sorted arrays of suffixes' fingerprints."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # batches, fingerprints, entries
        self.repeated = np.zeros(0, bool)
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        """Take a batch; mark its entries, and those before, that have an equal."""
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        own = np.zeros(len(keys), bool)
        same = keys[1:] == keys[:-1]
        own[1:] |= same
        own[:-1] |= same
        if self.size + len(keys) > len(self.repeated):
            self.repeated = np.concatenate([self.repeated, np.zeros(max(len(keys), len(self.repeated)), bool)])
        for _, level, members in self.levels:
            at = np.searchsorted(level, keys)
            hit = level[np.minimum(at, len(level) - 1)] == keys
            own |= hit
            # equal entries of one level are marked already; the first stands for them
            self.repeated[members[at[hit]]] = True
        ids = self.size + order
        self.repeated[ids] = own
        self.size += len(keys)
        batch = (1, keys, ids)
        while self.levels and self.levels[-1][0] == batch[0]:
            n, level, members = self.levels.pop()
            merged = np.concatenate([level, batch[1]])
            order = np.argsort(merged, kind="stable")
            batch = (2 * n, merged[order], np.concatenate([members, batch[2]])[order])
        if len(batch[1]):
            self.levels.append(batch)


def _entry_rows(span: int, reach: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            for first, last, data, offsets in text_slices(batch.column(1)):
                core, hull, lo, n = entries(data, offsets, span, reach)
                doc = np.searchsorted(offsets, lo, side="right") - 1
                distinct, place, count = np.unique(core, return_inverse=True, return_counts=True)
                known = count[place] > 1
                marker = distinct[count > 1]
                zero = np.zeros(len(marker), np.int64)
                packed = _pack(lo - offsets[doc], n, np.where(known, _KNOWN, _PLAIN))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([core, marker]).view(np.int64)),
                        pa.array(np.concatenate([hull, marker]).view(np.int64)),
                        pa.array(np.concatenate([key[first:last][doc], zero])),
                        pa.array(np.concatenate([packed, zero | _MARKER])),
                    ],
                    names=["core", "hull", "doc", "entry"],
                )

    return rows


def _repeated_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries whose core occurs again; a task has all entries of its cores."""
    index, kept, names = SuffixIndex(), [], ["core", "hull", "doc", "entry"]
    for batch in batches:
        core, hull, doc, entry = (batch.column(i).to_numpy() for i in range(4))
        known = entry & 3 == _KNOWN
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[known]) for x in (core, hull, doc, entry & ~3)], names=names)
        core, hull, doc, entry = core[~known], hull[~known], doc[~known], entry[~known]
        # a marker stands for several entries, so it is its own equal
        twice = np.concatenate([core, core[entry & 3 == _MARKER]])
        index.add(twice.view(np.uint64))
        kept.append((len(twice), core, hull, doc, entry))
    at = 0
    for size, core, hull, doc, entry in kept:
        found = index.repeated[at : at + len(core)] & (entry & 3 == _PLAIN)
        at += size
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (core, hull, doc, entry)], names=names)


def _strings(span: int):
    """The border entries of documents, string by string: one row for each entry and part."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            lists = batch.column(2)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            values = lists.flatten()
            entry, core, together = (values.field(i).to_numpy() for i in range(3))
            for first, last, data, offsets in text_slices(batch.column(1)):
                mine = slice(ends[first], ends[last])
                e, c, m = entry[mine], core[mine], together[mine]
                doc = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))
                lo, n = e >> 10, (e >> 2) & 255
                of = np.repeat(np.arange(len(e)), n)
                place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                start = offsets[doc[of]] + lo[of] + place
                h = span_hash(prefix_hash(data), start, start + span)
                distinct, index, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                known = count[inverse] > 1
                # of strings that repeat within the slice one is sent on, twice (the second time out of place)
                marker = index[count > 1]
                of = np.concatenate([of, of[marker], of[marker]])
                place = np.concatenate([place, place[marker], np.full(len(marker), 255)])
                h = np.concatenate([h, h[marker], h[marker]])
                known = np.concatenate([known, np.zeros(2 * len(marker), bool)])
                parts = 1 + m[of] // ENTRIES_TOGETHER
                part = np.where(known, -1 - doc[of], (h % parts.astype(np.uint64)).astype(np.int64))
                order = np.lexsort((place, part, of))
                of, place, h, part = of[order], place[order].astype(np.uint8), h[order], part[order]
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (part[1:] != part[:-1])
                at = np.flatnonzero(new)
                stop = np.append(at[1:], len(of))
                row = of[at]
                spans = list(zip(at.tolist(), stop.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c[row]),
                        pa.array(part[at]),
                        pa.array(key[first:last][doc[row]]),
                        pa.array(lo[row]),
                        pa.array([place[a:b].tobytes() for a, b in spans], pa.binary()),
                        pa.array([h[a:b].tobytes() if part[a] >= 0 else b"" for a, b in spans], pa.binary()),
                    ],
                    names=["core", "part", "doc", "lo", "places", "strings"],
                )

    return rows


def _runs(doc: np.ndarray, lo: np.ndarray, place: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
    """Repeated strings as runs of starts; ``of`` has the row of each place."""
    new = np.ones(len(place), bool)
    new[1:] = (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(place)))
    row = of[at]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[row]), pa.array(_pack(lo[row] + place[at], n, _KNOWN))], names=["doc", "entry"]
    )


def _repeated_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of strings that occur again; a task has all strings that may equal one of its own."""
    index, kept = SuffixIndex(), []
    for batch in batches:
        doc, lo = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        places = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(4)]
        of = np.repeat(np.arange(len(places)), [len(x) for x in places])
        place = np.concatenate([*places, np.zeros(0, np.uint8)]).astype(np.int64)
        sent = (batch.column(1).to_numpy() >= 0)[of]
        if (~sent).any():
            yield _runs(doc, lo, place[~sent], of[~sent])
        h = b"".join(x.as_py() for x in batch.column(5))
        index.add(np.frombuffer(h, np.uint64))
        kept.append((doc, lo, place[sent], of[sent]))
    at = 0
    for doc, lo, place, of in kept:
        found = index.repeated[at : at + len(place)] & (place != 255)
        at += len(place)
        if found.any():
            yield _runs(doc, lo, place[found], of[found])


def _removed(span: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans, sizes, removed = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                sizes.append(len(data))
                entry = found.values.to_numpy() if found.is_valid else np.zeros(0, np.int64)
                border = entry[entry & 3 == _BORDER] & ~3
                entry = entry[entry & 3 != _BORDER]
                entry = entry[(entry & 3 == _KNOWN) | ~np.isin(entry, border)]
                change = np.zeros(len(data) + 1, np.int64)
                lo, n = entry >> 10, (entry >> 2) & 255
                np.add.at(change, lo, 1)
                np.add.at(change, lo + n - 1 + span, -1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                kept.append(data[~gone].tobytes())
                spans.append(edge.tolist())
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.int64())),
                    pa.array(kept, pa.binary()),
                ],
                names=["id", "n_bytes", "n_removed", "edges", "kept"],
            )

    return rows


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", span: int = SPAN, reach: int = REACH) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, n_bytes, n_removed, edges, kept.

    ``edges`` has begin and end of each maximal removed run, one after the other; ``kept`` has the
    remaining bytes."""
    if not GRAM <= span - reach + 1 <= span or reach > 254:
        raise ValueError("reach must leave a core of 16 bytes or more and be 254 at most")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty().alias("text"))
    rows = rows.select(F.xxhash64("id", "text").alias("doc"), "id", "text")
    kind = F.col("entry").bitwiseAND(F.lit(3).cast("bigint"))
    # known entries need not meet anyone, so they are spread
    dealt = F.when(kind == _KNOWN, F.xxhash64("doc", "entry")).otherwise(F.col("core"))
    shape = "core bigint, hull bigint, doc bigint, entry bigint"
    found = rows.select("doc", "text").mapInArrow(_entry_rows(span, reach), shape).repartition(dealt)
    found = staged(found.mapInArrow(_repeated_entries, shape), "repeated-cores")
    hulls = found.groupBy("core", "hull").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "entry")).alias("one"))
    hulls = staged(hulls.select("core", "n", "one.doc", "one.entry"), "hulls")
    cores = hulls.groupBy("core").agg(F.count(F.lit(1)).alias("together"), F.min("n").alias("least"))
    cores = staged(cores.where("least = 1").select("core", "together"), "border-cores")
    borders = hulls.join(cores, "core").select("doc", "entry", "core", "together")
    borders = borders.groupBy("doc").agg(F.collect_list(F.struct("entry", "core", "together")).alias("entries"))

    # the texts are dealt once by document, for both joins
    texts = rows.repartition("doc")
    strings = texts.join(borders, "doc").select("doc", "text", "entries")
    strings = strings.mapInArrow(_strings(span), "core bigint, part bigint, doc bigint, lo bigint, places binary, strings binary")
    runs = strings.repartition("core", "part").mapInArrow(_repeated_strings, "doc bigint, entry bigint")
    alone = hulls.where("n = 1").select("doc", F.col("entry").bitwiseOR(F.lit(_BORDER).cast("bigint")).alias("entry"))
    every = found.select("doc", "entry").union(alone).union(runs)
    every = every.groupBy("doc").agg(F.collect_list("entry").alias("entries"))
    id_kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {id_kind}, n_bytes bigint, n_removed bigint, edges array<bigint>, kept binary"
    joined = texts.join(every, "doc", "left").select("id", F.col("text").cast("binary").alias("text"), "entries")
    return joined.mapInArrow(_removed(span), shape).withColumnRenamed("id", id_col)
