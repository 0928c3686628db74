"""Token ids in a binary format: one wavelet matrix for each shard.

Documents are sorted by id across tasks, encoded with a public tokenizer (no special tokens
added; ``end_id`` after each document) and written in shards of about ``SHARD_TOKENS`` ids, whole
documents only. A shard is one compressed file image (see :class:`WaveletMatrix`), kept as one row
of a Parquet table, so that any store Spark can write to holds it.

A wavelet matrix keeps the ids as bit planes from the highest bit down; after each plane the ids
with bit 0 come before those with bit 1, in stable order. Counts of ones before a place (rank) and
their inverse (select) give the id at a place, the number of an id before a place, and the place
of an id's k-th occurrence, from the planes alone. Planes are compressed in blocks of ``BLOCK`` bytes with
the ones before each block beside them, so a question inflates one or two blocks of each plane.

Null and empty texts have the end id alone. A null doc_id sorts first. Rows with equal ids follow
the order of their texts' hashes. An empty table gives no shard and no rows. Other columns are not
read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .textbytes import SLICE_BYTES, give_memory_back, prefix_hash, span_hash, text_slices, words

SHARD_TOKENS = 1 << 22
END_ID = 2
#: bytes of a bit plane that are compressed together
BLOCK = 1 << 14
_MAGIC = b"WAVM2\0\0\0"


class Plane:
    """One bit of each id, packed eight to a byte, in blocks that are compressed one by one.

    ``ends[b]`` is where block b's image ends in ``data``; ``ranks[b]`` is the number of ones before
    block b. Only the blocks that a question touches are inflated."""

    def __init__(self, n: int, ends: np.ndarray, ranks: np.ndarray, data: memoryview) -> None:
        self.n, self.ends, self.ranks, self.data = n, ends, ranks, data
        self._at, self._bytes, self._sums = -1, np.zeros(0, np.uint8), np.zeros(1, np.int64)

    @classmethod
    def pack(cls, bits: np.ndarray) -> Plane:
        raw = np.packbits(bits)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        cuts = range(0, len(raw), BLOCK)
        blocks = [squeeze(raw[at : at + BLOCK].data) for at in cuts]
        ones = [int(np.bitwise_count(raw[at : at + BLOCK]).sum(dtype=np.int64)) for at in cuts]
        ends = np.cumsum([len(x) for x in blocks], dtype=np.int64)
        return cls(len(bits), ends, np.cumsum(ones, dtype=np.int64) - np.array(ones, np.int64), memoryview(b"".join(blocks)))

    def image(self) -> bytes:
        return struct.pack("<q", len(self.data)) + self.ends.astype("<i8").tobytes() + self.ranks.astype("<i8").tobytes() + self.data

    @classmethod
    def read(cls, data: memoryview, at: int, n: int) -> tuple[Plane, int]:
        """The plane of ``n`` bits whose image begins at ``at``, and where the image ends."""
        (size,) = struct.unpack_from("<q", data, at)
        blocks = -(-n // (8 * BLOCK))
        ends = np.frombuffer(data, "<i8", blocks, at + 8)
        ranks = np.frombuffer(data, "<i8", blocks, at + 8 + 8 * blocks)
        begin = at + 8 + 16 * blocks
        return cls(n, ends, ranks, data[begin : begin + size]), begin + size

    def _inflate(self, block: int) -> np.ndarray:
        begin = int(self.ends[block - 1]) if block else 0
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.data[begin : int(self.ends[block])]), np.uint8)

    def _open(self, block: int) -> None:
        """Inflate a block and count its ones byte by byte; the last one opened stays."""
        if block != self._at:
            self._at, self._bytes = block, self._inflate(block)
            self._sums = np.concatenate([[0], np.cumsum(np.bitwise_count(self._bytes), dtype=np.int64)])

    def look(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit at each place, and the number of ones before it (places 0 to n; bit n is 0)."""
        bit, ones = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        of = np.minimum(places // (8 * BLOCK), max(0, len(self.ends) - 1))
        for block in np.unique(of).tolist() if len(self.ends) else []:
            mine = np.flatnonzero(of == block)
            self._open(block)
            inside = places[mine] - block * 8 * BLOCK
            byte = np.minimum(inside >> 3, len(self._bytes) - 1)
            rest, value = inside - (byte << 3), self._bytes[byte].astype(np.int64)
            bit[mine] = (value >> np.maximum(7 - rest, 0)) & (rest < 8) & 1
            ones[mine] = self.ranks[block] + self._sums[byte] + np.bitwise_count(value >> (8 - rest))
        return bit, ones

    def place(self, one: int, k: int) -> int:
        """The place of the k-th (from 0) 1 or 0: its block by the ranks, then inside that block."""
        starts = np.arange(len(self.ends), dtype=np.int64) * (8 * BLOCK)
        before = self.ranks if one else starts - self.ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        self._open(block)
        bits = np.unpackbits(self._bytes, count=min(8 * BLOCK, self.n - block * 8 * BLOCK))
        return block * 8 * BLOCK + int(np.flatnonzero(bits == one)[k - before[block]])

    def bits(self) -> np.ndarray:
        """All bits."""
        raw = [self._inflate(b) for b in range(len(self.ends))]
        return np.unpackbits(np.concatenate([*raw, np.zeros(0, np.uint8)]), count=self.n).view(bool)


class WaveletMatrix:
    """Ids with rank and select. ``planes[k]`` has the bit 2^(bits - 1 - k) of the ids in that
    plane's order; ``zeros[k]`` is the number of its 0 bits."""

    def __init__(self, n: int, planes: list[Plane], zeros: list[int]) -> None:
        self.n, self.planes, self.zeros = n, planes, zeros

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        bits = bits or max(1, int(ids.max()).bit_length() if len(ids) else 1)
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for k in range(bits - 1, -1, -1):
            ones = (now & now.dtype.type(1 << k)) != 0
            planes.append(Plane.pack(ones))
            low = now[~ones]
            zeros.append(len(low))
            now = np.concatenate([low, now[ones]])
        return cls(len(ids), planes, zeros)

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<qi{len(self.zeros)}q", self.n, len(self.planes), *self.zeros)
        return head + b"".join(p.image() for p in self.planes)

    @classmethod
    def from_bytes(cls, data: memoryview) -> WaveletMatrix:
        n, bits = struct.unpack_from("<qi", data)
        zeros = list(struct.unpack_from(f"<{bits}q", data, 12))
        at, planes = 12 + 8 * bits, []
        for _ in range(bits):
            plane, at = Plane.read(data, at, n)
            planes.append(plane)
        return cls(n, planes, zeros)

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at ``places``."""
        at, out = np.asarray(places, np.int64), np.zeros(len(places), np.int64)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit, ones = plane.look(at)
            out = (out << 1) | bit
            at = np.where(bit == 1, zeros + ones, at - ones)
        return out

    def _range(self, token: int, before: int) -> tuple[int, int]:
        lo, hi = 0, before
        if token < 0 or token >> len(self.planes) or not self.n:
            return 0, 0
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            ones = plane.look(np.array([lo, hi]))[1].tolist()
            if token >> (len(self.planes) - 1 - k) & 1:
                lo, hi = zeros + ones[0], zeros + ones[1]
            else:
                lo, hi = lo - ones[0], hi - ones[1]
        return lo, hi

    def rank(self, token: int, before: int | None = None) -> int:
        """How often ``token`` occurs before place ``before`` (in all: None)."""
        lo, hi = self._range(token, self.n if before is None else before)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """The place of occurrence ``k`` (from 0) of ``token``; -1 if it has no so many."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            return -1
        at = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - level) & 1
            at = self.planes[level].place(one, at - self.zeros[level] if one else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids in order."""
        values = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            ones = self.planes[k].bits()
            out = np.empty_like(values)
            out[~ones] = values[: self.zeros[k]]
            out[ones] = values[self.zeros[k] :] | values.dtype.type(1 << (len(self.planes) - 1 - k))
            values = out
        return values


def write_shard(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard's file image: the documents' lengths and the wavelet matrix of their ids."""
    sizes = zstandard.ZstdCompressor(level=1).compress(lengths.astype("<i8").tobytes())
    return _MAGIC + struct.pack("<qq", len(lengths), len(sizes)) + sizes + WaveletMatrix.build(ids).to_bytes()


def read_shard(data: bytes) -> tuple[np.ndarray, WaveletMatrix]:
    """The documents' lengths and the wavelet matrix, whose planes stay compressed until asked."""
    if data[: len(_MAGIC)] != _MAGIC:
        raise ValueError("not a shard of token ids")
    n, size = struct.unpack_from("<qq", data, len(_MAGIC))
    at, view = len(_MAGIC) + 16, memoryview(data)
    lengths = zstandard.ZstdDecompressor().decompress(view[at : at + size])
    return np.frombuffer(lengths, "<i8", n), WaveletMatrix.from_bytes(view[at + size :])


# The chain of steps before the model of word_bpe_49k.json, as that file states it. Texts
# are cut into pieces by arrays only for files with this very chain.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_SPECIAL = ["<|startoftext|>", "<|endoftext|>"]

# Classes of bytes: words of printable ASCII and accented Latin-1 letters (0xC3 and a second byte), where
# lower-casing and composing cannot differ, are cut by these; a word with any other byte is left whole.
_LETTER, _DIGIT, _OTHER, _FOREIGN = 1, 2, 3, 4
_CLASS = np.full(256, _FOREIGN, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[[9, 10, 11, 12, 13, 32]] = 0


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def cut_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case, starts, ends, left whole, number in each document) of the vocabulary's pieces.

    A piece is a run of letters, a digit, a run of other signs, or one of 's 't 'm 'd 're 've 'll
    where no other sign is before it. A word with bytes beyond printable Latin-1, or with ``<|``,
    which may begin a special token, is one piece as it stands (``left whole``)."""
    kind, low = _CLASS[data], data.copy()
    upper = (data >= 65) & (data <= 90)
    low[upper] += 32
    accent = np.flatnonzero(data[:-1] == 0xC3)
    second = data[accent + 1]
    accent, second = accent[(second != 0x97) & (second != 0xB7)], second[(second != 0x97) & (second != 0xB7)]
    kind[accent] = kind[accent + 1] = _LETTER
    low[accent[second < 0x9F] + 1] += 32
    kind[:-1][(data[:-1] == 60) & (data[1:] == 124)] = _FOREIGN

    starts, ends, counts = words(data, offsets)
    foreign = np.flatnonzero(kind == _FOREIGN)
    whole = np.unique(np.searchsorted(starts, foreign, side="right") - 1)
    begin = np.empty(len(data), bool)
    begin[:1] = True
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    begin[kind == 0] = False
    begin[starts] = True

    quotes = np.flatnonzero(data == 39)
    quotes = quotes[begin[quotes]]
    if len(quotes):
        left = ends[np.searchsorted(starts, quotes, side="right") - 1] - quotes
        one, two = (low[np.minimum(quotes + k, len(low) - 1)] for k in (1, 2))
        short = (left > 1) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (left > 2) & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
        size = np.where(short, 2, np.where(long, 3, 0))
        quotes, size, left = quotes[size > 0], size[size > 0], left[size > 0]
        begin[quotes + 1] = False
        begin[(quotes + size)[left > size]] = True
    if len(whole):
        step = np.zeros(len(data) + 1, np.int8)
        step[starts[whole]] += 1
        step[ends[whole]] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
        low[inside] = data[inside]
        begin[inside] = False
        begin[starts[whole]] = True
    first = np.flatnonzero(begin)
    last = np.append(first[1:], len(data))
    at_end = np.searchsorted(first, ends) - 1
    last[at_end] = ends
    left_whole = np.zeros(len(first), bool)
    left_whole[np.searchsorted(first, starts[whole])] = True
    return low, first, last, left_whole, np.diff(np.searchsorted(first, offsets))


class Encoder:
    """Encodes texts piece by piece, for white space always ends a word of this vocabulary and its
    pieces do not depend on one another. Each distinct piece is encoded once, by the library's model;
    words left whole go through the library's whole chain, as do whole texts if the file's chain is
    another one. What has been encoded stays known in arrays sorted by hash; beyond ``MOST`` pieces,
    those not used for longest go."""

    MOST = 400_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = str.maketrans(_byte_letters())
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.by_piece = (
            parts["normalizer"] == _NORMALIZER
            and parts["pre_tokenizer"] == _PRE_TOKENIZER
            and parts["truncation"] is None
            and parts["model"]["type"] == "BPE"
            and not parts["model"]["dropout"]
            and [t["content"] for t in parts["added_tokens"]] == _SPECIAL
        )
        self.keys, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.turn = np.zeros(0, np.uint32), 0

    def _ids(self, pieces: list[bytes], left_whole: list[bool]) -> list[list[int]]:
        """The ids of each piece."""
        words_whole = [p.decode() for p, w in zip(pieces, left_whole, strict=True) if w]
        whole = iter(self.tokenizer.encode_batch_fast(words_whole, add_special_tokens=False) if words_whole else [])
        tokenize, letters = self.model.tokenize, self.letters
        return [
            next(whole).ids if w else [t.id for t in tokenize(p.decode() if p.isascii() else p.decode("latin-1").translate(letters))]
            for p, w in zip(pieces, left_whole, strict=True)
        ]

    def _learn(self, keys: np.ndarray, lists: list[list[int]]) -> None:
        """Add new pieces, their keys in ascending order, with their ids."""
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        begin = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start = np.insert(self.keys, at, keys), np.insert(self.start, at, begin)
        self.length, self.used = np.insert(self.length, at, sizes), np.insert(self.used, at, self.turn)

    def _forget(self) -> None:
        """Keep the half of ``MOST`` that was used last."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.MOST // 2])
        self.keys, self.used, self.length = self.keys[keep], self.used[keep], self.length[keep]
        ends = np.cumsum(self.length)
        self.flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[keep] - (ends - self.length), self.length)]
        self.start = ends - self.length

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, each followed by ``end_id``, and their numbers."""
        if not self.by_piece:
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            lists = [[*e.ids, end_id] for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter(chain.from_iterable(lists), np.uint32, int(counts.sum())), counts
        low, starts, ends, left_whole, counts = cut_pieces(data, offsets)
        hashes = span_hash(prefix_hash(low), starts, ends)
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        self.turn += 1
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        new = first[~known]
        if len(new):
            raw = low.tobytes()
            pieces = [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            self._learn(distinct[~known], self._ids(pieces, left_whole[new].tolist()))
            at = np.searchsorted(self.keys, distinct)
        self.used[at] = self.turn
        # one more piece after each document: the end id, kept behind all others
        start, length = np.append(self.start[at], len(self.flat)), np.append(self.length[at], 1)
        order = np.insert(place, np.cumsum(counts), len(distinct))
        n = length[order]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = np.append(self.flat, np.uint32(end_id))[np.arange(total[-1]) + np.repeat(start[order] - total[:-1], n)]
        if len(self.keys) > self.MOST:
            self._forget()
        return ids, np.diff(total[np.concatenate([[0], np.cumsum(counts + 1)])])


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker's encoder; what it knows stays for the worker's next tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_shards(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs`` in the order of ids; the staged table of shards: part, shard, n_docs, n_tokens, ids, data.

    ``part`` and then ``shard`` give the order; ``ids`` has the documents' ids."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    # partitions follow one another in the order of ids, also after adaptive merging of neighbours
    ordered = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    shape = f"part int, shard int, n_docs bigint, n_tokens bigint, ids array<{kind.simpleString()}>, data binary"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_memory_back()
        encoder, part, shard = _encoder(vocabulary), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        names: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            all_ids, all_lengths = np.concatenate(ids), np.concatenate(lengths)
            keys = pa.concat_arrays(names)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([shard], pa.int32()),
                    pa.array([len(all_lengths)], pa.int64()),
                    pa.array([len(all_ids)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                    pa.array([write_shard(all_lengths, all_ids)], pa.binary()),
                ],
                names=["part", "shard", "n_docs", "n_tokens", "ids", "data"],
            )

        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1), min(SLICE_BYTES, shard_tokens)):
                some, n = encoder.encode(data, offsets, end_id)
                ids.append(some)
                lengths.append(n)
                names.append(batch.column(0).slice(lo, hi - lo))
                if sum(map(len, ids)) >= shard_tokens:
                    yield flush()
                    shard += 1
                    ids, lengths, names = [], [], []
        if lengths and sum(map(len, lengths)):
            yield flush()

    return staged(ordered.mapInArrow(encoded, shape), "token-shards")


def read_documents(shards: DataFrame, id_col: str = "doc_id", tokens: bool = False) -> DataFrame:
    """Each document as its shard's file has it: ``id_col``, start, n_tokens, ids_crc32 (and tokens).

    ``start`` is the number of ids of all documents before it: sums run within each part of the
    order and, over one row for each part, across parts."""
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    bases = bases.join(parts, F.col("part") == F.col("p")).select(
        "part", "shard", (F.col("part_start") + F.col("before")).alias("base")
    )
    names = ["part", "shard", "id", "offset", "n_tokens", "ids_crc32", *["tokens"] * tokens]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_memory_back()
        for batch in batches:
            for row in range(batch.num_rows):
                lengths, matrix = read_shard(batch.column(3)[row].as_buffer().to_pybytes())
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths)
                raw = memoryview(ids).cast("B")
                crcs = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [
                    pa.array(np.full(len(lengths), batch.column(0)[row].as_py(), np.int32)),
                    pa.array(np.full(len(lengths), batch.column(1)[row].as_py(), np.int32)),
                    batch.column(2)[row].values,
                    pa.array(ends - lengths),
                    pa.array(lengths),
                    pa.array(crcs, pa.int64()),
                ]
                if tokens:
                    places = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(places, pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = shards.schema["ids"].dataType.elementType.simpleString()
    shape = f"part int, shard int, id {kind}, offset bigint, n_tokens bigint, ids_crc32 bigint" + ", tokens array<int>" * tokens
    rows = shards.select("part", "shard", "ids", "data").mapInArrow(decoded, shape).join(bases, ["part", "shard"])
    return rows.select(
        F.col("id").alias(id_col),
        (F.col("base") + F.col("offset")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *["tokens"] * tokens,
    )
