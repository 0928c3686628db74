"""Language-model scores of whole texts: context-tree weighting over bytes.

A text is its UTF-8 bytes with A-Z as a-z, then one end byte that no text has. Each byte is eight
binary decisions, the highest bit first; each decision has a tree of contexts, the last 0, 1, ...
up to ``depth`` bytes. Every node keeps how often 0 and 1 followed in the training texts and the
Krichevsky-Trofimov estimate from that; nodes are weighted from the leaves up, half their own
block probability and half the product of their children's. A decision's probability mixes the
estimates of all depths along its context by those weights; a context that was never seen in
training ends the mix at the deepest one that was. The sum of the logarithms is the score; divided
by the number of bytes it is the code length per byte.

Training counts cover all texts whose crc32(doc_id as text) mod 7 is not 2: counts of the strings
of ``depth + 1`` bytes. The depth is the same at every size. The tree is dealt by the last ``TOP``
bytes of context to parts, each with all deeper nodes of its contexts; their number follows the
input (one for each ``batch_bytes``, ``PARTS`` at least). A part gets the
distinct strings of every batch with their training counts, builds its nodes, and sends each batch
the logarithms of its strings. Only the nodes of less than ``TOP`` bytes of context, 65,280 of them
whatever the input, are put together from all parts and sent to the tasks.

The base beside it scores words and one end for each text by counts in the training texts, with
one added. Documents are dealt to batches by a hash; each batch sends its distinct words with
their counts, gets the counts over all batches back, and sums them up for its own documents.
Words are told apart by 64-bit hashes.

Null texts count as empty (one end). Repeated rows count as often as they are there and each get a
row. An empty table gives no rows; without training texts every byte costs eight bits and
train_tokens is 0. Other columns than doc_id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .textbytes import _LOWER, give_memory_back, mix64, segment_sums, text_slices, word_hashes

FOLDS, HELD_OUT = 7, 2
START, END = 0xFE, 0xFF  # bytes that UTF-8 never has
END_WORD = np.uint64(0x454E44)
BATCH_BYTES = 16 << 20
TOP, PARTS = 2, 256
MOST_GRAMS = 1 << 21  # strings that a task gathers before it sends them on
DEEPEST = 6  # strings and a mark have to fit into 64 bits


def held_out(id_col: str = "doc_id") -> Column:
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == HELD_OUT


def byte_grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte (and each end) with the ``depth`` bytes before it, as one number; numbers per document."""
    sizes = np.diff(offsets)
    first = offsets[:-1] + np.arange(len(sizes)) * (depth + 1)
    padded = np.full(len(data) + len(sizes) * (depth + 1), START, np.uint8)
    padded[np.arange(len(data)) + np.repeat(first + depth - offsets[:-1], sizes)] = _LOWER[data]
    padded[first + depth + sizes] = END
    at = np.arange(len(data) + len(sizes)) + np.repeat(np.arange(len(sizes)) * depth, sizes + 1)
    code = np.zeros(len(padded) - depth, np.uint64)
    for k in range(depth + 1):
        code = (code << np.uint64(8)) | padded[k : len(padded) - depth + k]
    return code[at], sizes + 1


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0, by Stirling's series from x + 8 down."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    out = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series
    for k in range(8):
        out -= np.log(x + k)
    return out


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any one sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def _mask(n: int) -> np.uint64:
    """The last ``n`` bytes of a number."""
    return np.uint64((1 << (8 * n)) - 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _distinct(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, sorted, and the place of each number among them; by hash, as most are repeats."""
    coded = pa.array(numbers).dictionary_encode()
    values, place = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    order = np.argsort(values)
    rank = np.empty(len(values), np.int32)
    rank[order] = np.arange(len(values), dtype=np.int32)
    return values[order], rank[place]


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(first)


def _counted(grams: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct strings, sorted, and how often each is one of the ``trained``; by one sort of plain numbers."""
    ordered = np.sort((grams << np.uint64(1)) | trained)
    at = _runs(ordered >> np.uint64(1))
    counts = np.add.reduceat((ordered & np.uint64(1)).astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    return ordered[at] >> np.uint64(1), counts


def _merged(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct strings of several sorted lists, their counts added up, and the place of each string sent."""
    distinct, place = _distinct(np.concatenate([np.zeros(0, np.uint64), *grams]))
    sums = np.bincount(place, np.concatenate([np.zeros(0), *counts]), len(distinct)).astype(np.int64)
    return distinct, sums, place


class ContextTree:
    """The contexts of each depth from ``least`` on, and for each depth and bit the sorted keys of the
    nodes with their estimate of a 1 and their weight. A node's key is its context's number and the
    bits of the byte that are already known; 8 nodes at most for each string and depth."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int, least: int = 0) -> None:
        self.depth, self.least = depth, least
        byte = grams & np.uint64(255)
        self.contexts, number = [], []
        for d in range(least, depth + 1):
            found, place = np.unique((grams >> np.uint64(8)) & _mask(d), return_inverse=True)
            self.contexts.append(found)
            number.append(place.astype(np.uint64))
        shorter = [
            np.searchsorted(self.contexts[k], self.contexts[k + 1] & _mask(least + k)).astype(np.uint64)
            for k in range(depth - least)
        ]
        self.nodes: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(8)]
        #: for each bit the keys of the nodes at ``least`` with their zeros, ones and block probability
        self.roots: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for bit in range(8):
            known = byte >> np.uint64(8 - bit)
            one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.float64)
            below: tuple[np.ndarray, np.ndarray] | None = None
            for k in range(depth - least, -1, -1):
                keys, place = np.unique((number[k] << np.uint64(bit)) | known, return_inverse=True)
                ones = np.bincount(place, counts * one, len(keys))
                zeros = np.bincount(place, counts, len(keys)) - ones
                own = kt_block(zeros, ones)
                if below is None:
                    total, weight = own, np.ones(len(keys))
                else:
                    child, of = below
                    parent = (shorter[k][child >> np.uint64(bit)] << np.uint64(bit)) | (child & np.uint64((1 << bit) - 1))
                    children = np.bincount(np.searchsorted(keys, parent), of, len(keys))
                    total = np.logaddexp(own, children) - np.log(2)
                    weight = np.exp(own - np.log(2) - total)
                below = (keys, total)
                self.nodes[bit].append((keys, (ones + 0.5) / (ones + zeros + 1), weight))
            self.nodes[bit].reverse()
            self.roots.append((keys, zeros, ones, total))

    def log10(self, grams: np.ndarray, top: TopTree | None = None) -> np.ndarray:
        """log10 of the probability of each string's last byte after the others; ``top`` has the depths before ``least``."""
        out = np.zeros(len(grams))
        byte = grams & np.uint64(255)
        context = [
            _find(self.contexts[d - self.least], (grams >> np.uint64(8)) & _mask(d)) for d in range(self.least, self.depth + 1)
        ]
        for bit in range(8):
            if top is None:
                p, left = np.zeros(len(grams)), np.ones(len(grams))
                last, going = np.full(len(grams), 0.5), np.ones(len(grams), bool)
            else:
                p, left, last, going = top.mixed(grams, bit)
            for (number, seen), (keys, estimate, weight) in zip(context, self.nodes[bit], strict=True):
                if not len(keys):
                    break
                want = (number.astype(np.uint64) << np.uint64(bit)) | (byte >> np.uint64(8 - bit))
                at, there = _find(keys, want)
                going &= seen & there
                if not going.any():
                    break
                own, w = estimate[at], weight[at]
                p += np.where(going, left * w * own, 0)
                left *= np.where(going, 1 - w, 1)
                last = np.where(going, own, last)
            # the deepest node that was seen takes what no deeper one can
            p += left * last
            one = (byte >> np.uint64(7 - bit)) & np.uint64(1) == 1
            out += np.log10(np.where(one, p, 1 - p))
        return out


class TopTree:
    """The nodes of the depths before ``least``, all contexts and known bits in arrays."""

    def __init__(self, least: int, context: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> None:
        z, o, c = (np.zeros((1 << (8 * (least - 1)), 256)) for _ in range(3))
        z[context, node], o[context, node], c[context, node] = zeros, ones, children
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for d in range(least - 1, -1, -1):
            seen = z + o > 0
            own = kt_block(z, o)
            total = np.where(seen, np.logaddexp(own, c) - np.log(2), 0)
            weight = np.exp(own - np.log(2) - total)
            self.levels.insert(0, (seen, (o + 0.5) / (o + z + 1), weight))
            if d:
                z, o, c = (x.reshape(256, -1, 256).sum(0) for x in (z, o, total))

    def mixed(self, grams: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What these depths give to the mix of each string, what they leave, the last estimate, and whether all were seen."""
        p, left = np.zeros(len(grams)), np.ones(len(grams))
        last, going = np.full(len(grams), 0.5), np.ones(len(grams), bool)
        node = np.uint64(1 << bit) | ((grams & np.uint64(255)) >> np.uint64(8 - bit))
        for d, (seen, estimate, weight) in enumerate(self.levels):
            at = (((grams >> np.uint64(8)) & _mask(d)).astype(np.int64), node.astype(np.int64))
            going &= seen[at]
            own, w = estimate[at], weight[at]
            p += np.where(going, left * w * own, 0)
            left *= np.where(going, 1 - w, 1)
            last = np.where(going, own, last)
        return p, left, last, going


def _packed(numbers: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit numbers, byte by byte, compressed."""
    return zlib.compress(numbers.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)


def _unpacked(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.reshape(-1).view(np.uint64)


def _dealt(grams: np.ndarray, least: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that puts sorted strings into parts, the parts that have any, and where each ends."""
    part = (mix64(((grams >> np.uint64(8)) & _mask(least)) + np.uint64(1)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    found, n = np.unique(part, return_counts=True)
    return order, found, np.cumsum(n)


def _part_rows(grams: np.ndarray, counts: np.ndarray, depth: int, least: int, parts: int) -> tuple[list, list, list]:
    """part, grams, counts of each part that sorted strings have."""
    order, found, ends = _dealt(grams, least, parts)
    grams, counts = grams[order], counts[order].astype(np.uint64)
    spans = list(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)) if len(ends) else []
    return found.tolist(), [_packed(grams[a:b], depth + 1) for a, b in spans], [_packed(counts[a:b], 8) for a, b in spans]


def _part_tree(table: pa.Table, depth: int, least: int) -> tuple[ContextTree, np.ndarray, np.ndarray, np.ndarray]:
    """A part's tree, its distinct strings, which of them each sent string is, and how many each row sent."""
    sent = [_unpacked(x, depth + 1) for x in table.column("grams").to_pylist()]
    counts = np.concatenate([_unpacked(x, 8) for x in table.column("counts").to_pylist()])
    distinct, place = _distinct(np.concatenate(sent))
    n = np.bincount(place, counts.astype(np.float64), len(distinct))
    return ContextTree(distinct[n > 0], n[n > 0], depth, least), distinct, place, np.array([len(x) for x in sent])


def top_tree(training: DataFrame, depth: int, least: int, parts: int = PARTS) -> TopTree | None:
    """The depths before ``least`` of the tree of the texts of ``training``."""
    if not least:
        return None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_memory_back()
        def rows(grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            part, packed, n = _part_rows(grams, counts, depth, least, parts)
            return pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int64()), pa.array(packed, pa.binary()), pa.array(n, pa.binary())], names=["part", "grams", "counts"]
            )

        grams, counts = [], []
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                ordered = np.sort(byte_grams(data, offsets, depth)[0])
                at = _runs(ordered)
                grams.append(ordered[at])
                counts.append(np.diff(np.append(at, len(ordered))))
                if sum(map(len, grams)) > MOST_GRAMS:
                    distinct, n, _ = _merged(grams, counts)
                    grams, counts = [distinct], [n]
                    if len(distinct) > MOST_GRAMS // 2:
                        yield rows(distinct, n)
                        grams, counts = [], []
        yield rows(*_merged(grams, counts)[:2])

    def roots(table: pa.Table) -> pa.Table:
        tree = _part_tree(table, depth, least)[0]
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        for bit, (keys, zeros, ones, total) in enumerate(tree.roots):
            context = tree.contexts[0][keys >> np.uint64(bit)]
            node = np.uint64(1 << bit) | (keys & np.uint64((1 << bit) - 1))
            row = (context & _mask(least - 1), node, context, zeros, ones, total)
            for column, values in zip(columns, row, strict=True):
                column.append(values)
        values = [np.concatenate(c) for c in columns]
        return pa.table([pa.array(v.astype(t)) for v, t in zip(values, [np.int64] * 5 + [np.float64], strict=True)], names=names)

    names = ["context", "node", "child", "zeros", "ones", "total"]
    found = training.select("text").mapInArrow(counted, "part bigint, grams binary, counts binary").groupBy("part")
    found = found.applyInArrow(roots, "context bigint, node bigint, child bigint, zeros bigint, ones bigint, total double")
    # added up in the order of the children, so that the sum is the same in each run
    children = F.sort_array(F.collect_list(F.struct("child", "total")))
    table = (
        found.groupBy("context", "node")
        .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), children.alias("children"))
        .withColumn("children", F.aggregate("children", F.lit(0.0), lambda a, x: a + x["total"]))
        .toArrow()
    )
    return TopTree(least, *(table.column(c).to_numpy() for c in ("context", "node", "zeros", "ones", "children")))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", depth: int = 5, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes."""
    if not 0 <= depth <= DEEPEST:
        raise ValueError(f"depth is 0 to {DEEPEST}")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held"), text_or_empty().alias("text"))
    least = min(TOP, depth)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    batches = max(1, -(-int(total) // batch_bytes))
    parts = max(PARTS, batches)
    top = spark.sparkContext.broadcast(top_tree(rows.where(~F.col("held")), depth, least, parts))
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(batches))).select("batch", "id", "held", "text")
    dealt = dealt.repartition(batches, "batch")

    def batch_words(table: pa.Table) -> pa.Table:
        give_memory_back()
        trained = ~np.array(table.column("held").to_numpy())
        hashes, counts = [np.array([END_WORD])], [np.array([trained.sum()], np.int64)]
        for lo, hi, data, offsets in text_slices(table.column("text")):
            found, n = word_hashes(data, offsets)
            distinct, place = _distinct(found)
            hashes.append(distinct)
            counts.append(np.bincount(place, np.repeat(trained[lo:hi], n), len(distinct)).astype(np.int64))
        distinct, n, _ = _merged(hashes, counts)
        batch = pa.array(np.full(len(distinct), table.column("batch")[0].as_py(), np.int64))
        return pa.table({"batch": batch, "word": distinct.view(np.int64), "n": n})

    words = dealt.groupBy("batch").applyInArrow(batch_words, "batch bigint, word bigint, n bigint").repartition(batches, "word")
    # all three uses of the words read the same columns, so that they are dealt only once
    counts = words.groupBy("word").agg(F.sum("n").alias("c"), F.max("batch").alias("last"))
    totals = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("train_tokens"),
        F.count_if(F.col("c") > 0).alias("distinct_tokens"),
        F.max("last").alias("last"),
    )
    known = words.join(counts, "word").select("batch", "word", "c", "n", "last")

    def batch_grams(table: pa.Table) -> pa.Table:
        give_memory_back()
        trained = ~np.array(table.column("held").to_numpy())
        slices_of, counts = [], []
        for lo, hi, data, offsets in text_slices(table.column("text")):
            code, n = byte_grams(data, offsets, depth)
            distinct, seen = _counted(code, np.repeat(trained[lo:hi], n))
            slices_of.append(distinct)
            counts.append(seen)
        part, packed, n = _part_rows(*_merged(slices_of, counts)[:2], depth, least, parts)
        batch = np.full(len(part), table.column("batch")[0].as_py(), np.int64)
        return pa.table({"batch": batch, "part": pa.array(part, pa.int64()), "grams": pa.array(packed, pa.binary()), "counts": pa.array(n, pa.binary())})

    def part_scores(table: pa.Table) -> pa.Table:
        give_memory_back()
        tree, distinct, place, sizes = _part_tree(table, depth, least)
        values = tree.log10(distinct, top.value).astype(np.float32)[place]
        ends = np.cumsum(sizes)
        logs = [values[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        return pa.table({"batch": table.column("batch"), "part": table.column("part"), "logs": pa.array(logs, pa.binary())})

    grams = dealt.groupBy("batch").applyInArrow(batch_grams, "batch bigint, part bigint, grams binary, counts binary")
    logs = grams.groupBy("part").applyInArrow(part_scores, "batch bigint, part bigint, logs binary")
    known = known.unionByName(logs, allowMissingColumns=True)

    def batch_scores(left: pa.Table, right: pa.Table) -> pa.Table:
        give_memory_back()
        sent = right.filter(pc.is_valid(right.column("part"))).sort_by("part")
        right = right.filter(pc.is_null(right.column("part")))
        log_of = np.frombuffer(b"".join(sent.column("logs").to_pylist()), np.float32)
        # a string and its document's number in the slice are one plain number, so one sort gathers equal strings
        bits = np.uint64(64 - 8 * (depth + 1))
        slices_of, uses = [], []
        for _, _, data, offsets in text_slices(left.column("text")):
            for lo in range(0, len(offsets) - 1, 1 << int(bits)):
                some = offsets[lo : lo + (1 << int(bits)) + 1]
                code, own = byte_grams(data[some[0] : some[-1]], some - some[0], depth)
                code <<= bits
                code |= np.repeat(np.arange(len(own), dtype=np.uint64), own)
                code.sort()
                at = _runs(code >> bits)
                slices_of.append(code[at] >> bits)
                doc = (code & np.uint64((1 << int(bits)) - 1)).astype(np.uint32)
                uses.append((doc, np.diff(np.append(at, len(code))).astype(np.int32), len(own)))
        grams, place = _distinct(np.concatenate([np.zeros(0, np.uint64), *slices_of]))
        values = np.empty(len(grams))
        values[_dealt(grams, least, parts)[0]] = log_of
        scores, before = [], 0
        for found, (doc, times, n) in zip(slices_of, uses, strict=True):
            of = values[place[before : before + len(found)]]
            scores.append(np.bincount(doc, np.repeat(of, times), n))
            before += len(found)
        del uses, slices_of
        order = np.argsort(right.column("word").to_numpy().view(np.uint64))
        word = right.column("word").to_numpy().view(np.uint64)[order]
        c = right.column("c").to_numpy()[order]
        logs, seen = np.log10(c + 1.0), (c > 0).astype(np.float64)
        end = int(np.searchsorted(word, END_WORD))
        tokens, known_n, log_sum, sizes = ([] for _ in range(4))
        for _, _, data, offsets in text_slices(left.column("text")):
            found, n = word_hashes(data, offsets)
            distinct, place = _distinct(found)
            at = np.searchsorted(word, distinct)[place]
            tokens.append(n + 1)
            known_n.append(segment_sums(seen[at], n) + seen[end])
            log_sum.append(segment_sums(logs[at], n) + logs[end])
            sizes.append(np.diff(offsets))
        return pa.table(
            {
                "id": left.column("id"),
                "held_out": left.column("held"),
                "n_tokens": np.concatenate(tokens).astype(np.int64),
                "n_known": np.round(np.concatenate(known_n)).astype(np.int64),
                "log_sum": np.concatenate(log_sum),
                "score": np.concatenate(scores),
                "n_bytes": np.concatenate(sizes).astype(np.int64),
            }
        )

    kind = dealt.schema["id"].dataType.simpleString()
    shape = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, log_sum double, score double, n_bytes bigint"
    scored = dealt.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(batch_scores, shape)
    both = totals.select(F.struct("train_tokens", "distinct_tokens", "last")).scalar()
    scored = scored.withColumn("both", both).select("*", "both.train_tokens", "both.distinct_tokens")
    size = F.col("train_tokens") + F.col("distinct_tokens") + 1
    return scored.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        "train_tokens",
        (F.col("log_sum") - F.col("n_tokens") * F.log10(size)).alias("base_score"),
        "score",
        "n_bytes",
    )
