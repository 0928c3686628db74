"""MinHash near-dedup with DartMinHash signatures.

A document is the weighted set of its shingles of five words (white-space separated, A-Z as a-z),
each weighing as often as it occurs; a text of fewer words is one shingle, a text without words
has none. Two documents are linked when their weighted Jaccard similarity (sum of the smaller
weights over sum of the larger) is 0.8 or more; a class is what links connect. Equal texts are
always of one class, whatever their words.

Signatures. Every unit of weight of every shingle is a region in which hashed darts land: a
Poisson number of them (mean 1) for each unit interval of the dart's rank. A dart has a rank and
a coordinate, both from the hash of its region, and a coordinate keeps the dart of the lowest
rank. A document whose darts leave a coordinate empty goes on to the next intervals of ranks, so
the work follows the larger of its weight and k ln k. The chance that two documents keep the same
dart is their weighted similarity.

Joining. Each band of coordinates is hashed; documents that share a band are candidates. Within a
band's group each member is compared with the group's pivot (with others in further rounds, if
asked for); the links are merged into classes, and only groups that still hold several classes go
on. What is left is compared exactly: every member outside
the group's largest class with every member of another class, in pairs that were not compared
before and that exact bounds do not rule out (see :func:`remaining_pairs`). Each comparison counts the shingles (32 bits of their hashes) of both whole texts. So within the groups no link is
lost; a pair of similarity 0.8 shares no group with probability (1 - 0.8^rows)^bands, 7 in 10,000
with the defaults.

Nulls, ties and repeats: a null text counts as empty; a null doc_id is an id. Rows of equal texts
are one node; the class id is the smallest doc_id of the class (nulls last), and that row stays.
Rows that repeat that doc_id in the class all have kept true. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty, unused
from .textbytes import mix64, prefix_hash, span_hash, text_slices, words

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
LACK_BITS = 256


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each document's shingles, in order, and their numbers."""
    starts, ends, counts = words(data, offsets)
    word = span_hash(prefix_hash(data, lower=True), starts, ends)
    first = np.cumsum(counts) - counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
    length = np.repeat(np.minimum(counts, size), n)
    out = length.astype(np.uint64)
    for k in range(size):
        have = length > k
        value = np.zeros(len(at), np.uint64)
        value[have] = word[at[have] + k]
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + value)
    return out, n


def weights(shingle: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document (sorted), their weights, and their numbers."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((shingle, doc))
    shingle, doc = shingle[order], doc[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(shingle)))
    return shingle[first], weight, np.bincount(doc[first], minlength=len(counts))


def _poisson_cuts() -> np.ndarray:
    """Upper limits of the hash for 0, 1, 2, ... darts of mean 1."""
    terms = np.cumprod(np.concatenate([[np.exp(-1.0)], 1 / np.arange(1.0, 16.0)]))
    return np.minimum(np.cumsum(terms) * 2.0**64, 2.0**64 - 2049).astype(np.uint64)


_CUTS = _poisson_cuts()
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_AT_ONCE = 1 << 20  # regions times intervals that are worked on at once


def dart_signatures(shingle: np.ndarray, weight: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """documents x k: the earliest dart of each coordinate (all ones for a document without shingles)."""
    out = np.full((len(counts), k), _NONE)
    doc = np.repeat(np.arange(len(counts)), counts)
    # the unit regions of every shingle: its weight's first unit, second unit, ...
    of = np.repeat(np.arange(len(shingle)), weight)
    unit = np.arange(len(of)) - np.repeat(np.cumsum(weight) - weight, weight)
    region = mix64(shingle[of] + mix64(unit.astype(np.uint64) + np.uint64(1)))
    owner = doc[of]
    first, intervals = 0, 1  # ranks [0, 1), then [1, 2), [2, 4), [4, 8), ...
    while len(region):
        some = max(1, _AT_ONCE // intervals)
        for at in range(0, len(region), some):
            _throw(region[at : at + some], owner[at : at + some], first, intervals, out)
        going = (out == _NONE).any(1)[owner]  # documents of little weight go on until all are filled
        region, owner = region[going], owner[going]
        first, intervals = first + intervals, first + intervals
    return out


def _throw(region: np.ndarray, owner: np.ndarray, first: int, intervals: int, out: np.ndarray) -> None:
    """Throw the darts of ``intervals`` unit intervals of rank at unit regions; keep the earliest in ``out``."""
    k = out.shape[1]
    rank = np.tile(np.arange(first, first + intervals, dtype=np.uint64), len(region))
    base = mix64(np.repeat(region, intervals) ^ mix64(rank + np.uint64(0x51)))
    thrower = np.repeat(owner, intervals)
    darts = np.searchsorted(_CUTS, base, side="right")
    for d in range(int(darts.max())):
        some = np.flatnonzero(darts > d)
        thrown = mix64(base[some] + np.uint64((d + 1) * 0xA24BAED5))
        place = thrower[some] * k + (mix64(thrown) % np.uint64(k)).astype(np.int64)
        np.minimum.at(out.reshape(-1), place, (rank[some] << np.uint64(48)) | (thrown >> np.uint64(16)))


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """documents x bands: a hash of each band's coordinates and of the band."""
    parts = signatures.reshape(len(signatures), bands, rows)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), 1))
    for r in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out


def common_weight(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, bytes, bytes]:
    """The weight that two sets (sorted shingles, weights) share, and which shingles of either the
    other lacks in part or whole, as bits by the shingles' last ``LACK_BITS`` values."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j])
    lacks = []
    for (shingle, weight), at in ((a, i), (b, j)):
        lacking = np.ones(len(shingle), bool)
        lacking[at[least >= weight[at]]] = False
        bits = np.zeros(LACK_BITS, bool)
        bits[shingle[lacking] % LACK_BITS] = True
        lacks.append(np.packbits(bits).tobytes())
    return int(least.sum()), *lacks


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column(1)):
            shingle, weight, counts = weights(*shingles(data, offsets))
            total = np.bincount(np.repeat(np.arange(hi - lo), counts), weight, hi - lo).astype(np.int64)
            some = np.flatnonzero(counts)
            band = band_hashes(dart_signatures(shingle, weight, counts, BANDS * ROWS)[some], BANDS, ROWS)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(band.reshape(-1).view(np.int64))
            )
            nodes = batch.column(0).slice(lo, hi - lo).take(pa.array(some))
            yield pa.RecordBatch.from_arrays([nodes, pa.array(total[some]), lists], names=["node", "total", "bands"])


def _as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's shingles, cut to 32 bits, and their weights, as two byte strings."""
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column(1)):
            found, n = shingles(data, offsets)
            shingle, weight, counts = weights(found >> np.uint64(32), n)
            ends = np.cumsum(counts)
            raw, heavy = shingle.astype("<u4"), weight.astype("<u4")
            spans = list(zip((ends - counts).tolist(), ends.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array([raw[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([heavy[a:b].tobytes() for a, b in spans], pa.binary()),
                ],
                names=["node", "shingles", "weights"],
            )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [[np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(c)] for c in range(2, 6)]
        found = [common_weight((a, v), (b, w)) for a, v, b, w in zip(*sets, strict=True)]
        totals = [np.array([x.sum() for x in sets[c]], np.int64) for c in (1, 3)]
        common = np.array([f[0] for f in found], np.int64)
        lacks = [np.frombuffer(b"".join(f[k] for f in found), np.int64) for k in (1, 2)]
        ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (LACK_BITS // 64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(common),
                pa.array(common / np.maximum(1, totals[0] + totals[1] - common)),
                *[pa.ListArray.from_arrays(ends, pa.array(x)) for x in lacks],
            ],
            names=["a", "b", "common", "similarity", "of_a", "of_b"],
        )


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shingle, weight = ([np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(c)] for c in (1, 2))
        node = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in shingle]))
        values = [pa.array(np.concatenate([*x, np.zeros(0, "<u4")]).astype(np.int64)) for x in (shingle, weight)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(node), *values], names=["node", "shingle", "weight"])


def own_weights(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node, own: the weight of the shingles that no other of ``nodes`` has."""
    some = sets.join(nodes, "node", "left_semi").select("node", "shingles", "weights")
    rows = some.mapInArrow(_shingle_rows, "node binary, shingle bigint, weight bigint")
    found = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "weight")).alias("one"))
    return found.where("n = 1").groupBy("one.node").agg(F.sum("one.weight").alias("own"))


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with their common weight, similarity, and what of either the other lacks."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"), F.col("weights").alias(f"w{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "wa", "sb", "wb")
    return both.mapInArrow(_compared, "a binary, b binary, common bigint, similarity double, of_a array<bigint>, of_b array<bigint>")


def components(links: DataFrame) -> DataFrame:
    """node, comp: for each node of ``links`` (a, b) the smallest node that links connect it with.

    Classes hook onto the smallest class that they are linked with and follow those hooks to their
    end; what still links two classes goes round again. The hooks go from larger to smaller, so
    they have no circle, and each round at least halves the classes that are linked."""
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = staged(nodes.withColumn("comp", F.col("node")), "labels")
    edges = staged(links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "edges")
    while not edges.isEmpty():
        hooks = edges.groupBy("high").agg(F.min("low").alias("low"))
        while True:
            hooks = staged(hooks, "hooks")
            ahead = hooks.select(F.col("high").alias("low"), F.col("low").alias("next"))
            if hooks.join(ahead, "low", "left_semi").isEmpty():
                break
            hooks = hooks.join(ahead, "low", "left").select("high", F.coalesce("next", "low").alias("low"))
        to = lambda column: hooks.select(F.col("high").alias(column), F.col("low").alias(f"{column}_to"))
        labels = labels.join(to("comp"), "comp", "left").select("node", F.coalesce("comp_to", "comp").alias("comp"))
        labels = staged(labels, "labels")
        moved = edges.join(to("high"), "high", "left").join(to("low"), "low", "left")
        moved = moved.select(F.coalesce("high_to", "high").alias("a"), F.coalesce("low_to", "low").alias("b")).where("a <> b")
        edges = staged(moved.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "edges")
    return labels


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("comp", F.col("node"))
    return members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _as_pairs(pairs: DataFrame, tested: DataFrame | None, by_weight: bool = True) -> DataFrame:
    """Distinct unordered pairs that were not compared before, and whose weights allow the similarity."""
    if by_weight:
        pairs = pairs.where(F.least("ta", "tb") >= F.greatest("ta", "tb") * SIMILARITY)
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")


def pivots_of(members: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """band, y, tb, cy: the pivot of each group that holds several classes.

    First the member that shares its groups with most others, which lies in the middle of a cluster;
    later any one."""
    now = _labelled(members, labels)
    order = F.struct(-F.col("shared"), "node") if turn == 0 else F.xxhash64("node", "band", F.lit(turn))
    groups = now.groupBy("band").agg(
        F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min(F.struct(order.alias("order"), "node", "total", "comp")).alias("pivot")
    )
    pivot = [F.col(f"pivot.{name}").alias(alias) for name, alias in (("node", "y"), ("total", "tb"), ("comp", "cy"))]
    return groups.where("c1 <> c2").select("band", *pivot)


def pivot_pairs(members: DataFrame, labels: DataFrame | None, pivots: DataFrame, tested: DataFrame | None) -> DataFrame:
    """Each member with its group's pivot, if they are of different classes. At first all are compared,
    whatever their weights: ``remaining_pairs`` uses their distance from that pivot."""
    now = _labelled(members, labels).withColumnsRenamed({"node": "x", "total": "ta"})
    return _as_pairs(now.join(pivots, "band").where("comp <> cy"), tested, by_weight=tested is not None)


def remaining_pairs(
    members: DataFrame,
    labels: DataFrame | None,
    pivots: DataFrame | None,
    compared: DataFrame | None,
    tested: DataFrame | None,
    sets: DataFrame,
) -> DataFrame:
    """In groups that hold several classes: all members outside the largest with those of other classes
    that may be similar enough, each pair in the first group that both share.

    Ruled out is only what cannot be a link. 1 - similarity is a metric, so the distances from the
    group's first pivot p differ by no more than a link allows; they are cut into steps of that
    size, and members meet those of the same and the next steps. What x and y have in common is
    bounded twice: by what either shares with any other member at all; and by p's weight less the
    shingles of p that x or y lacks (at least as many as bits are set for them), plus what either has
    beyond p and not alone."""
    now = _labelled(members, labels)
    sizes = now.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    groups = sizes.groupBy("band").agg(F.max(F.struct("n", "comp"))["comp"].alias("largest"), F.count(F.lit(1)).alias("classes"))
    groups = staged(groups.where("classes > 1").select("band", "largest"), "open-groups")
    opened = now.join(groups, "band")
    width = 1 - SIMILARITY + 1e-9  # for rounding
    none = F.array(*[F.lit(0).cast("bigint")] * (LACK_BITS // 64))
    if compared is not None:
        first = pivots.select("band", F.col("y").alias("p"), F.col("tb").alias("tp"))
        opened = opened.join(first, "band").withColumns({"a": F.least("node", "p"), "b": F.greatest("node", "p")})
        opened = opened.join(compared, ["a", "b"], "left")
        itself = F.col("node") == F.col("p")
        opened = opened.withColumns(
            {
                "distance": F.when(itself, 0.0).otherwise(1 - F.col("similarity")),
                "with_p": F.when(itself, F.col("total")).otherwise(F.col("common")),
                "lacks": F.when(itself, none).when(F.col("a") == F.col("p"), F.col("of_a")).otherwise(F.col("of_b")),
            }
        )
    else:
        opened = opened.select("*", F.lit(0.0).alias("distance"), F.col("total").alias("tp"), F.lit(0).alias("with_p"), none.alias("lacks"))
    opened = staged(opened.select("band", "node", "total", "comp", "largest", "tp", "distance", "with_p", "lacks"), "open-members")
    own = own_weights(opened.select("node").distinct(), sets)
    shared = opened.groupBy("node").agg(F.collect_set("band").alias("bands"))  # BANDS of them at most
    opened = opened.join(own, "node", "left").join(shared, "node").withColumns(
        {
            "step": F.floor(F.col("distance") / width).cast("int"),
            "shares": F.col("total") - F.coalesce("own", F.lit(0)),
            "beyond": F.greatest(F.lit(0), F.col("total") - F.coalesce("own", F.lit(0)) - F.col("with_p")),
        }
    )
    opened = staged(opened, "open-members-weighed")
    renamed = lambda side, df: df.select("band", "step", "tp", *[F.col(c).alias(f"{side}_{c}") for c in sides])
    sides = ("node", "total", "comp", "distance", "lacks", "bands", "shares", "beyond")
    near = F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step")
    x = renamed("x", opened.where("comp <> largest").select(*[c for c in opened.columns if c != "step"], near)).drop("tp")
    y = renamed("y", opened)
    lacking = reduce(add, [F.bit_count(F.col("x_lacks")[k].bitwiseOR(F.col("y_lacks")[k])) for k in range(LACK_BITS // 64)])
    most = F.least("x_shares", "y_shares", F.col("tp") - lacking + F.least("x_beyond", "y_beyond"))
    may = (F.col("x_comp") != F.col("y_comp")) & (F.abs(F.col("x_distance") - F.col("y_distance")) < width)
    may &= most >= SIMILARITY * (F.col("x_total") + F.col("y_total") - most) - 1e-9
    may &= F.array_min(F.array_intersect("x_bands", "y_bands")) == F.col("band")
    pairs = x.join(y, ["band", "step"]).where(may)
    return _as_pairs(
        pairs.select(F.col("x_node").alias("x"), F.col("y_node").alias("y"), F.col("x_total").alias("ta"), F.col("y_total").alias("tb")),
        tested,
    )


def node_of(text: Column) -> Column:
    """What tells texts apart: 16 bytes of their digest."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", rounds: int = 1) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, class_id, kept, node (the text's digest)."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty().alias("text"))
    rows = rows.withColumn("node", node_of(F.col("text")))
    signed = rows.select("node", "text").mapInArrow(_signed, "node binary, total bigint, bands array<bigint>")
    signed = staged(signed.dropDuplicates(["node"]), "signatures")
    members = signed.select("node", "total", F.explode("bands").alias("band"))
    groups = staged(members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    members = staged(members.join(groups, "band"), "members")
    shared = members.groupBy("node").agg(F.sum("n").alias("shared"))
    members = staged(members.drop("n").join(shared, "node"), "members")
    wanted = members.select("node").distinct()
    texts = rows.select("node", "text").join(wanted, "node", "left_semi").groupBy("node").agg(F.max("text").alias("text"))
    sets = staged(texts.mapInArrow(_as_sets, "node binary, shingles binary, weights binary"), "sets")

    links = tested = labels = compared = pivots = None
    for turn in range(rounds + 1):
        if turn == rounds:
            pairs = remaining_pairs(members, labels, pivots, compared, tested, sets)
        else:
            chosen = staged(pivots_of(members, labels, turn), "pivots")
            pivots = chosen if pivots is None else pivots
            pairs = pivot_pairs(members, labels, chosen, tested)
        pairs = staged(pairs, "pairs")
        if pairs.isEmpty():
            continue
        found = staged(compare(pairs, sets), "compared")
        compared = found if compared is None else compared
        close = found.where(F.col("similarity") >= SIMILARITY).select("a", "b")
        links = close if links is None else links.union(close)
        tested = pairs if tested is None else tested.union(pairs)
        labels = components(links)

    texts_first = rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first"))
    classes = staged(_labelled(texts_first, labels), "classes")
    heads = classes.groupBy("comp").agg(F.min("first").alias("head"))
    heads = staged(classes.select("node", "comp").join(heads, "comp").select("node", "head"), "heads")
    return rows.select("id", "node").join(heads, "node").select(
        F.col("id").alias(id_col),
        F.col("head.id").alias("class_id"),
        (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("node") == F.col("head.node"))).alias("kept"),
        "node",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with all its columns, one row of each class: the one of the smallest doc_id."""
    own, of_id, node = unused(docs.columns, "text_node", "kept_id", "kept_node")
    found = near_duplicates(docs, id_col).where("kept").select(F.col(id_col).alias(of_id), F.col("node").alias(node))
    named = docs.withColumn(own, node_of(text_or_empty()))
    # rows that repeat id and text lie in one partition after the join
    same = (F.col(own) == F.col(node)) & F.col(id_col).eqNullSafe(F.col(of_id))
    kept = named.join(found.distinct(), same, "left_semi")
    return kept.dropDuplicates([own, id_col]).drop(own)
