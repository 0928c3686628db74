"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded, cut into overlapping chunks of ``2 * STEP`` bytes every ``STEP`` bytes
from the first to past the last byte, and each chunk is seen by every learned filter. The largest
answer of each filter over the whole document, rectified, goes into one logistic unit, whose
probability is the score: the higher, the likelier label 1.

The network is fitted by stochastic gradients on a sample of labelled rows: ``rows_per_label`` for
each label, by the order of a hash, of texts of ``fit_bytes`` at most. Rows whose
crc32(doc_id as text) mod 4 is 2 are held out. Scoring reads every whole text.

Nulls, empty and repeated rows: a null text is scored like the empty one (a single chunk of
padding); a null label is no label; a doc_id with several labels counts by its largest; each row
gets a row. Without labelled rows of both kinds every score is the share of label 1 (0.5 if there
are none). Only doc_id and the text are read from the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused
from .textbytes import give_memory_back, text_slices

STEP = 16
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7


def held_out(id_col: str = "doc_id", folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold


@dataclass
class ByteNet:
    embedding: np.ndarray  # 256 x d
    filters: np.ndarray  # (2 * STEP * d) x filters: the first half for a chunk's first STEP bytes
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    @classmethod
    def fresh(cls, width: int, filters: int, share: float, seed: int) -> ByteNet:
        rng = np.random.default_rng(seed)
        f32 = lambda x: x.astype(np.float32)
        return cls(
            f32(rng.normal(0, 0.5, (256, width))),
            f32(rng.normal(0, (2 * STEP * width) ** -0.5, (2 * STEP * width, filters))),
            np.zeros(filters, np.float32),
            f32(rng.normal(0, 0.3, filters)),
            float(np.log(share / (1 - share))),
        )

    def blocks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes in rows of STEP, each document padded and followed by a row of zeros; first rows."""
        sizes = np.diff(offsets)
        rows = np.maximum(1, -(-sizes // STEP)) + 1
        first = np.concatenate([[0], np.cumsum(rows)])
        padded = np.zeros(int(first[-1]) * STEP, np.uint8)
        padded[np.arange(len(data)) + np.repeat(first[:-1] * STEP - offsets[:-1], sizes)] = data
        return padded.reshape(-1, STEP), first

    def answers(self, block: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each chunk's answers; the rows of zeros after each document begin no chunk."""
        half = self.filters.shape[0] // 2
        rows = self.embedding[block].reshape(len(block), half)
        out = rows @ self.filters[:half]
        out[:-1] += (rows @ self.filters[half:])[1:]
        out[first[1:] - 1] = -np.inf
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        block, first = self.blocks(data, offsets)
        most = np.maximum.reduceat(self.answers(block, first), first[:-1], axis=0)
        z = np.maximum(most + self.bias, 0) @ self.weights + self.offset
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def fit(texts: list[bytes], labels: np.ndarray, width: int = 4, filters: int = 32, epochs: int = 12, rate: float = 3e-3, batch: int = 64, seed: int = 5) -> ByteNet:
    """Fit by Adam on the log loss; the gradient of a maximum goes to the chunk that has it."""
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    net = ByteNet.fresh(width, filters, share, seed)
    if len(set(labels.tolist())) < 2:
        net.weights[:] = 0
        return net
    rng = np.random.default_rng(seed)
    moments: dict[str, list[np.ndarray]] = {}
    step = 0

    def update(name: str, grad: np.ndarray) -> None:
        m = moments.setdefault(name, [np.zeros_like(grad), np.zeros_like(grad)])
        m[0] += 0.1 * (grad - m[0])
        m[1] += 0.01 * (grad * grad - m[1])
        change = rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        value = getattr(net, name)
        setattr(net, name, (value - change).astype(np.float32) if isinstance(value, np.ndarray) else float(value - change))

    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            step += 1
            rows = order[at : at + batch]
            part = [texts[i] for i in rows]
            data = np.frombuffer(b"".join(part), np.uint8)
            block, first = net.blocks(data, np.concatenate([[0], np.cumsum([len(x) for x in part])]))
            out = net.answers(block, first)
            best = np.stack([lo + out[lo:hi].argmax(0) for lo, hi in zip(first[:-1], first[1:], strict=True)])
            most = np.take_along_axis(out, best, 0) + net.bias
            hidden = np.maximum(most, 0)
            p = 1 / (1 + np.exp(-(hidden @ net.weights + net.offset)))
            dz = (p - labels[rows]) / len(rows)
            dh = dz[:, None] * net.weights * (most > 0)
            chunk = np.concatenate([block[best], block[best + 1]], axis=2)  # documents x filters x bytes
            seen = net.embedding[chunk].reshape(*best.shape, -1)
            by_byte = dh[..., None, None] * net.filters.T.reshape(1, filters, 2 * STEP, width)
            to_bytes = np.stack([np.bincount(chunk.ravel(), by_byte[..., k].ravel(), 256) for k in range(width)], 1)
            update("filters", np.einsum("df,dfx->xf", dh, seen).astype(np.float32))
            update("bias", dh.sum(0))
            update("weights", (hidden * dz[:, None]).sum(0) + 1e-4 * net.weights)
            update("embedding", to_bytes.astype(np.float32))
            update("offset", np.float32(dz.sum()))
    return net


def fit_sample(docs: DataFrame, labels: DataFrame, id_col: str, label: str, rows_per_label: int, fit_bytes: int) -> ByteNet:
    """Fit on a bounded sample of labelled rows outside the held-out fold."""
    labelled = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & ~held_out("id"))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text")).where(
        F.octet_length("text") <= fit_bytes
    )
    chosen: list = []
    for value in (0, 1):
        few = labelled.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(rows_per_label)
        found = texts.join(F.broadcast(few), "id").select("text", "label")
        chosen += found.orderBy(F.xxhash64("text"), "text").limit(rows_per_label).collect()
    return fit([x.text.encode() for x in chosen], np.array([x.label for x in chosen], np.float32))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label: str = "quality",
    rows_per_label: int = 2000,
    fit_bytes: int = 1 << 16,
    out: str = "score",
) -> DataFrame:
    """``docs`` with all its columns (``out`` replaced) and the score of each row's whole text in ``out``."""
    net = fit_sample(docs, labels, id_col, label, rows_per_label, fit_bytes)
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    # the text is sent once: as one of the columns, if it is one
    plain = [i for i, c in enumerate(kept) if c.lower() == "text" and docs.schema[c].dataType.simpleString() == "string"]
    at = plain[0] if plain else len(kept)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_memory_back()
        for batch in batches:
            scores = [net.score(data, offsets) for _, _, data, offsets in text_slices(batch.column(at))]
            values = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], values], names=[*kept, out])

    schema = docs.select(kept).withColumn(out, F.lit(0.0)).schema
    (text,) = unused(kept, "text")
    whole = docs.select(*kept, *([] if plain else [F.col("text").cast("string").alias(text)]))
    return whole.mapInArrow(scored, schema)
