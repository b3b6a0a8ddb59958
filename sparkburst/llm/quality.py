"""Hashed word n-gram logistic regression, trained by follow-the-regularised-leader, for text quality."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkburst.llm import wordhash as H
from sparkburst.llm.common import texts_of, trimmed, without

BITS = 20
#: Labelled rows that training reads at most: those with the smallest hash of their id.
FIT_ROWS = 6000
EPOCHS = 4
#: Texts that are taken out of a batch at once.
_ROWS = 512
#: Features are shares of a text's n-grams, times this.
GAIN = 12.0
THRESHOLD = 0.7
_REPEAT = np.uint64(0x5851F42D4C957F2D)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def _features(texts: list[bytes], classes: np.ndarray = H.byte_classes()) -> tuple[np.ndarray, np.ndarray]:
    """Feature number and text number of every n-gram (words, runs of marks, and pairs of neighbours), text by text.

    A word that equals the one before it is read as one fixed repeat token, so that repetition is learnt in general.
    """
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    starts, ends = H.spans(classes[data])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    token = H.hash_spans(data, starts, ends)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    same = doc[1:] == doc[:-1]
    token[1:][same & (token[1:] == token[:-1])] = _REPEAT
    pair = H.mix(token[:-1] * _PAIR + token[1:])[same]
    shift = np.uint64(64 - BITS)
    return np.concatenate((token >> shift, pair >> shift)).astype(np.int64), np.concatenate((doc, doc[:-1][same]))


def _as_bytes(texts: Iterable[str | None]) -> Iterator[bytes]:
    return ((t or "").lower().encode() for t in texts)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        index, value = [], []
        for text in _as_bytes(texts_of(batch)):
            found, counts = np.unique(_features([text])[0], return_counts=True)
            index.append(found.astype("<i4").tobytes())
            value.append((GAIN * counts / max(1, counts.sum())).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch["order"], batch["label"], batch["text_hash"], pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["order", "label", "text_hash", "index", "value"])


def ftrl(examples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> np.ndarray:
    """Weights (the last is the bias, not regularised) by FTRL-proximal updates, one example at a time."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    for epoch in range(epochs):
        for k in np.random.Generator(np.random.PCG64(epoch)).permutation(len(examples)):
            label, index, value = examples[k]
            index, value = np.append(index, size - 1), np.append(value, 1.0)
            w = _weights(z[index], n[index], alpha, beta, l1, l2)
            w[-1] = -z[-1] * alpha / (beta + np.sqrt(n[-1]))
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha
            z[index] += g - sigma * w
            n[index] += g * g
    w = _weights(z, n, alpha, beta, l1, l2)
    w[-1] = -z[-1] * alpha / (beta + np.sqrt(n[-1]))
    return w.astype(np.float32)


def _weights(z, n, alpha, beta, l1, l2):
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in b.to_pylist()]
    rows.sort(key=lambda r: (r["order"], r["index"], r["label"]))
    weights = ftrl([(r["label"], np.frombuffer(r["index"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float)) for r in rows]) if rows else np.zeros((1 << BITS) + 1, np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Weights learnt from at most fit_rows labelled documents (the smallest hashes of their ids, a bounded sample).

    Rows whose id hashes to the held-out quarter, null ids, null labels and labels other than 0 and 1 are left out; of
    several labels of one id the mean decides, of several documents of one id the text with the smallest hash. One task
    trains on the sample's sparse vectors: at most fit_rows of at most 2^20 features, however the tables repeat ids. Null
    and empty texts have no features and teach the bias. Without labelled rows, or without documents, every score is 1/2.
    """
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .withColumn("order", F.xxhash64(F.lit(11), "doc_id")).orderBy("order", "doc_id").limit(fit_rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("order", "label", F.xxhash64("text").alias("text_hash"), "text")
    vectors = sample.mapInArrow(trimmed(_vectors), "order long, label int, text_hash long, index binary, value binary")
    vectors = vectors.groupBy("order", "label").agg(F.min(F.struct("text_hash", "index", "value")).alias("v")).select("order", "label", "v.index", "v.value")
    return np.frombuffer(vectors.repartition(1).mapInArrow(trimmed(_fit), "weights binary").first()[0], np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """docs with score: the logistic of the sparse dot product of whole texts with the weights.

    The weights (4 MB, whatever the corpus) are broadcast; rows are scored where they lie, without a shuffle. Null and
    empty texts have no features and get the bias's score; very long texts are read whole, half a megabyte of text at a time or one
    text if it is longer. Repeated rows are scored alike. An empty table gives no rows. A column of docs named score is
    replaced, all others are kept.
    """
    names = without(docs, "score")
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows, _ROWS):
                texts = list(_as_bytes(batch[text].slice(at, _ROWS).to_pylist()))
                for a, b in H.chunks([len(t) for t in texts]):
                    index, doc = _features(texts[a:b])
                    out[at + a : at + b] = np.bincount(doc, w[index], b - a) / np.maximum(1, np.bincount(doc, minlength=b - a))
            score = 1 / (1 + np.exp(-(GAIN * out + float(w[-1]))))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(score)], [*names, "score"])

    from pyspark.sql import types as T

    return docs.select(names).mapInArrow(trimmed(scored), T.StructType([*docs.select(names).schema.fields, T.StructField("score", T.DoubleType())]))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
