"""Quality score by nearest-neighbour voting in a latent-semantic space.

A text's terms are its hashed byte n-grams, weighted by inverse document frequency, and
two terms for its shape: the shares of words that do and don't repeat the word before.
A truncated SVD of the labelled sample's term matrix gives the latent space. The labelled
vectors (``TRAIN_DOCS`` x ``DIMENSIONS`` numbers at most) are broadcast; every document's
cosine with all of them is computed exactly in blocks, and the labels of the ``NEIGHBOURS``
nearest vote with the ``POWER``-th power of their cosine as weight.

The sample is bounded: the labelled rows of the ``TRAIN_DOCS`` smallest id hashes, whole texts.

Defined results: a null or empty text has no direction and gets the sample's share of
label 1, as does every text without a labelled sample's help (0.5 when there is none);
rows with a null label or id aren't learned from; of repeated labels the largest counts;
repeated rows give repeated rows; an empty table gives an empty result; extra columns are
ignored. Equal cosines: the sample's order (id hash, then text) decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .ngrams import count_blocks, normal_rows

TRAIN_DOCS, DIMENSIONS, NEIGHBOURS, POWER = 4096, 64, 15, 8
BUCKETS = 2048


def shape(text: str) -> tuple[float, float]:
    words = text.split()
    same = sum(map(eq, words, words[1:])) / (len(words) - 1) if len(words) > 1 else 0.0
    return same ** 0.5, (1 - same) ** 0.5


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def terms(texts: list[str], idf: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """Term rows of ranges of texts."""
    for lo, hi, counts in count_blocks([t.encode("utf-8", "replace") for t in texts], BUCKETS):
        x = normal_rows(counts)
        if idf is not None:
            x = _unit(x * idf)
        form = np.array([shape(t) if t else (0.0, 0.0) for t in texts[lo:hi]], np.float32).reshape(-1, 2)
        yield lo, hi, np.hstack([x, form])


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled documents x dimensions, unit rows
    labels: np.ndarray
    share: float

    def score(self, texts: list[str]) -> list[float]:
        out: list[float] = []
        for _, _, x in terms(texts, self.idf):
            q = _unit(x @ self.axes)
            cosine = q @ self.vectors.T
            k = min(NEIGHBOURS, cosine.shape[1])
            near = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** POWER
            total = weight.sum(1)
            vote = (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-30)
            out += np.clip(np.where(total > 1e-30, vote, self.share), 0, 1).tolist()
        return out


def fit(docs: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality") -> Model | None:
    """Train on a bounded sample of the labelled rows for which ``usable`` (over doc_id) holds."""
    known = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("_y")).filter(usable & F.col("_y").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("_y").alias("_y")).withColumn("_h", F.xxhash64("doc_id")).orderBy("_h").limit(TRAIN_DOCS))
    rows = (docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
            .join(F.broadcast(known), "doc_id"))  # TRAIN_DOCS rows of three numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, x in terms(b.column(2).to_pylist()):
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())],
                                                 names=["h", "y", "x"])

    sample = map_batches(rows.select(F.col("_h").alias("h"), F.col("_y").cast("int").alias("y"), "_t"), run, "h long, y int, x binary").limit(2 * TRAIN_DOCS).collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r.h, bytes(r.x)))
    x = np.vstack([np.frombuffer(r.x, np.float16) for r in sample]).astype(np.float32)
    y = np.array([float(r.y > 0) for r in sample])
    n = len(x)
    idf = (np.log((1 + n) / (1 + (x[:, :BUCKETS] > 0).sum(0))) + 0.1).astype(np.float32)
    x[:, :BUCKETS] = _unit(x[:, :BUCKETS] * idf)
    _, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = axes[:, -DIMENSIONS:].astype(np.float32)
    return Model(idf, axes, _unit(x @ axes), y, float(y.mean()))


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every document."""
    bc = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the constants above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bc.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            s = m.score(texts) if m else [0.5] * len(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, score double")
