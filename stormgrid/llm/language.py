"""Language ID by error-correcting output codes over byte n-grams.

Each language has a codeword of bits; one binary logistic classifier per bit is trained
on hashed byte n-grams. A text's language is the codeword with the least loss-weighted
distance to the bits' margins. The share of that codeword in the softmax of the negative
losses is the score; a text whose best two codewords are close is flagged ambiguous.

The classifiers are trained on a sample bounded per language: up to ``TRAIN_PER_LANGUAGE``
documents of each labelled language, those of the smallest id hashes, whole texts. The model
grows with the number of languages only. Everything else covers all documents.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and not
ambiguous; with no labelled row at all every text is ``und``; with one language every text
with a letter is that language with score 1; repeated rows give repeated rows; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches
from .ngrams import count_blocks, normal_rows

TRAIN_PER_LANGUAGE = 400
BUCKETS = 4096
#: Difference of the best two codewords' mean losses below which a text is ambiguous.
AMBIGUOUS = 0.05
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of ``n`` classes: every split in two for few classes, else the best of random codes."""
    if n <= 6:
        rows = [[1] * (2 ** (n - 1) - 1)] + [[] for _ in range(n - 1)]
        for bits in itertools.product((-1, 1), repeat=n - 1):
            if any(b < 0 for b in bits):
                for r, b in zip(rows[1:], bits):
                    r.append(b)
        return np.array(rows, np.float32).reshape(n, -1)
    rng = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(n)))
    best, far = None, -1.0
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, width)).astype(np.float32)
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code.shape[1] - code @ code.T) / 2
        nearest = (apart + np.eye(n) * width).min()
        if nearest > far:
            best, far = code, nearest
    return best


def train(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 150, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Fit the bits' classifiers on normalised rows ``x`` with class numbers ``y``."""
    code = codewords(len(languages))
    target = code[y]
    share = np.bincount(y, minlength=len(languages))[y].astype(np.float32)
    row = (1 / share / len(languages))[:, None]  # each language counts alike
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        margin = target * (x @ w + b)
        pull = -target * row / (1 + np.exp(np.minimum(margin, 60)))
        grad = x.T @ pull + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        b -= rate * pull.sum(0)
    right = (target * (x @ w + b) > 0).mean(0)
    trust = np.maximum(right - 0.5, 0.05)
    return Model(languages, code, w, b, (trust / trust.sum()).astype(np.float32))


def losses(model: Model, x: np.ndarray) -> np.ndarray:
    """Loss-weighted distance of each row to each codeword."""
    f = x @ model.weights + model.bias
    toward, away = np.logaddexp(0, -f) * model.trust, np.logaddexp(0, f) * model.trust
    return toward @ (model.code.T > 0).astype(np.float32) + away @ (model.code.T < 0).astype(np.float32)


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    langs, scores, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
    has = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
    if model is None or not has:
        return langs, scores, unsure
    if len(model.languages) == 1:
        for i in has:
            langs[i], scores[i] = model.languages[0], 1.0
        return langs, scores, unsure
    for lo, hi, counts in count_blocks([texts[i].lower().encode("utf-8", "replace") for i in has], BUCKETS):
        loss = losses(model, normal_rows(counts))
        best = loss.argmin(1)
        p = np.exp(-model.code.shape[1] * (loss - loss.min(1, keepdims=True)))
        p = 1 / p.sum(1)
        two = np.partition(loss, 1, axis=1)[:, :2]
        for j, i in enumerate(has[lo:hi]):
            langs[i], scores[i] = model.languages[best[j]], float(p[j])
            unsure[i] = bool(two[j, 1] - two[j, 0] < AMBIGUOUS)
    return langs, scores, unsure


def fit(docs: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Train on a bounded sample of the rows for which ``usable`` holds."""
    rows = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    # ids are chosen without their texts; the window's rank is applied before its shuffle too
    w = Window.partitionBy("_lang").orderBy("_h")
    ids = (rows.select(F.col(lang).alias("_lang"), F.xxhash64(doc_id).alias("_h")).withColumn("_r", F.row_number().over(w))
           .filter(F.col("_r") <= TRAIN_PER_LANGUAGE).groupBy("_lang").agg(F.max("_h").alias("_most")).collect())
    most = {r["_lang"]: r["_most"] for r in ids}
    names = sorted(most)
    if not names:
        return None
    pick = F.lit(False)
    for name, h in most.items():
        pick = pick | ((F.col(lang) == name) & (F.xxhash64(doc_id) <= h))
    sample = _counts(rows.filter(pick).select(F.col(lang).alias("lang"), F.col(text).alias("text"))).limit(len(names) * TRAIN_PER_LANGUAGE).collect()
    x = np.zeros((len(sample), BUCKETS), np.float32)
    for i, r in enumerate(sample):
        x[i, np.frombuffer(r.buckets, np.int32)] = np.frombuffer(r.counts, np.int32)
    y = np.array([names.index(r.lang) for r in sample])
    return train(normal_rows(x), y, names) if len(names) > 1 else Model(names, codewords(1), None, None, None)


def _counts(rows: DataFrame) -> DataFrame:
    """Sparse n-gram counts of the sample's texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").lower().encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            at, n = [], []
            for _, _, counts in count_blocks(texts, BUCKETS):
                for row in counts:
                    own = np.flatnonzero(row)
                    at.append(own.astype(np.int32).tobytes())
                    n.append(row[own].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "buckets", "counts"])

    return map_batches(rows, run, "lang string, buckets binary, counts binary")


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every document."""
    bc = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, unsure = predict(bc.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())],
                                             names=["doc_id", "lang_pred", "score", "ambiguous"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run,
                       "doc_id long, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose language can't be told; all columns stay.

    That are the rows without a letter: of the others the decoder names the nearest codeword,
    and ambiguous ones stay, as they are clean documents. Without a model, rows with a letter stay too.
    """
    bc = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            if bc.value is None:
                keep = [bool(t and _LETTER.search(t)) for t in texts]
            else:
                keep = [x != UNKNOWN for x in predict(bc.value, texts)[0]]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
