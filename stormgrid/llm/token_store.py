"""Token ids in compressed shards with one trained dictionary, and their reader.

Documents are encoded and compressed one by one where they are read; only the
compressed frames are shuffled, by ranges of ``doc_id``. Each range becomes rows of a
Parquet table, one row per shard:

    range, part    place of the shard; ranges and parts ascend with doc_id
    first          ids of the range's earlier parts
    doc_ids, n_tokens, offsets   arrays of the shard's documents (int64 bytes each);
                   offsets has one entry more: frame i is data[offsets[i]:offsets[i+1]]
    data           the zstandard frames, one after another
    dictionary     SHA-256 of the dictionary that the frames need

A second small table holds the dictionary itself. A document is read by its shard's
offset index without touching other frames.

Defined results: a null or empty text is the end id alone; rows with a null ``doc_id``
come first; texts of one id follow each other by length, then by their frames; repeated rows are stored once each; an empty table gives empty files; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import map_batches, partitions, texts_of
from .token_ids import encoder, vocabulary_path

#: Documents that the dictionary is trained on (those of the smallest id hashes), the bytes
#: of one sample and the samples of one document, spread over all of it, and the dictionary's own bytes.
TRAIN_DOCS, SAMPLE_BYTES, SAMPLES, DICTIONARY_BYTES = 1000, 1 << 12, 4, 64 << 10
SHARD_BYTES = 4 << 20
LEVEL = 3


def train_dictionary(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> bytes:
    """Dictionary trained on a bounded sample of documents from all over the table."""
    chosen = (docs.select(F.xxhash64(F.col(doc_id)).alias("_h")).orderBy("_h").limit(TRAIN_DOCS)
              .agg(F.max("_h").alias("_h")).first()["_h"])
    if chosen is None:
        return b""
    rows = docs.filter(F.xxhash64(F.col(doc_id)) <= chosen).select(F.col(text).alias("text")).limit(TRAIN_DOCS).collect()
    parts = encoder(vocabulary).encode_batch([r.text or "" for r in rows])
    parts = sorted(x for p in parts for x in samples(p))
    if len(parts) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
        except zstandard.ZstdError:  # too little material
            pass
    return b"".join(parts)[-DICTIONARY_BYTES:]  # the samples themselves, as a dictionary of raw content


def samples(data: bytes) -> list[bytes]:
    """Stretches of whole ids, evenly spaced over all of ``data`` (all of it if it is short)."""
    if len(data) <= SAMPLE_BYTES * SAMPLES:
        return [data[i:i + SAMPLE_BYTES] for i in range(0, len(data), SAMPLE_BYTES)]
    last = (len(data) - SAMPLE_BYTES) // 4
    starts = [4 * (last * k // (SAMPLES - 1)) for k in range(SAMPLES)]
    return [data[i:i + SAMPLE_BYTES] for i in starts]


def _bounds(docs: DataFrame, doc_id: str, n: int) -> list[int]:
    """Approximate quantiles of the ids, ascending and distinct."""
    if n < 2:
        return []
    q = docs.select(F.col(doc_id).cast("double").alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 0.2 / n)
    return sorted({int(x) for x in q})


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text",
                end_id: int = 2) -> None:
    """Encode, compress and write all documents below ``path`` (tables ``shards`` and ``dictionary``)."""
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    dictionary = train_dictionary(docs, vocabulary, doc_id, text)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, dictionary)], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    n = partitions(spark)
    bounds = _bounds(docs, doc_id, n)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        z = _compressor(dictionary)
        for b in batches:
            raw = [e + end for e in enc.encode_batch(texts_of(b.column(1)))]
            frames = [z.compress(r) for r in raw]
            place = [0 if i is None else bisect_right(bounds, i) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), b.column(0), pa.array([len(r) // 4 for r in raw], pa.int64()),
                                              pa.array(frames, pa.binary())], names=["range", "_id", "n", "frame"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, first, size = None, 0, 0, 0
        ids: list = []
        ns: list[int] = []
        frames: list[bytes] = []

        def row() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, frames)])
            known = [i for i in ids if i is not None]
            cols = [pa.array([at], pa.int32()), pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([sum(ns)], pa.int64()),
                    pa.array([min(known, default=None)], pa.int64()), pa.array([max(known, default=None)], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())), pa.array([np.asarray(ns, "<i8").tobytes()], pa.binary()),
                    pa.array([offsets.astype("<i8").tobytes()], pa.binary()), pa.array([b"".join(frames)], pa.binary()), pa.array([digest])]
            return pa.RecordBatch.from_arrays(cols, names=SHARD_COLUMNS)

        for b in batches:
            for r, i, k, f in zip(*(b.column(c).to_pylist() for c in range(4))):
                if frames and (r != at or size + len(f) > SHARD_BYTES):
                    yield row()
                    part, first, size = part + 1, first + sum(ns), 0
                    ids, ns, frames = [], [], []
                if r != at:
                    at, part, first = r, 0, 0
                ids.append(i)
                ns.append(k)
                frames.append(f)
                size += len(f)
        if frames:
            yield row()

    packed = map_batches(docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text")), compress,
                         "range int, _id long, n long, frame binary")
    dealt = packed.repartitionById(n, F.col("range")).sortWithinPartitions("range", "_id", "n", "frame")
    map_batches(dealt, shards, SHARD_SCHEMA).write.parquet(f"{path}/shards")


SHARD_SCHEMA = ("range int, part int, first long, tokens long, min_id long, max_id long, doc_ids array<long>, n_tokens binary, "
                "offsets binary, data binary, dictionary string")
SHARD_COLUMNS = [c.split()[0] for c in SHARD_SCHEMA.split(", ")]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=d)


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    r = spark.read.schema("sha256 string, dictionary binary").parquet(f"{path}/dictionary").first()
    if hashlib.sha256(r.dictionary).hexdigest() != r.sha256:
        raise ValueError("the stored dictionary doesn't match its hash")
    return r.sha256, bytes(r.dictionary)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of one document (one list per stored row), read through the offset index."""
    digest, dictionary = _dictionary(spark, path)
    z = _decompressor(dictionary)
    out = []
    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards").filter((F.col("min_id") <= doc_id) & (F.col("max_id") >= doc_id))
    for r in shards.collect():  # the shards that hold this document, SHARD_BYTES each
        if r.dictionary != digest:
            raise ValueError("a shard needs another dictionary")
        at = np.frombuffer(r.offsets, "<i8")
        out += [np.frombuffer(z.decompress(r.data[at[i]:at[i + 1]]), "<u4").tolist() for i, d in enumerate(r.doc_ids) if d == doc_id]
    return out


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored document, from the files."""
    digest, dictionary = _dictionary(spark, path)
    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards")
    # one row per range, as many as shuffle partitions at most
    totals = {r["range"]: r.n for r in shards.groupBy("range").agg(F.sum("tokens").alias("n")).collect()}
    base, before = {}, 0
    for k in sorted(totals):
        base[k], before = before, before + totals[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = _decompressor(dictionary)
        for b in batches:
            for r in range(b.num_rows):
                k, first, ids, ns, offsets, data, need = (b.column(c)[r].as_py() for c in range(7))
                if need != digest:
                    raise ValueError("a shard needs another dictionary")
                at, ns = np.frombuffer(offsets, "<i8"), np.frombuffer(ns, "<i8")
                raw = [z.decompress(data[at[i]:at[i + 1]]) for i in range(len(ns))]
                if any(len(x) != 4 * n for x, n in zip(raw, ns)):
                    raise ValueError("a frame's length doesn't match the index")
                start = base[k] + first + np.cumsum(ns) - ns
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start, pa.int64()), pa.array(ns, pa.int64()),
                                                  pa.array([zlib.crc32(x) for x in raw], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    cols = ["range", "first", "doc_ids", "n_tokens", "offsets", "data", "dictionary"]
    return map_batches(shards.select(*cols), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fresh_path(spark: SparkSession) -> str:
    return scratch_path(spark, f"llm-tokens-{uuid.uuid4().hex[:12]}")
