"""Byte-level BPE: encode with a lexicon of frequent words and exact merges, and decode.

The frequent words of the whole corpus are counted by Spark, encoded once on the driver
and compiled into a minimal acyclic transducer (:mod:`lexicon`), which every worker maps
into memory. A word that the automaton doesn't accept is merged pair by pair in rank
order, which gives the same ids as the ``tokenizers`` library.

Defined results: a null text is the empty text (no ids, decoded to the empty text); a
special token's own string becomes its id, as in the library; repeated rows give repeated
rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of
from .lexicon import Lexicon, build
from .token_ids import PieceMemo, pieces, vocabulary_path

#: Words in the lexicon (the most frequent ones of the corpus).
LEXICON_WORDS = 50_000
#: The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that stand for themselves in the vocabulary file (first, last).
PLAIN_BYTES = ((33, 126), (161, 172), (174, 255))


def byte_letters() -> list[str]:
    """The letter of each byte in the vocabulary file; bytes that aren't plain take the
    letters from U+0100 on, in order."""
    spare = iter(range(256, 512))
    return [chr(b if any(lo <= b <= hi for lo, hi in PLAIN_BYTES) else next(spare)) for b in range(256)]


class Merger:
    """Vocabulary and merge ranks of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(self.letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = [vocab[c] for c in self.letters]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.result = [vocab[a + b] for a, b in merges]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of.update((i, t.encode()) for t, i in self.special.items())
        self.cut = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the leftmost pair of the lowest rank is merged until none is left."""
        ids = [self.first[b] for b in word]
        if len(ids) > 200:
            return self._merge_long(ids)
        get, result, none = self.rank.get, self.result, len(self.result)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            r = min(ranks)
            if r == none:
                break
            i = ranks.index(r)
            ids[i] = result[r]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for a very long pre-token, with a heap over linked neighbours."""
        import heapq

        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.rank.get
        heap = [(r, i) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = self.result[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [i for i in ids if i >= 0]

    def decode(self, ids) -> str:
        """Text of ids; byte sequences that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _joined(a: tuple[int, str, bytes], b: tuple[int, str, bytes]) -> tuple[int, str, bytes]:
    return a[0] + b[0], f"{a[1]},{b[1]}", a[2] + b[2]


class LexiconEncoder:
    """Whole texts to ids through the lexicon; remembered by piece of text.

    A piece's result is (number of ids, ids joined by commas, its decoded bytes).
    """

    def __init__(self, merger: Merger, lexicon: Lexicon):
        self.merger, self.lexicon = merger, lexicon
        self.memo = PieceMemo(lambda parts: map(self.result, parts), _joined)

    def _words(self, text: str) -> list[int]:
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            words = [text]  # one pre-token: letters after a space at most
        else:
            words = self.merger.cut(text)
        ids: list[int] = []
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            got = self.lexicon.get(b)
            ids += self.merger.merge(b) if got is None else got
        return ids

    def piece(self, text: str) -> list[int]:
        special = self.merger.special
        if not text or not special or not any(s in text for s in special):
            return self._words(text)
        ids: list[int] = []
        for part in self.merger.split(text):
            if part in special:
                ids.append(special[part])
            else:
                ids += self._words(part)
        return ids

    def result(self, text: str) -> tuple[int, str, bytes]:
        ids = self.piece(text) if text else []
        bytes_of = self.merger.bytes_of
        return len(ids), ",".join(map(str, ids)), b"".join([bytes_of[i] for i in ids])

    def encode_batch(self, texts: list[str]) -> list[list[tuple[int, str, bytes]]]:
        """The results of each text's pieces, in order."""
        cut = [pieces(t) for t in texts]
        get = self.memo.cover(cut).__getitem__
        return [list(map(get, c)) for c in cut]


def frequent_words(docs: DataFrame, text: str = "text", n: int = LEXICON_WORDS) -> list[bytes]:
    """The ``n`` most frequent words over all documents: a space and letters, as the
    pre-tokenizer cuts them. Counted by Spark; only the ``n`` words reach the driver."""
    words = docs.select(F.explode(F.split(F.col(text), " ")).alias("w"))
    top = (words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("w").rlike(r"^\p{L}{1,40}$"))
           .orderBy(F.desc("n"), "w").limit(n))
    return [f" {r.w}".encode() for r in top.collect()]


def compile_lexicon(docs: DataFrame, vocabulary: str, text: str = "text", n: int = LEXICON_WORDS) -> str:
    """Build the lexicon file of a corpus and add it to the job's files; its name."""
    merger = Merger(vocabulary)
    data = build({w: merger.merge(w) for w in frequent_words(docs, text, n)})
    name = f"lexicon-{uuid.uuid4().hex[:12]}.bin"
    folder = tempfile.TemporaryDirectory()
    _SERVED.append(folder)
    path = os.path.join(folder.name, name)
    with open(path, "wb") as f:
        f.write(data)
    docs.sparkSession.sparkContext.addFile(path)
    return name


#: Folders of files that the driver serves to executors until it ends.
_SERVED: list[tempfile.TemporaryDirectory] = []
_CACHE: dict[tuple[str, str], LexiconEncoder] = {}


def _encoder(vocabulary: str, lexicon: str) -> LexiconEncoder:
    key = vocabulary, lexicon
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = LexiconEncoder(Merger(vocabulary), Lexicon(SparkFiles.get(lexicon)))
    return _CACHE[key]


def encode(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text",
           lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    vocabulary = vocabulary or vocabulary_path()
    name = compile_lexicon(docs, vocabulary, text, lexicon_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary, name)
        for b in batches:
            ids = [[int(i) for p in found if p[0] for i in p[1].split(",")] for found in enc.encode_batch(texts_of(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run,
                       "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids (null ids: the empty text)."""
    vocabulary = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Merger(vocabulary)
        for b in batches:
            texts = [m.decode(x or ()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")), run, "doc_id long, text string")


def round_trip_digest(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text",
                      lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Encode every text, decode its ids, and return digests of both per document.

    The ids stay in the worker that made them: only doc_id, n_tokens, ids_sha256 and
    decoded_sha256 leave it.
    """
    vocabulary = vocabulary or vocabulary_path()
    name = compile_lexicon(docs, vocabulary, text, lexicon_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary, name)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for found in enc.encode_batch(texts_of(b.column(1))):
                n.append(sum([p[0] for p in found]))
                ids_sha.append(hashlib.sha256(",".join([p[1] for p in found if p[0]]).encode()).hexdigest())
                back = b"".join([p[2] for p in found]).decode("utf-8", "replace")
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run,
                       "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
