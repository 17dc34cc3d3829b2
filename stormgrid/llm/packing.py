"""Order-preserving packing of documents into sequences by dynamic programming.

The documents of one input split are one stream of ids in their stored order, each
closed by an end id. A cut may fall at a document's end, after a sentence, or, where neither
comes for ``STRIDE`` ids, at one of evenly spaced positions. With positions p and costs
D, the best way to end a sequence at p is

    D(p) = penalty(p) + cost of a sequence + min over q in [p - length, p) of D(q) + padding(p - q)

where padding is length - (p - q), but 0 when p - q is a power of two. The first kind
of padding makes the minimum a sliding one of D(q) + q, which a monotone queue gives in
constant time; the powers of two are a few single transitions more.

A split is worked through in stretches of whole documents (``STRETCH_TOKENS``), so that
memory stays bounded; a document of any length is packed whole. Nothing is shuffled.

Defined results: a null or empty text is one end id; a null ``doc_id`` stays null;
repeated rows are packed once each; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of
from .token_ids import encoder, vocabulary_path

SEQUENCE = 1024
#: Penalties in tokens of padding: a cut after a sentence, a cut elsewhere, each sequence.
SENTENCE_CUT, OTHER_CUT, EACH_SEQUENCE = 8, 64, 4
#: Tokens solved at a time.
STRETCH_TOKENS = 1 << 19
#: Without a document's or sentence's end for so many ids, cuts elsewhere are allowed, so far apart.
STRIDE = 32
#: Full-width marks that end a sentence, and what may close it.
WIDE_MARKS, WIDE_CLOSERS = "。！？｡", "」』）”’"
_WIDE_MARK = re.compile(f"[{WIDE_MARKS}]")
_WIDE_END = re.compile(f"[{WIDE_MARKS}][{WIDE_CLOSERS}]*")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sentence_ends(path: str) -> np.ndarray:
    """For each id, whether its text ends a sentence or a line."""
    tok = encoder(path).tok
    ends = np.zeros(tok.get_vocab_size(), bool)
    for i in range(len(ends)):
        t = tok.id_to_token(i) or ""
        ends[i] = t.rstrip("\"')]").endswith((".", "!", "?")) or t.endswith("Ċ")  # U+010A is a newline's letter
    return ends


def byte_widths(path: str) -> np.ndarray:
    """Bytes of text behind each id: a letter of the byte-level vocabulary each, UTF-8 for added tokens."""
    tok = encoder(path).tok
    out = np.array([len(tok.id_to_token(i) or "") for i in range(tok.get_vocab_size())], np.int64)
    for i, t in tok.get_added_tokens_decoder().items():
        out[i] = len(t.content.encode())
    return out


def wide_ends(text: str, ids: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Positions after ids whose bytes end with a full-width sentence end (one mark may be several ids)."""
    if not len(ids) or not _WIDE_MARK.search(text):
        return np.zeros(0, np.int64)
    at = np.cumsum(widths[ids])
    ends = [m.end() for m in _WIDE_END.finditer(text)]
    sizes = [len(text[lo:hi].encode("utf-8", "surrogatepass")) for lo, hi in zip([0, *ends], ends)]
    marks = np.cumsum(sizes)
    i = np.minimum(np.searchsorted(at, marks), len(at) - 1)
    return i[at[i] == marks] + 1


def cut_points(n: int, doc_ends: np.ndarray, sentence: np.ndarray, length: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cut positions (ascending, from 0 to n) and their penalties.

    ``doc_ends``: positions after each document; ``sentence``: positions after sentences.
    """
    stride = max(1, min(STRIDE, length // 4))
    price = np.full(n + 1, -1, np.int64)  # by position; -1: no cut
    price[sentence] = SENTENCE_CUT
    price[doc_ends] = 0
    price[[0, n]] = 0
    known = np.flatnonzero(price >= 0)
    between = (np.diff(known) - 1) // stride
    nth = np.arange(between.sum()) - np.repeat(np.cumsum(between) - between, between)
    price[np.repeat(known[:-1], between) + (nth + 1) * stride] = OTHER_CUT
    pos = np.flatnonzero(price >= 0)
    return pos, price[pos]


def best_cuts(pos: np.ndarray, cost: np.ndarray, length: int = SEQUENCE) -> list[int]:
    """Cut positions (first 0, last the end) of least total cost."""
    jumps: dict[int, list[int]] = {}
    index = np.full(int(pos[-1]) + 1, -1, np.int64)  # of a position among the cuts
    index[pos] = np.arange(len(pos))
    size = 1
    while size <= length:
        start = int(np.searchsorted(pos, size))
        at = index[pos[start:] - size]
        hit = np.flatnonzero(at >= 0)
        for j, i in zip((hit + start).tolist(), at[hit].tolist()):
            jumps.setdefault(j, []).append(i)
        size *= 2
    p, c = pos.tolist(), cost.tolist()
    total, back = [0] * len(p), [0] * len(p)
    values, indexes, head = [], [], 0  # queue from head on: D(q) + q, ascending, and index of q
    for j in range(1, len(p)):
        here = p[j]
        value = total[j - 1] + p[j - 1]
        while len(values) > head and values[-1] >= value:
            values.pop()
            indexes.pop()
        values.append(value)
        indexes.append(j - 1)
        while p[indexes[head]] < here - length:
            head += 1
        best, i = values[head] + length - here, indexes[head]
        for q in jumps.get(j, ()):
            if total[q] < best:
                best, i = total[q], q
        total[j], back[j] = best + c[j] + EACH_SEQUENCE, i
    out, j = [p[-1]], len(p) - 1
    while j > 0:
        j = back[j]
        out.append(p[j])
    return out[::-1]


def pack_stretch(ids: list[np.ndarray], ends: np.ndarray, length: int = SEQUENCE,
                 more: dict[int, np.ndarray] | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document's index, start, length, sequence, offset) of consecutive documents.

    ``more``: by document's index, positions after sentences that ``ends`` doesn't show.
    """
    sizes = [len(x) for x in ids]
    doc_ends = np.cumsum(sizes)
    n = int(doc_ends[-1])
    stream = np.concatenate(ids)
    sentence = np.flatnonzero(ends[stream]) + 1
    if more:
        sentence = np.unique(np.concatenate([sentence, *(doc_ends[d] - sizes[d] + x for d, x in more.items())]))
    cuts = best_cuts(*cut_points(n, doc_ends, sentence, length), length)
    starts = (doc_ends - sizes).tolist()
    for s, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        d, at = bisect_right(starts, lo) - 1, lo
        while at < hi:
            end = min(hi, starts[d] + sizes[d])
            yield d, at - starts[d], end - at, s, at - lo
            at, d = end, d + 1


def pack(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text",
         length: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """One row per piece of a document: where it starts, its length, sequence and offset there.

    A sequence's number holds the number of its input split in the upper bits.
    """
    vocabulary = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ends, widths = encoder(vocabulary), sentence_ends(vocabulary), byte_widths(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        keys: list = []
        held: list[np.ndarray] = []
        more: dict[int, np.ndarray] = {}
        size = 0

        def solve() -> pa.RecordBatch:
            nonlocal sequence
            rows = list(pack_stretch(held, ends, length, more))
            crc = [zlib.crc32(held[d][at:at + n].tobytes()) for d, at, n, _, _ in rows]
            out = [[keys[r[0]] for r in rows], [r[1] for r in rows], [r[2] for r in rows], crc,
                   [len(held[r[0]]) for r in rows], [sequence + r[3] for r in rows], [r[4] for r in rows]]
            sequence += rows[-1][3] + 1
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            texts = texts_of(b.column(1))
            for k, t, e in zip(b.column(0).to_pylist(), texts, enc.encode_batch(texts)):
                x = np.frombuffer(e + end, "<u4")
                if held and size + len(x) > STRETCH_TOKENS:
                    yield solve()
                    keys, held, more, size = [], [], {}, 0
                if not t.isascii() and len(at := wide_ends(t, x[:-1], widths)):
                    more[len(held)] = at
                keys.append(k)
                held.append(x)
                size += len(x)
        if held:
            yield solve()

    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, SCHEMA)
