"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q, at least ``max(LEAST_WORDS,
EXPONENT * q)`` words long, that no neighbouring word extends. For each power of two m, the
dictionary names the factors of m words that occur more than once in a document: a factor
of 2m words by the names of its halves. Where a factor and its next occurrence lie within
2m words, their distance is proposed as a period. In a stretch with that period, the factors
of one name form an arithmetic progression, and those at consecutive positions propose the
same distance d. Such positions i..j extend the proposal to the words i..j+m+d-1, which no
word extends any more, as the factors before and after break the progression. d is the
smallest period there: a primitive word of at most m words does not occur inside its square.
A run of period q and four periods is proposed by the least power of two of at least q
words, and again by larger ones, so proposals are deduplicated.

Texts are worked on one by one (a row's text is in memory anyway), short ones together in
numpy arrays of ``CHUNK_WORDS`` words; nothing is shuffled, a lost executor's splits are
computed again.

Defined results: a null or empty text has no words and no run; a null id leaves its text
unchanged by :func:`planted`; very long texts take memory in proportion to their words; of
runs with equal exponents the one that starts first, then the one of the smaller period is
the strongest; repeated rows get equal results; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks_by_size, map_batches

LEAST_WORDS, EXPONENT = 6, 4
#: Words that numpy works on at a time (a longer text alone).
CHUNK_WORDS = 1 << 18

Run = tuple[int, int, int]


def word_numbers(texts: list[list[bytes]]) -> np.ndarray:
    """The words of all texts as numbers, equal for equal words."""
    words = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def find_runs(numbers: np.ndarray, sizes: list[int]) -> list[list[Run]]:
    """The runs (start, length, period) of each text, by start, then period.

    ``numbers`` holds the words of all texts one after another, ``sizes`` their counts.
    """
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    found = []
    at = np.arange(len(numbers))  # positions whose factor is named, ascending
    name = np.full(len(numbers), -1, np.int64)  # of the factor of m words at a position, -1: occurs once
    key = doc * (len(numbers) + 1) + numbers
    m = 1
    while len(at):
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], np.diff(key[order]) != 0])
        number = np.cumsum(new) - 1
        name[:] = -1
        again = (np.bincount(number) > 1)[number]
        name[at[order[again]]] = number[again]
        here, after = at[order[:-1]][~new[1:]], at[order[1:]][~new[1:]]
        near = after - here <= m
        found.append(_stretches(here[near], after[near] - here[near], doc, m))
        at = np.flatnonzero(name >= 0)
        at = at[at + 2 * m <= ends[doc[at]]]
        at = at[name[at + m] >= 0]
        key = name[at] * (len(numbers) + 1) + name[at + m]  # a name belongs to one text
        m *= 2
    runs = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *found]), axis=0)
    runs = runs[runs[:, 1] >= np.maximum(LEAST_WORDS, EXPONENT * runs[:, 2])]
    out: list[list[Run]] = [[] for _ in sizes]
    first = ends - sizes
    for start, length, period in runs.tolist():
        d = int(doc[start])
        out[d].append((start - int(first[d]), length, period))
    return out


def _stretches(here: np.ndarray, distance: np.ndarray, doc: np.ndarray, m: int) -> np.ndarray:
    """(start, length, period) of the stretches in which consecutive positions propose one distance."""
    if not len(here):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((here, distance))
    here, distance = here[order], distance[order]
    first = np.concatenate([[True], (np.diff(here) != 1) | (np.diff(distance) != 0) | (np.diff(doc[here]) != 0)])
    start, period = here[first], distance[first]
    last = here[np.concatenate([first[1:], [True]])]
    return np.stack([start, last - start + m + period, period], axis=1)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, for a tenth of the ids with a period from some word on (the contract's rule)."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest length / period; of equals the first, then of the smallest period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that lie in the first period of each run they belong to, or in none, joined by spaces."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([w for w, g in zip(words, np.cumsum(gone).tolist()) if not g])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """doc_id, runs (arrays of start, length and period) and collapsed (bytes) of every document.

    ``plant`` first gives some documents a period (see :func:`planted`).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            words = [(t or b"").split() for t in b.column(1).to_pylist()]  # bytes: splits at ASCII white space only
            if plant:
                words = [planted(i, w) for i, w in zip(ids, words)]
            for lo, hi in chunks_by_size([len(w) for w in words], CHUNK_WORDS):
                part = words[lo:hi]
                runs = find_runs(word_numbers(part), [len(w) for w in part])
                cols = [pa.array([[r[c] for r in x] for x in runs], pa.list_(pa.int64())) for c in range(3)]
                left = pa.array([collapse(w, x) for w, x in zip(part, runs)], pa.binary())
                best = [strongest(x) or (None, None, None) for x in runs]
                cols += [pa.array([x[c] for x in best], pa.int64()) for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), *cols, left],
                                                 names=["doc_id", "starts", "lengths", "periods", "start", "length", "period", "collapsed"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return map_batches(rows, run, "doc_id long, starts array<long>, lengths array<long>, periods array<long>,"
                                  " start long, length long, period long, collapsed binary")


def run_digests(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests of :func:`periodic_runs`."""
    lines = F.expr("concat_ws('', transform(arrays_zip(starts, lengths, periods),"
                   " r -> concat(r.starts, ',', r.lengths, ',', r.periods, '\\n')))")
    return found.select("doc_id", F.size("starts").cast("long").alias("n_runs"), "start", "length", "period",
                        F.expr("(1000 * length) div period").alias("exponent_milli"),
                        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
