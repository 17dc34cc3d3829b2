"""Removal of repeated word sequences by recompression.

A window of ``WINDOW`` consecutive words is repeated if its words also start earlier (in a
document of a smaller id, or further up in the same one); every word that a repeated window
covers is removed. Windows are judged on the input.

Recompression rewrites all word sequences in rounds. A round first names each maximal run of
one symbol by symbol and length, then deals the symbols to a left and a right half and names
each pair of a left symbol and a right one after it. Names are fingerprints of what they
stand for, so one name means the same words in every task, and all tasks name alike without
an exchange. Whether a symbol arises depends on a few words around it, its support, which is
kept with it; hence equal word sequences have equal symbols wherever the supports lie inside.

A window's mark (:mod:`repeats`) is the highest-level symbol of the smallest fingerprint
whose support lies in the window (and is at most ``SUPPORT`` words long), or, where runs
leave none, a word of the smallest fingerprint. Short symbols recur by chance, so a mark is
known by its symbol and the ``SUPPORT`` words from where its support starts, which lie in the
window too. Marks that occur again reveal where repeats are; the windows around them are then
named by 96 bits of all their words and compared, which settles each window. All windows of
one mark go to its bucket, those of a hot mark to the buckets of their own names.

Defined results: words are separated by ASCII white space; a null text has no words; a null
id is smaller than all others; rows that repeat a ``doc_id`` count as one document; repeated
rows share their result; documents of fewer than ``WINDOW`` words stay whole; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .repeats import batches_of, bucket_of, from_steps, in_steps, repeated, spans
from .suffix_dedup import _mixed, _smallest

WINDOW, ROUNDS, SUPPORT = 20, 2, 12
#: Words whose fingerprints a worker remembers.
MEMO_WORDS = 500_000

_U = np.uint64
_C1, _C2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_RUN, _PAIR, _SIDE, _WORD = _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3), _U(0x589965CC75374CC3)
_NONE = _U((1 << 64) - 1)
_LOW = _U((1 << 24) - 1)


class _Fingerprints(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Fingerprints()


def fingerprints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of the texts, and the number of words of each."""
    if len(_WORDS) > MEMO_WORDS:
        _WORDS.clear()
    words = [t.split() for t in texts]  # bytes split at ASCII white space
    sizes = np.array([len(w) for w in words], np.int64)
    get = _WORDS.__getitem__
    return np.fromiter((h for w in words for h in map(get, w)), np.uint64, int(sizes.sum())), sizes


def compress(ids: np.ndarray, sizes: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after the rounds, and the first and last-but-one word of each one's support.

    A support that would reach over a document's edge ends outside of the document.
    """
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    floor, ceiling = (ends - sizes - 1)[doc], (ends + 1)[doc]
    sym, lo, hi = ids, np.arange(len(ids)), np.arange(1, len(ids) + 1)
    for r in range(rounds):
        if not len(sym):
            break
        same = doc[1:] == doc[:-1]
        head = np.flatnonzero(np.r_[True, ~((sym[1:] == sym[:-1]) & same)])
        count = np.diff(np.r_[head, len(sym)])
        sym, doc, lo, hi, floor, ceiling = _merged_runs(sym, doc, lo, hi, floor, ceiling, head, count, r)
        same = doc[1:] == doc[:-1]
        left = (_mixed(sym + _U(int(_SIDE) * (r + 1) % (1 << 64))) >> _U(63)).astype(bool)
        pair = np.r_[left[:-1] & ~left[1:] & same, False]
        keep = np.flatnonzero(np.r_[True, ~pair[:-1]])
        two = pair[keep]
        after, before = np.minimum(keep + 1, len(sym) - 1), np.maximum(keep - 1, 0)
        has_after, has_before = doc[after] == doc[keep], doc[before] == doc[keep]
        has_after &= after > keep
        has_before &= before < keep
        named = np.where(two, _mixed(sym[keep] * _C1 + sym[after] * _C2 + _PAIR + _U(r)), sym[keep])
        # a single left symbol depends on the next one, a single right symbol on the one before
        new_lo = np.where(left[keep], lo[keep], np.where(has_before, lo[before], floor[keep]))
        new_hi = np.where(left[keep], np.where(has_after, hi[after], ceiling[keep]), hi[keep])
        sym, doc, lo, hi, floor, ceiling = named, doc[keep], new_lo, new_hi, floor[keep], ceiling[keep]
    return sym, lo, hi


def _merged_runs(sym, doc, lo, hi, floor, ceiling, head, count, r):
    """Name runs; that a run (or a single symbol) ends depends on its neighbours."""
    n = len(sym)
    before, after = np.maximum(head - 1, 0), np.minimum(head + count, n - 1)
    has_before = (head > 0) & (doc[before] == doc[head])
    has_after = (head + count < n) & (doc[after] == doc[head])
    named = np.where(count > 1, _mixed(sym[head] * _C2 + count.astype(np.uint64) * _RUN + _U(r)), sym[head])
    return (named, doc[head], np.where(has_before, lo[before], floor[head]), np.where(has_after, hi[after], ceiling[head]),
            floor[head], ceiling[head])


def window_marks(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows that lie in one document: first word, mark's place, mark's name."""
    n, none = len(ids), np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, np.zeros(0, np.uint64)
    sym, lo, hi = compress(ids, sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    small = (hi - lo <= SUPPORT) & (lo >= 0) & (hi <= n)
    small[small] &= doc[lo[small]] == doc[np.minimum(hi[small], n) - 1]
    value, at = _mixed(sym[small] ^ _PAIR), lo[small]
    name = np.full(n, _NONE)
    order = np.argsort(value)[::-1]
    name[at[order]] = value[order]  # the smallest of symbols whose supports start together is written last
    here = np.arange(n, dtype=np.uint64) & _LOW
    high = _smallest(np.where(name == _NONE, _NONE, (name & ~_LOW) | here), WINDOW - SUPPORT + 1)
    first = np.flatnonzero(doc[:n - WINDOW + 1] == doc[WINDOW - 1:])
    high = high[first]
    place = (high & _LOW).astype(np.int64) + (first & ~int(_LOW))
    place += np.where(place < first, 1 << 24, 0)
    found = high != _NONE
    names = name[np.where(found, place, 0)]
    if not found.all():
        words = _mixed(ids + _WORD)
        low = _smallest((words & ~_LOW) | here, WINDOW - SUPPORT + 1)[first]
        at = (low & _LOW).astype(np.int64) + (first & ~int(_LOW))
        at += np.where(at < first, 1 << 24, 0)
        place = np.where(found, place, at)
        names = np.where(found, names, words[np.where(found, 0, at)] ^ _C1)
    return first, place, _mixed(names ^ sequence_names(ids, SUPPORT, _C1)[place])


def _runs(place: np.ndarray, names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive windows with the same mark: first and last index."""
    cut = np.flatnonzero((np.diff(place) != 0) | (names[1:] != names[:-1]) | (np.diff(first) != 1)) + 1
    return np.r_[0, cut], np.r_[cut, len(first)] - 1


def marks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ids, sizes = fingerprints(texts)
    first, place, names = window_marks(ids, sizes)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lo, _ = _runs(place, names, first)
    return names[lo], np.repeat(np.arange(len(sizes)), sizes)[first[lo]]


def sequence_names(ids: np.ndarray, length: int, factor: np.uint64) -> np.ndarray:
    """A fingerprint of each ``length`` words in a row."""
    n = len(ids) - length + 1
    block, size, out, done = _mixed(ids * factor + _RUN), 1, np.zeros(n, np.uint64), 0
    while size <= length:
        power = _U(pow(int(factor), size, 1 << 64))
        if length & size:
            out = out * power + block[done:done + n]
            done += size
        block, size = block[:-size] * power + block[size:], size * 2
    return _mixed(out)


def details(keys: np.ndarray, orders: np.ndarray, texts: list[bytes], is_shared, is_hot, n: int) -> list:
    """Windows at shared marks; of equal ones only the first travels."""
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    done = 0
    for own_keys, part in batches_of(keys.tolist(), texts):
        ids, sizes = fingerprints(part)
        first, place, names = window_marks(ids, sizes)
        if len(first):
            doc = np.repeat(np.arange(len(sizes)), sizes)[first]
            lo, hi = _runs(place, names, first)
            shared = is_shared(own_keys[doc[lo]], names[lo])
            own = np.repeat(shared, hi - lo + 1)
            first, doc, names = first[own], doc[own], names[own]
            a, b = sequence_names(ids, WINDOW, _C1)[first], sequence_names(ids, WINDOW, _C2)[first].astype(np.uint32)
            begin = np.cumsum(sizes) - sizes
            dest = bucket_of(np.where(is_hot(names), a, names), n)
            for c, v in zip(cols, (a, b, own_keys[doc], orders[done + doc], first - begin[doc], dest)):
                c.append(v)
        done += len(part)
    if not cols[0]:
        return []
    (a, b, key, order, at, dest), later = _by_window(*(np.concatenate(c) for c in cols))
    sent = ~later
    return spans(key[later], at[later], 1, n) + in_steps(dest[sent], 0, *(c[sent] for c in (a, b, key, order, at)))


def _by_window(a, b, key, order, at, *more):
    """The columns sorted by window name, document and place; and which rows come after the first (and what ties with it)."""
    by = np.lexsort((at, order, b, a))
    a, b, key, order, at, *more = (c[by] for c in (a, b, key, order, at, *more))
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    start = np.flatnonzero(new)[np.cumsum(new) - 1] if len(a) else np.zeros(0, np.int64)
    return (a, b, key, order, at, *more), (order > order[start]) | (at > at[start])


def solve(parts: list[bytes], n: int) -> list:
    """All windows of a bucket but the first of each name."""
    (_, _, key, _, at), later = _by_window(*from_steps(parts))
    return spans(key[later], at[later], 0, n)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (remaining words, joined by spaces) of every document."""
    def finish(ids: list, texts: list[bytes], found: list) -> list[pa.Array]:
        n_words, n_removed, kept = [], [], []
        for t, (lo, hi) in zip(texts, found):
            words = t.split()
            gone = 0
            if len(lo):
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, lo, 1)
                np.add.at(edge, hi + WINDOW, -1)
                stay = (np.cumsum(edge[:-1]) == 0).tolist()
                left = [w for w, s in zip(words, stay) if s]
                gone = len(words) - len(left)
            else:
                left = words
            n_words.append(len(words))
            n_removed.append(gone)
            kept.append(b" ".join(left))
        return [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())]

    return repeated(docs, doc_id, text, marks, details, solve, finish,
                    "doc_id long, n_words long, n_removed long, kept binary")
